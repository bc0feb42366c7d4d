"""Named preprocessing steps over packed signals (one array ``y`` per row), chained by name, and presets of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from pulsegrove.operators import spectral
from pulsegrove.sources.sinks import pipeline_id

STEPS: dict[str, Callable[..., DataFrame]] = {"bandpass": spectral.bandpassed, "notch": spectral.notched, "decimate": spectral.decimated, "resample": spectral.resampled}

PRESETS: dict[str, list[tuple[str, dict]]] = {
    "raw": [],
    "line": [("notch", {"line": 50.0, "width": 2.0})],
    "filtered": [("notch", {"line": 50.0, "width": 2.0}), ("bandpass", {"low": 1.0, "high": 100.0})],
    "slow": [("notch", {"line": 50.0, "width": 2.0}), ("bandpass", {"low": 0.5, "high": 40.0}), ("decimate", {"factor": 4})],
}


def register(name: str, step: Callable[..., DataFrame]) -> None:
    """Adds a step, a function of a DataFrame and its parameters."""
    STEPS[name] = step


def run(signals: DataFrame, steps: list[tuple[str, dict]] | str, rate: float) -> tuple[DataFrame, str]:
    """The signals after all steps in order, and the pipeline's id; steps that know a rate get ``rate``."""
    chain = PRESETS[steps] if isinstance(steps, str) else steps
    unknown = [name for name, _ in chain if name not in STEPS]
    if unknown:
        raise ValueError(f"no such step: {unknown}")

    def apply(df: DataFrame, step: tuple[str, dict]) -> DataFrame:
        function, parameters = STEPS[step[0]], dict(step[1])
        if "rate" in function.__code__.co_varnames[: function.__code__.co_argcount]:
            parameters.setdefault("rate", rate)
        return df.transform(function, **parameters)

    return reduce(apply, chain, signals), pipeline_id(chain)
