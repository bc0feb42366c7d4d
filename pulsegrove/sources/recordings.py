"""Binary recordings read in slices: each task opens the file at its own offset and reads no more than its samples.

A recording's header is a few hundred bytes and is read when the frame is declared; sample data are only read in tasks.
Both readers give channel, k (sample index), t (seconds from the start) and value, restricted to a time window by
reading only the blocks that it touches.
"""

from __future__ import annotations

import configparser
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples of all channels in one block.
BLOCK = 1 << 16
SCHEMA = "channel string, k long, t double, value double"


@dataclass(frozen=True)
class BrainVision:
    """What a .vhdr header says: only multiplexed 32-bit floats are read."""

    data: str
    rate: float
    channels: tuple[str, ...]
    resolutions: tuple[float, ...]

    @property
    def samples(self) -> int:
        return Path(self.data).stat().st_size // (4 * len(self.channels))

    def read(self, start: int, n: int) -> np.ndarray:
        width = len(self.channels)
        x = np.fromfile(self.data, "<f4", count=n * width, offset=start * width * 4)
        return x.reshape(-1, width).astype(float) * np.array(self.resolutions)


def brainvision_header(path: str) -> BrainVision:
    text = Path(path).read_text(encoding="utf-8-sig", errors="replace")
    body = text[text.index("[") :]
    ini = configparser.ConfigParser(strict=False, interpolation=None, comment_prefixes=(";",), allow_no_value=True)
    ini.optionxform = str
    ini.read_string(body)
    common = ini["Common Infos"]
    if common.get("DataOrientation", "MULTIPLEXED").upper() != "MULTIPLEXED" or ini["Binary Infos"]["BinaryFormat"].upper() != "IEEE_FLOAT_32":
        raise ValueError("only multiplexed IEEE_FLOAT_32 is read")
    fields = [v.split(",") for _, v in sorted(ini["Channel Infos"].items(), key=lambda kv: int(kv[0][2:]))]
    if len(fields) != int(common["NumberOfChannels"]):
        raise ValueError("the number of channels does not match their list")
    return BrainVision(str(Path(path).parent / common["DataFile"]), 1e6 / float(common["SamplingInterval"]), tuple(f[0].replace("\\1", ",") for f in fields), tuple(float(f[2]) if len(f) > 2 and f[2].strip() else 1.0 for f in fields))


@dataclass(frozen=True)
class Edf:
    """What an EDF header says; signals of the commonest rate are read, annotation signals are not."""

    data: str
    rate: float
    channels: tuple[str, ...]
    header: int
    record: int
    per_record: int
    places: tuple[int, ...]
    scale: tuple[float, ...]
    offset: tuple[float, ...]

    @property
    def samples(self) -> int:
        return (Path(self.data).stat().st_size - self.header) // (2 * self.record) * self.per_record

    def read(self, start: int, n: int) -> np.ndarray:
        first, last = start // self.per_record, -(-(start + n) // self.per_record)
        raw = np.fromfile(self.data, "<i2", count=(last - first) * self.record, offset=self.header + 2 * first * self.record)
        raw = raw[: len(raw) // self.record * self.record].reshape(-1, self.record)
        x = np.stack([raw[:, p : p + self.per_record].ravel() * s + o for p, s, o in zip(self.places, self.scale, self.offset)], axis=1)
        return x[start - first * self.per_record :][:n]


def edf_header(path: str) -> Edf:
    with open(path, "rb") as f:
        head = f.read(256).decode("latin-1")
        n = int(head[252:256])
        rest = f.read(256 * n).decode("latin-1")
    at, fields = 0, []
    for width in (16, 80, 8, 8, 8, 8, 8, 80, 8, 32):
        fields.append([rest[at + i * width : at + (i + 1) * width].strip() for i in range(n)])
        at += width * n
    labels, units = fields[0], fields[2]
    low, high, dlow, dhigh = ([float(x) for x in fields[i]] for i in (3, 4, 5, 6))
    counts = [int(x) for x in fields[8]]
    signals = [i for i in range(n) if "Annotations" not in labels[i]]
    common = max((counts[i] for i in signals), key=[counts[i] for i in signals].count)
    signals = [i for i in signals if counts[i] == common]
    micro = {"V": 1e6, "mV": 1e3, "nV": 1e-3}
    gain = [(high[i] - low[i]) / (dhigh[i] - dlow[i]) for i in signals]
    unit = [micro.get(units[i], 1.0) for i in signals]
    return Edf(
        path, common / float(head[244:252]), tuple(labels[i] for i in signals), int(head[184:192]), sum(counts), common, tuple(sum(counts[:i]) for i in signals), tuple(g * u for g, u in zip(gain, unit)),
        tuple((low[i] - g * dlow[i]) * u for i, g, u in zip(signals, gain, unit)),
    )


def samples(spark: SparkSession, recording: BrainVision | Edf, start_s: float = 0.0, stop_s: float | None = None) -> DataFrame:
    """channel, k, t, value of a recording between two times, both included."""
    last = recording.samples - 1 if stop_s is None else min(recording.samples - 1, int(np.floor(stop_s * recording.rate + 1e-9)))
    first = max(0, int(np.ceil(start_s * recording.rate - 1e-9)))
    step = max(1, BLOCK // max(1, len(recording.channels)))
    blocks = spark.range(first, max(first, last + 1), step).select(F.col("id").alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in batch.column(0).to_pylist():
                x = recording.read(start, min(step, last + 1 - start))
                k = np.arange(start, start + len(x))
                for i, name in enumerate(recording.channels):
                    values = pa.array(x[:, i], mask=~np.isfinite(x[:, i]))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(x), pa.string()), pa.array(k, pa.int64()), pa.array(k / recording.rate), values], ["channel", "k", "t", "value"])

    return blocks.mapInArrow(run, SCHEMA)
