from __future__ import annotations

from pulsegrove.functions.units import unit_in
from pulsegrove.operators.unit_normalize import foreign_units, normalize_peaks

PEAKS = "summary_id long, raw_id long, max_peak_abs string, voltage_unit string, model_id int, unit string, scale_pv long"
RAW = "raw_id long, value_scale_to_uv double, signal_units string, unit string"
MODELS = "model_id int, voltage_unit string"


def test_alias_is_longest_and_a_word():
    assert unit_in(" millivolts") == "mV"
    assert unit_in("µV") == unit_in("μv") == unit_in("micro-V") == unit_in("mcV") == "uV"
    assert unit_in("volt") == "V" and unit_in("nv (peak)") == "nV"
    assert unit_in("counts") is None and unit_in("vague") is None and unit_in("") is None and unit_in(None) is None
    assert unit_in("x" * 100_000 + " mV") == "mV"


def test_first_field_that_names_a_unit_holds(spark):
    # columns named as the operator's own ones do not disturb it
    rows = [
        (1, 1, "2 mV", "uV", 1, "x", 0), (2, 1, "2", "V", 1, "x", 0), (3, 1, "2", "counts", 1, "x", 0), (4, 2, "3,5e+01", None, 1, "x", 0), (5, 3, "4", "", 1, "x", 0), (6, 4, "5", None, 9, "x", 0),
        (7, 1, "n/a", "mV", 1, "x", 0), (8, 1, None, "mV", 1, "x", 0), (9, None, "6", None, None, "x", 0), (10, 1, "2 mV", "uV", 1, "x", 0), (11, 2, "nan", "mV", 1, "x", 0),
        (12, 1, "1,234.5 uV", None, 1, "x", 0), (13, 1, "mV 3", None, 1, "x", 0), (14, 1, "1 234 uV", None, 1, "x", 0),
    ]
    raw = [(1, 0.25, "mV", "y"), (2, None, "V", "y"), (3, float("nan"), "a.u.", "y")]
    out = normalize_peaks(spark.createDataFrame(rows, PEAKS), spark.createDataFrame(raw, RAW), spark.createDataFrame([(1, "nV"), (2, None)], MODELS))
    got = {r.summary_id: (r.unit_pv, r.unit_from, r.peak_uv, r.status) for r in out.collect()}
    assert len(got) == len(rows)
    assert got[1] == got[10] == (10**9, "text", 2000.0, "converted")
    assert got[2] == (10**12, "field", 2e6, "converted")
    assert got[3] == (250_000, "scale", 0.5, "converted")
    assert got[4] == (10**12, "signal", 35e6, "converted")
    assert got[5] == (1000, "model", 0.004, "converted")
    assert got[6][3] == got[9][3] == "no_unit" and got[6][2] is None
    assert got[7][3] == got[8][3] == got[11][3] == got[12][3] == got[14][3] == "unreadable"
    assert got[13] == (10**9, "text", 3000.0, "converted")
    assert {r.summary_id for r in foreign_units(out).collect()} == {1, 2, 3, 4, 5, 10, 13}


def test_empty_tables(spark):
    out = normalize_peaks(spark.createDataFrame([], PEAKS), spark.createDataFrame([], RAW), spark.createDataFrame([], MODELS))
    assert out.count() == 0
