from __future__ import annotations

import numpy as np
import pytest

from pulsegrove.sources import recordings, sinks, tables


def test_brainvision_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(recordings, "BLOCK", 300)
    x = np.random.default_rng(9).normal(size=(1600, 3)).astype("<f4")
    x[7, 1] = np.nan
    x.tofile(tmp_path / "a.eeg")
    text = "Brain Vision Data Exchange Header File Version 1.0\n; comment\n[Common Infos]\nDataFile=a.eeg\nDataOrientation=MULTIPLEXED\nNumberOfChannels=3\nSamplingInterval=5000\n[Binary Infos]\nBinaryFormat=IEEE_FLOAT_32\n[Channel Infos]\nCh1=A1,,0.5,uV\nCh2=A2,,,uV\nCh3=B\\11,,2\n"
    (tmp_path / "a.vhdr").write_text(text)
    header = recordings.brainvision_header(str(tmp_path / "a.vhdr"))
    assert header.rate == 200 and header.channels == ("A1", "A2", "B,1") and header.samples == 1600
    got = {(r.channel, r.k): (r.t, r.value) for r in recordings.samples(spark, header, 0.02, 3.0).collect()}
    assert len(got) == 3 * 597 and got["A1", 4] == (0.02, x[4, 0] * 0.5) and got["B,1", 600] == (3.0, x[600, 2] * 2.0) and got["A2", 7][1] is None
    assert recordings.samples(spark, header).count() == 4800
    (tmp_path / "b.vhdr").write_text(text.replace("IEEE_FLOAT_32", "INT_16"))
    with pytest.raises(ValueError):
        recordings.brainvision_header(str(tmp_path / "b.vhdr"))


def test_edf_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(recordings, "BLOCK", 90)
    rng = np.random.default_rng(1)
    digital = rng.integers(-2000, 2000, (4, 2, 100)).astype("<i2")  # records x signals x samples
    pad = lambda x, n: str(x).ljust(n)[:n]
    n, head = 3, 256 * 4
    fields = [("A1", "A2", "EDF Annotations"), ("",) * 3, ("uV", "mV", ""), (-3200, -1, -1), (3200, 1, 1), (-32768, -32768, -32768), (32767, 32767, 32767), ("",) * 3, (100, 100, 8), ("",) * 3]
    text = pad("0", 8) + pad("x", 160) + pad("01.01.24", 8) + pad("00.00.00", 8) + pad(head, 8) + pad("EDF+C", 44) + pad(4, 8) + pad(0.5, 8) + pad(n, 4)
    for width, values in zip((16, 80, 8, 8, 8, 8, 8, 80, 8, 32), fields):
        text += "".join(pad(v, width) for v in values)
    body = b"".join(digital[r].tobytes() + np.zeros(8, "<i2").tobytes() for r in range(4))
    (tmp_path / "a.edf").write_bytes(text.encode("latin-1") + body)
    header = recordings.edf_header(str(tmp_path / "a.edf"))
    assert header.rate == 200 and header.channels == ("A1", "A2") and header.samples == 400
    got = {(r.channel, r.k): r.value for r in recordings.samples(spark, header, 0.5, 1.0).collect()}
    flat = digital.transpose(1, 0, 2).reshape(2, -1)
    assert len(got) == 202
    assert np.allclose([got["A1", k] for k in range(100, 201)], (flat[0, 100:201] + 32768.0) * 6400 / 65535 - 3200)
    assert np.allclose([got["A2", k] for k in range(100, 201)], ((flat[1, 100:201] + 32768.0) * 2 / 65535 - 1) * 1000)


def test_text_tables(spark, tmp_path):
    (tmp_path / "signal.csv").write_text("Time,A1,A2\n0.0,1,x\n0.5,2,\n")
    assert sorted((r.t, r.channel, r.value) for r in tables.signal_csv(spark, str(tmp_path / "signal.csv")).where("value is not null").collect()) == [(0.0, "A1", 1.0), (0.5, "A1", 2.0)]
    (tmp_path / "dated.csv").write_text("date,A1\n2024-01-01 00:00:00,1\n2024-01-01 00:00:01,2\n")
    assert dict(tables.signal_csv(spark, str(tmp_path / "dated.csv")).dtypes)["ts"] == "timestamp_ntz"
    (tmp_path / "meta.csv").write_text("Subject,session,Name,label\nsub-P1,ses-2,A1,B1\n,n/a,A2,B2\n")
    rows = tables.metadata(spark, str(tmp_path / "meta.csv"), ["patient_id", "session_id", "elec_label", "mni_x"]).collect()
    assert [(r.patient_id, r.session_id, r.elec_label, r.mni_x) for r in rows] == [("P1", "2", "B1", None), (None, None, "B2", None)]


def test_bids_events(spark, tmp_path):
    head = "onset\tduration\ttrial_type\telectrical_stimulation_site\tstatus\n"
    lines = [f"{2 * i}\t0.1\telectrical_stimulation\tLTG01-LTG02\t{'bad' if i == 3 else 'good'}\n" for i in range(5)] + ["1\tn/a\trest\tn/a\tn/a\n"]
    (tmp_path / "x_events.tsv").write_text(head + "".join(lines))
    (row,) = tables.stim_table(tables.bids_events(spark, str(tmp_path))).collect()
    assert (row.stim_pair, row.stim_start, row.stim_stop, row.stim_freq, row.n) == ("LTG_1_2", 0.0, 8.0, 0.5, 4)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2.5, ["x", "y"]), ("b", 2, None, [])], "acq string, epoch int, value double, reasons array<string>")
    steps = [("bandpass", {"low": 1}), ("reject", {})]
    assert sinks.read_epochs(spark, str(tmp_path / "e"), steps) is None
    sinks.write_epochs(df, str(tmp_path / "e"), steps, "acq")
    assert sinks.read_epochs(spark, str(tmp_path / "e"), steps).count() == 2
    assert sinks.pipeline_id(steps) != sinks.pipeline_id(steps[::-1])
    manifest = sinks.write_reports({"t": df, "u": df.orderBy("epoch", ascending=False), "v": df.limit(0)}, str(tmp_path / "r")).collect()
    assert [(m.table, m.n_rows) for m in manifest] == [("t", 2), ("u", 2), ("v", 0)] and manifest[0].hash == manifest[1].hash != manifest[2].hash
    assert spark.read.csv(str(tmp_path / "r/t"), header=True).where("reasons = 'x;y'").count() == 1
