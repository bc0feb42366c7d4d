from __future__ import annotations

import datetime as dt
import json

from pulsegrove.operators import schema_drift

FILES = "file_id long, stream_id string, kind string, exported_at timestamp, name string, field string"
ROWS = "row_id long, file_id long, line_no int, payload string, name string, type string"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def frames(spark, files, rows):
    return spark.createDataFrame([(i, r, n, p, "x", "y") for i, (r, n, p) in enumerate(rows)], ROWS), spark.createDataFrame([(*f, "x", "y") for f in files], FILES)


def migrated(spark, files, rows, kind):
    r, f = frames(spark, files, rows)
    return schema_drift.migrate(r, schema_drift.versions(r, f), kind)


def test_changes_against_the_file_before(spark):
    # file ids are not in the order of export; the stream crosses a month
    files = [(5, "s", "raw", day(0)), (2, "s", "raw", day(40)), (9, "s", "raw", day(41)), (7, "t", "stim", day(3)), (8, "t", "stim", day(3))]
    rows = [
        (5, 1, json.dumps({"patient_id": "A", "sampling_freq": 512, "notch": None})), (5, 1, json.dumps({"patient_id": "A", "sampling_freq": 512, "notch": None})), (5, 2, None), (5, 3, "no json"), (5, 4, "[1]"),
        (2, 1, json.dumps({"PatientID": "A", "sampling_freq": "512 Hz", "notch": 1})), (9, 1, json.dumps({"PatientID": 3, "fs": {"rate": 512, "unit": "kHz"}, "extra field": True})),
        (7, 1, json.dumps({"start_time": 1.5, "stim": ["A1", "A2"]})), (8, 1, json.dumps({"stim_start": 2, "stim": {"anode": "A1", "cathode": "A2"}})),
    ]
    r, f = frames(spark, files, rows)
    got = {(x.file_id, x.field_name, x.change_kind) for x in schema_drift.changes(schema_drift.versions(r, f)).collect()}
    assert got == {
        (2, "patient_id", "renamed"), (2, "sampling_freq", "retyped"), (9, "patient_id", "retyped"), (9, "sampling_freq", "renamed"), (9, "sampling_freq", "retyped"), (9, "notch", "removed"), (9, "extra field", "added"),
        (8, "stim_start", "renamed"), (8, "stim_pair", "retyped"),
    }
    raw = {x.row_id: x for x in schema_drift.migrate(r, schema_drift.versions(r, f), "raw").collect()}
    assert len(raw) == 7 and raw[0].sampling_freq == 512 and raw[5].sampling_freq == 512 and raw[6].sampling_freq == 512_000 and raw[6].patient_id == "3"
    assert not raw[2].readable and not raw[3].readable and not raw[4].readable and raw[2].patient_id is None
    assert [x.stim_pair for x in schema_drift.migrate(r, schema_drift.versions(r, f), "stim").orderBy("row_id").collect()] == ["A_1_2", "A_1_2"]
    table = {x.file_id: x for x in schema_drift.versions(r, f).collect()}
    assert table[9].renames == {"PatientID": "patient_id", "fs": "sampling_freq", "extra field": "extra field"} and "raw_file" in table[9].defaults and table[9].casts["sampling_freq"] == "number"
    assert [table[i].version for i in (5, 2, 9)] == [1, 2, 3] and table[5].steps == []
    assert {(s.field, s.change, tuple(s.old_names or ()), tuple(s.new_names or ())) for s in table[9].steps} >= {("sampling_freq", "renamed", ("sampling_freq",), ("fs",)), ("notch", "removed", ("notch",), ())}


def test_renames_outside_the_known_names_are_followed_along_the_chain(spark):
    names = ["sampling_freq", "samplng_freq2", "smplng_fq2", "smplng_rate2"]
    files = [(i, "s", "raw", day(20 * i)) for i in range(6)]
    rows = [(i, n, json.dumps({names[min(i, 3)]: value, "patient_id": "A", "amplifier": "unit-1"})) for i in range(5) for n, value in enumerate((512, 2048))]
    rows += [(5, 0, json.dumps({"colour": "red", "patient_id": "A", "amplifier_mk": "unit-1"}))]
    r, f = frames(spark, files, rows)
    table = schema_drift.versions(r, f)
    assert {(x.file_id, x.field_name, x.change_kind) for x in schema_drift.changes(table).collect()} == {
        (1, "sampling_freq", "renamed"), (2, "sampling_freq", "renamed"), (3, "sampling_freq", "renamed"), (5, "sampling_freq", "removed"), (5, "colour", "added"), (5, "amplifier", "removed"), (5, "amplifier_mk", "added"),
    }
    assert [x.version for x in table.orderBy("file_id").collect()] == [1, 2, 3, 4, 4, 5]
    assert [x.sampling_freq for x in schema_drift.migrate(r, table, "raw").orderBy("file_id", "line_no").collect()] == [512.0, 2048.0] * 5 + [None]


def test_numbers_with_units_come_out_in_the_field_s_own(spark):
    rows = [(1, n, json.dumps({"pulse_width_us": x, "amplitude_ma": y})) for n, (x, y) in enumerate([("0.3 ms", "1.5 mA"), ("300µs", "500 uA"), (200, 2), ("5 furlongs", None)])]
    out = migrated(spark, [(1, "s", "stim", day(0))], rows, "stim").orderBy("line_no").collect()
    assert [(x.pulse_width_us, x.amplitude_ma) for x in out] == [(300.0, 1.5), (300.0, 0.5), (200.0, 2.0), (None, None)]


def test_labels_in_objects(spark):
    rows = [(1, 1, json.dumps({"elec_label": x})) for x in ({"lead": "RTPOLE", "contact": 7}, ["LAMYG", 3], " LCINA4 ", None)]
    out = migrated(spark, [(1, "s", "electrode", day(0))], rows, "electrode").orderBy("row_id")
    assert [x.elec_label for x in out.collect()] == ["RTPOLE7", "LAMYG3", "LCINA4", None]


def test_times_and_pairs_have_one_form(spark):
    rows = [(1, 1, json.dumps({"stim_start": a, "stim_pair": b})) for a, b in ((1709607845, "LTG1-LTG2"), ("2024-03-05T03:04:05", ["LTG1", "LTG2"]), (12.5, {"cathode": "LTG2", "anode": "LTG1"}), (None, "LTG_1_2"))]
    out = migrated(spark, [(1, "s", "stim", day(0))], rows, "stim").orderBy("row_id").collect()
    assert [r.stim_start for r in out] == ["2024-03-05T03:04:05", "2024-03-05T03:04:05", "12.5", None] and {r.stim_pair for r in out} == {"LTG_1_2"}


def test_values_of_other_fields_stay(spark):
    rows = [(1, 1, json.dumps(x)) for x in ({"patient_id": "A", "notch": None, "Headbox": {"no": 3}, "impedance_kohm": 5.5}, {"patid": "B"})] + [(1, 3, None), (1, 4, '{"batch_code": "b1", "notch": 50}')]
    out = migrated(spark, [(1, "s", "raw", day(0))], rows, "raw").orderBy("row_id").collect()
    assert [r.others for r in out] == [{"notch": None, "Headbox": '{"no":3}', "impedance_kohm": "5.5"}, {}, {}, {"batch_code": "b1", "notch": "50"}]
    assert [r.patient_id for r in out] == ["A", "B", None, None]


def test_repeated_rows_have_their_other_fields_once(spark):
    r, f = frames(spark, [(1, "s", "raw", day(0))], [(1, 1, json.dumps({"notch": 50}))])
    out = schema_drift.migrate(r.unionByName(r), schema_drift.versions(r.unionByName(r), f), "raw").collect()
    assert {tuple(x.others.items()) for x in out} == {(("notch", "50"),)}


def test_empty_tables(spark):
    r, f = frames(spark, [], [])
    assert schema_drift.changes(schema_drift.versions(r, f)).count() == 0 and schema_drift.migrate(r, schema_drift.versions(r, f), "raw").count() == 0 and schema_drift.versions(r, f).count() == 0
