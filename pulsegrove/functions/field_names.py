"""The project's field names of each kind of metadata file, and the other names under which they occur."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Other names of each field, in lower case without signs between the letters.
SHARED = {
    "patient_id": ["patid", "sub", "subject", "participantid"],
    "session_id": ["ses", "sess", "session"],
}
ALIASES = {
    "raw": SHARED
    | {
        "raw_file": ["file", "filepath", "edffile", "recordingfile"],
        "start_time": ["start", "begintime", "measdate", "recordingstart"],
        "stop_time": ["end", "endtime", "finish", "recordingstop"],
        "sampling_freq": ["fs", "sfreq", "samplerate", "samplingfrequency", "samplingfreqhz", "sampligfreq", "abtastrate"],
        "value_scale_to_uv": ["scaletouv", "signalscaletouv", "voltagescaletouv", "uvpercount"],
    },
    "stim": SHARED
    | {
        "stim_pair": ["stim", "stimsite", "stimuluspair", "stimulationpair", "electricalstimulationsite", "pairestim"],
        "stim_start": ["start", "starttime", "onset", "stimonset"],
        "stim_stop": ["stop", "end", "endtime", "stimend", "offsettime"],
        "stim_freq": ["frequency", "stimulationfrequency", "repetitionfrequency", "rephz"],
        "amplitude_ma": ["amplitude", "ampma", "currentma", "stimcurrent"],
        "pulse_width_us": ["pulsewidth", "pwus", "phasewidthus"],
    },
    "electrode": SHARED
    | {
        "elec_label": ["channel", "channelname", "contact", "electrode", "elektrode", "label", "name"],
        "anat_label": ["anat", "anatomy", "region", "atlaslabel"],
        "mni_x": ["x", "xmni"],
        "mni_y": ["y", "ymni"],
        "mni_z": ["z", "zmni"],
        "bad_channel": ["bad", "isbad", "exclude"],
    },
}
#: How a field's values are brought to one type; fields that are not named here stay texts.
CASTS = {x: "number" for x in ("sampling_freq", "value_scale_to_uv", "stim_freq", "amplitude_ma", "pulse_width_us", "mni_x", "mni_y", "mni_z")} | {"bad_channel": "flag", "stim_pair": "pair", "elec_label": "label"} | {x: "time" for x in ("start_time", "stop_time", "stim_start", "stim_stop")}
#: Units that a number may be written with, by what they are in the field's own unit; "" is a number without one.
HERTZ, MICROVOLTS = {"": 1.0, "hz": 1.0, "khz": 1e3}, {"": 1.0, "uv": 1.0, "nv": 1e-3, "mv": 1e3, "v": 1e6}
MILLIMETRES = {"": 1.0, "mm": 1.0, "cm": 10.0, "m": 1e3}
UNITS = {
    "sampling_freq": HERTZ, "stim_freq": HERTZ, "value_scale_to_uv": MICROVOLTS, "amplitude_ma": {"": 1.0, "ma": 1.0, "ua": 1e-3, "a": 1e3},
    "pulse_width_us": {"": 1.0, "us": 1.0, "ms": 1e3, "s": 1e6}, "mni_x": MILLIMETRES, "mni_y": MILLIMETRES, "mni_z": MILLIMETRES,
}


def bare(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[^0-9A-Za-z]", ""))


def alias_table(spark: SparkSession) -> DataFrame:
    """kind, bare_name, field, cast: a fixed table of under 150 rows."""
    rows = [(kind, x, field, CASTS.get(field, "text")) for kind, fields in ALIASES.items() for field, names in fields.items() for x in [field.replace("_", ""), *names]]
    return spark.createDataFrame(rows, "kind string, bare_name string, field string, cast string")
