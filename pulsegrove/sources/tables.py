"""Text tables: signals as CSV, metadata with other column names, and BIDS events and electrodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Other column names of the metadata tables, the first one present counts.
COLUMN_ALIASES = {
    "patient_id": ["subject", "subject_id", "patient", "participant_id"], "session_id": ["session", "ses"], "stim_pair": ["pair", "stimulation_pair", "electrical_stimulation_site"], "elec_label": ["label", "name", "channel", "contact"],
    "anat_label": ["region", "anatomy"], "sampling_freq": ["sfreq", "fs", "sampling_frequency"], "raw_file": ["file", "filename", "path"], "mni_x": ["x"], "mni_y": ["y"], "mni_z": ["z"],
}
TIME_NAMES = ("times", "time", "timestamp", "datetime", "date")
TRUE_WORDS = ("1", "true", "yes", "y", "bad", "exclude")


def truth(column: str | Column) -> Column:
    """A textual flag as boolean; null and blank stay null."""
    text = F.lower(F.trim(F.col(column) if isinstance(column, str) else column))
    return F.when(text != "", text.isin(*TRUE_WORDS))


def canonical_columns(df: DataFrame) -> DataFrame:
    """``df`` with known other names renamed, whatever their case; a canonical name that is there is never overwritten."""
    present = {c.lower(): c for c in df.columns}
    renamed = {}
    for name, others in COLUMN_ALIASES.items():
        if name in present:
            renamed[present[name]] = name
        elif hit := next((present[o] for o in others if o in present and present[o] not in renamed), None):
            renamed[hit] = name
    return df.withColumnsRenamed(renamed)


def metadata(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A metadata CSV under canonical names; missing columns are null, ids are text without sub- and ses-."""
    df = canonical_columns(spark.read.csv(path, header=True, nullValue="n/a"))
    for c in columns:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    for c, prefix in (("patient_id", "sub-"), ("session_id", "ses-")):
        if c in df.columns:
            df = df.withColumn(c, F.regexp_replace(F.trim(c), f"^{prefix}", ""))
    return df


def signal_csv(spark: SparkSession, path: str) -> DataFrame:
    """channel, t (double) or ts (timestamp), value: a wide CSV in long form.

    The time column is the first of the known names, else the first column; it counts as date and time if over 80 % of
    its values parse as such and not as numbers. Values that are no numbers are null.
    """
    wide = spark.read.csv(path, header=True)
    low = {c.lower(): c for c in wide.columns}
    time = next((low[x] for x in TIME_NAMES if x in low), wide.columns[0])
    stamp, number = F.try_to_timestamp(F.col(f"`{time}`")), F.col(f"`{time}`").try_cast("double")
    share = wide.agg(F.avg(F.when(number.isNull(), stamp.isNotNull().cast("double")).otherwise(0.0))).first()[0] or 0.0
    at = stamp.cast("timestamp_ntz").alias("ts") if share > 0.8 else number.alias("t")
    values = [c for c in wide.columns if c != time]
    numbers = wide.select(at, *(F.col(f"`{c}`").try_cast("double").alias(c) for c in values))
    return numbers.unpivot([numbers.columns[0]], values, "channel", "value")


def bids_events(spark: SparkSession, path: str) -> DataFrame:
    """onset, duration, stim_pair and the file of each usable stimulation in BIDS events tables (TSV, n/a is null)."""
    rows = spark.read.csv(path, sep="\t", header=True, nullValue="n/a").withColumn("file", F.input_file_name())
    usable = F.col("trial_type").rlike(r"(?i)stim") & F.coalesce(F.lower("status") != "bad", F.lit(True))
    return rows.where(usable).select("file", F.col("onset").try_cast("double").alias("onset"), F.col("duration").try_cast("double").alias("duration"), stim_pair(F.col("electrical_stimulation_site")).alias("stim_pair"))


def stim_pair(text: Column) -> Column:
    """LTG1-LTG2 and the like as LTG_1_2; other spellings as they are."""
    pattern = r"^\s*([A-Za-z]+)0*(\d+)\s*[-_/ ]\s*\1?0*(\d+)\s*$"
    return F.when(text.rlike(pattern), F.regexp_replace(text, pattern, "$1_$2_$3")).otherwise(F.trim(text))


def stim_table(events: DataFrame) -> DataFrame:
    """file, stim_pair, stim_start, stim_stop, stim_freq (1 / median interval), n of BIDS events."""
    gaps = events.withColumn("gap", F.col("onset") - F.lag("onset").over(Window.partitionBy("file", "stim_pair").orderBy("onset")))
    return gaps.groupBy("file", "stim_pair").agg(F.min("onset").alias("stim_start"), F.max("onset").alias("stim_stop"), (1 / F.median(F.when(F.col("gap") > 0, F.col("gap")))).alias("stim_freq"), F.count("*").alias("n"))


def bids_recordings(spark: SparkSession, root: str) -> DataFrame:
    """path, subject, session, task, suffix of the recordings below ``root``; an .eeg file counts only through its .vhdr.

    The listing is Spark's own; no file is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    entity = lambda key: F.nullif(F.regexp_extract(name, f"(?:^|_){key}-([A-Za-z0-9]+)", 1), F.lit(""))
    kept = files.where(name.rlike(r"_ieeg\.(vhdr|edf|bdf|nwb)$"))
    return kept.select("path", entity("sub").alias("subject"), entity("ses").alias("session"), entity("task").alias("task"), F.regexp_extract(name, r"\.([a-z]+)$", 1).alias("suffix"))


def contacts_table(electrodes: DataFrame, channels: DataFrame, session: str, name: str) -> DataFrame:
    """The rows of ``electrodes``, and of ``channels`` for names that a session's electrodes have not; of repeats the first by all columns."""
    shared = [c for c in electrodes.columns if c in channels.columns and c not in (session, name)]
    both = electrodes.select(session, name, *shared, F.lit(0).alias("_from")).unionByName(channels.select(session, name, *shared, F.lit(1).alias("_from")))
    first = both.where(F.col(name).isNotNull()).groupBy(session, name).agg(F.min(F.struct("_from", *shared)).alias("_r"))
    return first.select(session, name, *(F.col(f"_r.{c}").alias(c) for c in shared))


def times_or_numbers(events: DataFrame, column: str, least: float = 0.8) -> DataFrame:
    """``events`` with ``seconds`` (if every text of the column is a number) or ``at`` (if over ``least`` of them are times); else both null."""
    number, time = F.col(column).try_cast("double"), F.try_to_timestamp(F.col(column))
    rates = events.where(F.col(column).isNotNull()).agg(F.avg(number.isNotNull().cast("double")).alias("n"), F.avg(time.isNotNull().cast("double")).alias("t"))
    numeric = F.coalesce(rates.select("n").scalar() == 1, F.lit(False))
    return events.withColumns({"seconds": F.when(numeric, number), "at": F.when(~numeric & (rates.select("t").scalar() > least), time)})


def unique_labels(channels: DataFrame, recording: str, label: str, order: str, name: str) -> DataFrame:
    """``channels`` with repeated labels of a recording told apart: CH, CH_2, CH_3 in order."""
    n = F.row_number().over(Window.partitionBy(recording, label).orderBy(order))
    return channels.withColumn(name, F.when(n == 1, F.col(label)).otherwise(F.concat(F.col(label), F.lit("_"), n.cast("string"))))


def joined_recordings(parts: DataFrame, scale: str) -> DataFrame:
    """channel, k, value of a recording read from several files (file, channel, k, value and the file's ``scale``).

    A sample in several files comes from the first by name; files whose scales differ are refused when the rows are read.
    """
    one = parts.groupBy("channel", "k").agg(F.min_by("value", "file").alias("value"))
    differ = parts.agg(F.count_distinct(scale).alias("n")).scalar()
    checked = F.when(differ > 1, F.raise_error(F.lit("files of one recording have different scales")).cast("double")).otherwise(F.col("value"))
    return one.select("channel", "k", checked.alias("value"))


def only(rows: DataFrame, column: str, value: object) -> DataFrame:
    """The rows of one value, such as a patient; raises if there are none."""
    own = rows.where(F.col(column) == value)
    if own.limit(1).count() == 0:
        raise ValueError(f"no {column} {value!r}")
    return own
