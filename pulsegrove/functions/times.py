"""Written times as columns: every valid reading of a text as an array of UTC instants.

All arithmetic is on microseconds as long, so the session's time zone plays no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_US = 86_400_000_000

# Minutes east of UTC of zone abbreviations, by country of the IANA zone. "" holds everywhere.
ABBREVIATIONS = {
    "": {"UTC": 0, "GMT": 0, "Z": 0},
    "US": {"EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420},
    "CE": {"CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120},
    "GB": {"BST": 60},
    "FI": {"EET": 120, "EEST": 180},
    "JP": {"JST": 540},
    "CN": {"CST": 480},
    "IN": {"IST": 330},
    "AU": {"AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480},
}
COUNTRY = {
    "Europe/London": "GB", "Europe/Helsinki": "FI", "Asia/Tokyo": "JP", "Asia/Shanghai": "CN", "Asia/Kolkata": "IN", "Asia/Calcutta": "IN",
}
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "mär": 3, "mrz": 3, "apr": 4, "may": 5, "mai": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "dez": 12,
}

CLOCK = r"(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,](\d{1,12}))?)?"
HALF = r"\s*(?:([AaPp]\.?[Mm]\.?)(?![A-Za-z]))?"
ZONE = r"\s*[\[(]?((?:[+-]\d{2}(?::?\d{2})?)|[A-Za-z]{1,5}|[A-Za-z]+/[A-Za-z_/+-]+)?[\])]?\s*$"
#: Layouts of a full time, as kind and pattern; each is rewritten into kind|first|second|third|hour|minute|second|fraction|half|zone.
LAYOUTS = (
    ("Y", r"^\s*(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})[T ]\s*" + CLOCK + HALF + ZONE, "Y|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("B", r"^\s*(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d{1,12}))?)?" + ZONE, "B|$1|$2|$3|$4|$5|$6|$7||$8"),
    ("N", r"^\s*(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})[T ,]\s*" + CLOCK + HALF + ZONE, "N|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("M", r"^\s*(?:\p{L}{2,9}\.?,?\s+)?(\d{1,2})\.?\s+(\p{L}{3})\p{L}*\.?\s+(\d{4}),?\s+" + CLOCK + HALF + r"(?:\s*Uhr)?" + ZONE, "M|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("E", r"^\s*(\d{10}|\d{13}|\d{16}|\d{19})\s*$", "E|$1||||||||"),
)
#: Zones whose names the engine's zone tables hold; any other name would fail the job.
ZONE_NAME = r"^(UTC|(Africa|America|Antarctica|Asia|Atlantic|Australia|Europe|Indian|Pacific)/[A-Za-z_]+(/[A-Za-z_]+)?)$"
ISO_UTC = r"^\s*(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}([.,]\d+)?)?|\d{8}T\d{4}(\d{2}([.,]\d+)?)?)Z\s*$"


def once(value: Column) -> Column:
    """``value``, which filters further up must not be pushed below: there they would repeat its whole expression."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def layout_fields(text: Column) -> Column:
    """The text as an array kind, first, second, third, hour, minute, second, fraction, half, zone; kind is null if no layout fits."""
    rewritten = text
    for _, pattern, to in LAYOUTS:
        rewritten = F.regexp_replace(rewritten, pattern, to)
    return F.when(rewritten.rlike(r"^[YBNME]\|"), F.split(rewritten, r"\|"))


def number(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("long")


def fraction_us(digits: Column) -> Column:
    """Microseconds of the digits after the decimal mark; digits past the sixth are cut."""
    return F.coalesce(F.rpad(F.substring(digits, 1, 6), 6, "0").try_cast("long"), F.lit(0))


def day_number(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01, null if there is no such date between 1900 and 2199."""
    return F.when(year.between(1900, 2199), F.unix_date(F.concat_ws("-", year, month, day).try_cast("date")).cast("long"))


def clock_us(hour: Column, minute: Column, second: Column, fraction: Column, half: Column) -> Column:
    """Microseconds since midnight of plain columns, null if there is no such time of day; half is a, p or empty."""
    full = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    return F.when((full <= 23) & (minute <= 59) & (second <= 59), ((full * 60 + minute) * 60 + second) * 1_000_000 + fraction)


def clock_parts(*texts: Column) -> list[Column]:
    """Texts of hour, minute, second, fraction and half as the columns _h, _mi, _s, _fr and _half that ``clock_us`` takes."""
    h, m, s, fraction, half = texts
    parts = {"_h": number(h), "_mi": number(m), "_s": F.coalesce(number(s), F.lit(0)), "_fr": fraction_us(fraction), "_half": F.lower(F.substring(F.coalesce(half, F.lit("")), 1, 1))}
    return [value.alias(name) for name, value in parts.items()]


CLOCK_COLUMNS = ("_h", "_mi", "_s", "_fr", "_half")


def wall_us(instant_us: Column, tz: Column) -> Column:
    """What a wall clock in ``tz`` shows at an instant, as microseconds."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(instant_us), tz))


def with_instants(df: DataFrame, local: str, tz: str, name: str) -> DataFrame:
    """``df`` with the array ``name`` of all instants at which clocks in ``tz`` show ``local``: none in a gap, two in a doubled hour.

    Each step is a column of its own, so that no expression is evaluated twice.
    """
    at, zone = F.col(local), F.col(tz)
    df = df.withColumns({"_early": at - (wall_us(at - DAY_US, zone) - (at - DAY_US)), "_late": at - (wall_us(at + DAY_US, zone) - (at + DAY_US))})
    early = F.when(wall_us(F.col("_early"), zone) == at, F.col("_early"))
    late = F.when((F.col("_late") != F.col("_early")) & (wall_us(F.col("_late"), zone) == at), F.col("_late"))
    return df.withColumn(name, F.array_compact(F.array(early, late))).drop("_early", "_late")


def country_of(tz: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in COUNTRY.items() for x in pair])
    return F.coalesce(F.try_element_at(known, tz), F.when(tz.startswith("America/"), "US").when(tz.startswith("Australia/"), "AU").when(tz.startswith("Europe/"), "CE"))


def with_offset(df: DataFrame, zone: str, tz: str, name: str) -> DataFrame:
    """``df`` with the minutes east of UTC that a written zone means at a site in ``tz``; null for a zone's name or nonsense."""
    table = {f"{country}|{abbreviation}": minutes for country, names in ABBREVIATIONS.items() for abbreviation, minutes in names.items()}
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    written = F.col(zone)
    digits = F.rpad(F.regexp_replace(written, r"[^0-9]", ""), 4, "0")
    df = df.withColumn("_digits", F.when(written.rlike(r"^[+-]\d"), digits)).withColumns(
        {"_minutes": number(F.substring("_digits", 1, 2)) * 60 + number(F.substring("_digits", 3, 2)), "_everywhere": F.concat(F.lit("|"), F.upper(written)), "_there": F.concat(country_of(F.col(tz)), F.lit("|"), F.upper(written))}
    )
    numeric = F.when(F.col("_minutes") <= 15 * 60, F.when(written.startswith("-"), -F.col("_minutes")).otherwise(F.col("_minutes")))
    out = F.when(F.col("_digits").isNotNull(), numeric).otherwise(F.coalesce(F.try_element_at(known, F.col("_everywhere")), F.try_element_at(known, F.col("_there"))))
    return df.withColumn(name, out).drop("_digits", "_minutes", "_everywhere", "_there")


#: What a reading against the site's declared order costs beforehand, in steps of ``viterbi.SWITCH_COST``.
CONTRARY = 3.0


def with_readings(df: DataFrame, text: str, tz: str, date_order: str, name: str) -> DataFrame:
    """``df`` with every valid reading of a text, as array<struct<fmt string, us bigint, cost double>> ``name``.

    fmt is the order in which a numeric date is read, or the layout; cost is 0 for the order that the site declares. A date
    of two-digit parts is read in all three orders, one whose year has four digits in the two that have it last.
    """
    kept = [F.col(f"`{x}`") for x in df.columns]
    at = lambda i: F.get("_f", F.lit(i))
    df = df.withColumn("_f", once(layout_fields(F.col(text))))
    df = df.select(
        *kept, at(0).alias("_kind"), number(at(1)).alias("_a"), number(at(2)).alias("_b"), number(at(3)).alias("_c"), F.length(at(3)).alias("_n"), F.length(at(1)).alias("_m"),
        F.lower(at(2)).alias("_name"), F.nullif(at(9), F.lit("")).alias("_zone"), *clock_parts(*(at(k) for k in range(4, 9))),
    ).withColumn("_clock", clock_us(*map(F.col, CLOCK_COLUMNS)))
    df = with_offset(df, "_zone", tz, "_offset")
    kind, a, b, c, numeric = F.col("_kind"), F.col("_a"), F.col("_b"), F.col("_c"), F.col("_kind") == "N"
    order, short = F.col(date_order), (F.col("_n") == 2)
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    full = lambda y: F.when(short, y + 2000).otherwise(y)
    df = df.withColumns(
        {
            "_y1": F.when(kind.isin("Y", "B"), a).otherwise(full(c)),
            "_m1": F.when(kind == "M", F.try_element_at(months, F.col("_name"))).otherwise(b),
            "_d1": F.when(kind.isin("Y", "B"), c).otherwise(a),
            "_fmt1": F.when(kind.isin("Y", "B"), "YMD").when(numeric, "DMY").when(kind == "M", "NAME"),
            "_y2": F.when(numeric & (a != b), full(c)),
            "_y3": F.when(numeric & short & (F.col("_m") == 2) & (a != c), a + 2000),
        }
    )
    # where two orders give one day, the declared one stands for both
    year_first = (order == "YMD") & short & (F.col("_m") == 2)
    alike = F.when(year_first, a == c).otherwise(a == b)
    declared = lambda fmt, like: F.when(numeric & (order != fmt) & ~F.coalesce(like, F.lit(False)), CONTRARY).otherwise(0.0)
    for k, (y, m, day) in {"1": ("_y1", "_m1", "_d1"), "2": ("_y2", "_a", "_b"), "3": ("_y3", "_b", "_c")}.items():
        df = df.withColumn(f"_local{k}", day_number(F.col(y), F.col(m), F.col(day)) * DAY_US + F.col("_clock"))
    df = df.withColumn("_tz", F.when(F.col("_zone").contains("/"), F.col("_zone")).when(F.col("_zone").isNull(), F.col(tz)).when(F.col("_offset").isNotNull(), "UTC"))
    df = df.withColumn("_tz", F.when(F.col("_tz").rlike(ZONE_NAME), F.col("_tz")))
    df = df.withColumns({f"_local{k}": F.col(f"_local{k}") - F.coalesce(F.when(F.col("_zone").isNull() | F.col("_zone").contains("/"), 0).otherwise(F.col("_offset")), F.lit(0)) * 60_000_000 for k in "123"})
    for k in "123":
        df = with_instants(df, f"_local{k}", "_tz", f"_us{k}")
    epoch = F.when(kind == "E", F.when(F.col("_m") == 10, a * 1_000_000).when(F.col("_m") == 13, a * 1000).when(F.col("_m") == 19, F.floor(a / 1000)).otherwise(a).cast("bigint"))
    reading = lambda fmt, cost: lambda u: F.struct(fmt.alias("fmt"), u.alias("us"), cost.alias("cost"))
    lists = [
        F.transform(F.array_compact(F.array(epoch)), reading(F.lit("EPOCH"), F.lit(0.0))),
        F.transform("_us1", reading(F.col("_fmt1"), declared("DMY", alike))),
        F.transform("_us2", reading(F.lit("MDY"), declared("MDY", F.lit(False)))),
        F.transform("_us3", reading(F.lit("YMD"), declared("YMD", F.lit(False)))),
    ]
    none = F.array().cast("array<struct<fmt:string,us:bigint,cost:double>>")
    return df.select(*kept, F.concat(*[F.coalesce(x, none) for x in lists]).alias(name))
