"""Voltage units written in text: an alias automaton, and the factors its codes stand for.

Aliases come from a rule (every spelling of a prefix before every spelling of volt), so a new spelling is one word here.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Picovolts in one unit.
FACTORS = {"pV": 1, "nV": 10**3, "uV": 10**6, "mV": 10**9, "V": 10**12, "kV": 10**15}
#: Spellings of each prefix, lower case after compatibility folding (the micro sign becomes the Greek letter).
PREFIXES = {
    "pV": ("p", "pico"),
    "nV": ("n", "nano"),
    "uV": ("u", "μ", "mc", "mic", "micro"),
    "mV": ("m", "milli"),
    "V": ("",),
    "kV": ("k", "kilo"),
}
VOLT = ("v", "volt", "volts", "vlt", "vlts")


@lru_cache(maxsize=1)
def automaton():
    """The Aho-Corasick automaton over all aliases."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for code, prefixes in PREFIXES.items():
        for prefix in prefixes:
            for volt in VOLT:
                for gap in ("", "-", " ", "_") if prefix else ("",):
                    found.add_word(f"{prefix}{gap}{volt}", (code, len(prefix) + len(gap) + len(volt)))
    found.make_automaton()
    return found


def unit_in(text: str | None) -> str | None:
    """The unit whose alias stands first in ``text`` as a word of its own; the longest alias wins at one place."""
    if not text:
        return None
    text = unicodedata.normalize("NFKC", text).lower()
    for end, (code, length) in automaton().iter_long(text):
        before, after = text[end - length] if end >= length else " ", text[end + 1] if end + 1 < len(text) else " "
        if not before.isalpha() and not after.isalpha():
            return code
    return None


@F.pandas_udf(T.StringType())
def find_unit(texts: pd.Series) -> pd.Series:
    """``unit_in`` of each text; a batch's repeated texts are searched once."""
    codes, distinct = pd.factorize(texts)
    found = [unit_in(x) for x in distinct]
    return pd.Series([found[k] if k >= 0 else None for k in codes], dtype=object)


def factor_table(spark: SparkSession) -> DataFrame:
    """unit string, unit_pv long: one row per unit, a fixed handful."""
    return spark.createDataFrame(list(FACTORS.items()), "unit string, unit_pv long")


#: Perhaps a word, then a number with a point or a comma as decimal mark, perhaps with an exponent, then the rest.
NUMBER = r"^\s*([A-Za-zµμ][A-Za-zµμ_-]*)?\s*([-+]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][-+]?\d+)?)(.*)$"
#: A rest that goes on with the number, such as after a separator of thousands: which number is meant is open.
MORE = r"^\s*[.,']?\d"


def number_of(text: Column) -> Column:
    """The one number of a text as a double; null if there is none or its digits go on after it."""
    return F.when(~F.regexp_extract(text, NUMBER, 3).rlike(MORE), F.regexp_replace(F.regexp_extract(text, NUMBER, 2), ",", ".").try_cast("double"))


def rest_of(text: Column) -> Column:
    """What follows the number, else the word before it; null if there is neither."""
    return F.coalesce(*(F.nullif(F.trim(F.regexp_extract(text, NUMBER, part)), F.lit("")) for part in (3, 1)))
