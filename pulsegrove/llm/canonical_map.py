"""Problem 3: freely typed values mapped to the entries of a canonical list.

Distinct values are normalised once (look-alike letters, wide digits, number words, amplifier prefixes, remarks) into a
side with letters and a contact number. The letters' character n-grams are looked up in an inverted index of the catalog's
labels and anatomical names: bigrams and trigrams weighted by their rarity in the catalog, and gapped n-grams of the whole
word less one letter, which a typing error leaves in common. A candidate's score is the cosine of these weighted counts.
The best lead is accepted if its score reaches a threshold and leads the next one by a margin. Leads closer to each other
than the margin are settled by an exact check of edits among them; if two are equally near, the value is ambiguous.

Defined results: null, empty and placeholder values, values without exactly one number, with two sides, or equally
close to two leads are unmatched and reported with a reason; equal values share one result; texts of any length are
normalised whole; an empty catalog leaves every value unmatched; extra columns are not carried along.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Score at which a lead is accepted, and its margin over the next lead.
THRESHOLD, MARGIN = 0.15, 0.03
#: Lengths of the n-grams, and the share of the gapped ones as a multiple of theirs.
LENGTHS, GAPPED = (2, 3), 2.0
#: Weight of an n-gram that the catalog doesn't have, such as a typing error makes.
STRANGE = 0.25

# Letters of other scripts that look like Latin ones, number words, and words that name no lead.
LOOKALIKES = str.maketrans("АВЕЅІЈКМНОРСТУХаеѕіјкмнорстухΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABESIJKMHOPCTYXaesijkmhopctyxABEZHIKMNOPTYX")
WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen"]
NOISE = {"pol", "eeg", "seeg", "ieeg", "ref", "avg", "ok", "noisy", "bad", "good", "contact", "no", "nr", "of", "elec", "electrode", "channel", "the", "side"}
SIDES = {"l": "l", "left": "l", "lt": "l", "links": "l", "r": "r", "right": "r", "rt": "r", "rechts": "r"}
REFERENCE = re.compile(r"[-/_\s]+\(?(?:a[12]|m[12]|ref|avg|cz)\)?\s*$")
INDEX = re.compile(r"\[\s*\d+\s*\]\s*$")


def spell(text: str | None) -> tuple[str, int, str]:
    """side and letters, number, reason (empty if readable) of a typed contact."""
    if text is None or not text.strip():
        return "", -1, "missing"
    text = unicodedata.normalize("NFKC", text).translate(LOOKALIKES).lower()
    text = REFERENCE.sub("", INDEX.sub("", text.strip()))
    text = re.sub(r"(?<=\d)o(?=\d|\W|$)", "0", text)
    text = re.sub(r"(?<=\d)[il](?=\d|\W|$)", "1", text)
    tokens = [t for t in re.findall(r"[^\W\d_]+|\d+", text) if t not in NOISE]
    tokens = [str(WORDS.index(t)) if t in WORDS else t for t in tokens]
    numbers = [t for t in tokens if t.isdigit()]
    letters = [t for t in tokens if not t.isdigit()]
    sides = {SIDES[t] for t in letters if t in SIDES}
    stem = "".join(t for t in letters if t not in SIDES)
    if not stem:
        return "", -1, "no lead"
    if len(numbers) != 1 or len(numbers[0]) > 4:
        return stem, -1, "no number" if not numbers else "many numbers"
    if len(sides) > 1:
        return stem, -1, "two sides"
    return "".join(sides) + "|" + stem, int(numbers[0]), ""


@F.pandas_udf(T.StructType([T.StructField("stem", T.StringType()), T.StructField("number", T.IntegerType()), T.StructField("reason", T.StringType())]))
def spelled(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([spell(x) for x in texts], columns=["stem", "number", "reason"])


def grams(word: Column) -> Column:
    """The character n-grams of a word between its ends, as an array with repeats."""
    framed = F.concat(F.lit("^"), word, F.lit("$"))
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(framed) - (n - 1)), lambda i: F.substring(framed, i, F.lit(n)))
    return F.concat(*(F.when(F.length(framed) >= n, of(n)).otherwise(F.array().cast("array<string>")) for n in LENGTHS))


def gapped(word: Column, longest: Column | None = None) -> Column:
    """The word, and the word less each of its letters.

    Of a word over ``longest`` + 1 letters only itself: none of its others can be one of a word of ``longest`` letters.
    """
    less = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    whole = F.array(word)
    each = F.array_distinct(F.concat(whole, less))
    return F.transform(each if longest is None else F.when(F.length(word) <= longest + 1, each).otherwise(whole), lambda x: F.concat(F.lit("="), x))


def counted(words: DataFrame, word: str, longest: Column | None = None) -> DataFrame:
    """``words`` with a row for each distinct gram of ``word``, its count n and whether it is gapped (at least one letter each)."""
    each = F.concat(F.transform(grams(F.col(word)), lambda g: F.struct(g.alias("gram"), F.lit(False).alias("gap"))), F.transform(gapped(F.col(word), longest), lambda g: F.struct(g.alias("gram"), F.lit(True).alias("gap"))))
    return words.select(*words.columns, F.explode(each).alias("g")).groupBy(*words.columns, "g.gram", "g.gap").agg(F.count("*").alias("n"))


def unit_vectors(weighed: DataFrame, key: list[str]) -> DataFrame:
    """key, gram, v of rows of key, gram, gap, v: both kinds scaled to length 1, the gapped ones then to ``GAPPED``, and all to length 1."""
    lengths = weighed.groupBy(*key, "gap").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_length"))
    scale = F.when(F.col("gap"), GAPPED).otherwise(1.0) / (1 + GAPPED**2) ** 0.5
    return weighed.join(lengths, [*key, "gap"]).select(*key, "gram", (F.col("v") / F.col("_length") * scale).alias("v"))


def edit_distance(a: Column, b: Column) -> Column:
    """Insertions, deletions and substitutions between two words; a swap of neighbours alone counts as one."""
    edits = F.levenshtein(a, b)
    swap = (F.length(a) == F.length(b)) & (F.size(F.array_intersect(gapped(a), gapped(b))) >= 2)
    return F.when((edits == 2) & swap, 1).otherwise(edits)


def lead_forms(catalog: DataFrame) -> DataFrame:
    """lead, form: the ways in which each lead of the catalog may be written out, its side first."""
    leads = catalog.where("lead_label is not null").select(F.upper(F.trim("lead_label")).alias("lead"), F.lower(F.trim("anat_label")).alias("name")).distinct()
    spoken = F.regexp_replace(F.regexp_replace("name", r"^left\b", "l"), r"^right\b", "r")
    forms = leads.select("lead", F.explode(F.array(F.lower("lead"), F.regexp_replace(spoken, r"[^a-z]", ""))).alias("form"))
    return forms.where("form is not null and form <> ''").distinct()


def match_stems(stems: DataFrame, catalog: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """stem, lead, score, verdict for each distinct stem (side|letters); lead is null unless the verdict is accepted."""
    forms = lead_forms(catalog)
    longest = F.lit(forms.agg(F.max(F.length("form"))).first()[0] or 0)  # one number of a reference table
    entries = counted(forms, "form")
    rarity = entries.groupBy("gram").agg(F.count_distinct("form").alias("df")).select("gram", (F.lit(1.0) / F.sqrt("df")).alias("weight"))
    index = unit_vectors(entries.join(rarity, "gram").select("lead", "form", "gram", "gap", F.when(F.col("gap"), 1.0).otherwise(F.col("n") * F.col("weight")).alias("v")), ["lead", "form"])

    words = stems.withColumn("side", F.split("stem", r"\|")[0]).withColumn("word", F.concat("side", F.split("stem", r"\|")[1])).select("stem", "side", "word")
    weighed = counted(words, "word", longest).join(rarity, "gram", "left").select("stem", "side", "word", "gram", "gap", F.when(F.col("gap"), 1.0).otherwise(F.col("n") * F.coalesce("weight", F.lit(STRANGE))).alias("v"))
    asked = unit_vectors(weighed, ["stem", "side", "word"]).withColumnRenamed("v", "q")
    hits = asked.join(index, "gram").where((F.col("side") == "") | F.col("form").startswith(F.col("side"))).groupBy("stem", "word", "lead", "form").agg(F.sum(F.col("q") * F.col("v")).alias("score"))
    per_lead = hits.groupBy("stem", "word", "lead").agg(F.max("score").alias("score"), F.max_by("form", F.struct("score", "form")).alias("form"))
    # the catalog's leads are few, and fewer of them share a gram with one word
    top = per_lead.groupBy("stem", "word").agg(F.sort_array(F.collect_list(F.struct("score", "lead", "form")), asc=False).alias("ranked"))
    best = F.col("ranked")[0]
    close = F.filter("ranked", lambda c: c["score"] > best["score"] - margin)
    near = F.array_sort(F.transform(close, lambda c: F.struct(edit_distance(F.col("word"), c["form"]).alias("edits"), c["lead"].alias("lead"), c["score"].alias("score"))))
    decided = top.select("stem", best.alias("best"), F.size(close).alias("n_close"), F.when(F.size(close) > 1, near).alias("near"))
    first, second = F.col("near")[0], F.col("near")[1]
    verdict = F.when(F.col("best")["score"] < threshold, "too far").when((F.col("n_close") > 1) & (first["edits"] == second["edits"]), "ambiguous").otherwise("accepted")
    lead = F.when(F.col("n_close") > 1, first["lead"]).otherwise(F.col("best")["lead"])
    return decided.select("stem", F.when(verdict == "accepted", lead).alias("lead"), F.col("best")["score"].alias("score"), verdict.alias("verdict"))


def map_values(values: DataFrame, catalog: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """value, catalog_id, score, verdict for each distinct ``value`` (null included)."""
    distinct = values.select("value").distinct().withColumn("s", spelled("value"))
    parsed = distinct.select("value", F.col("s.stem").alias("stem"), F.col("s.number").alias("number"), F.col("s.reason").alias("reason"))
    stems = parsed.where("reason = ''").select("stem").distinct()
    matched = match_stems(stems, catalog, threshold, margin)
    contacts = catalog.groupBy(F.upper(F.trim("lead_label")).alias("lead"), F.col("contact_no").alias("number")).agg(F.min("catalog_id").alias("catalog_id"))
    # merged, as the optimizer doesn't foresee the size of what Python returns and would broadcast all values
    found = parsed.join(matched.hint("merge"), "stem", "left").join(contacts, ["lead", "number"], "left")
    verdict = F.when(F.col("reason") != "", F.col("reason")).when(F.col("verdict").isNull(), "no candidate").when((F.col("verdict") == "accepted") & F.col("catalog_id").isNull(), "no such contact").otherwise(F.col("verdict"))
    return found.select("value", "catalog_id", "score", verdict.alias("verdict"))


def map_tables(tables: dict[str, DataFrame], catalog: DataFrame) -> DataFrame:
    """tab, row_key, value, catalog_id, verdict for each row of tables with row_key and value."""
    rows = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("tab"), "row_key", "value")
        rows = part if rows is None else rows.unionByName(part)
    mapped = map_values(rows, catalog).withColumnRenamed("value", "_v")
    # missing values, perhaps many, need no partner and must not meet in one task of the join
    blank = rows.where("value is null").select("tab", "row_key", "value", F.lit(None).cast("long").alias("catalog_id"), F.lit("missing").alias("verdict"))
    written = rows.where("value is not null").join(mapped, F.col("value") == F.col("_v"), "left")
    return written.select("tab", "row_key", "value", "catalog_id", "verdict").unionByName(blank)


def rewritten(mapped: DataFrame, catalog: DataFrame) -> DataFrame:
    """tab, row_key, catalog_id of the matched rows whose value is not the catalog's label letter for letter."""
    labels = catalog.select(F.col("catalog_id").alias("_id"), "elec_label")
    hit = mapped.where("catalog_id is not null").join(labels, F.col("catalog_id") == F.col("_id"))
    return hit.where(F.col("value") != F.col("elec_label")).select("tab", "row_key", "catalog_id")


def unmatched(mapped: DataFrame) -> DataFrame:
    """value, verdict, n_rows: the report of what has no entry."""
    return mapped.where("catalog_id is null").groupBy("value", "verdict").agg(F.count("*").alias("n_rows"))
