"""Mapping free-entered values to a reference list by a symmetric-delete dictionary.

Both sides are cleaned to (name, kind words): legal forms, places, years and lead-ins go; the
words for the kind of house (Press, Books, ...) are told apart from the name, in front of it
or behind it, abbreviated or misspelt. Every name of the list is entered into a dictionary
under each string that up to ``max_edits`` deletions leave of its first ten letters; a typed
name is looked up under its own deletions, so any pair within the bound meets in an equi-join.
Met pairs are ranked by weighted Damerau-Levenshtein cost, then by how often the entry was
typed without a slip. Where several entries share the name, the kind words decide.

The dictionary is broadcast only if it is proven to fit ``MAX_DICTIONARY_BYTES`` (a name has at most
``KEYS`` keys of ten letters); a longer list is joined by shuffling. Work is done once per distinct
value, so a value typed by a third of all rows costs no more than a rare one; Python stages are
spread by the number of their rows. Write the result as a table before joining it back to the rows:
a join of plain shuffles is split by AQE where one value holds most rows.

Defined results: null and blank values give no row from ``match_values``; values that name no
entry, or a name shared by several entries without a kind word that decides, give a null
entry; equal costs go to the entry typed more often without a slip, then the smaller id.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from foliomill.llm.spelling import deletes, fold, repair, squeeze, typo_cost
from foliomill.runtime import cut, spread

#: Words for the kind of house with their abbreviations (fixed values).
KINDS = {
    "press": ("press", "pr", "prs"),
    "books": ("books", "book", "bks", "bk"),
    "media": ("media", "med"),
    "medical": ("medical", "med"),
    "verlag": ("verlag", "vlg", "verl"),
    "house": ("house", "hse", "haus"),
    "technical": ("technical", "tech", "techn"),
    "academic": ("academic", "acad"),
    "university": ("university", "univ"),
    "publications": ("publications", "publication", "publns", "pubs", "pubn", "publ"),
    "publishers": ("publishers", "publisher", "publ", "pubs", "pub"),
    "publishing": ("publishing", "pubg", "pub", "publ"),
    "editions": ("editions", "edition", "edns", "eds", "edn", "ed"),
    "education": ("education", "educ", "edu"),
}
#: Legal forms and words without meaning (fixed values).
LEGAL = frozenset("ltd limited llc inc incorporated gmbh co company corp plc sa ag bv pvt group the and et und y".split())
LEADS = re.compile(r"^(?:published by|publ(?:isher)?[.:]|pub\.|c/o|by|imprint of|an imprint of|©|\(c\)|copyright)\s*", re.I)
YEARS = re.compile(r"\b(?:1[5-9]|20)\d\d\b")

MAX_EDITS = 3
MAX_DICTIONARY_BYTES = 64 << 20
#: Most keys of a name: its first ten letters with up to MAX_EDITS left out.
KEYS = 1 + 10 + 45 + 120
HYPOTHESES = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType())), T.StructField("slips", T.DoubleType())]))


def allowed(length: int) -> float:
    """Largest typo cost for a name of ``length`` letters."""
    return 1.0 if length <= 5 else 2.0 if length <= 8 else 3.0


@lru_cache(1 << 16)
def kinds_of(word: str) -> tuple[tuple[str, ...], float]:
    """The kinds that ``word`` may stand for, and the cost of the slips in it."""
    exact = tuple(k for k, forms in KINDS.items() if word in forms)
    if exact:
        return exact, 0.0
    if len(word) < 4:
        return (), 0.0
    limit = 1.0 if len(word) < 8 else 2.0
    costs = {k: typo_cost(word, k, limit) for k in KINDS}
    least = min(costs.values())
    return (tuple(k for k, c in costs.items() if c == least), least) if least <= limit else ((), 0.0)


def words_of(value: str) -> list[str]:
    """Cleaned words of a typed value, in order."""
    text = " ".join(repair(value).split())
    while (shorter := LEADS.sub("", text)) != text:
        text = shorter
    text = re.sub(r"[(\[][^)\]]*[)\]]", " ", text)
    head, colon, tail = text.partition(":")
    if colon and squeeze(tail) and not tail.startswith("//"):
        text = tail
    text = YEARS.sub(" ", fold(text))
    text = re.sub(r"\b([a-z])\.\s?([a-z])\.(?:\s?([a-z])\.)?", r"\1\2\3", text)
    return [w for w in re.split(r"[^\w]+|_", text) if w and w not in LEGAL]


def hypotheses(value: str | None) -> list[tuple[str, list[str], float]]:
    """Ways to read a value as a name with kind words behind it or in front of it."""
    if value is None:
        return []
    words = words_of(value)
    kinds = [kinds_of(w) for w in words]
    found: dict[str, tuple[str, list[str], float]] = {}
    for n in range(len(words), 0, -1):
        for name, rest in ((words[:n], kinds[n:]), (words[-n:], kinds[:-n])):
            if all(k for k, _ in rest):
                key = "".join(name)
                slips = sum(c for _, c in rest)
                if key not in found or slips < found[key][2]:
                    found[key] = (key, ["|".join(k) for k, _ in rest], slips)
    return list(found.values())


@pandas_udf(HYPOTHESES)
def hypotheses_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda v: [{"name": n, "kinds": k, "slips": s} for n, k, s in hypotheses(v)])


@pandas_udf(T.ArrayType(T.StringType()))
def deletes_udf(words: pd.Series) -> pd.Series:
    return words.map(lambda w: deletes(w, MAX_EDITS if len(w) > 8 else 2 if len(w) > 5 else 1))


@pandas_udf(T.ArrayType(T.StringType()))
def all_deletes_udf(words: pd.Series) -> pd.Series:
    return words.map(lambda w: deletes(w, MAX_EDITS))


@pandas_udf(T.DoubleType())
def cost_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([typo_cost(x, y, MAX_EDITS) for x, y in zip(a, b, strict=True)], dtype="float64")


@pandas_udf(T.ArrayType(T.StringType()))
def entry_words_udf(names: pd.Series) -> pd.Series:
    """[name, kind words joined by ' ', initials] of an entry of the list."""

    def split(name: str) -> list[str]:
        words = words_of(name)
        n = len(words)
        while n > 1 and any(words[n - 1] in forms for forms in KINDS.values()):
            n -= 1
        return ["".join(words[:n]), " ".join(words[n:]), "".join(w[0] for w in words) if len(words) > 2 else ""]

    return names.map(split)


def kind_fits(typed: str, entry: str) -> Column:
    """Whether typed kind words (alternatives joined by '|') read as the entry's kind words."""
    own = F.filter(F.split(entry, " "), lambda x: x != "")
    each = F.zip_with(typed, own, lambda words, kind: F.array_contains(F.split(words, "[|]"), kind))
    return (F.size(typed) == F.size(own)) & F.forall(each, lambda x: x)


def reference_names(reference: DataFrame, entry_id: str, name: str) -> DataFrame:
    """(entry, name, kind, initials, shared) of a reference list; rows with a null id or name are ignored."""
    rows = reference.where(F.col(entry_id).isNotNull() & F.col(name).isNotNull())
    parts = rows.select(F.col(entry_id).alias("entry"), entry_words_udf(F.col(name)).alias("w")).distinct()
    named = parts.select("entry", F.col("w")[0].alias("name"), F.col("w")[1].alias("kind"), F.col("w")[2].alias("initials")).where("name <> ''")
    shared = named.groupBy("name").agg((F.countDistinct("entry") > 1).alias("shared"))
    return named.join(shared, "name")


def match_values(values: DataFrame, value: str, reference: DataFrame, entry_id: str, name: str) -> DataFrame:
    """(value, entry, cost): the entry of ``reference`` each distinct value means, null if none."""
    distinct = cut(values.where(F.trim(F.regexp_replace(F.col(value), r"[\s\x{A0}\x{FEFF}]+", " ")) != "").groupBy(F.col(value).alias("value")).agg(F.count("*").alias("rows")))
    entries = cut(reference_names(reference, entry_id, name))
    readings = spread(distinct, "value").select("value", "rows", F.explode(hypotheses_udf("value")).alias("h")).select("value", "rows", F.col("h.name").alias("typed"), F.col("h.kinds").alias("kinds"), F.col("h.slips").alias("slips"))
    readings = cut(readings)

    names = entries.select("name").distinct()
    dictionary = names.select("name", F.explode(all_deletes_udf("name")).alias("left_over"))
    most = names.agg(F.sum(KEYS * (F.octet_length("name") + 72))).first()[0]
    typed = cut(readings.select("typed").distinct())
    looked_up = spread(typed, "typed").select("typed", F.explode(deletes_udf("typed")).alias("left_over"))
    met = cut(looked_up.join(F.broadcast(dictionary) if (most or 0) <= MAX_DICTIONARY_BYTES else dictionary.hint("merge"), "left_over").select("typed", "name").distinct())
    shorter = F.least(F.length("typed"), F.length("name"))
    near = cut(spread(met, "typed", "name").withColumn("cost", cost_udf("typed", "name")).where(F.col("cost") <= F.when(shorter <= 5, 1.0).when(shorter <= 8, 2.0).otherwise(3.0)))
    acronyms = entries.where("initials <> ''").groupBy("initials").agg(F.min("entry").alias("entry"), F.countDistinct("entry").alias("n")).where("n = 1")
    short = distinct.where(F.col("value").rlike(r"^\s*[A-Z]{3,6}\.?\s*$")).select("value", F.lower(F.regexp_replace("value", r"[\s.]", "")).alias("initials")).join(acronyms, "initials").select("value", "entry", F.lit(2.0).alias("total"), F.lit(0).alias("usual"))

    usual = readings.join(names.withColumnRenamed("name", "typed"), "typed", "left_semi").groupBy(F.col("typed").alias("name")).agg(F.sum("rows").alias("usual"))
    ranked = readings.join(near, "typed").join(entries, "name").join(usual, "name", "left")
    fits = ranked.where(~F.col("shared") | kind_fits("kinds", "kind"))
    scored = fits.select("value", "entry", (F.col("cost") + F.col("slips")).alias("total"), F.coalesce("usual", F.lit(0)).alias("usual")).unionByName(short)
    best = scored.groupBy("value").agg(F.min(F.struct("total", (-F.col("usual")).alias("u"), "entry")).alias("b"))
    return distinct.join(best, "value", "left").select("value", F.col("b.entry").alias("entry"), F.col("b.total").alias("cost"))

