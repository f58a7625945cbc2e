"""Variant spellings of names typed by people: noisy-channel attribution.

Rows are parsed into people, bodies and rows that name two people. Distinct forms with their
frequencies then go through one channel model: a form is attached to the candidate of the
greatest posterior, which is the candidate's frequency (prior) times the likelihood that it was
typed as the form. Forms and candidates meet through shared keys, never as all pairs of a group:

1. typos, in given names, in surnames and in the names of bodies: candidates share a delete; the
   likelihood falls with the weighted edit cost;
2. nicknames: candidates are the full names of that surname that the nickname may stand for
   (``SHORT``), and, with the little weight ``ELSEWHERE``, those of all other surnames;
3. dropped parts: middle initials, generation marks, given names cut to an initial or left out
   (``DROPPED``); an initial that the full form lacks is far less likely (``ADDED``).

In 2 and 3 a form is attached only where one candidate holds the share ``CERTAIN`` of the
posterior: what fits two people about as well belongs to none. Attachments by typos are chained
with hash-to-min, so an attachment to a form that is itself attached ends at the same entity.

A surname spelling shared by people of several initials is the name of a family rather than a slip;
it is attached only to a spelling shared by ``FAMILY`` times as many initials. Bodies are told by
the words for their kind (a list, endings such as -ation, their place in the name); the words of
the kind must agree.

Frequencies are partial aggregations over all rows. Delete keys take in the whole word, or both
ends of a long one, so no key collects more than the spellings of near names. Nothing is
collected to the driver; Python stages are spread by the number of rows.

Defined results: rows with a null id or a null or blank name take no part; a row that names
two people is an entity of its own ("y" or "et" between a given name with surname and a lone
second surname names one); of repeated rows of an id the greatest name counts; equal posteriors
go to the smaller spelling; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from foliomill.llm.groups import hash_to_min
from foliomill.llm.spelling import deletes, fold, hidden, repair, squeeze, typo_cost
from foliomill.runtime import cut, spread

#: Titles, roles and degrees that belong to no name (fixed values).
NOISE = frozenset("dr prof professor mr mrs ms sir phd md msc ed eds editor author by the llc inc ltd".split())
#: Generation marks (fixed values).
GENERATIONS = {"jr": "jr", "junior": "jr", "sr": "sr", "senior": "sr", "ii": "ii", "iii": "iii", "iv": "iv"}
#: Particles that begin a surname (fixed values).
PARTICLES = frozenset("van von der den de del della di da dos du la le al el ter ten bin ibn zu".split())
#: Words that name kinds of bodies, with what may stand for them (fixed values).
BODY_WORDS = {
    "foundation": ("foundation", "fdn", "found"),
    "institute": ("institute", "inst"),
    "center": ("center", "centre", "ctr"),
    "association": ("association", "assoc", "assn"),
    "collective": ("collective", "coll"),
    "university": ("university", "univ"),
    "department": ("department", "dept"),
    "laboratory": ("laboratory", "lab"),
    "working": ("working", "wkg"),
    "group": ("group", "grp"),
    "society": ("society", "soc"),
    "committee": ("committee", "comm"),
    "consortium": ("consortium", "cons"),
    "standards": ("standards", "stds"),
    "software": ("software", "softw", "sw"),
    "documentation": ("documentation", "doc", "docs"),
    "engineering": ("engineering", "eng"),
    "clinical": ("clinical", "clin"),
    "messaging": ("messaging", "msg"),
    "semantics": ("semantics", "sem"),
    "interoperability": ("interoperability", "interop"),
    "informatics": ("informatics", "inf"),
    "systems": ("systems", "sys", "syst"),
    "applied": ("applied", "appl"),
    "open": ("open",),
    "data": ("data",),
    "graph": ("graph",),
}
_BODY_HEADS = frozenset("foundation institute center association collective university department laboratory society committee consortium".split())
#: Other words that name a body where they stand last in a name, or in front of "of" or "for" (fixed values).
_OTHER_HEADS = frozenset("council agency bureau ministry office authority academy college school company board union alliance network team project press library museum hospital trust forum club league service services".split())
_HEAD_ENDING = re.compile(r"(?:[aieo]tion|ment|ology|ometry|ics|ware|works|ship)s?$")
#: Short forms of given names (fixed values).
NICKNAMES = {
    "abigail": "abby gail", "alexander": "alex sasha xander", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny", "charles": "charlie chuck",
    "christopher": "chris kit", "daniel": "dan danny", "deborah": "deb debbie", "dmitri": "dima mitya", "eduardo": "lalo edu", "edward": "ed eddie ted ned",
    "ekaterina": "katya kate", "elizabeth": "liz beth betty lizzie eliza", "francesca": "fran franny cesca", "frederick": "fred freddy", "gabriella": "gabby ella",
    "gerald": "gerry jerry", "gregory": "greg", "guadalupe": "lupe lupita", "harold": "hal harry", "henrik": "rik hank", "ignacio": "nacho", "isabella": "bella izzy isa",
    "james": "jim jimmy jamie", "jennifer": "jen jenny", "jonathan": "jon jonny", "jose": "pepe", "joseph": "joe joey", "katherine": "kate katie kathy kit", "lawrence": "larry",
    "leonard": "len lenny leo", "margaret": "maggie peggy meg", "matthew": "matt", "michael": "mike mick", "natalya": "natasha", "nicholas": "nick nico", "oliver": "ollie",
    "oluwaseun": "seun", "patricia": "pat patty trish", "philippa": "pippa", "rajesh": "raj", "ramon": "moncho", "rebecca": "becky becca", "richard": "rick dick rich",
    "robert": "bob bobby rob robbie", "ronald": "ron ronnie", "samuel": "sam sammy", "stephen": "steve", "susan": "sue susie", "tadeusz": "tadek", "theodore": "theo ted",
    "thomas": "tom tommy", "timothy": "tim", "valentina": "vale val", "victoria": "vicky tori", "vincent": "vince vinny", "vladislav": "vlad", "william": "bill billy will",
    "wolfgang": "wolf", "xavier": "xavi javi", "zachary": "zach zack",
}
SHORT_OF = [(short, full) for full, shorts in NICKNAMES.items() for short in shorts.split()]

#: Spellings differ by at most so many edits.
MAX_EDITS = 2
#: Longest word whose keys are deletes of the whole, and letters taken from each end of a longer one (2 * ENDS <= WHOLE - MAX_EDITS + 1, so the ends stay apart).
WHOLE, ENDS = 12, 5
#: Log-odds that one unit of typo cost takes from a candidate's prior.
PENALTY = 1.2
#: Likelihoods of typing a nickname, of dropping a part and of adding a middle initial.
SHORT, DROPPED, ADDED = 0.2, 0.3, 1e-5
#: Weight of a full name seen with other surnames only.
ELSEWHERE = 1e-4
#: Share of the posterior that one candidate must hold.
CERTAIN = 0.98
#: A family's spelling is a slip of one that so many times as many initials share.
FAMILY = 8
#: Rows that a name of NICKNAMES counts for beside those it stands in.
LISTED = 5
#: Words held to be given names when they stand first in so many different rows.
KNOWN_GIVEN = 3

PARSED = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "first", "last", "middle", "gen", "given", "surname", "body")] + [T.StructField("order", T.StringType())])
_PAIR = re.compile(r"\s(?:&|and|with|und)\s|;\s*(?=\S)", re.I)
#: Joins two people, or the two surnames of one.
_AND = re.compile(r"\s(?:et|y)\s", re.I)
_ROLE = re.compile(r"[(\[][^)\]]*[)\]]")


@lru_cache(1 << 16)
def body_word(word: str) -> str | None:
    for name, forms in BODY_WORDS.items():
        if word in forms:
            return name
    if len(word) >= 4:
        near = [(typo_cost(word, n, 2.0), n) for n in BODY_WORDS if abs(len(n) - len(word)) <= 2]
        if near and min(near)[0] <= (0.75 if len(word) < 5 else 1.0 if len(word) < 8 else 2.0):
            return min(near)[1]
    return None


def _body(words: list[str]) -> tuple[str, str] | None:
    kinds = [body_word(w) for w in words]
    listed = sum(k is not None for k in kinds) >= 2 and (set(kinds) & _BODY_HEADS or {"working", "group"} <= set(kinds))
    if not listed:
        heads = [w in _OTHER_HEADS or kind in _BODY_HEADS or (len(w) > 7 and _HEAD_ENDING.search(w) is not None) for w, kind in zip(words, kinds, strict=True)]
        last = len(words) > 2 and heads[-1] and min(map(len, words)) > 1
        if not last and not any(head and nxt in ("of", "for") for head, nxt in zip(heads, words[1:], strict=False)):
            return None
        kinds = [kind or (w if head else None) for w, kind, head in zip(words, kinds, heads, strict=True)]
    own = [w for w, k in zip(words, kinds, strict=True) if k is None and w not in ("of", "on", "for", "and", "the")]
    return "".join(own), " ".join(sorted(k for k in kinds if k))


def _two_people(plain: str) -> bool:
    if _PAIR.search(plain):
        return True
    sides = [side.split() for side in _AND.split(plain.split(",")[0])]
    if len(sides) < 2:
        return False
    return not (len(sides) == 2 and len(sides[1]) == 1 and ("," in plain or len(sides[0]) > 1))


def parse(name: str | None) -> dict | None:
    """The parts of a typed name; ``order`` is 'sure' where a comma or a lone word tells the surname."""
    if name is None or not squeeze(name):
        return None
    text = " ".join(hidden(repair(name)).replace("​", "").split())
    plain = _ROLE.sub(" ", text).strip(" ;.")
    words = [w for w in re.split(r"[^\w'’-]+", fold(plain)) if w]
    body = _body([w for w in words if w not in NOISE])
    blank = dict.fromkeys(("first", "last", "middle", "gen", "given", "surname", "body"))
    if body:
        return blank | {"kind": "body", "surname": body[0], "body": body[1], "order": "sure"}
    if _two_people(plain):
        return blank | {"kind": "two", "order": "sure"}
    parts = [[w for w in re.split(r"[\s.]+", fold(p)) if squeeze(w)] for p in plain.split(",")]
    gen = next((GENERATIONS[squeeze(w)] for p in parts for w in p if squeeze(w) in GENERATIONS), None)
    parts = [[w for w in p if squeeze(w) not in GENERATIONS and squeeze(w) not in NOISE] for p in parts]
    parts = [p for p in parts if p]
    if not parts:
        return None
    if len(parts) > 1:
        return blank | _person(parts[1], parts[0]) | {"kind": "person", "gen": gen, "order": "sure"}
    words = parts[0]
    if len(words) == 1:
        return blank | {"kind": "person", "surname": squeeze(words[0]), "given": "", "middle": "", "gen": gen, "order": "sure"}
    if words[0] in PARTICLES and len(words) > 2:
        end = next(i for i, w in enumerate(words) if w not in PARTICLES) + 1
        if end < len(words):
            return blank | _person(words[end:], words[:end]) | {"kind": "person", "gen": gen, "order": "sure"}
    cut_at = next((i for i in range(1, len(words)) if words[i] in PARTICLES and i < len(words) - 1), None)
    if len(words) > 3 and words[-2] in ("y", "et"):
        cut_at = min(len(words) - 3, cut_at or len(words))
    if cut_at is None:
        cut_at = len(words) - 1
        last_is_initial = len(squeeze(words[-1])) == 1
        if last_is_initial:
            return blank | _person(words[1:], words[:1]) | {"kind": "person", "gen": gen, "order": "sure"}
    out = blank | _person(words[:cut_at], words[cut_at:]) | {"kind": "person", "gen": gen, "order": "sure"}
    if len(words) == 2 and len(squeeze(words[0])) > 1:
        out |= {"order": "guess", "first": squeeze(words[0]), "last": squeeze(words[1])}
    return out


def _person(given: list[str], surname: list[str]) -> dict:
    names = [squeeze(w) for w in given]
    middle = "".join(w[0] for w in names[1:] if w and w not in PARTICLES)
    particles = [w for w in names[1:] if w in PARTICLES]
    return {"given": names[0] if names else "", "middle": middle, "surname": "".join(particles) + "".join(squeeze(w) for w in surname)}


@pandas_udf(PARSED)
def parse_udf(names: pd.Series) -> pd.DataFrame:
    found = [parse(n) or dict.fromkeys(PARSED.names) for n in names]
    return pd.DataFrame(found, columns=PARSED.names, dtype=object)


def near_keys(word: str) -> list[str]:
    """Keys that two words within MAX_EDITS edits share: deletes of the whole word, or of both ends of a long one."""
    whole = deletes(word, MAX_EDITS if len(word) > 5 else 1, WHOLE) if len(word) <= WHOLE else []
    if len(word) <= WHOLE - MAX_EDITS:
        return whole
    # lengths about the limit have both kinds of keys
    head, tail = word[:ENDS], word[: -ENDS - 1 : -1]
    return whole + sorted({f"{x}|{y}" for n in range(MAX_EDITS + 1) for x in deletes(head, n) for y in deletes(tail, MAX_EDITS - n)})


@pandas_udf(T.ArrayType(T.StringType()))
def near_keys_udf(words: pd.Series) -> pd.Series:
    return words.map(near_keys)


@pandas_udf(T.DoubleType())
def cost_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([typo_cost(x, y, 3.0) for x, y in zip(a, b, strict=True)], dtype="float64")


def channel(forms: DataFrame, key: list[str], word: str, count: str, most: Column) -> DataFrame:
    """(key..., word, canon): each spelling with the candidate of the greatest posterior.

    Candidates are spellings that share ``key`` and a delete and rank before the spelling by
    (count, spelling). The posterior is log count minus PENALTY times the typo cost; the
    spelling itself stands with its own count and no cost. ``most`` bounds the cost; it may use the
    other columns of ``forms``, those of the candidate under the name ``canon_...``.
    """
    extra = [c for c in forms.columns if c not in (*key, word, count)]
    keyed = cut(spread(forms, word).select(*key, word, count, *extra, F.explode(near_keys_udf(word)).alias("_near")))
    other = keyed.select(*key, F.col(word).alias("canon"), F.col(count).alias("canon_count"), *[F.col(c).alias(f"canon_{c}") for c in extra], "_near")
    before = (F.col("canon_count") > F.col(count)) | ((F.col("canon_count") == F.col(count)) & (F.col("canon") < F.col(word)))
    # the deletes are many times what their source's size suggests: never a broadcast
    met = keyed.join(other.hint("merge"), [*key, "_near"]).where(before).drop("_near").distinct()
    priced = met.withColumn("cost", cost_udf(word, "canon")).where(F.col("cost") <= most)
    posterior = F.log(F.col("canon_count") + 1.0) - PENALTY * (F.col("cost") - 1.0)
    better = priced.withColumn("score", posterior).where(F.col("score") >= F.log(F.col(count) + 1.0) - PENALTY)
    best = better.groupBy(*key, word).agg(F.max(F.struct("score", "canon_count", "canon")).alias("b"))
    return best.select(*key, word, F.col("b.canon").alias("canon"))


def certain(offers: DataFrame, form: list[str], candidate: str, weight: str) -> DataFrame:
    """(form..., candidate): the candidate that holds CERTAIN of the posterior of each form; ``weight`` is frequency times likelihood."""
    each = offers.groupBy(*form, candidate).agg(F.sum(weight).alias("_w"))
    best = each.groupBy(*form).agg(F.max(F.struct("_w", candidate)).alias("_b"), F.sum("_w").alias("_all"))
    return best.where(F.col("_b._w") >= CERTAIN * F.col("_all")).select(*form, F.col(f"_b.{candidate}").alias(candidate))


def parsed_names(authors: DataFrame, author_id: str, name: str) -> DataFrame:
    """(id, kind, given, middle, surname, gen, body) of each row, with guessed orders decided by how often a word stands first."""
    rows = authors.where(F.col(author_id).isNotNull()).groupBy(F.col(author_id).cast("long").alias("id")).agg(F.max(name).alias("name"))
    parsed = cut(spread(rows, "id").select("id", parse_udf("name").alias("p")).select("id", "p.*").where("kind is not null"))
    firsts = parsed.where("kind = 'person' and length(given) > 1").groupBy(F.col("given").alias("word")).agg(F.countDistinct("surname").alias("n"))
    guess = parsed.where("order = 'guess'")
    weighed = guess.join(firsts.select(F.col("word").alias("first"), F.col("n").alias("n_first")), "first", "left").join(firsts.select(F.col("word").alias("last"), F.col("n").alias("n_last")), "last", "left")
    swap = (F.coalesce("n_last", F.lit(0)) >= KNOWN_GIVEN) & (F.coalesce("n_last", F.lit(0)) > F.coalesce("n_first", F.lit(0)))
    decided = weighed.select("id", "kind", F.when(swap, F.col("last")).otherwise(F.col("given")).alias("given"), "middle", F.when(swap, F.col("first")).otherwise(F.col("surname")).alias("surname"), "gen", "body")
    return parsed.where("order = 'sure'").select(decided.columns).unionByName(decided)


def canonical_given(people: DataFrame) -> DataFrame:
    """Adds ``g``: the given name with rare spellings attached to frequent or well-known ones."""
    spark = people.sparkSession
    listed = spark.createDataFrame([(n,) for n in sorted({*NICKNAMES, *[short for short, _ in SHORT_OF]})], "given string").withColumn("listed", F.lit(LISTED))
    seen = people.where(F.length("given") > 1).groupBy("given").agg(F.countDistinct("surname").alias("n"))
    given = seen.join(F.broadcast(listed), "given", "full").select("given", (F.coalesce("n", F.lit(0)) + F.coalesce("listed", F.lit(0))).alias("n"), F.col("listed").isNotNull().alias("listed"))
    given = cut(given)
    rare = channel(given, [], "given", "n", F.when(F.length("given") <= 3, 0.75).when(F.length("given") <= 6, 1.0).otherwise(2.0))
    known = given.join(rare, "given").join(given.select(F.col("given").alias("canon"), F.col("n").alias("m")), "canon")
    taken = (F.col("m") >= F.when(F.col("n") <= 2, 4).otherwise(15) * F.col("n")) & ~F.col("listed")
    return people.join(known.where(taken).select("given", F.col("canon").alias("g")), "given", "left").withColumn("g", F.coalesce("g", "given"))


def entities(authors: DataFrame, author_id: str, name: str) -> DataFrame:
    """(id, entity): rows of one entity share the value, the smallest id; a row alone stands with its own id."""
    rows = cut(parsed_names(authors, author_id, name))
    people = canonical_given(rows.where("kind = 'person'")).select("id", "g", F.coalesce("middle", F.lit("")).alias("m"), "surname", F.coalesce("gen", F.lit("")).alias("gen"))
    people = _named(cut(people)).withColumn("key", F.substring("g", 1, 1))
    bodies = rows.where("kind = 'body'").select("id", F.lit("").alias("g"), F.lit("").alias("m"), "surname", F.lit("").alias("gen"), F.concat(F.lit("body "), "body").alias("key"))
    named = cut(people.unionByName(bodies))

    # a spelling shared by people of several initials is the name of a family, not a slip
    families = named.where("g <> ''").groupBy("surname").agg(F.countDistinct("key").alias("initials")).where("initials > 1")
    is_body = F.col("key").startswith("body ")
    forms = named.groupBy("key", "surname").agg(F.count("*").alias("n")).join(families, "surname", "left")
    forms = forms.select("key", "surname", (F.col("n") + F.when(is_body, 0).otherwise(F.coalesce("initials", F.lit(0)))).alias("n"), F.when(is_body, 1).otherwise(F.coalesce("initials", F.lit(1))).alias("spread"))
    limit = F.when((F.col("spread") > 1) & (F.col("canon_spread") < FAMILY * F.col("spread")), -1.0).when(F.length("surname") <= 5, 1.0).otherwise(2.0)
    named = cut(_settle(named, channel(cut(forms), ["key"], "surname", "n", limit), ["key"], "surname"))

    of_bodies = named.where(is_body).select("id", F.concat_ws("|", "key", "surname").alias("form"))
    links = cut(_links(named.where(~is_body).drop("key")).unionByName(of_bodies))
    first = links.groupBy("form").agg(F.min("id").alias("entity"))
    alone = rows.where("kind = 'two'").select("id", F.col("id").alias("entity"))
    return links.join(first, "form").select("id", "entity").unionByName(alone)


def _settle(df: DataFrame, attached: DataFrame, key: list[str], word: str) -> DataFrame:
    """Replaces each spelling by the end of its chain of attachments."""
    own = attached.select(F.concat_ws("|", *key, word).alias("a"), F.concat_ws("|", *key, "canon").alias("b"))
    chained = hash_to_min(own, "a", "b").select(F.col("vertex").alias("_form"), F.col("group").alias("_group"))
    return df.withColumn("_form", F.concat_ws("|", *key, word)).join(chained, "_form", "left").withColumn(word, F.coalesce("_group", "_form")).drop("_form", "_group")


def _named(people: DataFrame) -> DataFrame:
    """Nicknames stand for the full name of the greatest posterior among those of the surname and of all names."""
    shorts = F.broadcast(people.sparkSession.createDataFrame(SHORT_OF, "g string, long string"))
    full = people.where(F.length("g") > 1).groupBy("surname", "g").agg(F.count("*").alias("n"))
    means = full.select("surname", "g").join(shorts, "g")
    here = means.join(full.select("surname", F.col("g").alias("long"), F.col("n")), ["surname", "long"], "left")
    certainly = certain(here.withColumn("weight", (F.coalesce("n", F.lit(0)) + ELSEWHERE) * SHORT), ["surname", "g"], "long", "weight")
    return people.join(certainly, ["surname", "g"], "left").withColumn("g", F.coalesce("long", "g")).drop("long")


def _links(people: DataFrame) -> DataFrame:
    """(id, form): each person with the full form it stands for."""
    people = cut(_named(people))
    forms = people.groupBy("surname", "g", "m", "gen").agg(F.count("*").alias("n"))

    # a form without middle initial or generation mark stands for the one fuller form that it may have been cut from
    full = cut(forms.where(F.length("g") > 1))
    longer = full.where(F.length("m") > 1).select("surname", "g", F.col("m").alias("longer"), F.explode(F.sequence(F.lit(1), F.length("m") - 1)).alias("k"), (F.col("n") * DROPPED).alias("w"))
    longer = certain(longer.withColumn("m", F.expr("left(longer, k)")), ["surname", "g", "m"], "longer", "w")
    full = cut(full.join(longer, ["surname", "g", "m"], "left").select("surname", "g", F.col("m").alias("typed"), F.coalesce("longer", "m").alias("m"), "gen", "n"))
    middles = certain(full.where("m <> ''").withColumn("w", F.col("n") * DROPPED), ["surname", "g"], "m", "w").withColumnRenamed("m", "one_m")
    marks = certain(full.where("gen <> ''").withColumn("w", F.col("n") * DROPPED), ["surname", "g"], "gen", "w").withColumnRenamed("gen", "one_gen")
    whole = full.join(middles, ["surname", "g"], "left").join(marks, ["surname", "g"], "left")
    m2 = F.when(F.col("m") == "", F.coalesce("one_m", "m")).otherwise(F.col("m"))
    gen2 = F.when(F.col("gen") == "", F.coalesce("one_gen", "gen")).otherwise(F.col("gen"))
    whole = cut(whole.select("surname", "g", F.col("typed").alias("m"), "gen", "n", m2.alias("m2"), gen2.alias("gen2")))
    entity = F.concat_ws("|", "surname", "g", "m2", "gen2")

    # what each full form may be cut to: the given name to an initial or nothing, and without middle initials or mark
    ends = whole.groupBy("surname", "g", "m2", "gen2").agg(F.sum("n").alias("n")).select("surname", F.substring("g", 1, 1).alias("i"), "m2", "gen2", entity.alias("form"), F.col("n").cast("double").alias("n"))
    part = lambda kept, name: F.struct(kept.alias(name), F.lit(1.0).alias("p"))
    less = lambda name: F.struct(F.lit("").alias(name), F.lit(DROPPED).alias("p"))
    starts = F.transform(F.sequence(F.lit(0), F.length("m2")), lambda k: F.struct(F.substr("m2", F.lit(1), k).alias("m"), F.when(k == F.length("m2"), 1.0).otherwise(DROPPED).alias("p"))).cast("array<struct<m:string,p:double>>")
    m = F.when(F.col("m2") == "", F.array(part(F.lit(""), "m"), F.struct(F.lit("*").alias("m"), F.lit(ADDED).alias("p")))).otherwise(starts)
    gen = F.when(F.col("gen2") == "", F.array(part(F.lit(""), "gen"))).otherwise(F.array(part(F.col("gen2"), "gen"), less("gen")))
    offered = ends.select("surname", "form", "n", F.explode(F.array(part(F.col("i"), "i"), less("i"))).alias("i"), m.alias("m"), gen.alias("gen"))
    offered = offered.select("surname", "form", "n", "i", F.explode("m").alias("m"), "gen").select("surname", "form", "n", "i", "m", F.explode("gen").alias("gen"))
    offered = offered.select("surname", "i.i", "m.m", "gen.gen", "form", (F.col("n") * F.col("i.p") * F.col("m.p") * F.col("gen.p")).alias("w"))

    # middle initials may also have been added to a form that has none or one
    short = forms.where(F.length("g") <= 1).select("surname", F.col("g").alias("i"), "m", "gen")
    typed = F.array(part(F.col("m"), "m"), F.when(F.col("m") != "", part(F.lit("*"), "m")), F.when(F.length("m") > 1, F.struct(F.substring("m", 1, 1).alias("m"), F.lit(ADDED).alias("p"))))
    typed = F.array_compact(typed.cast("array<struct<m:string,p:double>>"))
    asked = short.select("surname", "i", F.col("m").alias("typed"), "gen", F.explode(typed).alias("t")).select("surname", "i", "typed", "gen", "t.m", "t.p")
    fits = certain(asked.join(offered, ["surname", "i", "m", "gen"]).withColumn("w", F.col("w") * F.col("p")), ["surname", "i", "typed", "gen"], "form", "w").withColumnRenamed("typed", "m")
    fitted = short.join(fits, ["surname", "i", "m", "gen"], "left").withColumn("form", F.coalesce("form", F.concat_ws("|", F.lit("short"), "surname", "i", "m", "gen")))
    known = whole.select("surname", "g", "m", "gen", entity.alias("form")).unionByName(fitted.withColumnRenamed("i", "g"))
    return people.join(known, ["surname", "g", "m", "gen"]).select("id", "form")


def same_pairs(found: DataFrame, id_a: str, id_b: str) -> DataFrame:
    """All pairs of rows of one entity, smaller id first."""
    a = found.select("entity", F.col("id").alias(id_a))
    b = found.select("entity", F.col("id").alias(id_b))
    return a.join(b, "entity").where(F.col(id_a) < F.col(id_b)).select(id_a, id_b)
