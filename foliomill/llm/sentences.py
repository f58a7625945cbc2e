"""Sentence boundaries across languages and scripts, in SQL expressions only.

Two passes over each text, both of which keep its length:

1. dots that end nothing are masked with a private-use placeholder: those of abbreviations,
   initials, German ordinals, decimals, versions, file names and URLs;
2. the masked text is cut into pieces by one expression that walks from sentence to sentence.
   A piece is a fenced block, a table, a heading, or a run of prose (perhaps behind a list
   marker) up to a terminator of its script; quotations and brackets are stepped over whole.

Offsets are sums of the pieces' lengths; white space is trimmed from both ends; ``restore``
gives the text of a piece back. Everything runs row by row in the JVM and nothing is shuffled.
The pieces of a text are exploded in three steps (runs of ``GROUP`` x ``GROUP`` pieces, then of
``GROUP``, then single ones); each row carries its own run and where it begins, never the whole
text, so rows and time grow with the length of a text. Every loop of the expressions is possessive,
so no text makes them backtrack; in texts above ``LONG`` characters openers that nothing closes
are marked beforehand, with the same result, so that no paragraph is searched once per opener.

Rules beyond the obvious: an end mark before a lower-case word ends nothing; a quotation
opened at the start of a sentence goes on with its reporting clause; one opened within a
sentence ends it if it ends with an end mark and no lower-case word follows; a bracket that
is a whole sentence ends behind the bracket; Thai sentences end at spaces between Thai words.
Quotations and brackets are paired within a paragraph, whatever their length.

Defined results: null, empty and blank texts give no rows; offsets count Unicode code points;
U+E001 in a text itself is read as a masked dot (U+E002 and U+E003 as openers that nothing closes); repeated rows are split each on its own;
extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP = 64
LONG = 1 << 16

DOT = "\ue001"
#: Placeholders for openers that nothing closes: those that may follow an end mark without a space, and the others.
OPEN, OPEN_OTHER = "\ue002", "\ue003"

#: Abbreviations that end no sentence, whatever follows; "_" stands for a space or none (fixed values).
ALWAYS = (
    "Mr Mrs Ms Dr Prof Lt St Col Gen Capt Sgt Rev Hon Gov Sen Rep Messrs Mt i.e e.g viz cf approx esp incl vs al "
    "z d.h u.a vgl bzw ca Hr Frl Abb Abs Kap Nr Tab Bd S ggf evtl sog "
    "MM Mme Mlle chap fig art cf env "
    "Sr Sra Srta Dra Ud Uds pág págs núm cap "
    "см рис гл стр им ул ср проф акад тов напр "
    "κ κα δρ βλ κεφ σελ π.χ δηλ αρ "
    "डॉ श्री प्रो पृ सं अ د أ م ص d._h z._B u._a т._е т._к i._e e._g"
).split()
#: Abbreviations that end no sentence before a number (fixed values).
BEFORE_NUMBER = (
    "No Nos p pp Fig Figs Sec Secs Ch Vol Vols Tab Eq Art Ref Refs Ed para ver "
    "Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec janv févr avr juil déc enero feb г п"
).split()
#: Month names behind a German ordinal (fixed values).
MONTHS = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"




def _choice(words: list[str]) -> str:
    """One alternation, grouped by the first letter so that most positions fail at once."""
    by_first: dict[str, list[str]] = {}
    for word in sorted(set(words), key=len, reverse=True):
        for form in sorted({word, word.upper()}):
            by_first.setdefault(form[0], []).append(form[1:].replace(".", "[.]").replace("_", "[ \\x{A0}]?"))
    return "|".join(first + "(?:" + "|".join(rest) + ")" for first, rest in by_first.items())


_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_H = r"[ \t\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_NOT_LINE = r"[^\n\r\x{85}\x{2028}\x{2029}]"
_NEW_WORD = r"(?<![\p{L}\p{N}\p{M}])"

#: Dots (and marks within URLs) that end nothing.
MASK = (
    r"[.?!](?:(?=[\p{Ll}\p{N}_/=&])(?!\p{Ll}\p{Lu})"
    rf"|(?<={_NEW_WORD}(?:{_choice([w for w in ALWAYS if len(w) > 4])})[.])"
    rf"|(?<!\p{{L}}{{5}}[.])(?:(?<={_NEW_WORD}(?:{_choice([w for w in ALWAYS if len(w) <= 4])})[.])"
    rf"|(?<={_NEW_WORD}[\p{{Lu}}\p{{Lo}}][.])(?={_WS}{{0,2}}\p{{L}}|-)"
    rf"|(?={_WS}{{0,2}}[\p{{N}}.])(?<={_NEW_WORD}(?:{_choice(BEFORE_NUMBER)})[.])"
    rf"|(?={_WS}(?:{MONTHS}))(?<=\p{{N}}[.])))"
)

_STOP = ".!?…"
_WIDE = "。！？｡।॥؟"
_CLOSERS = r")\]”’»\"'」』）"
_HAN = r"\x{3040}-\x{30FF}\x{3400}-\x{9FFF}"
_THAI = r"[\x{E01}-\x{E4E}]"
_JOINED = r"[\x{AC00}-\x{D7A3}\x{621}-\x{64A}\x{900}-\x{963}]"
_GREEK = r"[\x{370}-\x{3FF}\x{1F00}-\x{1FFF}]"

_FENCE = r"(?:```|~~~)"
_MARKER = rf"(?:[-*+•]|\d{{1,9}}[.){DOT}]){_H}++"
_HARD = rf"{_H}*+(?:\R|$|#{{1,6}} |{_FENCE}|[|]|[-*+•]{_H}|1[.){DOT}]{_H})"
_SOFT = rf"\R(?!{_HARD})"


#: Openers with what closes them.
_QUOTES = (('"', '"'), ("“", "”"), ("„", "“”"), ("«", "»"), ("「", "」"), ("『", "』"), ("《", "》"))
_BRACKETS = (("(", ")"), ("[", "]"), ("（", "）"))


def _until(closing: str) -> str:
    """All up to a closing mark or the end of the paragraph."""
    inner = rf"[^{re.escape(closing)}\n\r\x{{85}}\x{{2028}}\x{{2029}}]*+"
    return rf"{inner}(?:\R(?!{_H}*+\R){inner})*+"


def _span(opening: str, closing: str) -> str:
    return rf"{re.escape(opening)}{_until(closing)}[{re.escape(closing)}]"


_QUOTE = "(?:" + "|".join(_span(*x) for x in _QUOTES) + ")"
_BRACKET = "(?:" + "|".join(_span(*x) for x in _BRACKETS) + ")"
_ENDED = rf"(?<=[{_STOP}{_WIDE}][)\]）”“»」』\"])"

#: What may follow an end mark that ends a sentence.
_NEXT = rf"{_WS}(?!{_WS}*+\p{{Ll}}(?!\p{{Lu}}))|$"
#: Where sentences are joined without a space.
_JOIN = (
    rf"(?<=[\p{{Ll}}\p{{N}})\]”\"»][{_STOP}]{{1,3}})(?=\p{{Lu}}[\p{{Ll}} ]|[“\"«(¿¡{OPEN}]\p{{Lu}})"
    rf"|(?<={_JOINED}{{2}}[{_STOP}])(?={_JOINED})|(?<=[{_HAN}]…{{1,4}})"
)
#: What may follow a quotation that ends a sentence; Chinese and Japanese text only if a colon introduced the quotation.
_QUOTE_NEXT = rf"{_WS}(?!{_WS}*+\p{{Ll}}(?!\p{{Lu}}))|$|\p{{Lu}}\p{{Ll}}"
_TOLD = "(?<=[:：])"
_ENDS = rf"(?:{_TOLD}{_QUOTE}{_ENDED}(?:{_QUOTE_NEXT}|[{_HAN}])|{_QUOTE}{_ENDED}(?:{_QUOTE_NEXT}))"


def _plain() -> list[str]:
    """Runs of characters without a part in the rules.

    Latin characters are named one by one, which makes their class a bit set; the class of
    the other characters is slower and stands apart.
    """
    special = set(f"{_STOP}{_WIDE}\"“„«「『《([（;;\n\r\x85  ")
    latin = "".join(f"\\x{i:02X}" for i in range(256) if chr(i) not in special)
    others = "".join(f"\\x{{{ord(c):X}}}" for c in sorted(special) if ord(c) > 255)
    return [f"[{latin}]++", rf"[^\x00-\xFF\x{{E01}}-\x{{E4E}}{others}]++"]


def _body(soft: bool) -> str:
    parts = [
        *_plain(),
        rf"[{_STOP}]++[{_CLOSERS}]*+(?!{_NEXT}|{_JOIN})",
        *([_SOFT] if soft else []),
        rf"{_THAI}++(?!(?:{_H}|{_SOFT})++(?![ๆฯ]){_THAI})",
        rf"{_TOLD}{_QUOTE}(?!{_ENDED}(?:{_QUOTE_NEXT}|[{_HAN}]))",
        rf"(?<![:：]){_QUOTE}(?!{_ENDED}(?:{_QUOTE_NEXT}))",
        _BRACKET,
        rf"(?!{_ENDS})[\"“„«「『《(\[（]",
        rf"[;\x{{37E}}](?<!{_GREEK}.)",
    ]
    return "(?:" + "|".join(parts) + ")*+"


_END = rf"(?:[{_STOP}]++[{_CLOSERS}]*+|[{_WIDE}][{_WIDE}!?]*+[{_CLOSERS}]*+|{_QUOTE}|{_THAI}++|[;\x{{37E}}]|)"
_WHOLE = rf"{_BRACKET}{_ENDED}(?={_WS}|$)"
_AT_LINE = rf"(?<=(?:^|[\n\r\x{{85}}\x{{2028}}\x{{2029}}]){_H}{{0,8}})"

#: One sentence with the white space in front of it.
PIECE = (
    rf"{_WS}*+(?:{_AT_LINE}(?:"
    rf"{_FENCE}{_NOT_LINE}*+(?:\R(?!{_H}{{0,3}}{_FENCE}){_NOT_LINE}*+)*+(?:\R{_H}{{0,3}}{_FENCE}{_NOT_LINE}*+)?"
    rf"|[|]{_NOT_LINE}*+(?:\R{_H}{{0,3}}[|]{_NOT_LINE}*+)*+"
    rf"|#{{1,6}} {_NOT_LINE}*+"
    rf"|{_MARKER}(?:{_WHOLE}|{_QUOTE}?+{_body(False)}{_END}))"
    rf"|{_WHOLE}|{_QUOTE}?+{_body(True)}{_END})"
    r"|(?s:.)"
)
#: White space (and U+FEFF) at the ends of a piece.
BLANK = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def _runs(df: DataFrame, size: int) -> DataFrame:
    """(_key, at, parts) with at most ``size`` parts a row; ``at`` is the offset of the first one."""
    last = F.floor((F.size("parts") - 1) / size).cast("int")
    # the groups' arrays stand in a column of their own: an expression used twice would be run twice
    groups = F.transform(F.sequence(F.lit(0), last), lambda g: F.slice("parts", g * size + 1, F.lit(size)))
    cut = df.select("_key", "at", groups.alias("groups"))
    sums = F.transform("groups", lambda g: F.aggregate(g, F.lit(0), lambda n, x: n + F.length(x)))
    summed = cut.select("_key", "at", "groups", sums.alias("sums"))
    before = F.transform("sums", lambda _, i: F.aggregate(F.slice("sums", F.lit(1), i), F.lit(0), lambda n, x: n + x))
    # outer: an inner generator would have a filter on the array's size inferred, which runs the expressions again
    rows = summed.select("_key", "at", F.explode_outer(F.arrays_zip(F.col("groups").alias("parts"), before.alias("before"))).alias("run"))
    return rows.select("_key", (F.col("at") + F.col("run.before")).alias("at"), F.col("run.parts").alias("parts"))


def _with_starts(df: DataFrame) -> DataFrame:
    """One row (_key, at, part) per element of the array ``parts``; ``at`` is the sum of the lengths before it."""
    runs = _runs(_runs(df.withColumn("at", F.lit(0)), GROUP * GROUP), GROUP)
    before = F.transform("parts", lambda _, i: F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x)))
    rows = runs.select("_key", "at", F.explode_outer(F.arrays_zip("parts", before.alias("before"))).alias("one"))
    return rows.select("_key", (F.col("at") + F.col("one.before")).alias("at"), F.col("one.parts").alias("part"))


def _alone(opening: str, closing: str):
    """Marks the openers of a part that begins with one and ends without what closes it."""
    mark = OPEN if opening in "“«(" else OPEN_OTHER
    return lambda part: F.when(part.startswith(opening) & ~F.substring(part, -1, 1).isin(*closing), F.translate(part, opening, mark)).otherwise(part)


def _marked(text: Column) -> Column:
    """The text with placeholders for openers that nothing closes in their paragraph; of the same length.

    From the first such opener to the end of its paragraph all of its kind are such.
    """
    for opening, closing in (*_QUOTES[1:], *_BRACKETS):
        other = "„" if opening == "“" else ""
        kinds = [rf"[^{re.escape(opening + other)}]++", *([rf"„{_until('“”')}[“”]?+"] if other else []), rf"{re.escape(opening)}{_until(closing)}[{re.escape(closing)}]?+"]
        parts = F.regexp_extract_all(text, F.lit("(?:" + "|".join(kinds) + ")"), F.lit(0))
        text = F.array_join(F.transform(parts, _alone(opening, closing)), "")
    return text


def masked(text: Column) -> Column:
    """The text with a placeholder for each dot that ends nothing; of the same length."""
    return F.regexp_replace(text, MASK, DOT)


def restore(text: Column) -> Column:
    """The text with dots for placeholders."""
    return F.translate(text, DOT, ".")


def split_sentences(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sent_start, sent_end) of each sentence of each text."""
    body = F.when(F.length(text) > LONG, _marked(F.col(text))).otherwise(F.col(text))
    pieces = F.regexp_extract_all(masked(body), F.lit(PIECE), F.lit(0))
    rows = documents.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("_key"), pieces.alias("parts"))
    sentences = _with_starts(rows)
    # filtered by the piece itself: a filter on the offsets would be pushed below the explode and split the texts twice
    sentences = sentences.where(F.ltrim("part", F.lit(BLANK)) != "")
    left = F.ltrim("part", F.lit(BLANK))
    start = (F.col("at") + F.length("part") - F.length(left)).cast("long")
    size = F.length(F.rtrim(left, F.lit(BLANK)))
    return sentences.select(F.col("_key").alias(key), start.alias("sent_start"), (start + size).cast("long").alias("sent_end"))
