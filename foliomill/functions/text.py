"""Text helpers as JVM column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a title or query (fixed values).
STOPWORDS = (
    "a", "an", "and", "as", "at", "be", "by", "do", "for", "from",
    "how", "in", "is", "it", "its", "of", "on", "or", "that", "the",
    "this", "to", "vs", "what", "when", "where", "why", "with", "your",
)
#: Words that the full-text index leaves out, beside those.
INDEX_STOPWORDS = (*STOPWORDS, "are", "can", "does", "into", "should", "use", "using", "was", "which", "who", "will", "you")
#: Upper-case words that are no acronyms (fixed values).
NOT_ACRONYMS = (
    "AND", "OR", "OF", "TO", "IN", "AT", "BY", "IS",
    "IT", "AS", "ON", "AN", "DO", "BE", "GO", "I", "A",
    "THE", "FOR", "NEW", "THIS", "WITH",
)


def significant_tokens(text: Column) -> Column:
    """Lower-case tokens without stop words, in order, repeats kept."""
    found = F.regexp_extract_all(text, F.lit("([A-Za-z][A-Za-z0-9_-]+)"), F.lit(1))
    return F.filter(F.transform(found, F.lower), lambda t: ~t.isin(*STOPWORDS))


def index_terms(text: Column) -> Column:
    """Terms of the full-text index: lower-case runs of letters; digits separate."""
    terms = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))
    return F.filter(terms, lambda t: ~t.isin(*INDEX_STOPWORDS))


def acronyms(text: Column) -> Column:
    """Distinct upper-case words of two to six characters, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])([A-Z][A-Z0-9]{1,5})(?![A-Za-z0-9_])"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(*NOT_ACRONYMS)))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def clean_title(text: Column, default: str) -> Column:
    """Title without a trailing ISBN and surrounding space; ``default`` if nothing is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(text, r"-?\b(97[89])?\d{9}[\dX]$", "")), F.lit("")), F.lit(default))


def years(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b((?:19|20)\d\d)\b"), F.lit(1))))


def first_sentence(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"^\s*([^.!?\n]+[.!?]?)", 1))


def initials(text: Column) -> Column:
    """Upper-case first letters of the words; null with fewer than two words."""
    words = F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+)"), F.lit(1))
    return F.when(F.size(words) > 1, F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")))


def token_in_title(title: Column, token: Column) -> Column:
    """Substring test that also accepts the singular of a longer plural."""
    singular = (F.length(token) > 4) & token.endswith("s") & F.contains(F.lower(title), F.regexp_replace(token, "s$", ""))
    return F.contains(F.lower(title), token) | singular


#: Authority of publishers by normalised name (fixed values).
AUTHORITY = {
    "o'reilly": 0.85,
    "o'reilly media": 0.85,
    "manning": 0.85,
    "manning publications": 0.85,
    "pragmatic bookshelf": 0.80,
    "pragmatic programmers": 0.80,
    "addison-wesley": 0.80,
    "addison-wesley professional": 0.80,
    "pearson": 0.78,
    "pearson education": 0.78,
    "morgan kaufmann": 0.80,
    "mit press": 0.85,
    "no starch press": 0.78,
    "apress": 0.72,
    "wiley": 0.72,
    "john wiley & sons": 0.72,
    "wiley & sons": 0.72,
    "wrox": 0.68,
    "packt": 0.65,
    "elsevier": 0.78,
    "ft press": 0.70,
    "morgan kaufmann publishers": 0.80,
    "academic press": 0.78,
    "mcgraw-hill": 0.78,
    "mcgraw hill": 0.78,
    "mcgraw-hill education": 0.78,
    "mcgraw-hill companies": 0.78,
    "crc press": 0.75,
    "taylor & francis": 0.75,
    "taylor & francis group": 0.75,
    "sas institute": 0.70,
    "sas press": 0.70,
    "jossey-bass": 0.72,
    "pearson education india": 0.74,
    "pearson education india services": 0.74,
}
#: Authority of other publishers (fixed value).
DEFAULT_AUTHORITY = 0.6
#: Legal forms and words for the kind of house at the end of a publisher's name.
_FORMS = r"([,\s]+(inc|incorporated|co|company|ltd|limited|llc|llp|pvt|private|plc|gmbh|sa)\.?)+\s*$"
_HOUSES = r"([,\s]+(publishing|publisher|publishers|publications|press|books|media)\.?)+\s*$"


def authority(publisher: Column, known: dict[str, float] | None = None) -> Column:
    """Authority of a publisher: its name as typed, else without legal forms, else without the word for its kind."""
    table = AUTHORITY if known is None else known
    plain = F.regexp_replace(F.translate(F.lower(F.trim(publisher)), "’‘“”", "''\"\""), "^the ", "")
    names = [plain, F.regexp_replace(plain, _FORMS, ""), F.regexp_replace(F.regexp_replace(plain, _FORMS, ""), _HOUSES, "")]
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(*[F.try_element_at(lookup, n) for n in names], F.lit(DEFAULT_AUTHORITY))
