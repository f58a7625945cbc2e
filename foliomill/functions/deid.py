"""De-identification of columns, JVM-side; keyed hashing is HMAC-SHA256 built from sha2."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of personal identifiers, in reporting order (fixed values).
PHI_PATTERNS = (
    ("ssn", r"\b(?!000|666|9\d{2})\d{3}-?(?!00)\d{2}-?(?!0000)\d{4}\b"),
    ("phone", r"(?:\+?1[\s.-]?)?(?:\(\d{3}\)|\d{3})[\s.-]\d{3}[\s.-]\d{4}\b"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("iso_date", r"\b(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b"),
    ("mrn_like", r"\b\d{12,}\b"),
)

#: Shapes of typed dates and their forms (fixed values).
FORMS = (
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{14}$", "yyyyMMddHHmmss"),
    (r"^\d{12}$", "yyyyMMddHHmm"),
)


def hmac_hex(value: Column, salt: str) -> Column:
    """HMAC-SHA256 of a string column under ``salt`` (at most 64 bytes), as hex."""
    key = salt.encode().ljust(64, b"\0")
    if len(key) > 64:
        raise ValueError("salt must be at most 64 bytes")
    inner = F.lit(bytes(b ^ 0x36 for b in key))
    outer = F.lit(bytes(b ^ 0x5C for b in key))
    first = F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256)
    return F.sha2(F.concat(outer, F.unhex(first)), 256)


def pseudonym(value: Column, salt: str, length: int = 16) -> Column:
    if length < 4:
        raise ValueError("length must be at least 4")
    return F.substring(hmac_hex(value, salt), 1, length)


def subject_offset(value: Column, salt: str, most: int = 60) -> Column:
    """Days in [-most, most], the same for all dates of a subject."""
    head = F.conv(F.substring(hmac_hex(value, salt), 1, 16), 16, 10).cast("decimal(20,0)")
    return (F.pmod(head, F.lit(2 * most + 1).cast("decimal(20,0)")) - most).cast("int")


def age_band(born: Column, at: Column, size: int = 5) -> Column:
    """'40-44'; '90+' from 90; null for a birth after ``at``."""
    had = (F.month(at) > F.month(born)) | ((F.month(at) == F.month(born)) & (F.dayofmonth(at) >= F.dayofmonth(born)))
    age = F.year(at) - F.year(born) - F.when(had, 0).otherwise(1)
    low = F.floor(age / size) * size
    return F.when(age >= 90, "90+").when(age >= 0, F.concat(low.cast("string"), F.lit("-"), (low + size - 1).cast("string")))


def truncate_zip(zip_code: Column, allowed: list[str] | None = None) -> Column:
    """The first three digits where the allow-list holds them, else null; null for all without a list."""
    three = F.substring(F.regexp_replace(zip_code, "[^0-9]", ""), 1, 3)
    return F.when(three.isin(allowed), three) if allowed else F.lit(None).cast("string")


def year_only(date: Column) -> Column:
    """The year of a typed date (2024-05-06, 20240506, 2024-05 or 2024); null for anything else."""
    shape = r"^\s*((?:19|20)\d{2})(?:-?(?:0[1-9]|1[0-2])(?:-?(?:0[1-9]|[12]\d|3[01])(?:[T ].*)?)?)?\s*$"
    return F.nullif(F.regexp_extract(date, shape, 1), F.lit("")).cast("int")


def shifted(date: Column, days: Column) -> Column:
    """A typed date moved by ``days``, in the form it was typed in; null where no form fits.

    Forms: 2024-05-06, 20240506, 05/06/2024, 2024-05-06T10:20:30, 2024-05-06 10:20:30, 20240506102030 and 202405061020.
    """
    out = F.lit(None).cast("string")
    for shape, form in FORMS:
        moved = F.try_to_timestamp(date, F.lit(form)) + F.make_interval(days=days)
        out = F.when(date.rlike(shape), F.date_format(moved, form)).otherwise(out)
    return out


def k_anonymize(df: DataFrame, quasi: list[str], k: int = 5) -> DataFrame:
    """Quasi-identifiers of combinations with fewer than ``k`` rows become '*'; nulls are a value.

    Counts are pre-aggregated and joined back, so a combination with most of the rows is no hot task.
    """
    counts = df.groupBy(*quasi).agg(F.count("*").alias("_n")).select("_n", *[F.col(q).alias(f"_{q}") for q in quasi])
    on = reduce(Column.__and__, [F.col(q).eqNullSafe(F.col(f"_{q}")) for q in quasi])
    joined = df.join(counts, on)
    return joined.select(*[F.when(F.col("_n") < k, F.lit("*")).otherwise(F.col(c).cast("string")).alias(c) if c in quasi else F.col(c) for c in df.columns])


def phi_matches(text: Column) -> Column:
    """Array of (kind, match) over PHI_PATTERNS."""

    def named(kind: str):
        return lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("match"))

    return F.flatten(F.array(*[F.transform(F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)), named(kind)) for kind, p in PHI_PATTERNS]))
