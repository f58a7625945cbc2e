"""HL7 v2 and X12 messages in string columns: parsing, building and structural checks, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Segments each message type must hold (fixed values).
REQUIRED = {
    "ADT^A01": ("MSH", "EVN", "PID", "PV1"),
    "ADT^A03": ("MSH", "EVN", "PID", "PV1"),
    "ADT^A08": ("MSH", "EVN", "PID", "PV1"),
    "ORU^R01": ("MSH", "PID", "OBR", "OBX"),
}


def hl7_segments(message: Column) -> Column:
    """Array of segments, each an array of fields; the field separator counts as MSH-1."""
    lines = F.filter(F.split(message, r"\r\n?|\n"), lambda s: s.rlike(r"^[A-Z][A-Z0-9]{2}\|"))
    return F.transform(lines, lambda s: F.when(s.startswith("MSH|"), F.concat(F.array(F.lit("MSH"), F.lit("|")), F.split(F.substr(s, F.lit(5)), r"\|"))).otherwise(F.split(s, r"\|")))


def hl7_field(message: Column, segment: str, index: int, occurrence: int = 1) -> Column:
    """Field ``index`` (MSH-1 is the separator) of the n-th segment of a kind; null if absent."""
    own = F.filter(hl7_segments(message), lambda s: F.get(s, F.lit(0)) == segment)
    return F.get(F.get(own, F.lit(occurrence - 1)), F.lit(index))


def hl7_missing(message: Column) -> Column:
    """Required segments that the message lacks; null for a type that is not known."""
    kind = F.array_join(F.slice(F.split(hl7_field(message, "MSH", 9), r"\^"), 1, 2), "^")
    there = F.transform(hl7_segments(message), lambda s: F.get(s, F.lit(0)))
    out = F.lit(None).cast("array<string>")
    for name, needed in REQUIRED.items():
        out = F.when(kind == name, F.array_except(F.array(*[F.lit(n) for n in needed]), there)).otherwise(out)
    return out


def hl7_build(segments: Column) -> Column:
    """The message of an array of field arrays, the reverse of ``hl7_segments``."""
    one = lambda s: F.when(F.get(s, F.lit(0)) == "MSH", F.concat(F.lit("MSH|"), F.array_join(F.slice(s, F.lit(3), F.size(s)), "|"))).otherwise(F.array_join(s, "|"))
    return F.array_join(F.transform(segments, one), "\r")


def x12_segments(message: Column) -> Column:
    return F.transform(F.filter(F.split(message, "~"), lambda s: F.trim(s) != ""), lambda s: F.split(F.trim(s), r"\*"))


def x12_build(transaction: str, control: Column, body: Column) -> Column:
    """ST, body and SE; SE01 counts the body and both envelope segments. ``body`` is an array of strings."""
    number = F.lpad(control.cast("string"), 4, "0")
    head = F.concat_ws("*", F.lit("ST"), F.lit(transaction), number)
    tail = F.concat_ws("*", F.lit("SE"), (F.size(body) + 2).cast("string"), number)
    return F.concat(F.array_join(F.concat(F.array(head), body, F.array(tail)), "~"), F.lit("~"))


def x12_errors(message: Column) -> Column:
    """Names of what is wrong with the ST/SE envelope."""
    segments = x12_segments(message)
    first, last = F.get(segments, F.lit(0)), F.get(segments, F.size(segments) - 1)
    no_st, no_se = F.coalesce(F.get(first, F.lit(0)) != "ST", F.lit(True)), F.coalesce(F.get(last, F.lit(0)) != "SE", F.lit(True))
    count = F.coalesce(F.get(last, F.lit(1)) != F.size(segments).cast("string"), F.lit(True))
    control = F.coalesce(F.get(first, F.lit(2)) != F.get(last, F.lit(2)), F.lit(True))
    checks = ((no_st, "no ST"), (no_se, "no SE"), (~no_se & count, "SE01"), (~no_se & ~no_st & control, "control number"))
    return F.array_compact(F.array(*[F.when(c, n) for c, n in checks]))
