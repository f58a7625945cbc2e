"""Verdicts of votes and their spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The four verdicts, in the order that decides ties (fixed values).
LABELS = ("CORROBORATES", "CONTRADICTS", "SUPERSEDED", "UNRELATED")
#: How a verdict may begin, letters only and in upper case (fixed values).
SPELLINGS = (("CORROBORAT", 0), ("CONTRADICT", 1), ("SUPERSED", 2), ("UNRELATED", 3), ("NOTRELATED", 3))


def label_index(verdict: Column) -> Column:
    """Position in ``LABELS`` of a typed verdict; null for what is no vote."""
    letters = F.regexp_replace(F.upper(verdict), "[^A-Z]", "")
    out = F.lit(None).cast("int")
    for start, index in SPELLINGS:
        out = F.when(letters.startswith(start), index).otherwise(out)
    return out
