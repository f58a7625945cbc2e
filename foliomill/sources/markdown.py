"""Markdown sectionizer: one row per section, fence-aware, in document order."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HEADING = re.compile(r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$")
_FENCE = re.compile(r"^ {0,3}(```|~~~)")


def sections(text: str | None, split_level: int = 2) -> list[tuple[int, int, int, str, str]]:
    """(ordinal, parent ordinal or -1, level, heading, body) of the headings up to ``split_level``.

    Deeper headings stay in the body; text before the first heading is dropped.
    """
    out: list[tuple[int, int, int, str, list[str]]] = []
    stack: list[tuple[int, int]] = []
    fence = None
    for line in re.split(r"\r\n?|\n", text or ""):
        mark = _FENCE.match(line)
        if mark:
            fence = None if fence == mark.group(1) else fence or mark.group(1)
        found = None if fence or mark else _HEADING.match(line)
        if found and len(found.group(1)) <= split_level:
            level = len(found.group(1))
            while stack and stack[-1][1] >= level:
                stack.pop()
            out.append((len(out), stack[-1][0] if stack else -1, level, found.group(2), []))
            stack.append((len(out) - 1, level))
        elif out:
            out[-1][4].append(line)
    return [(o, p, n, h, "\n".join(b).strip()) for o, p, n, h, b in out]


def sectionize(docs: DataFrame, key: str, text: str, split_level: int = 2) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *s) for k, t in zip(batch["key"], batch["text"], strict=True) if isinstance(t, str) for s in sections(t, split_level)]
            yield pd.DataFrame(rows, columns=["key", "ordinal", "parent", "level", "heading", "body"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"key {kind}, ordinal int, parent int, level int, heading string, body string").withColumnRenamed("key", key)


#: Fenced blocks, which are never cut, and paragraphs.
_BLOCK = r"((?:```|~~~)(?s:.*?)(?:\n *(?:```|~~~)[^\n]*+|\z)|[^\n]++(?:\n(?!\s*+\n|```|~~~)[^\n]++)*+)"


def parts(body: Column, most: int = 4000) -> Column:
    """Blocks of a section packed greedily into parts of at most ``most`` characters; a larger block is a part of its own."""
    blocks = F.filter(F.regexp_extract_all(body, F.lit(_BLOCK), F.lit(1)), lambda b: F.trim(b) != "")

    def pack(packed: Column, block: Column) -> Column:
        last, before = F.element_at(packed, -1), F.slice(packed, F.lit(1), F.size(packed) - 1)
        fits = F.length(last) + F.length(block) <= most
        return F.when(last == "", F.array(block)).when(fits, F.concat(before, F.array(F.concat(last, F.lit("\n\n"), block)))).otherwise(F.concat(packed, F.array(block)))

    return F.filter(F.aggregate(blocks, F.array(F.lit("")), pack), lambda p: p != "")
