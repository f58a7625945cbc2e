"""Evaluation passages leaking into a corpus.

Every item is cut into windows of ``WIDTH`` words, the size that a counting part of an item
(12 words) holds untouched even with two changes at any places. A window's SimHash sums
its words' 64 signs, weighted by how rare the word is among the items; words of no item share
one sign pattern. Documents are slid over with windows of the same size. A multi-index finds
every item window within ``RADIUS`` bits: the 64 bits are cut into ``RADIUS + 2`` blocks, of
which any two fingerprints within the radius share at least two, so each pair of blocks is
looked up for equality and the candidates' whole distance is counted.

Candidates are verified exactly: around the alignments that the windows propose, a passage
counts where some stretch of ``STRETCH`` words stands in the document with at most ``EDITS``
words changed, left out or put in; a word with one typo is half an edit. At most ``TRIM`` edits
may be at the ends of the stretch: with more there, only a shorter phrase is left.

The filter before the look-up loses nothing: a stretch with at most ``EDITS`` edits holds ``WIDTH``
unchanged words in a row, whose window has the fingerprint of the item's own. It only keeps windows
out of which more than one word stands in no item.

General notices are no passages. They are told from the side of the items: a stretch belongs to a
notice where it stands at the end of at least ``NOTICE_ITEMS`` other items behind different words,
and in at least ``NOTICE_PAGES`` different surroundings (``CONTEXT`` words on both sides) of documents
and items.
Both limits are the same at every size. A passage may stand in any number of documents, copies of a
page have one surrounding, and text that several items share otherwise leads to each of them.
``notices`` tells what was held to be one.

Scale: documents are scanned in one pass without a shuffle; only hits are aggregated. The
items' index is broadcast in blocks of at most ``BLOCK_ITEMS`` items and ``BLOCK_CHARS``
characters, one scan each, and released after it. How rare a word is, is counted over all items before
(in ``COUNTERS`` hashed counters), so results don't depend on the blocks.

Defined results: null, empty and blank texts hold nothing, and such items are found nowhere;
repeated rows of a document or an item give one row per (document, item); an item shorter
than a stretch counts when it stands whole; Chinese and Japanese are compared by character,
with ``STRETCH_CHARS`` characters to a stretch and ``EDITS_CHARS`` edits; markup, case, spacing, punctuation and
invisible characters are not compared; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.spelling import hidden
from foliomill.runtime import cut

WIDTH = 4
RADIUS = 3
STRETCH, STRETCH_CHARS = 12, 20
#: Words (characters) that may be changed, left out or put in within a stretch, and how many of them at its ends.
EDITS, EDITS_CHARS = 2, 4
TRIM, TRIM_CHARS = 1, 2
#: The share of a stretch's weight that must stand unchanged: the same phrase about other rare names is no passage.
KEPT = 0.78
#: Costs of an edit and of a word with one typo, and what no stretch can cost; below UNIT stands the lost weight in 1/100.
UNIT = 1_000_000
CHANGED, MISSPELT, FAR = 2 * UNIT, UNIT, 1000 * UNIT
NOTICE_ITEMS, NOTICE_PAGES = 2, 10
#: Diagonals that are tried together.
BAND = 4
#: Words on each side of a found part that tell one page from another.
CONTEXT = 3
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 20_000_000
COUNTERS = 1 << 18

_CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿"
_WORD = re.compile(rf"[{_CJK}]|[^\W_{_CJK}]+")
_ASCII_WORD = re.compile("[a-z0-9]+")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>|&(?:nbsp|amp|quot|lt|gt);")


def words(text: str) -> list[str]:
    """Comparable words: letters and digits, Chinese and Japanese by character."""
    if "<" in text or "&" in text:
        text = _TAG.sub("", text)
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return _WORD.findall(unicodedata.normalize("NFKC", hidden(text)).casefold())


@lru_cache(1 << 16)
def misspelt(a: str, b: str) -> bool:
    """One letter more, less or another, or two neighbours swapped; in words of four letters or more."""
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1:
        return False
    short, most = min(len(a), len(b)), max(len(a), len(b))
    head = next((i for i in range(short) if a[i] != b[i]), short)
    tail = next((i for i in range(short - head) if a[-1 - i] != b[-1 - i]), short - head)
    return head + tail >= most - 1 or (len(a) == len(b) == head + tail + 2 and a[head] == b[head + 1] and a[head + 1] == b[head])


def padded(parts: list[np.ndarray], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """All parts in one array with gaps wider than any stretch before, between and behind, and where each begins."""
    pad = 2 * STRETCH_CHARS
    lengths = np.array([len(x) + pad for x in parts], dtype=np.int64)
    begin = np.append(0, np.cumsum(lengths))[:-1] + pad
    flat = np.full(int(lengths.sum()) + pad, gap, dtype=np.int32)
    for at, x in zip(begin.tolist(), parts, strict=True):
        flat[at : at + len(x)] = x
    return flat, begin


def counter(word: str) -> int:
    return zlib.crc32(word.encode()) % COUNTERS


def word_counts(texts: list[str]) -> np.ndarray:
    """In how many texts each counter's words stand."""
    out = np.zeros(COUNTERS, dtype=np.int32)
    for t in texts:
        out[sorted({counter(w) for w in words(t)})] += 1
    return out


def unique_rows(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct rows of integer columns, sorted; each row is one number of mixed radix as long as that fits."""
    if not len(columns[0]):
        return columns
    low = [int(c.min()) for c in columns]
    size = [int(c.max()) - x + 1 for c, x in zip(columns, low, strict=True)]
    if math.prod(size) >= 1 << 62:
        rows = np.unique(np.stack(columns, 1), axis=0)
        return tuple(rows[:, i] for i in range(len(columns)))
    code = np.zeros(len(columns[0]), dtype=np.int64)
    for c, x, n in zip(columns, low, size, strict=True):
        code = code * n + (c - x)
    code = np.unique(code)
    out = []
    for x, n in zip(reversed(low), reversed(size), strict=True):
        out.append(code % n + x)
        code //= n
    return tuple(reversed(out))


class ItemIndex:
    """Windows, fingerprints and words of a block of items; ``counts`` and ``n`` are those of all items."""

    def __init__(self, ids: list[int], texts: list[str], counts: np.ndarray | None = None, n: int | None = None):
        self.ids = np.array(ids, dtype=np.int64)
        tokens = [words(t) for t in texts]
        self.vocabulary = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for t in tokens for w in t))}
        counts, n = (word_counts(texts), len(texts)) if counts is None else (counts, n)
        self.weight = np.array([1.0 + math.log(max(n, 1))] + [1.0 + math.log(n / counts[counter(w)]) for w in self.vocabulary])
        signs = np.random.default_rng(7).integers(0, 2, (len(self.weight), 64)) * 2 - 1
        self.signed = (signs * np.round(self.weight * 8)[:, None]).astype(np.int16)
        self.tokens = [np.array([self.vocabulary[w] for w in t], dtype=np.int32) for t in tokens]
        self.by_char = [bool(t) and sum(len(w) == 1 and ord(w) > 0x3000 for w in t) * 2 > len(t) for t in tokens]
        self.rule = [self._rule(len(t), c) for t, c in zip(tokens, self.by_char, strict=True)]
        self.of_rule = {rule: np.array([x == rule for x in self.rule]) for rule in set(self.rule)}
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.words = ["", *self.vocabulary]
        self._index()
        self.flat, self.begin = padded(self.tokens, -3)
        self._stretches()

    @staticmethod
    def _rule(m: int, by_char: bool) -> tuple[int, int, int]:
        """(words of a stretch, edits, edits at its ends) of an item of m words; short items in proportion."""
        size, edits, trim = (STRETCH_CHARS, EDITS_CHARS, TRIM_CHARS) if by_char else (STRETCH, EDITS, TRIM)
        part = min(m, size) * edits // size
        return min(m, size), part, min(trim, part)

    def _index(self) -> None:
        rows, item, at = [], [], []
        for k, t in enumerate(self.tokens):
            for a in range(len(t) - WIDTH + 1):
                rows.append(t[a : a + WIDTH])
                item.append(k)
                at.append(a)
        windows = np.array(rows, dtype=np.int32).reshape(-1, WIDTH)
        prints = self.fingerprints(windows)
        item, at = np.array(item, dtype=np.int32), np.array(at, dtype=np.int32)
        order = np.argsort(prints, kind="stable")
        prints, item, at = prints[order], item[order], at[order]
        kept, start = np.unique(prints, return_index=True)
        ends = np.append(start[1:], len(prints))[: len(start)]
        self.prints = kept
        self.span = np.stack([start, ends], 1) if len(kept) else np.zeros((0, 2), dtype=np.int64)
        self.item, self.at = item, at
        edges = np.linspace(0, 64, RADIUS + 3).astype(int)
        blocks = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.masks = [np.uint64(x | y) for i, x in enumerate(blocks) for y in blocks[i + 1 :]]
        self.tables = []
        for mask in self.masks:
            keys = self.prints & mask
            order = np.argsort(keys, kind="stable")
            there = np.zeros(1 << 22, dtype=bool)
            there[self._slot(keys)] = True
            self.tables.append((keys[order], order, there))

    def _stretches(self) -> None:
        """Numbers the stretches by their words: one that stands in several items is aligned once."""
        self.stretch_at = np.full(len(self.flat), -1, dtype=np.int64)
        first, item, start = [], [], []
        held = [np.zeros(0, dtype=np.int64)]
        for rule, mine in self.of_rule.items():
            k = np.flatnonzero(mine & (self.length >= max(rule[0], 1)))
            n = self.length[k] - rule[0] + 1
            k = np.repeat(k, n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            where = self.begin[k] + at
            if not len(where):
                continue
            _, one, number = np.unique(self.flat[where[:, None] + np.arange(rule[0])], axis=0, return_index=True, return_inverse=True)
            self.stretch_at[where] = number.ravel() + sum(map(len, first))
            first.append(where[one])
            item.append(k)
            start.append(at)
            held.append(where)
        self.first = np.concatenate([*first, np.zeros(0, dtype=np.int64)])
        order = np.argsort(self.stretch_at[np.concatenate(held)], kind="stable")
        self.holder = np.concatenate([*item, np.zeros(0, dtype=np.int64)])[order]
        self.holder_start = np.concatenate([*start, np.zeros(0, dtype=np.int64)])[order]
        self.holders = np.append(0, np.cumsum(np.bincount(self.stretch_at[np.concatenate(held)], minlength=len(self.first))))

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    def fingerprints(self, windows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(windows), dtype=np.uint64)
        for a in range(0, len(windows), 1 << 16):
            part = windows[a : a + (1 << 16)]
            sums = self.signed[part[:, 0]].copy()
            for j in range(1, WIDTH):
                sums += self.signed[part[:, j]]
            out[a : a + len(part)] = np.packbits(sums > 0, axis=1).view(np.uint64).ravel()
        return out

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (position in ``prints``, position in ``self.prints``) within RADIUS bits."""
        left, right = [], []
        for mask, (keys, order, there) in zip(self.masks, self.tables, strict=True):
            masked = prints & mask
            maybe = np.flatnonzero(there[self._slot(masked)])
            wanted = masked[maybe]
            lo, hi = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
            some = hi > lo
            maybe, lo, n = maybe[some], lo[some], (hi - lo)[some]
            if not len(maybe):
                continue
            a = np.repeat(maybe, n)
            b = order[np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())]
            close = np.bitwise_count(prints[a] ^ self.prints[b]) <= RADIUS
            left.append(a[close])
            right.append(b[close])
        if not left:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return unique_rows(np.concatenate(left), np.concatenate(right))

    def _aligned(self, rule: tuple[int, int, int], flat: np.ndarray, spelt: list[str], stretch: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows (row, cost, begin, end) of each stretch that stands at about word ``at`` of ``flat``.

        The alignments tried are those that begin at one of ``BAND`` words from ``at`` on, and two beside them. Each of the
        ``trim`` words that may be changed at the ends counts as an edit; what is left begins and ends
        with a match.
        """
        size, edits, trim = rule
        own = self.flat[self.first[stretch][:, None] + np.arange(size)]
        where = at[:, None, None] + np.arange(size)[:, None] + np.arange(-2, BAND + 2)
        there = flat[np.clip(where, 0, len(flat) - 1)]
        same = there == own[:, :, None]
        rows = np.flatnonzero(same.any(2).sum(1) >= size - 2 * edits)
        own, where, there = own[rows], where[rows], there[rows]
        lost = np.round(100 * self.weight[own]).astype(np.int64)
        whole = same[rows].all(1)
        straight = whole.argmax(1)
        total, begin, end = np.zeros(len(rows), dtype=np.int64), straight, (size - 1) * (BAND + 4) + straight
        rest = np.flatnonzero(~whole.any(1))
        total[rest], begin[rest], end[rest] = self._edited(rule, own[rest], where[rest], there[rest], same[rows[rest]], lost[rest], spelt)
        good = np.flatnonzero(self._enough(total, lost, edits))
        cells = where[good].reshape(len(good), size * (BAND + 4))
        at = np.arange(len(good))
        return np.stack([rows[good], total[good], cells[at, begin[good]], cells[at, end[good]]], 1)

    def _edited(self, rule: tuple[int, int, int], own: np.ndarray, where: np.ndarray, there: np.ndarray, same: np.ndarray, lost: np.ndarray, spelt: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``_cheapest`` of stretches that don't stand word for word; typos are looked for where it is not enough."""
        _, edits, trim = rule
        cost = np.where(same, 0, CHANGED + lost[:, :, None])
        total, begin, end = self._cheapest(cost, lost, edits, trim)
        bad = np.flatnonzero(~self._enough(total, lost, edits))
        if len(bad):
            for n, i, x in zip(*np.nonzero(there[bad] == 0), strict=True):
                if misspelt(self.words[own[bad[n], i]], spelt[where[bad[n], i, x]]):
                    cost[bad[n], i, x] = MISSPELT
            total[bad], begin[bad], end[bad] = self._cheapest(cost[bad], lost[bad], edits, trim)
        return total, begin, end

    @staticmethod
    def _enough(total: np.ndarray, lost: np.ndarray, edits: int) -> np.ndarray:
        return (total // UNIT * UNIT <= CHANGED * edits) & (total % UNIT <= (1 - KEPT) * lost.sum(1))

    @staticmethod
    def _cheapest(cost: np.ndarray, lost: np.ndarray, edits: int, trim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cost, cell of the first match, cell of the last match) of the best alignment of each stretch; ``cost[n, i, s]`` is that of word i on diagonal s."""
        n, size, wide = cost.shape
        total, begin, end = np.full(n, FAR), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        least = lost.min(1)[:, None] if n else lost[:, :1]
        for less in range(trim + 1):
            for p in range(less + 1):
                q = size - less + p
                d = np.where(cost[:, p] < CHANGED, cost[:, p], FAR)
                for j in range(p + 1, q):
                    new = d + cost[:, j]
                    if j == q - 1:
                        d = np.where(cost[:, j] < CHANGED, new, FAR)
                        break
                    new[:, :-1] = np.minimum(new[:, :-1], d[:, 1:] + CHANGED + lost[:, j, None])
                    for _ in range(edits):
                        new[:, 1:] = np.minimum(new[:, 1:], new[:, :-1] + CHANGED + least)
                    d = new
                at = d.argmin(1)
                one = d.min(1) + CHANGED * less + lost[:, :p].sum(1) + lost[:, q:].sum(1)
                first = (np.abs(np.arange(wide) - at[:, None]) + wide * (cost[:, p] >= CHANGED)).argmin(1)
                better = one < total
                total = np.where(better, one, total)
                begin, end = np.where(better, p * wide + first, begin), np.where(better, (q - 1) * wide + at, end)
        return total, begin, end

    @staticmethod
    def _contexts(found: np.ndarray, spelt: list[str]) -> list[tuple[int, bool]]:
        """For each row (.., start, cost, first and last word) the hash of the words on both sides of the run of stretches that it stands in, and whether the run ends the text behind others."""
        out = []
        for run in np.split(found, np.flatnonzero(np.diff(found[:, 2]) > 1) + 1):
            begin, end = int(run[0, 4]), int(run[-1, 5]) + 1
            around = "\n".join([*spelt[max(begin - CONTEXT, 0) : begin], "", *spelt[end : end + CONTEXT]])
            out += [(int.from_bytes(hashlib.blake2b(around.encode(), digest_size=8).digest(), "big", signed=True), begin > 0 and end >= len(spelt) - 1)] * len(run)
        return out

    def _tries(self, rule: tuple[int, int, int], document: np.ndarray, k: np.ndarray, diagonal: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, stretch, band) of all stretches that hold one of the windows; every stretch that counts holds a window that proposes it."""
        ahead = max(rule[0] - WIDTH, 0) + 1
        document, k, diagonal = (np.repeat(x, ahead) for x in (document, k, diagonal))
        start = (at[:, None] - np.arange(ahead)).ravel()
        there = (start >= 0) & (start + rule[0] <= self.length[k])
        return unique_rows(document[there], self.stretch_at[self.begin[k[there]] + start[there]], (diagonal + start)[there] // BAND)

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, list[int], list[tuple[int, bool]]]]:
        """(position of the text, position of the item, similarity, counting starts, their contexts) of each leak."""
        get = self.vocabulary.get
        spelt = [words(t) if t else [] for t in texts]
        ids = [np.array([get(w, 0) for w in t], dtype=np.int32) for t in spelt]
        if not len(self.prints) or sum(map(len, ids)) < WIDTH:
            return
        flat, begin = padded(ids, -2)
        known = np.append(0, np.cumsum(flat > 0))
        gap = np.append(0, np.cumsum(flat < 0))
        first = np.flatnonzero((known[WIDTH:] - known[:-WIDTH] >= WIDTH - 1) & (gap[WIDTH:] == gap[:-WIDTH]))
        if not len(first):
            return
        windows = np.stack([flat[first + j] for j in range(WIDTH)], 1)
        left, right = self.near(self.fingerprints(windows))
        n = self.span[right, 1] - self.span[right, 0]
        entry = np.repeat(self.span[right, 0] - np.append(0, np.cumsum(n)[:-1])[: len(n)], n) + np.arange(n.sum())
        w = np.repeat(first[left], n)
        document = np.searchsorted(begin, w, "right") - 1
        k, at = self.item[entry].astype(np.int64), self.at[entry].astype(np.int64)
        diagonal = w - begin[document] - at
        strings = [""] * len(flat)
        for x, t in zip(begin.tolist(), spelt, strict=True):
            strings[x : x + len(t)] = t
        found = []
        for rule in set(self.rule):
            mine = np.flatnonzero(self.of_rule[rule][k])
            tries = self._tries(rule, document[mine], k[mine], diagonal[mine], at[mine])
            for a in range(0, len(tries[0]), 5000):
                d, stretch, bands = (x[a : a + 5000] for x in tries)
                row, cost, left_end, right_end = self._aligned(rule, flat, strings, stretch, begin[d] + BAND * bands).T
                d = d[row]
                first, n = self.holders[stretch[row]], self.holders[stretch[row] + 1] - self.holders[stretch[row]]
                holder = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                found.append(np.stack([np.repeat(d, n), self.holder[holder], self.holder_start[holder], *(np.repeat(x, n) for x in (cost, left_end - begin[d], right_end - begin[d]))], 1))
        if not found:
            return
        best = np.concatenate(found)
        best = best[np.lexsort(best.T[::-1])]
        best = best[np.append(True, (best[1:, :3] != best[:-1, :3]).any(1))[: len(best)]]
        for one in np.split(best, np.flatnonzero((best[1:, :2] != best[:-1, :2]).any(1)) + 1) if len(best) else []:
            d, i = one[0, :2].tolist()
            score = 1 - int(one[:, 3].min()) // UNIT * UNIT / (CHANGED * self.rule[i][0])
            yield d, i, score, one[:, 2].tolist(), self._contexts(one, spelt[d])


_built: dict[int, ItemIndex] = {}


def _index_of(shared) -> ItemIndex:
    """The index of a broadcast block, built once per Python worker."""
    key = shared.value[0]
    if key not in _built:
        _built.clear()
        _built[key] = ItemIndex(*shared.value[1:])
    return _built[key]


def _item_blocks(items: DataFrame) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Items (item, version, text) in id order in blocks of a bounded number of rows and characters."""
    ids: list[int] = []
    versions: list[int] = []
    texts: list[str] = []
    size = 0
    for row in items.orderBy("item", "version").toLocalIterator():
        if ids and (len(ids) >= BLOCK_ITEMS or size + len(row["text"]) > BLOCK_CHARS):
            yield ids, versions, texts
            ids, versions, texts, size = [], [], [], 0
        ids.append(row["item"])
        versions.append(row["version"])
        texts.append(row["text"])
        size += len(row["text"])
    yield ids, versions, texts


def _all_counts(items: DataFrame) -> tuple[np.ndarray, int]:
    """``word_counts`` of all items (at most COUNTERS rows come back) and the number of items."""

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = word_counts(batch["text"].tolist())
            at = np.flatnonzero(found)
            yield pd.DataFrame({"counter": at, "n": found[at]})

    counts = np.zeros(COUNTERS, dtype=np.int32)
    for row in items.select("text").mapInPandas(per_batch, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).collect():
        counts[row["counter"]] = row["n"]
    return counts, items.count()


_numbers = count()


_HIT = "own boolean, item long, version long, similarity double, starts array<int>, contexts array<long>, tails array<boolean>, by_char boolean"


def _hits(documents: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str) -> DataFrame:
    """Every alignment of a document (``own`` false) or of an item with an item, as a written table."""
    spark = documents.sparkSession
    kind = documents.schema[key].dataType.simpleString()
    passages = cut(items.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text")).distinct().withColumn("version", F.xxhash64("text")))
    counts, n = _all_counts(passages)
    rows = documents.select(F.col(key).alias("doc"), F.col(text).alias("text"), F.lit(False).alias("own"))
    rows = rows.unionByName(passages.select(F.lit(None).cast(kind).alias("doc"), "text", F.lit(True).alias("own")))
    hits, sent = None, []
    for ids, versions, texts in _item_blocks(passages):
        shared = spark.sparkContext.broadcast((next(_numbers), ids, texts, counts, n))
        sent.append(shared)

        def scan(batches: Iterator[pd.DataFrame], shared=shared, versions=versions) -> Iterator[pd.DataFrame]:
            index = _index_of(shared)
            for batch in batches:
                docs, body, own = batch["doc"].array, batch["text"].to_numpy(), batch["own"].to_numpy()
                for a in range(0, len(batch), 500):
                    found = list(index.scan([t if isinstance(t, str) else None for t in body[a : a + 500]]))
                    if found:
                        yield pd.DataFrame({
                            "doc": docs.take([a + d for d, *_ in found]), "own": [own[a + d] for d, *_ in found], "item": [int(index.ids[i]) for _, i, *_ in found], "version": [versions[i] for _, i, *_ in found],
                            "similarity": [s for _, _, s, *_ in found], "starts": [x for *_, x, _ in found], "contexts": [[c for c, _ in x] for *_, x in found], "tails": [[t for _, t in x] for *_, x in found], "by_char": [bool(index.by_char[i]) for _, i, *_ in found],
                        })

        part = rows.mapInPandas(scan, f"doc {kind}, {_HIT}")
        hits = part if hits is None else hits.unionByName(part)
    hits = cut(hits)
    for shared in sent:
        shared.unpersist()
    return hits


def _by_stretch(hits: DataFrame) -> DataFrame:
    stretches = hits.select("doc", "own", "item", "version", "similarity", "by_char", F.explode(F.arrays_zip("starts", "contexts", "tails")).alias("s"))
    return stretches.select("doc", "own", "item", "version", "similarity", "by_char", F.col("s.starts").alias("start"), F.col("s.contexts").alias("context"), F.col("s.tails").alias("tail"))


def notices(hits: DataFrame) -> DataFrame:
    """(item, version, start, by_char, n_items, n_pages) of each stretch of a general notice."""
    # distinct first: copies of a page and repeated items are folded before anything is counted
    once = _by_stretch(hits).select("item", "version", "start", "by_char", "context", "own", (F.col("own") & F.col("tail")).alias("ends")).distinct()
    counted = once.groupBy("item", "version", "start").agg(F.first("by_char").alias("by_char"), F.count_if("ends").alias("n_items"), F.countDistinct("context").alias("n_pages"))
    return counted.where((F.col("n_items") >= NOTICE_ITEMS) & (F.col("n_pages") >= NOTICE_PAGES))


def find_leaks(documents: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str) -> DataFrame:
    """(key, item_id, similarity) for each document that holds a counting part of an item."""
    hits = _hits(documents, key, text, items, item, item_text)
    # the words of a notice belong to no passage: stretches that hold some of them are dropped too
    size, trim = (F.when(F.col("by_char"), x).otherwise(y) for x, y in ((STRETCH_CHARS, STRETCH), (TRIM_CHARS, TRIM)))
    held = notices(hits).select("item", "version", F.explode(F.sequence(F.col("start") - size + trim + 1, F.col("start") + size - trim - 1)).alias("start")).distinct()
    kept = _by_stretch(hits.where(~F.col("own"))).join(held, ["item", "version", "start"], "left_anti")
    return kept.groupBy("doc", "item").agg(F.max("similarity").alias("similarity")).withColumnsRenamed({"doc": key, "item": item})
