"""Encoding of whole corpora with a public byte-level BPE vocabulary.

The rank file (tiktoken format) is a parameter and is read once per Python worker. Texts go
through Arrow batches; the ids of a batch are laid into one flat buffer with offsets, so no
row objects are built on the way back.

Long texts are cut before encoding at boundaries where the vocabulary's word pattern is sure
to start a new piece: before a space that stands between two letters or digits (the piece on the
left cannot take the space, the one on the right starts with it), and between a letter or digit and
a mark that is neither (all but the apostrophe), also those of Chinese, Japanese and Thai. So encoding
the parts one by one gives the same ids, and the work of one call is bounded by ``LONG`` and the next
such place, in scripts without spaces too.

Defined results: null and empty texts give an empty list; strings that look like special
tokens are plain text; text is encoded exactly as it stands. ``decode`` joins the raw bytes
of all ids before reading them as UTF-8, so characters split over ids come back whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The word pattern of the byte_bpe_50k vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Texts longer than this many characters are cut at safe boundaries.
LONG = 1 << 16

#: Marks that are no letters and no digits: punctuation but the apostrophe, and the vowel and tone signs of Thai.
_MARKS = "!-&(-/:-@\\[-`{-~…“”„«»、。〃〈-】！-／：-＠ัิ-ฺ็-๎"
_SAFE = re.compile(rf"(?<=[^\W_]) (?=[^\W_])|(?<=[^\W_])(?=[{_MARKS}])")


def default_rank_file() -> str:
    """The rank file of byte_bpe_50k where the vocabulary package is installed."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@lru_cache(maxsize=2)
def encoding(rank_file: str):
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = LONG) -> Iterator[str]:
    """Parts of ``text`` of about ``size`` characters; their encodings join to that of the whole."""
    start = 0
    while len(text) - start > size:
        boundary = _SAFE.search(text, start + size)
        if boundary is None:
            break
        yield text[start : boundary.start()]
        start = boundary.start()
    yield text[start:]


def encode_text(text: str | None, rank_file: str, size: int = LONG) -> list[int]:
    if not text:
        return []
    encode = encoding(rank_file).encode_ordinary
    if len(text) <= size:
        return encode(text)
    ids: list[int] = []
    for part in safe_parts(text, size):
        ids.extend(encode(part))
    return ids


def encode_corpus(documents: DataFrame, key: str, text: str, rank_file: str, size: int = LONG) -> DataFrame:
    """(key, ids array<int>) for each row of ``documents``, nulls and empty texts included."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [encode_text(t, rank_file, size) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], ["key", "ids"])

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(encoded: DataFrame, ids: str, rank_file: str, name: str = "text") -> DataFrame:
    """Adds the text of the ids, joined as raw bytes (invalid UTF-8 is replaced)."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def text_of(column):
        raw = encoding(rank_file).decode_bytes
        return column.map(lambda x: None if x is None else raw([int(i) for i in x]).decode("utf-8", "replace"))

    return encoded.withColumn(name, text_of(F.col(ids)))
