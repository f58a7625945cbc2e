import random

import pytest

from foliomill.llm.queries import p6_ids, p6_round_trip
from foliomill.llm.tokens import decode, default_rank_file, encode_corpus, encode_text, encoding, safe_parts


def test_parts_encode_like_the_whole():
    rank_file = default_rank_file()
    text = "It's 12 apples, don't you see?  two  spaces 3 x <|endoftext|> 你好 café naïve it 's\n\n tail " * 40
    whole = encoding(rank_file).encode_ordinary(text)
    for size in (1, 7, 50, 333):
        assert "".join(safe_parts(text, size)) == text
        assert encode_text(text, rank_file, size) == whole


def test_parts_of_scripts_without_spaces():
    rank_file = default_rank_file()
    rng = random.Random(8)
    texts = [
        "报告需要复核。先重建，再等！《目录》（见第4节）……索引" * 60,
        "ใครปิดดัชนีรุ่น41.2เร็วระบบใช้เวลา5วินาที" * 60,
        "".join(rng.choices("aé你ไั7' 's\n\t.,!?'’_-“。の々Ⅷ²\u0301\u200b", k=3000)),
        "word's don't I'll_x 'tis “it's” A.B's 3's" * 50,
    ]
    for text in texts:
        whole = encoding(rank_file).encode_ordinary(text)
        for size in (1, 3, 40, 333):
            assert "".join(safe_parts(text, size)) == text
            assert encode_text(text, rank_file, size) == whole
    assert max(map(len, safe_parts(texts[0], 100))) < 130 and max(map(len, safe_parts(texts[1], 100))) < 130


def test_special_rows_and_round_trip(spark):
    rows = [(1, None), (2, ""), (3, "<|endoftext|> plain"), (4, "a" * 5000), (5, "\U0001f469‍\U0001f52c การ x" * 50), (6, "same"), (6, "same")]
    df = spark.createDataFrame(rows, "doc_id long, body string").selectExpr("*", "0 as ids", "'k' as key")
    rank_file = default_rank_file()
    got = decode(encode_corpus(df, "doc_id", "body", rank_file, size=100), "ids", rank_file).collect()
    assert len(got) == 7
    assert {(r.doc_id, r.text) for r in got} == {(i, t or "") for i, t in rows}
    assert all(r.ids == [] for r in got if r.doc_id in (1, 2))
    assert 50256 not in next(r.ids for r in got if r.doc_id == 3)


def test_against_the_tokenizers_library(spark, sf_dir):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    other = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    other.encode_special_tokens = True
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in p6_ids(spark, sf_dir).collect():
        assert r.ids == other.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_round_trip_of_all_documents(spark, sf_dir):
    rows = p6_round_trip(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and all(r.same for r in rows)
