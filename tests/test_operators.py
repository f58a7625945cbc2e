import hashlib
import hmac
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliomill.functions import deid, messages, text
from foliomill.operators import graph, retrieval, vector_index
from foliomill.plans import analytics, search
from foliomill.sources import sinks
from foliomill.sources.markdown import parts, sections
from foliomill.streaming.events import drain, hourly_events


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_hmac_equals_the_library(spark):
    for value in ("", "Ann", "Zoë " * 50):
        assert one(spark, deid.hmac_hex(F.col("v"), "salt"), v=value) == hmac.new(b"salt", value.encode(), hashlib.sha256).hexdigest()
    with pytest.raises(ValueError):
        deid.pseudonym(F.lit("x"), "salt", 3)


def test_offset_is_unsigned_and_bounded(spark):
    rows = spark.range(300).select(F.col("id").cast("string").alias("v")).select("v", deid.subject_offset(F.col("v"), "s", 60).alias("o")).collect()
    for r in rows:
        assert r.o == int(hmac.new(b"s", r.v.encode(), hashlib.sha256).hexdigest()[:16], 16) % 121 - 60


@pytest.mark.parametrize(("born", "band"), [("1980-01-02", "45-49"), ("1981-01-01", "45-49"), ("1930-01-01", "90+"), ("2030-01-01", None), (None, None)])
def test_age_band(spark, born, band):
    assert one(spark, deid.age_band(F.to_date("b"), F.to_date(F.lit("2026-01-01"))), b=born) == band


def test_zip(spark):
    assert one(spark, deid.truncate_zip(F.col("z"), ["123"]), z="12345-6789") == "123"
    assert one(spark, deid.truncate_zip(F.col("z"), ["999"]), z="12345") is None
    assert one(spark, deid.truncate_zip(F.col("z")), z="12345") is None


@pytest.mark.parametrize(("typed", "moved", "year"), [("2024-05-30", "2024-06-09", 2024), ("20240530", "20240609", 2024), ("05/30/2024", "06/09/2024", None), ("2024-05-30T10:20:30", "2024-06-09T10:20:30", 2024), ("20240530102030", "20240609102030", None), ("202405301020", "202406091020", None), ("2024", None, 2024), ("soon", None, None), (None, None, None)])
def test_typed_dates(spark, typed, moved, year):
    assert one(spark, deid.shifted(F.col("d"), F.lit(10)), d=typed) == moved
    assert one(spark, deid.year_only(F.col("d")), d=typed) == year


def test_phi_patterns(spark):
    found = one(spark, deid.phi_matches(F.col("t")), t="123-45-6789 900-12-3456 000-12-3456 (555) 010-1234 +1 555.010.1234 a@b.example 2024-02-30 2024-13-01 123456789012")
    assert [(m.kind, m.match) for m in found] == [("ssn", "123-45-6789"), ("phone", "(555) 010-1234"), ("phone", "+1 555.010.1234"), ("email", "a@b.example"), ("iso_date", "2024-02-30"), ("mrn_like", "123456789012")]


def test_k_anonymity_counts_nulls_as_a_value(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", "x")], "id int, q string, r string")
    got = {r.id: (r.q, r.r) for r in deid.k_anonymize(df, ["q", "r"], 2).collect()}
    assert got == {1: ("a", None), 2: ("a", None), 3: ("*", "*")}


HL7 = "MSH|^~\\&|A|B|C|D|2024||ADT^A01|1|P|2.5\rPID|1||77\rOBX|1||a\rOBX|2||b"


def test_hl7(spark):
    assert one(spark, messages.hl7_field(F.col("m"), "MSH", 2), m=HL7) == "^~\\&"
    assert one(spark, messages.hl7_field(F.col("m"), "OBX", 3, 2), m=HL7) == "b"
    assert one(spark, messages.hl7_field(F.col("m"), "PV1", 3), m=HL7) is None
    assert one(spark, messages.hl7_missing(F.col("m")), m=HL7) == ["EVN", "PV1"]
    assert one(spark, messages.hl7_missing(F.col("m")), m=HL7.replace("ADT^A01", "ORU^R01")) == ["OBR"]
    assert one(spark, messages.hl7_missing(F.col("m")), m=HL7.replace("ADT^A01", "ZZZ")) is None
    assert one(spark, messages.hl7_build(messages.hl7_segments(F.col("m"))), m=HL7) == HL7


def test_x12(spark):
    good = one(spark, messages.x12_build("270", F.col("c"), F.array(F.lit("A*1"), F.lit("B*2"))), c=7)
    assert good == "ST*270*0007~A*1~B*2~SE*4*0007~"
    assert one(spark, messages.x12_errors(F.col("m")), m=good) == []
    assert one(spark, messages.x12_errors(F.col("m")), m=good.replace("SE*4", "SE*5")) == ["SE01"]
    assert one(spark, messages.x12_errors(F.col("m")), m="A*1~") == ["no ST", "no SE"]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "apple pear apple"), (2, "pear"), (3, None), (4, "kiwi 9 plum")], "d long, t string")
    queries = spark.createDataFrame([(9, "apple"), (9, "missing")], "query long, term string")
    # the last version of a doc counts, equal rows once
    old = spark.createDataFrame([(1, "apple apple apple", 1), (1, "apple pear apple", 2), (1, "apple pear apple", 2), (2, "apple", None), (2, "pear", 1), (3, None, 1), (4, "kiwi 9 plum", None)], "d long, t string, v int")
    again = retrieval.bm25(retrieval.versions(old, "d", F.col("v"), F.col("t")), queries, 5).collect()
    got = retrieval.bm25(retrieval.versions(docs, "d", None, F.col("t")), queries, 5).collect()
    assert again == got
    idf = math.log((3 - 1 + 0.5) / 1.5 + 1)
    assert [(r.query, r.doc, r["rank"]) for r in got] == [(9, 1, 1)]
    assert got[0].score == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2)), abs=1e-6)


def _watch_top(monkeypatch):
    """Counts the rows that searches pass on to be ranked over all tasks."""
    seen, plain = [], retrieval.top_per
    monkeypatch.setattr(retrieval, "top_per", lambda df, *rest: (seen.append(df.count()), plain(df, *rest))[1])
    return seen


def test_bm25_writes_no_pairs_of_query_and_doc(spark, monkeypatch):
    seen = _watch_top(monkeypatch)
    docs = [(d, "apple " * (d % 5) + "pear " * (d % 3) + "kiwi") for d in range(400)]
    queries = [(q, term) for q in range(50) for term in ("kiwi", ("apple", "pear")[q % 2], f"unknown{q}")]
    rows = retrieval.versions(spark.createDataFrame(docs, "d long, t string"), "d", None, F.col("t"))
    got = retrieval.bm25(rows, spark.createDataFrame(queries, "query long, term string"), 3).collect()
    # two sets of terms, four tasks; 20,000 pairs of query and doc
    assert sum(seen) <= 2 * 4 * 3
    words = {d: t.split() for d, t in docs}
    df = {term: sum(term in w for w in words.values()) for term in ("apple", "pear", "kiwi")}
    avg = sum(map(len, words.values())) / 400

    def score(q, d):
        tf = {term: words[d].count(term) for term in ("kiwi", ("apple", "pear")[q % 2])}
        return round(sum(math.log((400 - df[t] + 0.5) / (df[t] + 0.5) + 1) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(words[d]) / avg)) for t, n in tf.items()), 6)

    for q in range(50):
        want = sorted(range(400), key=lambda d, q=q: (-score(q, d), d))[:3]
        mine = sorted((r for r in got if r.query == q), key=lambda r: r["rank"])
        assert [(r.doc, r["rank"]) for r in mine] == [(d, i) for i, d in enumerate(want, 1)]
        assert [r.score for r in mine] == pytest.approx([score(q, d) for d in want], abs=2e-6)


def test_title_search_writes_no_pairs_of_query_and_doc(spark, monkeypatch):
    seen = _watch_top(monkeypatch)
    monkeypatch.setattr(retrieval, "BLOCK_TERMS", 1)
    titles = spark.createDataFrame([(d, ("Apple pear", "Pear pear", "Kiwi", None)[d % 4]) for d in range(400)] + [(0, "pear apple")], "doc long, title string")
    queries = spark.createDataFrame([(q, term) for q in range(50) for term in (("apple", "pear", "plum") if q % 2 else ("pear",))] + [(50, "plum")], "query long, term string")
    got = retrieval.title_search(titles, queries, 3).collect()
    assert sum(seen) <= 2 * 4 * 3
    ends = {0: [(0, 1.0), (1, 1.0), (4, 1.0)], 1: [(0, 1.0), (4, 1.0), (8, 1.0)]}
    for q in range(51):
        assert [(r.doc, r.score) for r in sorted((r for r in got if r.query == q), key=lambda r: r["rank"])] == (ends[q % 2] if q < 50 else [])
    assert retrieval.title_search(titles.limit(0), queries, 3).count() == 0


@pytest.mark.parametrize("most", [0, 1000])
def test_pages_hold_the_results_only(spark, tmp_path, monkeypatch, most):
    at = "timestamp'2025-01-0%d'"
    chapters = [(1, at % 1, "old", "x"), (1, at % 2, "new", "y"), (2, "null", "other", "z"), (3, at % 1, "third", "w")]
    rows = " union all ".join(f"select {i}L as chapter_id, {t} as indexed_at, 7L as book_id, '{title}' as title, repeat('{c}', 500) as content" for i, t, title, c in chapters)
    spark.sql(rows).write.parquet(f"{tmp_path}/chapter.parquet")
    spark.sql("select 7L as book_id, timestamp'2025-01-01' as updated_at, 'Book' as title, date'2025-01-01' as publication_date, 'House' as publisher").write.parquet(f"{tmp_path}/book.parquet")
    spark.sql("select id as doc_id, concat('d', id) as title, 'web' as source, timestamp'2025-01-01' as collected_at from range(5)").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(search, "MAX_RESULTS", most)
    results = spark.createDataFrame([("chapter", 1), ("chapter", 1), ("chapter", 3), ("chapter", 9), ("doc_section", 3)], "kind string, doc long")
    got = search._pages(spark, str(tmp_path), results).collect()
    assert sorted((r.kind, r.doc, r.title, r.excerpt) for r in got) == [("chapter", 1, "new", "y" * 160), ("chapter", 3, "third", "w" * 160), ("doc_section", 3, "d3", None)]


def test_interactive_joins_no_more_rows_than_the_pool(spark, tmp_path, monkeypatch):
    # 20 queries of four results each have chapter 1 as primary, which 500 documents contradict
    scored = spark.sql("select q.id as query, if(d.id < 3, 'chapter', 'doc_section') as kind, d.id as doc, 1.0 / d.id as rrf, 0.5 as recency, 0.5 as alignment, 1.0 / d.id as relevance, 0.5 as corroboration, 0.5 as authority from range(20) q, range(1, 5) d")
    edges = "select id + 4 as from_doc_section_id, 1L as to_chapter_id, cast(null as long) as to_doc_section_id, 'CONTRADICTS' as relation_type from range(500)"
    others = " union all select 3L, 1L, null, 'CORROBORATES' union all select 3L, 2L, null, 'CONTRADICTS' union all select null, 1L, 4L, 'CONTRADICTS' union all select 4L, 1L, 3L, 'CONTRADICTS'"
    spark.sql(edges + others).write.parquet(f"{tmp_path}/alignment_edge.parquet")
    monkeypatch.setattr(search, "r41_components", lambda *_: scored)
    joined, plain = [], type(scored).join
    monkeypatch.setattr(type(scored), "join", lambda *a, **k: (joined.append(plain(*a, **k)), joined[-1])[1])
    got = search.r43_interactive(spark, str(tmp_path)).collect()
    assert joined and max(df.count() for df in joined) <= 80
    assert sorted((r.query, r.role, r.kind, r.doc, r.nth) for r in got) == sorted(
        (q, *r) for q in range(20) for r in (("primary", "chapter", 1, 1), ("corroboration", "chapter", 2, 1), ("corroboration", "doc_section", 3, 2), ("conflict", "doc_section", 4, 1))
    )


def test_vector_search_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(60, [0.0] * 8), (61, None)]
    df = spark.createDataFrame(rows, "i long, v array<double>")
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    got = retrieval.vector_search(df, "i", "v", df.where("i < 5"), 3).collect()
    unit = np.array([np.array(v) / (np.linalg.norm(v) or 1) for _, v in rows[:61]])
    for q in range(5):
        want = sorted(range(61), key=lambda j, q=q: (-round(float(unit[q] @ unit[j]), 6), j))[:3]
        assert [r.doc for r in sorted((r for r in got if r.query == q), key=lambda r: r["rank"])] == want
    assert retrieval.vector_search(df, "i", "v", df.limit(0), 3).count() == 0


def test_vector_index_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.4 * rng.normal(size=16)).tolist()) for i in range(1500)] + [(1500, [0.0] * 16), (1501, None)]
    df = spark.createDataFrame(rows, "i long, v array<double>").withColumn("cell", F.lit("x"))
    queries = df.where("i % 20 = 0")
    exact = retrieval.vector_search(df, "i", "v", queries, 10)
    found = vector_index.indexed_search(df, "i", "v", queries, 10)
    got = vector_index.recall(found, exact).first()
    assert (got.n_queries, got.n_exact) == (76, 760) and got.recall >= 0.9
    every = vector_index.indexed_search(df, "i", "v", queries, 10, 10_000)
    assert vector_index.recall(every, exact).first().recall == 1.0
    assert vector_index.indexed_search(df.limit(0), "i", "v", queries, 10).count() == 0


def test_scores(spark):
    assert one(spark, retrieval.recency(F.col("a").cast("double")), a=730) == pytest.approx(0.5)
    assert one(spark, retrieval.recency(F.col("a").cast("double")), a=-1) == 1.0
    assert one(spark, retrieval.recency(F.col("a").cast("double")), a=None) == 0.5
    assert one(spark, retrieval.alignment_share(F.col("a"), F.col("b")), a=0, b=0) == 0.5
    with pytest.raises(ValueError):
        retrieval.combined({"x": F.lit(1.0)}, {"x": 0.5})


def test_neighborhood(spark):
    edges = graph.undirected(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1), (4, 5), (5, 6), (7, 7), (None, 1)], "a long, b long"), "a", "b")
    seeds = spark.createDataFrame([(1,)], "node long")
    assert {r.node: r.depth for r in graph.neighborhood(edges, seeds, 2).collect()} == {1: 0, 2: 1, 4: 1, 3: 2, 5: 2}


def test_layers(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 1), (5, 6), (6, 5), (7, 5), (8, 8), (None, 1)], "src long, dst long")
    assert dict(map(tuple, graph.layers(edges).collect())) == {3: 0, 2: 1, 1: 2, 4: 3, 5: -1, 6: -1, 7: -1, 8: -1}
    assert graph.layers(edges.limit(0)).count() == 0


def test_walk(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 1)], "src long, dst long")
    seeds = spark.createDataFrame([(7, 1), (8, 2), (8, 9)], "query long, node long")
    got = sorted(map(tuple, graph.walk(edges, seeds, 2).select("query", "node", "depth").collect()))
    assert got == [(7, 1, 0), (7, 2, 1), (7, 3, 2), (8, 1, 1), (8, 2, 0), (8, 3, 1), (8, 4, 2), (8, 9, 0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "a", "x")], "id long, kind string, note string")
    sinks.write_parquet(df, f"{tmp_path}/p", ["kind"])
    sinks.write_json(df, f"{tmp_path}/j")
    for back in (spark.read.parquet(f"{tmp_path}/p"), spark.read.schema(df.schema).json(f"{tmp_path}/j")):
        assert sorted(map(tuple, back.select("id", "kind", "note").collect())) == [(1, "a", None), (2, "b", "x"), (3, "a", "x")]
    sinks.record(df, f"{tmp_path}/a", "shift", F.col("kind"), F.col("note"))
    sinks.record(df.limit(1), f"{tmp_path}/a", "drop", F.col("kind"), F.col("note"))
    assert sorted(map(tuple, sinks.summary(spark, f"{tmp_path}/a").collect())) == [("drop", 1, 1, 1), ("shift", 3, 2, 2)]


def test_text(spark):
    assert one(spark, text.significant_tokens(F.col("t")), t="How to use The data-mesh and data-mesh 2") == ["use", "data-mesh", "data-mesh"]
    assert one(spark, text.acronyms(F.col("t")), t="CDC AND HL7 in CDC, Abc") == ["CDC", "HL7"]
    assert one(spark, text.slug(F.col("t")), t=" A b--C! ") == "a-b-c"
    assert one(spark, text.clean_title(F.col("t"), "none"), t="Guide-9781234567897") == "Guide"
    assert one(spark, text.years(F.col("t")), t="2024 1999 12024 2024") == ["1999", "2024"]
    assert one(spark, text.token_in_title(F.col("t"), F.lit("graphs")), t="Graph walks") is True


def test_sections():
    doc = "lost\n# A\nx\n### deep\n```\n# code\n```\n## B ##\ny\n# C"
    assert sections(doc) == [(0, -1, 1, "A", "x\n### deep\n```\n# code\n```"), (1, 0, 2, "B", "y"), (2, -1, 1, "C", "")]
    assert sections(None) == [] and sections("no heading") == []


def test_parts(spark):
    body = "aaa\nbbb\n\nccc\n```\none\n\ntwo\n```\nddd\n\n\n" + "e" * 30 + "\n\nf\n~~~\nopen"
    assert one(spark, parts(F.col("t"), 14), t=body) == ["aaa\nbbb\n\nccc", "```\none\n\ntwo\n```", "ddd", "e" * 30, "f\n\n~~~\nopen"]
    assert one(spark, parts(F.col("t"), 14), t=" \n\n") == [] and one(spark, parts(F.col("t")), t=None) is None
    paragraphs = [f"paragraph {i} " + "x" * (i % 50) for i in range(20_000)]
    got = one(spark, parts(F.col("t")), t="\n\n".join(paragraphs))
    assert "\n\n".join(got) == "\n\n".join(p for p in paragraphs) and max(map(len, got)) < 4000 + 2 * 200


def test_stream_windows(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:50:00", "a", 2.0), (3, "2024-01-01 09:00:00", "b", 5.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "events.parquet"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "events.parquet"))
    got = drain(hourly_events(stream)).collect()
    assert [(r.event_type, r.n, r.total) for r in got if r.event_type == "a"] == [("a", 2, 3.0)]


def test_spelt_votes(spark, tmp_path):
    votes = ["Corroborates", "CORROBORATES.", "corroborated", "contradiction", "not related", "no idea", None]
    rows = [(1, k, v) for k, v in enumerate(votes)] + [(2, 0, "?"), (3, 0, "superseded"), (3, 1, "Contradicts!"), (3, 2, "UNRELATED")]
    spark.createDataFrame(rows, "alignment_edge_id long, sample int, verdict string").selectExpr("*", "0.5D as confidence", "timestamp_ntz'2025-01-01' AS created_at").write.parquet(f"{tmp_path}/alignment_vote.parquet")
    spark.createDataFrame([(1, "CORROBORATES"), (2, "CONTRADICTS"), (3, "CORROBORATES")], "alignment_edge_id long, relation_type string").write.parquet(f"{tmp_path}/alignment_edge.parquet")
    found = analytics.a17_majority_of_spelt_votes(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(1, 5, 3, 1, "CORROBORATES"), (3, 3, 0, 2, "CONTRADICTS")]
    decided = analytics.a17_majority_vote(spark.read.parquet(f"{tmp_path}/alignment_vote.parquet").sparkSession, str(tmp_path)).drop("n_for", "n_against").collect()
    assert sorted(map(tuple, decided)) == [(1, 7, 5, "NO_MAJORITY", 0.0), (2, 1, 0, "NO_DATA", 0.0), (3, 3, 3, "CONTRADICTS", 0.333)]
    actions = analytics.a18_actions_of_spelt_votes(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, actions)) == [("keep", "CONTRADICTS", 1), ("keep", "CORROBORATES", 1), ("update", "CORROBORATES", 1)]
