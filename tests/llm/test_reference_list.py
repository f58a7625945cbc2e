import pytest

from foliomill.llm import reference_list
from foliomill.llm.reference_list import match_values
from foliomill.llm.spelling import deletes, fold, repair, typo_cost
from foliomill.runtime import cut

REFERENCE = [(1, "Alder House", "X"), (2, "Alder Press", None), (3, "Brook & Sons Editions Ltd.", "Y"), (4, "Südwerk Medical Books", None), (None, "Nobody Press", None), (5, None, None)]


@pytest.fixture(scope="module")
def reference(spark):
    return spark.createDataFrame(REFERENCE, "id long, label string, value string")


@pytest.mark.parametrize(("a", "b", "cost"), [("abc", "abc", 0), ("abcd", "abdc", 0.7), ("house", "houuse", 0.6), ("press", "pres", 0.6), ("cat", "cst", 0.7), ("cat", "cpt", 1), ("", "ab", 2)])
def test_typo_cost(a, b, cost):
    assert typo_cost(a, b) == pytest.approx(cost)
    assert typo_cost(b, a) == pytest.approx(cost)


def test_helpers():
    assert repair("SÃ¼dhafen") == "Südhafen" and repair("Ñandú") == "Ñandú"
    assert fold("ŁÓDŹ​ ß") == "lodz ss"
    assert "bc" in deletes("abc", 1) and len(deletes("abcdefghijkl", 2)) == 1 + 10 + 45


@pytest.mark.parametrize(
    ("typed", "entry"),
    [
        ("Alder House", 1),
        ("ALDER PR.", 2),
        ("Press, Aldder", 2),
        ("Alder", None),
        ("Alder Media", None),
        ("Published by Brook and Sons, 2011", 3),
        ("Place: Brookk&Sons Books (Y)", 3),
        ("Brook & Sons Seed Catalogue", None),
        ("SÃ¼dwerk Med. Bks", 4),
        ("Suedwerk", 4),
        ("BSE", 3),
        ("n/a", None),
        ("x" * 5000, None),
        ("???", None),
    ],
)
def test_values(spark, reference, typed, entry):
    values = spark.createDataFrame([(typed, 1), (typed, 2), (None, 3), ("  ", 4)], "typed string, cost int")
    got = match_values(values, "typed", reference, "id", "label").collect()
    assert [(r.value, r.entry) for r in got] == [(typed, entry)]


def test_empty(spark, reference):
    none = spark.createDataFrame([], "typed string")
    assert match_values(none, "typed", reference, "id", "label").count() == 0
    one = spark.createDataFrame([("Alder House",)], "typed string")
    assert [r.entry for r in match_values(one, "typed", reference.limit(0), "id", "label").collect()] == [None]


def test_long_lists_are_shuffled(spark, reference, monkeypatch):
    values = spark.createDataFrame([("ALDER PR.",), ("Brookk & Sons",), ("nobody at all",)], "typed string")
    want = sorted((r.value, r.entry or -1) for r in match_values(values, "typed", reference, "id", "label").collect())
    monkeypatch.setattr(reference_list, "MAX_DICTIONARY_BYTES", 10)
    assert sorted((r.value, r.entry or -1) for r in match_values(values, "typed", reference, "id", "label").collect()) == want


def test_join_back_on_a_hot_value_is_split(spark):
    limits = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    books = spark.range(0, 60_000, 1, 4).selectExpr("id", "if(id % 6 = 0, concat('House ', id % 60), 'Alder House') as publisher")
    for key, value in limits.items():
        spark.conf.set(key, value)
    try:
        joined = books.join(cut(books.groupBy("publisher").count()), "publisher")
        assert len(joined.collect()) == 60_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in limits:
            spark.conf.unset(key)
