import math
import random

import pytest

from foliomill.llm import consensus

SCHEMA = "item long, who int, verdict string, confidence double, at int, outcome string"


def counted(spark, rows):
    df = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA)
    return consensus.counted_votes(df, "item", "who", "verdict", "confidence", "at")


def test_digamma(spark):
    got = spark.createDataFrame([(0.1,), (1.0,), (7.5,)], "x double").selectExpr(consensus.digamma("x")).collect()
    assert [g[0] for g in got] == pytest.approx([-10.423754940411, -0.577215664902, 1.946757484242], abs=1e-8)


def test_learns_habits_and_confidence(spark):
    rng = random.Random(5)
    truth = {i: rng.randrange(4) for i in range(400)}
    rows = []
    for i, t in truth.items():
        for who in range(6):
            if who == 0:
                label, conf = (1 - t if t < 2 else t), 0.9
            elif who == 1:
                label, conf = rng.randrange(4), None
            elif who == 2:
                sure = rng.random() < 0.5
                label, conf = (t, 0.9) if sure else (rng.randrange(4), 0.2)
            else:
                label, conf = (t if rng.random() < 0.6 else rng.randrange(4)), 0.5
            rows.append((i, who, consensus.LABELS[label].title(), conf, 1))
    result = consensus.fit(consensus.with_outcomes(counted(spark, rows)))
    got = {r.item: r.verdict for r in consensus.verdicts(result).collect()}
    right = sum(got[i] == consensus.LABELS[t] for i, t in truth.items()) / len(truth)
    assert right > 0.95
    rel = {r.who: r for r in consensus.reliability(result).collect()}
    assert rel[1].reliability < 0.45 < 0.6 < rel[3].reliability
    assert all(r.low <= r.reliability <= r.high and r.n_votes == 400 for r in rel.values())


def test_versions_nulls_and_no_votes(spark):
    rows = [(1, 0, "UNRELATED", 0.5, 1), (1, 0, "Contradicts.", 0.5, 2), (1, 0, "Contradicts.", 0.5, 2), (2, 0, "n/a", 0.5, 1), (3, None, "not related", math.nan, None), (None, 1, "UNRELATED", 1.0, 1), (4, 1, None, None, 1)]
    votes = counted(spark, rows)
    assert sorted((r.item, r.label, r.confidence) for r in votes.collect()) == [(1, 1, 0.5), (3, 3, None)]
    got = {r.item: r.verdict for r in consensus.verdicts(consensus.fit(consensus.with_outcomes(votes))).collect()}
    assert got == {1: "CONTRADICTS", 3: "UNRELATED"}
    assert [r.agreement for r in consensus.item_agreement(votes).collect()] == [None, None]


def test_alpha_and_empty(spark):
    rows = [(1, 0, "UNRELATED", None, 1), (1, 1, "UNRELATED", None, 1), (2, 0, "UNRELATED", None, 1), (2, 1, "SUPERSEDED", None, 1)]
    assert consensus.krippendorff(counted(spark, rows)).first().alpha == pytest.approx(1 - 2 / ((16 - 10) / 3))
    none = counted(spark, [])
    assert consensus.verdicts(consensus.fit(consensus.with_outcomes(none))).count() == 0
    assert consensus.krippendorff(none).first().alpha is None
