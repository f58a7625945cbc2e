"""Consensus of several annotators' labels by a mean-field variational confusion model.

Model: each item has a hidden class; class shares have a Dirichlet prior; every annotator has,
for each class, a Dirichlet row over outcomes. An outcome is the label given together with the
band of the confidence given, bands being quantiles of that annotator's own confidences, so a
habit (swapping, merging or defaulting labels) and the use of confidence are learned together.
Coordinate ascent: the posterior of an item is the softmax of summed expected log
probabilities; the rows are updated with digamma of expected counts. Both are group-bys. The
class prior takes part as one more vote of a pseudo annotator on each item. The votes are kept
partitioned and sorted by item, so in a round only the annotators' counts travel: the posterior of
an item is a running window over its own votes (at most one an annotator), and the counts are
summed before they are shuffled. ``STEPS`` rounds make one job and end in a written table.
A fit that does not settle raises an error.

Defined results: the latest row of (item, annotator) counts (ties: the greatest remaining
values); labels that are none of ``LABELS`` after spelling is normalised are no vote; a null
annotator counts as one nameless annotator; null or NaN confidences form a band of their own;
rows with a null item are ignored; equal posteriors go to the label named first; an empty
table gives empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.functions.verdicts import LABELS, label_index
from foliomill.runtime import cut, release, small_or_shuffled

#: Quantile bands of confidence; one more is for missing values.
BANDS = 5
#: Annotators and outcomes up to this many rows are broadcast, more are shuffled.
MAX_BROADCAST_ROWS = 100_000
NAMELESS = -(1 << 62)
#: Rounds between two written tables (and two looks at how far the counts moved).
STEPS = 3
PRIOR_CLASS, PRIOR_RIGHT, PRIOR_WRONG = 1.0, 1.5, 0.5


def digamma(x: str) -> str:
    """SQL text of digamma of a positive expression: recurrence to x + 6, then the asymptotic series (error below 1e-9)."""
    y = f"(({x}) + 6)"
    series = f"ln({y}) - 1 / (2 * {y}) - 1 / (12 * pow({y}, 2)) + 1 / (120 * pow({y}, 4)) - 1 / (252 * pow({y}, 6))"
    return f"({series} - {' - '.join(f'1 / (({x}) + {i})' for i in range(6))})"


def counted_votes(votes: DataFrame, item: str, annotator: str, label: str, confidence: str, version: str) -> DataFrame:
    """(item, who, label, confidence) of the counting votes."""
    rows = votes.where(F.col(item).isNotNull()).select(
        F.col(item).cast("long").alias("item"),
        F.coalesce(F.col(annotator).cast("long"), F.lit(NAMELESS)).alias("who"),
        F.struct(F.col(version).alias("v"), label_index(F.col(label)).alias("label"), F.nanvl(F.col(confidence).cast("double"), F.lit(None).cast("double")).alias("confidence")).alias("row"),
    )
    latest = rows.groupBy("item", "who").agg(F.max("row").alias("row"))
    return latest.where("row.label is not null").select("item", "who", "row.label", "row.confidence")


def with_outcomes(counted: DataFrame) -> DataFrame:
    """Adds ``outcome`` = label * (BANDS + 1) + band of confidence."""
    cuts = [i / BANDS for i in range(1, BANDS)]
    limits = counted.groupBy("who").agg(F.percentile_approx("confidence", cuts).alias("cuts"))
    joined = counted.join(small_or_shuffled(limits, MAX_BROADCAST_ROWS), "who")
    band = F.when(F.col("confidence").isNull(), BANDS).otherwise(F.size(F.filter("cuts", lambda c: c < F.col("confidence"))))
    return joined.select("item", "who", "label", (F.col("label") * (BANDS + 1) + band).alias("outcome"))


@dataclass
class Consensus:
    """Results of ``fit``: posteriors per item, votes used, expected counts per annotator and outcome."""

    posteriors: DataFrame
    votes: DataFrame
    counts: DataFrame
    rounds: int


def fit(votes: DataFrame, max_rounds: int = 600, tolerance: float = 1e-4) -> Consensus:
    """Variational fit of ``with_outcomes`` rows; stops when a round moves expected counts by less than ``tolerance`` of all votes.

    Raises if that does not happen within ``max_rounds``.
    """
    spark = votes.sparkSession
    classes = range(len(LABELS))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    votes = cut(votes)
    prior_votes = votes.select("item").distinct().select("item", F.lit(-1).cast("long").alias("who"), F.lit(None).cast("int").alias("label"), F.lit(-1).alias("outcome"))
    rows = votes.unionByName(prior_votes).repartition(parts, "item").sortWithinPartitions("item").persist()

    first = [f"sum(IF(label = {k}, 1D, 0D)) OVER (PARTITION BY item) + 0.01D AS q{k}" for k in classes]
    counts = cut(_counts(_shares(rows.selectExpr("who", "outcome", *first))))
    small = counts.count() <= MAX_BROADCAST_ROWS
    for done in range(STEPS, max_rounds + STEPS, STEPS):
        new = counts
        for _ in range(STEPS):
            new = _counts(_row_posteriors(rows, _expected_logs(new, small), small))
        new = cut(new)
        both = new.unionByName(counts.selectExpr("who", "outcome", *[f"-n{k} AS n{k}" for k in classes]))
        change = both.groupBy("who", "outcome").agg(*[F.expr(f"abs(sum(n{k}))").alias(f"d{k}") for k in classes], F.expr(f"sum({' + '.join(f'greatest(n{k}, 0)' for k in classes)})").alias("n"))
        moved = change.selectExpr(f"sum({' + '.join(f'd{k}' for k in classes)}) AS moved", "sum(n) AS all").first()
        release(counts)
        counts = new
        if not moved["all"] or moved["moved"] < tolerance * STEPS * moved["all"]:
            posteriors = cut(_posteriors(rows, _expected_logs(counts, small), small))
            rows.unpersist()
            return Consensus(posteriors, votes, counts, done)
    raise RuntimeError(f"the fit did not settle in {max_rounds} rounds")


# Plans of several rounds are deep, so the columns of a round are SQL text, each parsed at once.


def _shares(df: DataFrame) -> DataFrame:
    """Divides q0, q1, ... by their sum."""
    names = [f"q{k}" for k in range(len(LABELS))]
    keep = [c for c in df.columns if c not in names]
    return df.selectExpr("*", f"{' + '.join(names)} AS total").selectExpr(*keep, *[f"{n} / total AS {n}" for n in names])


def _softmax(df: DataFrame) -> DataFrame:
    """Turns sums of logs s0, s1, ... into shares q0, q1, ..."""
    names = [f"s{k}" for k in range(len(LABELS))]
    keep = [c for c in df.columns if c not in names]
    return _shares(df.selectExpr("*", f"greatest({', '.join(names)}) AS top").selectExpr(*keep, *[f"exp({n} - top) AS q{k}" for k, n in enumerate(names)]))


def _counts(row_posteriors: DataFrame) -> DataFrame:
    return row_posteriors.groupBy("who", "outcome").agg(*[F.sum(f"q{k}").alias(f"n{k}") for k in range(len(LABELS))])


def _expected_logs(counts: DataFrame, small: bool) -> DataFrame:
    """E[log probability] of each (who, outcome) under each class; of the class itself for the pseudo annotator.

    Few counts (``small``, the bound of the broadcast) stand in one partition, which needs no shuffle.
    """
    counts = counts.coalesce(1) if small else counts
    classes = range(len(LABELS))
    width = BANDS + 1
    of_who = "OVER (PARTITION BY who, outcome = -1)"
    row_alpha = PRIOR_RIGHT + PRIOR_WRONG * (len(LABELS) - 1)
    summed = counts.selectExpr("*", *[f"sum(n{k}) {of_who} AS t{k}" for k in classes], f"sum({' + '.join(f'n{k}' for k in classes)}) {of_who} AS items")
    prior = [f"IF(outcome = -1, {PRIOR_CLASS}D, IF(outcome div {width} = {k}, {PRIOR_RIGHT / width}D, {PRIOR_WRONG / width}D))" for k in classes]
    both = summed.selectExpr("who", "outcome", *[f"n{k} + {prior[k]} AS a{k}" for k in classes], *[f"IF(outcome = -1, items + {PRIOR_CLASS * len(LABELS)}D, t{k} + {row_alpha}D) AS b{k}" for k in classes])
    return both.selectExpr("who", "outcome", *[f"{digamma(f'a{k}')} - {digamma(f'b{k}')} AS l{k}" for k in classes])


def _scored(rows: DataFrame, logs: DataFrame, small: bool) -> DataFrame:
    return rows.join(F.broadcast(logs) if small else logs, ["who", "outcome"])


def _row_posteriors(rows: DataFrame, logs: DataFrame, small: bool) -> DataFrame:
    """(who, outcome, q0, q1, ...) of each vote: the posterior of its item."""
    return _softmax(_scored(rows, logs, small).selectExpr("who", "outcome", *[f"sum(l{k}) OVER (PARTITION BY item) AS s{k}" for k in range(len(LABELS))]))


def _posteriors(rows: DataFrame, logs: DataFrame, small: bool) -> DataFrame:
    return _softmax(_scored(rows, logs, small).groupBy("item").agg(*[F.sum(f"l{k}").alias(f"s{k}") for k in range(len(LABELS))]))


def verdicts(result: Consensus) -> DataFrame:
    """(item, verdict, posterior): the label of the greatest posterior."""
    top = F.greatest(*[F.col(f"q{k}") for k in range(len(LABELS))])
    verdict = F.coalesce(*[F.when(F.col(f"q{k}") >= top, F.lit(name)) for k, name in enumerate(LABELS)])
    return result.posteriors.select("item", verdict.alias("verdict"), top.alias("posterior"))


def item_agreement(votes: DataFrame) -> DataFrame:
    """(item, n_votes, agreement): share of agreeing pairs among an item's votes; null with one vote."""
    by_label = votes.groupBy("item", "label").agg(F.count("*").alias("n"))
    n, same = F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1))
    return by_label.groupBy("item").agg(n.alias("n_votes"), F.when(n > 1, same / (n * (n - 1))).alias("agreement"))


def krippendorff(votes: DataFrame) -> DataFrame:
    """One row (n_items, n_votes, alpha) over items with two votes or more, nominal labels; alpha is null without disagreement to expect."""
    by_label = votes.groupBy("item", "label").agg(F.count("*").alias("n"))
    sizes = by_label.groupBy("item").agg(F.sum("n").alias("m")).where("m > 1")
    paired = by_label.join(sizes, "item")
    inside = paired.agg(F.countDistinct("item").alias("n_items"), F.sum("n").alias("n_votes"), F.sum(F.col("n") * (F.col("m") - F.col("n")) / (F.col("m") - 1)).alias("observed"))
    shares = paired.groupBy("label").agg(F.sum("n").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("squares"))
    both = inside.join(F.broadcast(shares))
    expected = (F.col("n_votes") * F.col("n_votes") - F.col("squares")) / (F.col("n_votes") - 1)
    return both.select("n_items", F.coalesce("n_votes", F.lit(0)).alias("n_votes"), F.when(expected > 0, 1 - F.col("observed") / expected).alias("alpha"))


def reliability(result: Consensus, z: float = 1.96) -> DataFrame:
    """(who, n_votes, reliability, low, high): chance that a vote names the item's class, with a posterior interval.

    Mean and interval of the Beta posterior with the model's own prior weights.
    """
    width = BANDS + 1
    right = sum((F.when(F.floor(F.col("outcome") / width) == k, F.col(f"n{k}")).otherwise(0.0) for k in range(len(LABELS))), F.lit(0.0))
    all_votes = sum((F.col(f"n{k}") for k in range(len(LABELS))), F.lit(0.0))
    sums = result.counts.where("outcome >= 0").groupBy("who").agg(F.sum(right).alias("right"), F.sum(all_votes).alias("votes"))
    a = F.col("right") + PRIOR_RIGHT
    b = F.col("votes") - F.col("right") + PRIOR_WRONG * (len(LABELS) - 1)
    mean = a / (a + b)
    sd = F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    who = F.when(F.col("who") != NAMELESS, F.col("who"))
    return sums.select(who.alias("who"), F.round("votes").cast("long").alias("n_votes"), mean.alias("reliability"), F.greatest(F.lit(0.0), mean - z * sd).alias("low"), F.least(F.lit(1.0), mean + z * sd).alias("high"))

