"""Tree scores, isotonic calibration, the policy grid and the routed cascade."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import FEATURE_NAMES


def fixture_tree_score() -> Column:
    """Deterministic stand-in for a fitted tree."""
    total = 0.1 * F.col("dense_similarity") + 0.5 * F.col("business_name_sequence") + 0.35 * F.col("business_address_sequence") + 0.05 * F.col("country_exact")
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def fit_gbt(train: DataFrame, dev: DataFrame, *, trees: int = 400, depth: int = 6, rate: float = 0.05, patience: int = 30, bins: int = 256, seed: int = 42, step: int = 40):
    """Boosted trees cut to the round with the least dev log loss.

    Grows `step` more rounds at a time and stops once the best is `patience` rounds back. Returns (model, best round).
    """
    from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    assemble = VectorAssembler(inputCols=FEATURE_NAMES, outputCol="features")
    ready, held = (assemble.transform(d).select("features", F.col("label").cast("double").alias("label")).cache() for d in (train, dev))
    best, model, grown = 0, None, 0
    while grown < trees:
        grown = min(trees, grown + step)
        model = GBTClassifier(maxIter=grown, maxDepth=depth, stepSize=rate, maxBins=bins, lossType="logistic", seed=seed, featuresCol="features", labelCol="label").fit(ready)
        losses = model.evaluateEachIteration(held)
        best = int(np.argmin(losses)) + 1
        if grown - best >= patience:
            break
    if best < grown:
        model = GBTClassifier(maxIter=best, maxDepth=depth, stepSize=rate, maxBins=bins, lossType="logistic", seed=seed, featuresCol="features", labelCol="label").fit(ready)
    ready.unpersist()
    held.unpersist()
    assert isinstance(model, GBTClassificationModel)
    return model, best


def gbt_scores(model, rows: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(VectorAssembler(inputCols=FEATURE_NAMES, outputCol="features").transform(rows))
    return scored.withColumn("x", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def isotonic_knots(scored: DataFrame, score: str, label: str = "label") -> list[tuple[float, float]]:
    """Boundaries and values of the non-decreasing least-squares fit. Few, whatever the rows: ties are averaged first."""
    from pyspark.ml.regression import IsotonicRegression

    tied = scored.groupBy(score).agg(F.avg(F.col(label).cast("double")).alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
    model = IsotonicRegression(featuresCol=score, labelCol="y", weightCol="w").fit(tied)
    return list(zip(model.boundaries.toArray().tolist(), model.predictions.toArray().tolist()))


def isotonic_apply(score: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear interpolation between knots, clipped at the ends, as a native expression."""
    at = F.array(*[F.lit(float(x)) for x, _ in knots])
    value = F.array(*[F.lit(float(y)) for _, y in knots])
    below = F.size(F.filter(at, lambda x: x <= score))
    x0, x1 = F.get(at, below - 1), F.get(at, below)
    y0, y1 = F.get(value, below - 1), F.get(value, below)
    return F.when(below == 0, F.lit(float(knots[0][1]))).when(below == len(knots), F.lit(float(knots[-1][1]))).otherwise(y0 + (score - x0) * (y1 - y0) / (x1 - x0))


def policy_values(size: int) -> list[float]:
    return sorted({-1e-6, 1 + 1e-6, *np.linspace(0, 1, size).tolist()})


def policy_grid(spark, size: int) -> DataFrame:
    """(policy, lower, upper, acceptance) in order; size^3 rows, known beforehand."""
    v = policy_values(size)
    rows = [(lo, hi, c) for lo in v for hi in v if lo < hi for c in v]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "policy int, lower double, upper double, acceptance double")


def route(x: Column, c: Column, lower: Column, upper: Column, acceptance: Column) -> tuple[Column, Column]:
    """(accepted, routed): both thresholds route inclusively, scores above the upper one are accepted."""
    routed = (x >= lower) & (x <= upper)
    return (x > upper) | (routed & F.coalesce(c >= acceptance, F.lit(False))), routed


def entity_f(tp: Column, predicted: Column, positives: Column) -> Column:
    """F0.5 of one entity; without positives 1 if nothing is predicted, else 0."""
    return F.when(positives == 0, (predicted == 0).cast("double")).when(tp == 0, F.lit(0.0)).otherwise(1.25 * tp / (0.25 * positives + predicted))


def evaluate_policies(scored: DataFrame, entities: DataFrame, truth: DataFrame, grid: DataFrame) -> DataFrame:
    """Per policy the sums over entities: f, tp, predicted, routed.

    scored (qid, x, c, label); entities (qid) count even without pairs. The grid is a fixed parameter, not data. Pairs
    are gathered by entity, which has a bounded number of candidates; an entity is held against all policies at once
    where it lies, and a task gives one row a policy.
    """
    rows = grid.collect()
    marks = [sorted({r[n] for r in rows}) for n in ("lower", "upper", "acceptance")]
    place = [np.array([marks[k].index(r[n]) for r in rows]) for k, n in enumerate(("lower", "upper", "acceptance"))]
    lower, upper, acceptance = map(np.array, marks)
    numbers = [r["policy"] for r in rows]
    positives = entities.join(truth.groupBy("qid").agg(F.count(F.lit(1)).alias("positives")), "qid", "left").select("qid", F.coalesce("positives", F.lit(0)).alias("positives"))
    own = scored.groupBy("qid").agg(*[F.collect_list(F.coalesce(F.col(n).cast("double"), F.lit(float("nan")))).alias(n) for n in ("x", "c", "label")])
    ready = positives.join(own, "qid", "left").select("positives", "x", "c", "label")
    kind = grid.schema["policy"].dataType.simpleString()

    def run(frames):
        sums = np.zeros((4, len(rows)))
        for frame in frames:
            for n, x, c, label in zip(frame["positives"], frame["x"], frame["c"], frame["label"]):
                x, c, label = (np.zeros(0) if v is None else np.asarray(v, float) for v in (x, c, label))
                above, routed = (x[:, None] > upper).astype(float), (x[:, None, None] >= lower[:, None]) & (x[:, None, None] <= upper)
                taken = (c[:, None] >= acceptance).astype(float)
                counts = []
                for weight in (np.ones(len(x)), (label == 1).astype(float)):
                    both = np.tensordot(routed * weight[:, None, None], taken, (0, 0))
                    counts.append((weight @ above)[None, :, None] + both)
                predicted, tp = (v[place[0], place[1], place[2]] for v in counts)
                f = (predicted == 0).astype(float) if n == 0 else 1.25 * tp / (0.25 * n + predicted)
                sums += np.stack([f, tp, predicted, routed.sum(axis=0)[place[0], place[1]]])
        yield pd.DataFrame({"policy": numbers, "f": sums[0], "tp": sums[1].astype(np.int64), "predicted": sums[2].astype(np.int64), "routed": sums[3].astype(np.int64)})

    parts = ready.mapInPandas(run, f"policy {kind}, f double, tp long, predicted long, routed long")
    return grid.join(parts.groupBy("policy").agg(*[F.sum(n).alias(n) for n in ("f", "tp", "predicted", "routed")]), "policy").select(*grid.columns, "f", "tp", "predicted", "routed")


def best_policy(evaluated: DataFrame) -> DataFrame:
    """The row with the largest f, then precision, fewest routed pairs, smallest number."""
    precision = F.col("tp") / F.greatest("predicted", F.lit(1))
    return evaluated.withColumn("precision", precision).orderBy(F.desc(F.round("f", 9)), F.desc("precision"), "routed", "policy").limit(1)


def decide(scored: DataFrame, lower: float, upper: float, acceptance: float, cross=None, knots: list | None = None) -> DataFrame:
    """(qid, tid, x, c, routed, accepted). `cross` scores the routed pairs alone; c is null elsewhere.

    `cross` maps a frame to one with a column c; `knots` calibrate it.
    """
    flagged = scored.withColumn("routed", (F.col("x") >= lower) & (F.col("x") <= upper))
    if cross is None:
        if not flagged.where("routed").isEmpty():
            raise ValueError("routed pairs need a second scorer")
        ready = flagged.withColumn("c", F.lit(None).cast("double"))
    else:
        sent = cross(flagged.where("routed"))
        sent = sent.select("qid", "tid", (isotonic_apply(F.col("c"), knots) if knots else F.col("c")).alias("c"))
        ready = flagged.join(sent, ["qid", "tid"], "left")
    accepted, _ = route(F.col("x"), F.col("c"), F.lit(lower), F.lit(upper), F.lit(acceptance))
    return ready.select("qid", "tid", "x", "c", "routed", accepted.alias("accepted"))


def isotonic_by_blocks(scored: DataFrame, score: str, label: str = "label") -> DataFrame:
    """(score, fit) by the max-min formula, for small inputs: an independent statement of the fit."""
    tied = scored.groupBy(score).agg(F.sum(F.col(label).cast("double")).alias("s"), F.count(F.lit(1)).alias("n")).withColumn("i", F.row_number().over(Window.orderBy(score)))
    upto = lambda c: F.sum(c).over(Window.orderBy("i"))
    run = tied.select("i", upto("s").alias("sum"), upto("n").alias("num"), "s", "n")
    a, b = run.select(F.col("i").alias("j"), (F.col("sum") - F.col("s")).alias("sum0"), (F.col("num") - F.col("n")).alias("num0")), run.select(F.col("i").alias("k"), "sum", "num")
    means = a.join(b, F.col("j") <= F.col("k")).select("j", "k", ((F.col("sum") - F.col("sum0")) / (F.col("num") - F.col("num0"))).alias("m"))
    inner = means.withColumn("low", F.min("m").over(Window.partitionBy("j").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)))
    return tied.select("i", score).join(inner, (F.col("k") == F.col("i")) & (F.col("j") <= F.col("i"))).groupBy("i", score).agg(F.max("low").alias("fit")).drop("i")
