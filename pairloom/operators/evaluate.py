"""Evaluation of scores against 0/1 labels, per measure.

Input in long form: (measure, score, label). Every operator first counts per (measure, score),
which is combined map-side; sweeps then run over distinct scores, not rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.text import ratio
from pairloom.session import materialize


def long_form(wide: DataFrame, measures: list[str], label: str = "label") -> DataFrame:
    return wide.select(F.col(label).cast("int").alias("label"), *(F.col(m).cast("double").alias(m) for m in measures)).unpivot("label", measures, "measure", "score")


def confusion(scores: DataFrame, threshold: Column) -> DataFrame:
    """tp, tn, fp, fn per measure at score >= threshold."""
    hit, real = F.col("score") >= threshold, F.col("label") == 1
    return scores.groupBy("measure").agg(F.count_if(hit & real).alias("tp"), F.count_if(~hit & ~real).alias("tn"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"))


def with_metrics(counted: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1, mcc from the four counts; 0 where undefined."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    out = counted.withColumns({"accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumns({"f1": ratio(2 * p * r, p + r), "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))})


def metrics_at(scores: DataFrame, threshold: float) -> DataFrame:
    return with_metrics(confusion(scores, F.lit(threshold)).withColumn("threshold", F.lit(float(threshold))))


def per_score(scores: DataFrame) -> DataFrame:
    return scores.groupBy("measure", "score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))


def per_weighted_score(rows: DataFrame, measures: list[str], weight: str = "n") -> DataFrame:
    """per_score() of rows that each stand for weight equal ones."""
    wide = rows.select(F.col("label").cast("int").alias("label"), F.col(weight).alias("__n"), *(F.col(m).cast("double").alias(m) for m in measures))
    counted = lambda y: F.sum(F.when(F.col("label") == y, F.col("__n")).otherwise(F.lit(0)))
    return wide.unpivot(["label", "__n"], measures, "measure", "score").groupBy("measure", "score").agg(counted(1).alias("pos"), counted(0).alias("neg"))


def running_counts(counted: DataFrame) -> DataFrame:
    """per_score() with tp and fp, the positives and negatives at or above each score, and p and n of the measure.

    A measure's scores may be as many as the rows, so no task holds a whole measure: bounds at the measure's quantiles
    deal scores to buckets, sums run within a bucket, and the totals of the buckets above are added. Bounds and totals
    have a row a measure and bucket, which is what is broadcast.
    """
    n = max(2, int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = counted.groupBy("measure").agg(F.percentile_approx("score", [i / n for i in range(1, n)], 10_000).alias("bounds"))
    placed = counted.join(F.broadcast(bounds), "measure").withColumn("bucket", F.size(F.filter("bounds", lambda b: b > F.col("score")))).drop("bounds")
    totals = placed.groupBy("measure", "bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    whole = Window.partitionBy("measure")
    above = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("measure", "bucket", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("pos", "neg")), F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("n"))
    down = Window.partitionBy("measure", "bucket").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down)})
    joined = own.join(F.broadcast(offsets), ["measure", "bucket"])
    return joined.select("measure", "score", "pos", "neg", (F.col("tp") + F.col("pos_above")).alias("tp"), (F.col("fp") + F.col("neg_above")).alias("fp"), "p", "n")


def ranked(scores: DataFrame) -> DataFrame:
    """running_counts of the scores, whose counts are written once: they are read for bounds, totals and sums."""
    return running_counts(materialize(per_score(scores), "per-score"))


def _sweep(run: DataFrame) -> DataFrame:
    return run.select("measure", F.col("score").alias("threshold"), "tp", (F.col("n") - F.col("fp")).alias("tn"), "fp", (F.col("p") - F.col("tp")).alias("fn"))


def sweep(scores: DataFrame) -> DataFrame:
    """Each distinct score as a threshold: (measure, threshold, tp, tn, fp, fn)."""
    return _sweep(ranked(scores))


def _best(frame: DataFrame, *order: Column) -> DataFrame:
    """The row of each measure that is largest in order, combined map-side."""
    return frame.groupBy("measure").agg(F.max_by(F.struct(*(c for c in frame.columns if c != "measure")), F.struct(*order)).alias("best")).select("measure", "best.*")


def _best_f1(run: DataFrame) -> DataFrame:
    return _best(with_metrics(_sweep(run)), F.round("f1", 12), F.col("threshold"))


def best_f1(scores: DataFrame) -> DataFrame:
    """The threshold of the highest F1; of ties the highest threshold."""
    return _best_f1(ranked(scores))


def youden(scores: DataFrame) -> DataFrame:
    """The threshold of the largest TPR - FPR; of ties the highest, infinity where nothing beats 0."""
    rates = ranked(scores).select("measure", F.col("score").alias("threshold"), (ratio(F.col("tp"), F.col("p")) - ratio(F.col("fp"), F.col("n"))).alias("j"))
    best = _best(rates, F.round("j", 12), F.col("threshold"))
    none = F.round("j", 12) <= 0
    return best.select("measure", F.when(none, F.lit(float("inf"))).otherwise(F.col("threshold")).alias("threshold"), F.when(none, F.lit(0.0)).otherwise(F.col("j")).alias("j"))


def _roc_auc(run: DataFrame) -> DataFrame:
    below = F.col("p") + F.col("n") - F.col("tp") - F.col("fp")
    rank = below + (F.col("pos") + F.col("neg") + 1) / 2
    sums = run.groupBy("measure").agg(F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("n"), F.sum(F.col("pos") * rank).alias("ranks"))
    p, n = F.col("p"), F.col("n")
    return sums.select("measure", F.when(p * n == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.col("ranks") - p * (p + 1) / 2, p * n)).alias("auc"))


def roc_auc(scores: DataFrame) -> DataFrame:
    """Mann-Whitney with average ranks; NaN where a class is missing."""
    return _roc_auc(ranked(scores))


def leaderboard(scores: DataFrame) -> DataFrame:
    """Best-F1 metrics and AUC of each measure, best first."""
    run = ranked(scores)
    return _best_f1(run).join(_roc_auc(run), "measure").orderBy(F.col("f1").desc(), "measure")


def separation(scores: DataFrame, top: int | None = None) -> DataFrame:
    """Mean score of positives minus that of negatives."""
    out = scores.groupBy("measure").agg((F.avg(F.when(F.col("label") == 1, F.col("score"))) - F.avg(F.when(F.col("label") == 0, F.col("score")))).alias("separation"))
    return out if top is None else out.orderBy(F.col("separation").desc(), "measure").limit(top)


def correlations(wide: DataFrame, measures: list[str]) -> DataFrame:
    """Pearson correlation of each pair of measures, in one pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(measures) for b in measures[i + 1 :]]
    row = wide.agg(*(F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")


def label_balance(frame: DataFrame, label: str = "label") -> DataFrame:
    return frame.agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("positives"), F.avg(label).alias("rate"))


def by_type(scores: DataFrame, kind: str, threshold: float) -> DataFrame:
    """Metrics per measure and type of pair, with the total of each measure as type null."""
    hit, real = F.col("score") >= threshold, F.col("label") == 1
    counted = scores.rollup("measure", kind).agg(F.count_if(hit & real).alias("tp"), F.count_if(~hit & ~real).alias("tn"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"), F.grouping("measure").alias("__g"))
    return with_metrics(counted.filter("__g = 0").drop("__g"))


def split_summary(values: DataFrame, group: str, value: str) -> DataFrame:
    """Mean and population standard deviation over repeated splits."""
    return values.groupBy(group).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def pr_auc(scores: DataFrame) -> DataFrame:
    """Average precision: each score's share of the positives, times the precision from it on."""
    points = ranked(scores).select("measure", (ratio(F.col("pos"), F.col("p")) * ratio(F.col("tp"), F.col("tp") + F.col("fp"))).alias("part"))
    return points.groupBy("measure").agg(F.sum("part").alias("average_precision"))


def repeated_splits(frame: DataFrame, ids: list[str], measures: list[str], splits: int = 5, test_share: float = 0.3, learned: bool = True) -> DataFrame:
    """F1 on held-out rows, (seed, system, f1): the single measure that is best on the train rows, the mean ensemble scaled by them, and a logistic regression on them.

    Thresholds, too, come from the train rows. frame has a 0/1 label; splits are a handful, and each of them collects a threshold a measure.
    Rows are read and dealt to all splits once: equal rows (measures and label) are counted by side, and counts stand for rows from there on.
    """
    from pairloom.operators import ensemble, learn

    spark, out = frame.sparkSession, []
    sides = ensemble.split_sides(ids, test_share, range(splits))
    counted = frame.groupBy(*measures, "label").agg(*(F.count_if(side == name).alias(f"{name}_{seed}") for seed, side in enumerate(sides) for name in ("train", "test")))
    counted = materialize(counted, "split-counts")
    for seed in range(splits):
        train, test = (counted.filter(F.col(f"{side}_{seed}") > 0).select(*measures, "label", F.col(f"{side}_{seed}").alias("n")) for side in ("train", "test"))
        found = _best_f1(running_counts(materialize(per_weighted_score(train, measures), "per-score"))).collect()
        best = min(found, key=lambda r: (-round(r.f1, 12), measures.index(r.measure)))
        scored = {"mean": [ensemble.mean_ensemble(x, measures, train).select(F.col("ensemble").alias("mean"), "label", "n") for x in (train, test)]}
        if learned:
            model = learn.logistic(train.withColumn("label", F.col("label").cast("double")), measures, weight="n")
            scored["logreg"] = [learn.probabilities(model, x.withColumn("label", F.col("label").cast("double"))).select(F.col("score").alias("logreg"), F.col("label").cast("int").alias("label"), "n") for x in (train, test)]
        # All systems at once: each is a measure of the long form.
        together = lambda side: reduce(DataFrame.union, (per_weighted_score(x[side], [name]) for name, x in scored.items()))
        cuts = {r.measure: r.threshold for r in _best_f1(running_counts(materialize(together(0), "per-score"))).collect()} | {"best_single": best.threshold}
        on_test = together(1).union(per_weighted_score(test.select(F.col(best.measure).alias("best_single"), "label", "n"), ["best_single"]))
        threshold = F.element_at(F.create_map(*(F.lit(x) for pair in cuts.items() for x in pair)), F.col("measure"))
        hit = F.col("score") >= threshold
        total = lambda keep, c: F.sum(F.when(keep, F.col(c)).otherwise(F.lit(0)))
        cells = on_test.groupBy("measure").agg(total(hit, "pos").alias("tp"), total(~hit, "neg").alias("tn"), total(hit, "neg").alias("fp"), total(~hit, "pos").alias("fn"))
        out += [(seed, r.measure, r.f1) for r in with_metrics(cells).collect()]
    return spark.createDataFrame(out, "seed int, system string, f1 double")


def best_single(frame: DataFrame, ids: list[str], measures: list[str], test_share: float = 0.3, seed: int = 0) -> DataFrame:
    """The measure and threshold that are best by F1 on the train rows, with their metrics on the test rows."""
    from pairloom.operators import ensemble

    own = ensemble.split_train_test(frame, ids, test_share, seed)
    on_train = best_f1(long_form(own.filter("split = 'train'"), measures))
    order = F.array_position(F.array(*map(F.lit, measures)), F.col("measure"))
    best = on_train.orderBy(F.round("f1", 12).desc(), order).limit(1).select("measure", "threshold")  # one row
    test = long_form(own.filter("split = 'test'"), measures).join(F.broadcast(best), "measure")
    hit, real = F.col("score") >= F.col("threshold"), F.col("label") == 1
    counted = test.groupBy("measure", "threshold").agg(F.count_if(hit & real).alias("tp"), F.count_if(~hit & ~real).alias("tn"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"))
    return with_metrics(counted)
