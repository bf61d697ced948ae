"""The registered queries of the similarity engine. Pair queries run over all consecutive turns of conversations, whole texts; evaluation queries over all of lineitem.

The labels of both are fixtures (who speaks, whether a line was returned): they exercise the
operators and say nothing about accuracy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import native, registry
from pairloom.functions import text as T
from pairloom.operators import ensemble, evaluate, learn, vectors
from pairloom.operators.pairs import turn_pairs, with_code
from pairloom.plans import oracles
from pairloom.session import ship_package

COLUMNS = ["s1", "s2", "s3"]
IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
SEED = 7
RATES = ("accuracy", "precision", "recall", "f1", "mcc")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = turn_pairs(read(spark, sf_dir, "conversations"))
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("code1", "code2")})


def cores(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread_out(frame: DataFrame) -> DataFrame:
    """Measures cost far more a row than reading does: rows go to every core."""
    return frame.repartition(cores(frame.sparkSession))


def rounded(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.round(c, 6) for c in columns})


def native_scores(spark: SparkSession, sf_dir: str, wanted: list[str]) -> DataFrame:
    """(conv_id, turn, label, measures...): texts meet by identifiers, and features are made behind the join, on all cores. A text's features are up to a hundred times its size, so they are neither dealt out nor written."""
    dealt = read(spark, sf_dir, "conversations").repartition(cores(spark), "conv_id", "turn")
    before = dealt.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("code1"), (F.col("role") == "user").cast("int").alias("label"))
    after = read(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") - 1).alias("turn"), F.coalesce("text", F.lit("")).alias("code2")).repartition(cores(spark), "conv_id", "turn")
    return registry.score(before.join(after, ["conv_id", "turn"]), wanted).select("conv_id", "turn", "label", *wanted)


def measure_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if name == "lev":  # DuckDB's distance counts bytes: both sides compare ASCII
            own = spread_out(pairs(spark, sf_dir).withColumns({c: F.regexp_replace(c, r"[^\x00-\x7F]", "") for c in ("code1", "code2")}))
            scored = registry.score(own, [name])
        elif name in native.MEASURES or name in native.TEACHING:
            scored = native_scores(spark, sf_dir, [name])
        else:
            scored = registry.score(spread_out(pairs(spark, sf_dir)), [name])
        return scored.select("conv_id", "turn", F.round(F.col(name), 6).alias("score"))

    return run


def lev_whole(spark, sf_dir):
    """Edit distance by code points over whole texts; DuckDB's counts bytes, so there is no SQL for it."""
    return registry.score(spread_out(pairs(spark, sf_dir)), ["lev"]).select("conv_id", "turn", F.round("lev", 6).alias("score"))


def exe_zero(spark, sf_dir):
    return registry.score(pairs(spark, sf_dir), ["exe"]).select("conv_id", "turn", F.col("exe").alias("score"))


def exe_outputs(spark, sf_dir):
    """Captured outputs (here: the texts) compared; nothing is run."""
    from pairloom.functions.sequences import output_ratio

    own = spread_out(pairs(spark, sf_dir))
    return own.select("conv_id", "turn", F.round(registry.arrow_measure(output_ratio)(F.col("code1"), F.col("code2")), 6).alias("score"))


def comments_w2v(spark, sf_dir):
    return rounded(vectors.word_vector_scores(pairs(spark, sf_dir)).select("conv_id", "turn", "score"), "score")


def embedding_cosine(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    follow = v.select(F.col("id").alias("id1"), (F.col("id") + 1).alias("id2"))
    return rounded(vectors.embedding_cosine(v, follow), "score")


def flagship(spark, sf_dir):
    scored = native_scores(spark, sf_dir, ["bow", "jaccard", "ngrams", "winn"])
    out = rounded(scored, "bow", "jaccard", "ngrams", "winn")
    return out.withColumn("mean", F.round((F.col("bow") + F.col("jaccard") + F.col("ngrams") + F.col("winn")) / 4, 4))


def feature_rows(spark, sf_dir):
    """All text measures of every pair, one row each, as the feature sink writes them."""
    wanted = registry.names()
    return rounded(registry.score(spread_out(pairs(spark, sf_dir)), wanted).select("conv_id", "turn", *wanted, "label"), *wanted)


def pair_join(spark, sf_dir):
    own = with_code(turn_pairs(read(spark, sf_dir, "conversations")))
    return own.select("conv_id", "turn", F.length("code1").cast("long").alias("n1"), F.length("code2").cast("long").alias("n2"), "label")


def method_names(spark, sf_dir):
    found = T.find_all(F.col("code1"), native.APART + native.METHOD, 1)
    return pairs(spark, sf_dir).select("conv_id", "turn", F.size(found).cast("long").alias("n"))


def code_metrics(spark, sf_dir):
    v = native.code_metrics(F.col("code1"))
    own = spread_out(pairs(spark, sf_dir)).select("conv_id", "turn", v.alias("v"))
    return own.select("conv_id", "turn", *(F.round(F.get("v", F.lit(i)), 6).alias(n) for i, n in enumerate(native.METRIC_NAMES)))


def graph_edges(spark, sf_dir):
    """The edges of each first turn's token graph."""
    own = pairs(spark, sf_dir).withColumn("t", T.blank_split(F.col("code1")))
    edge = F.zip_with(F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", F.lit(2), F.size("t")), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))
    return own.select("conv_id", "turn", F.explode(F.array_distinct(edge)).alias("e")).select("conv_id", "turn", "e.src", "e.dst")


def snippet_scores(spark, sf_dir):
    """The batch run: snippets by identifier, listed pairs, features once a snippet, scores."""
    turns = read(spark, sf_dir, "conversations")
    name = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    snippets = turns.select(name(F.col("turn")).alias("idx"), F.col("text").alias("func"))
    listed = pairs(spark, sf_dir).select(name(F.col("turn")).alias("id1"), name(F.col("turn") + 1).alias("id2"), "label")
    wanted = ["fcall", "graph", "jaccard"]
    return rounded(registry.score_snippets(snippets, listed, wanted), *wanted)


def semclone_flag(spark, sf_dir):
    """Whether both texts declare a public method of one name and are alike."""
    from pairloom.functions.sequences import shares_method

    own = spread_out(pairs(spark, sf_dir))
    flag = registry.arrow_measure(lambda a, b: float(shares_method(a, b)))
    return own.select("conv_id", "turn", (flag(F.col("code1"), F.col("code2")) == 1).alias("clone"))


def semantic_diff(spark, sf_dir):
    """Added and removed lines of each pair, as counts."""
    from pairloom.functions.sequences import line_changes

    own = spread_out(pairs(spark, sf_dir))
    count = lambda k: registry.arrow_measure(lambda a, b: float(len(line_changes(a, b)[k])))(F.col("code1"), F.col("code2")).cast("long")
    return own.select("conv_id", "turn", count(0).alias("added"), count(1).alias("removed"))


def robustness(spark, sf_dir):
    """Mean score of each native measure between a text and what a probe makes of it: how far formatting, comments and added lines move it.

    Every text counts, null as empty. A text's own features are made once, below the probes, in the task that compares them.
    """
    from pairloom.functions.probes import PROBES

    wanted = [n for n in registry.names() if n in native.MEASURES]
    made = lambda side, code: (native.MEASURES[m].features(F.col(code)).alias(f"{side}_{m}") for m in wanted)
    texts = spread_out(read(spark, sf_dir, "conversations").select(F.coalesce("text", F.lit("")).alias("code1")))
    probe = F.explode(F.array(*(F.struct(F.lit(n).alias("probe"), f(F.col("code1")).alias("code2")) for n, f in PROBES.items())))
    probed = texts.select("code1", *made("a", "code1")).select("*", probe.alias("p")).select("p.*", *(f"a_{m}" for m in wanted))
    scored = registry.combine(probed.select("probe", *(f"a_{m}" for m in wanted), *made("b", "code2")), wanted, ["probe"])
    return rounded(scored.groupBy("probe").agg(*(F.avg(m).alias(m) for m in wanted)), *wanted)


def token_graph(spark, sf_dir):
    own = pairs(spark, sf_dir).withColumn("t", T.blank_split(F.col("code1")))
    edge = F.zip_with(F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", F.lit(2), F.size("t")), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))
    return own.select("conv_id", "turn", F.size(F.array_distinct(edge)).cast("long").alias("edges"), F.size(F.array_distinct("t")).cast("long").alias("nodes"))


def wide(spark, sf_dir) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    return lines.select(*IDS, F.col("l_discount").alias("s1"), F.col("l_tax").alias("s2"), F.col("l_quantity").alias("s3"), (F.col("l_returnflag") == "R").cast("int").alias("label"))


def scores(spark, sf_dir) -> DataFrame:
    return evaluate.long_form(wide(spark, sf_dir), COLUMNS)


def confusion(spark, sf_dir):
    return evaluate.confusion(scores(spark, sf_dir), F.lit(0.05))


def metrics_at(spark, sf_dir):
    return rounded(evaluate.metrics_at(scores(spark, sf_dir), 0.05).drop("threshold"), *RATES)


def roc_auc(spark, sf_dir):
    return rounded(evaluate.roc_auc(scores(spark, sf_dir)), "auc")


def youden_threshold(spark, sf_dir):
    return rounded(evaluate.youden(scores(spark, sf_dir)), "j")


def best_f1_threshold(spark, sf_dir):
    return rounded(evaluate.best_f1(scores(spark, sf_dir)), *RATES)


def leaderboard(spark, sf_dir):
    return rounded(evaluate.leaderboard(scores(spark, sf_dir)).select("measure", "threshold", *RATES, "auc"), *RATES, "auc")


def pr_auc(spark, sf_dir):
    return rounded(evaluate.pr_auc(scores(spark, sf_dir)), "average_precision")


def separation(spark, sf_dir):
    return rounded(evaluate.separation(scores(spark, sf_dir)), "separation")


def corr_pairs(spark, sf_dir):
    return rounded(evaluate.correlations(wide(spark, sf_dir), COLUMNS), "r")


def label_balance(spark, sf_dir):
    return rounded(evaluate.label_balance(wide(spark, sf_dir)), "rate")


def by_type(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    own = lines.select(F.lit("s1").alias("measure"), F.col("l_linestatus").alias("kind"), F.col("l_discount").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return rounded(evaluate.by_type(own, "kind", 0.05), *RATES)


def three_way(spark, sf_dir):
    return ensemble.three_way(wide(spark, sf_dir), IDS, seed=SEED).select(*IDS, "split")


def best_single(spark, sf_dir):
    return rounded(evaluate.best_single(wide(spark, sf_dir), IDS, COLUMNS, seed=SEED), *RATES)


def repeated_splits(spark, sf_dir):
    """Held-out F1 of the best single measure, the mean ensemble and a logistic regression over five splits."""
    found = evaluate.repeated_splits(wide(spark, sf_dir), IDS, COLUMNS)
    return rounded(evaluate.split_summary(found, "system", "f1"), "mean", "std")


def logit_metrics(spark, sf_dir):
    """Metrics of the classes that two logits name."""
    own = wide(spark, sf_dir).withColumn("logits", F.array("s1", "s2"))
    scored = own.select(F.lit("logits").alias("measure"), learn.argmax_label().cast("double").alias("score"), "label")
    return rounded(evaluate.metrics_at(scored, 0.5).drop("threshold"), *RATES)


def forest_search(spark, sf_dir):
    """A small grid over the train rows; the operator's own grid is larger."""
    own = ensemble.split_train_test(wide(spark, sf_dir).withColumn("label", F.col("label").cast("double")), IDS, seed=SEED)
    found = learn.forest_search(own.filter("split = 'train'"), COLUMNS, trees=(4, 8), depths=(2, 4), least=(2,), folds=2, seed=SEED)
    return rounded(learn.search_table(found), "f1")


def boosted_search(spark, sf_dir):
    """Two draws over the train rows; the operator's own number is larger."""
    own = ensemble.split_train_test(wide(spark, sf_dir).withColumn("label", F.col("label").cast("double")), IDS, seed=SEED)
    found = learn.boosted_search(own.filter("split = 'train'"), COLUMNS, draws=2, folds=2, seed=SEED, rounds=(2, 4), depths=(2, 3))
    return rounded(learn.search_table(found), "f1")


def split_train_test(spark, sf_dir):
    return ensemble.split_train_test(wide(spark, sf_dir), IDS, seed=SEED).select(*IDS, "split")


def sample_exact_k(spark, sf_dir):
    return ensemble.sample_exact(wide(spark, sf_dir), IDS, 500, seed=SEED).select(*IDS)


def minmax_scale(spark, sf_dir):
    return rounded(ensemble.scale(wide(spark, sf_dir), COLUMNS).select(*IDS, *COLUMNS), *COLUMNS)


def zscore_train(spark, sf_dir):
    own = ensemble.split_train_test(wide(spark, sf_dir), IDS, seed=SEED)
    return rounded(ensemble.zscore(own, COLUMNS, own.filter("split = 'train'")).select(*IDS, *COLUMNS), *COLUMNS)


def mean_ensemble(spark, sf_dir):
    return rounded(ensemble.mean_ensemble(wide(spark, sf_dir), COLUMNS).select(*IDS, "ensemble"), "ensemble")


def vote_ensemble(spark, sf_dir):
    own = wide(spark, sf_dir)
    # One row for each measure.
    best = {r.measure: r.threshold for r in evaluate.best_f1(evaluate.long_form(own, COLUMNS)).collect()}
    return rounded(ensemble.vote_ensemble(own, {c: best[c] for c in COLUMNS}).select(*IDS, "ensemble"), "ensemble")


def explain(spark, sf_dir):
    out = ensemble.explain(ensemble.scale(wide(spark, sf_dir), COLUMNS), COLUMNS)
    out = out.withColumns({c: F.array_join(c, ",") for c in ("supporting", "dissenting")})
    return rounded(out.select(*IDS, "verdict", "confidence", "disagreement", "uncertain", "supporting", "dissenting"), "confidence", "disagreement")


def learned(kind: str):
    def run(spark, sf_dir):
        own = ensemble.split_train_test(wide(spark, sf_dir).withColumn("label", F.col("label").cast("double")), IDS, seed=SEED)
        fit = {"logreg": learn.logistic, "rf": lambda t, c: learn.forest(t, c, trees=20, depth=5), "gbt": lambda t, c: learn.boosted(t, c, rounds=5, depth=3)}[kind]
        model = fit(own.filter("split = 'train'"), COLUMNS)
        scored = learn.probabilities(model, own.filter("split = 'test'"))
        return rounded(evaluate.metrics_at(scored.select(F.lit(kind).alias("measure"), "score", F.col("label").cast("int").alias("label")), 0.5), *RATES)

    return run


def rf_importances(spark, sf_dir):
    own = wide(spark, sf_dir).withColumn("label", F.col("label").cast("double"))
    return learn.importances(learn.forest(own, COLUMNS, trees=20, depth=5), COLUMNS)


QUERIES: dict = {n: measure_query(n) for n in registry.names() if n != "exe"} | {n: measure_query(n) for n in registry.names(teaching=True)}
QUERIES |= {
    f.__name__: f
    for f in (
        lev_whole, exe_zero, exe_outputs, comments_w2v, embedding_cosine, flagship, feature_rows, pair_join, method_names, code_metrics, token_graph, graph_edges, snippet_scores, semclone_flag, semantic_diff,
        robustness, three_way, best_single, repeated_splits, logit_metrics, forest_search, boosted_search, confusion, metrics_at, roc_auc,
        youden_threshold, best_f1_threshold, leaderboard, pr_auc, separation, corr_pairs, label_balance, by_type, split_train_test, sample_exact_k, minmax_scale, zscore_train,
        mean_ensemble, vote_ensemble, explain, rf_importances,
    )
}
QUERIES |= {k: learned(k) for k in ("logreg", "rf", "gbt")}

ORACLES: dict[str, str] = oracles.MEASURES | oracles.EVALUATION | {"flagship": oracles.FLAGSHIP, "graph_edges": oracles.EDGES, "best_single": oracles.BEST_SINGLE, "logit_metrics": oracles.LOGITS, "snippet_scores": oracles.SNIPPETS, "three_way": oracles.THREE_WAY}
