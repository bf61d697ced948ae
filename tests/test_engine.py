"""Scans, joins, evaluation, ensembles, streaming and the registered queries."""

import json
import math
import os
import random

import duckdb
import pytest

from pyspark.sql import functions as F

import __spark_entry__
from pairloom.functions import probes
from pairloom.operators import ensemble, evaluate, learn, pairs, vectors
from pairloom.plans import catalog
from pairloom.sources import scans, sinks
from pairloom.streaming.scoring import score_stream

SCORES = [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)]


def long_scores(spark, rows):
    return spark.createDataFrame([("m", float(s), y) for s, y in rows], "measure string, score double, label int")


def test_toy_auc_and_threshold(spark):
    a = long_scores(spark, SCORES)
    assert evaluate.roc_auc(a).first().auc == pytest.approx(0.75)
    best = evaluate.best_f1(a).first()
    assert (best.threshold, best.f1) == (0.35, pytest.approx(0.8))
    b = long_scores(spark, SCORES + [(0.6, 0)])
    assert evaluate.roc_auc(b).first().auc == pytest.approx(4 / 6)
    assert evaluate.best_f1(b).first().threshold == 0.8


def test_sweeps_equal_plain_ones_over_many_scores(spark):
    """Thousands of distinct scores in several buckets, ties, and a measure with few."""
    rng = random.Random(4)
    rows = [(m, round(rng.random(), d), int(rng.random() < 0.4)) for m, d, n in (("many", 6, 3000), ("some", 2, 800), ("one", 0, 50)) for _ in range(n)]
    frame = spark.createDataFrame(rows, "measure string, score double, label int").repartition(6)
    swept = {(r.measure, r.threshold): (r.tp, r.tn, r.fp, r.fn) for r in evaluate.sweep(frame).collect()}
    found = {n: {r.measure: r for r in getattr(evaluate, n)(frame).collect()} for n in ("roc_auc", "best_f1", "youden", "pr_auc")}
    for name in ("many", "some", "one"):
        own = [(s, y) for m, s, y in rows if m == name]
        p, n = sum(y for _, y in own), sum(1 - y for _, y in own)
        at = {}
        for t in {s for s, _ in own}:
            tp, fp = sum(y for s, y in own if s >= t), sum(1 - y for s, y in own if s >= t)
            at[t] = (tp, n - fp, fp, p - tp)
        assert at == {t: v for (m, t), v in swept.items() if m == name}
        wins = sum((a > b) + 0.5 * (a == b) for a, y in own if y for b, z in own if not z)
        assert found["roc_auc"][name].auc == pytest.approx(wins / (p * n))
        f1 = lambda v: round(2 * v[0] / (2 * v[0] + v[2] + v[3]), 12)
        assert found["best_f1"][name].threshold == max(at, key=lambda t: (f1(at[t]), t))
        assert found["youden"][name].j == pytest.approx(max(0, *(v[0] / p - v[2] / n for v in at.values())))
        last, area = 0.0, 0.0
        for t in sorted(at, reverse=True):
            tp, _, fp, _ = at[t]
            area, last = area + (tp / p - last) * tp / (tp + fp), tp / p
        assert found["pr_auc"][name].average_precision == pytest.approx(area)


def test_row_numbers_over_ranges(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(50), i, "x") for i in range(2000)]
    frame = spark.createDataFrame(rows, "k int, i int, range_0 string").repartition(7)
    got = scans.ranked_lines(frame, "k", "i").collect()
    assert [(r.k, r.i) for r in sorted(got, key=lambda r: r.rank)] == sorted((k, i) for k, i, _ in rows) and sorted(r.rank for r in got) == list(range(1, 2001))
    assert scans.ranked_lines(frame.limit(0), "k").count() == 0


def test_repeated_splits_equal_plain_ones(spark):
    rng = random.Random(7)
    rows = [(i, round(rng.random() * 0.6 + y * 0.4, 3), round(rng.random(), 3), y) for i in range(300) for y in [int(rng.random() < 0.5)]]
    frame = spark.createDataFrame(rows, "id int, a double, b double, label int")

    def f1(own, t):
        tp, fp, fn = (sum(1 for s, y in own if (s >= t) == hit and y == real) for hit, real in ((True, 1), (True, 0), (False, 1)))
        return 2 * tp / (2 * tp + fp + fn) if tp else 0.0

    top = lambda own: max({s for s, _ in own}, key=lambda t: (round(f1(own, t), 12), t))
    got = {(r.seed, r.system): r.f1 for r in evaluate.repeated_splits(frame, ["id"], ["a", "b"], splits=2).collect()}
    for seed in range(2):
        side = {r.id: r.split for r in ensemble.split_train_test(frame, ["id"], 0.3, seed).collect()}
        train, test = ([r for r in rows if side[r[0]] == s] for s in ("train", "test"))
        a, t = [(r[1], r[3]) for r in train], [(r[1], r[3]) for r in test]
        assert got[seed, "best_single"] == pytest.approx(f1(t, top(a)))
        lo, hi = ([f(r[k] for r in train) for k in (1, 2)] for f in (min, max))
        mean = lambda r: sum((r[k + 1] - lo[k]) / (hi[k] - lo[k]) for k in (0, 1)) / 2
        on_train, on_test = ([(mean(r), r[3]) for r in x] for x in (train, test))
        assert got[seed, "mean"] == pytest.approx(f1(on_test, top(on_train)), abs=0.02)
        assert got[seed, "logreg"] > 0.6
    single = evaluate.best_single(frame, ["id"], ["a", "b"]).first()
    assert single.measure == "a" and single.f1 == pytest.approx(got[0, "best_single"])
    summary = {r.system: r for r in evaluate.split_summary(spark.createDataFrame([(0, "m", 0.5), (1, "m", 0.7)], "seed int, system string, f1 double"), "system", "f1").collect()}
    assert summary["m"]["mean"] == pytest.approx(0.6) and summary["m"]["std"] == pytest.approx(0.1)


def test_searches_find_the_better_point(spark):
    rows = [(i % 10 / 10, (i * 7) % 10 / 10, float((i % 10 >= 5) != ((i * 7) % 10 >= 5))) for i in range(400)]
    frame = spark.createDataFrame(rows, "a double, b double, label double")
    found = learn.search_table(learn.forest_search(frame, ["a", "b"], trees=(5,), depths=(1, 5), least=(1,), folds=2)).collect()
    assert len(found) == 2 and "maxDepth=5" in found[0].point and found[0].f1 > found[1].f1
    found = learn.search_table(learn.boosted_search(frame, ["a", "b"], draws=2, folds=2, rounds=(2,), depths=(2,))).collect()
    assert len(found) == 2 and found[0].f1 >= found[1].f1


def test_scans_of_several_files(spark, tmp_path):
    os.makedirs(tmp_path / "s")
    for name, func in (("a.jsonl", "old"), ("b.jsonl", "new")):
        (tmp_path / "s" / name).write_text("".join(json.dumps({"idx": str(i), "func": f"{func}{k}{i}"}) + "\n" for k in range(2) for i in range(50)))
    own = {r.idx: r.func for r in scans.snippets(spark, str(tmp_path / "s")).collect()}
    assert own == {str(i): f"new1{i}" for i in range(50)}
    (tmp_path / "bad.jsonl").write_text('{"idx": "1"}\n')
    with pytest.raises(Exception, match="without func"):
        scans.snippets(spark, str(tmp_path / "bad.jsonl"), strict=True).collect()
    (tmp_path / "tabs.txt").write_text("x 1\ty\t1\n")
    (row,) = scans.pair_list(spark, str(tmp_path / "tabs.txt"), tabs=True).collect()
    assert tuple(row) == ("x 1", "y", 1)
    (tmp_path / "pairs.json").write_text(json.dumps([{"code1": "a", "code2": "b", "score": 1}, {"code1": "c", "code2": "d", "score": 0}]))
    pairs_of = scans.pair_json(spark, str(tmp_path / "pairs.json"))
    assert sorted(tuple(r) for r in pairs_of.collect()) == [("a", "b", 1), ("c", "d", 0)]
    sinks.write_json(pairs_of, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_given_embeddings_and_saved_models(spark, tmp_path):
    frame = spark.createDataFrame([("aab", "aab"), ("ab", "ba"), ("a", "b"), (None, "a")], "code1 string, code2 string")

    def provider():
        import numpy as np

        return lambda texts: np.array([[t.count("a"), t.count("b")] for t in texts])

    got = [r.score for r in vectors.provided_cosine(frame, provider).collect()]
    assert got == pytest.approx([1.0, 1.0, 0.0, 0.0])
    rows = spark.createDataFrame([(float(i % 2), i % 2 * 0.9, float(i % 2)) for i in range(40)], "a double, b double, label double")
    model = learn.logistic(rows, ["a", "b"])
    sinks.save_model(model, str(tmp_path / "model"))
    again = scans.load_model(str(tmp_path / "model"))
    assert learn.probabilities(again, rows).select("score").collect() == learn.probabilities(model, rows).select("score").collect()
    logits = spark.createDataFrame([([0.1, 0.9],), ([2.0, 2.0],)], "logits array<double>")
    assert [r.y for r in logits.select(learn.argmax_label().alias("y")).collect()] == [1, 0]


def test_probes(spark):
    frame = spark.createDataFrame([("int größe = 1;\nx",)], "c string")
    got = frame.select(*(f(F.col("c")).alias(n) for n, f in probes.PROBES.items())).first()
    assert got.renamed == "int größe_x = 1;\nx" and got.reordered == "x\nint größe = 1;" and got.doubled_spaces == "int  größe  =  1;\nx"


def test_one_class_auc_is_nan_and_youden_can_be_infinite(spark):
    assert math.isnan(evaluate.roc_auc(long_scores(spark, [(0.5, 1), (0.6, 1)])).first().auc)
    assert math.isinf(evaluate.youden(long_scores(spark, [(0.9, 0), (0.1, 1)])).first().threshold)


def test_scans(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text("\n".join(json.dumps({"idx": i, "func": f}) for i, f in (("1", "a"), ("2", "b"), ("1", "c"))))
    own = scans.snippets(spark, str(tmp_path / "s.jsonl"))
    assert {r.idx: r.func for r in own.collect()} == {"1": "c", "2": "b"}
    (tmp_path / "p.txt").write_text("1 2 1\n2  1 0\n1 9 1\n")
    listed = scans.pair_list(spark, str(tmp_path / "p.txt"))
    assert sorted(tuple(r) for r in pairs.attach_code(listed, own).select("id1", "id2", "label", "code1", "code2").collect()) == [("1", "2", 1, "c", "b"), ("2", "1", 0, "b", "c")]
    (tmp_path / "bad.txt").write_text("1 2\n")
    with pytest.raises(Exception, match="three fields"):
        scans.pair_list(spark, str(tmp_path / "bad.txt")).collect()
    good = "[" + ", ".join(["0.5"] * 22) + "]"
    (tmp_path / "f.txt").write_text(f"{good}\n\nnot json\n[1, 2]\n{good}\n")
    assert scans.feature_rows(spark, str(tmp_path / "f.txt")).count() == 2
    assert scans.feature_rows(spark, str(tmp_path / "f.txt"), max_rows=1).count() == 1
    assert scans.feature_rows(spark, str(tmp_path / "f.txt"), mode="report").filter("bad IS NOT NULL").count() == 2
    with pytest.raises(Exception, match="malformed"):
        scans.feature_rows(spark, str(tmp_path / "f.txt"), mode="fail").collect()


def test_labelled_tree(spark, tmp_path):
    for path in ("case-01/original/O.java", "case-01/plagiarized/L2/03/P.java", "case-01/non-plagiarized/01/N.java", "case-02/original/A.java", "case-02/original/B.java", "case-02/non-plagiarized/01/N.java"):
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(f"class {file.stem} {{\n}}\n")
    found = pairs.case_pairs(scans.labelled_tree(spark, str(tmp_path))).collect()
    assert sorted((r.case_id, r.level or "", r.label) for r in found) == [("case-01", "", 0), ("case-01", "L2", 1)]


def test_curated_pairs_filters(spark, tmp_path):
    rows = [{"id": "a", "language": "java", "clone_type": 1, "label": 1}, {"id": "b", "language": "java|python", "clone_type": None, "label": 0}]
    (tmp_path / "c.json").write_text(json.dumps(rows))
    ids = lambda **k: [r.id for r in scans.curated_pairs(spark, str(tmp_path / "c.json"), **k).collect()]
    assert ids(language="python") == ["b"] and ids(clone_type=None) == ["b"] and ids(clone_type=1) == ["a"] and len(ids()) == 2


def test_feature_sink_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([tuple(i / 22 for i in range(22))], ", ".join(f"m{i} double" for i in range(22)))
    for _ in range(2):
        sinks.append_features(frame, frame.columns, str(tmp_path / "out"))
    assert scans.feature_rows(spark, str(tmp_path / "out")).count() == 2


def test_ensembles_and_splits(spark):
    frame = spark.createDataFrame([(i, i / 9, 1.0, 1 - i / 9, i % 2) for i in range(10)], "id int, a double, b double, c double, label int")
    assert {round(r.ensemble, 6) for r in ensemble.mean_ensemble(frame, ["a", "b", "c"]).collect()} == {round(1 / 3, 6)}
    votes = ensemble.vote_ensemble(frame, {"a": 0.5, "b": 2.0})
    assert votes.filter("id = 9").first().ensemble == 0.5
    split = ensemble.three_way(frame, ["id"])
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 7, "valid": 1, "test": 2}
    assert ensemble.sample_exact(frame, ["id"], 4).count() == 4
    told = ensemble.explanation_text(ensemble.explain(frame, ["a", "b", "c"])).filter("id = 0").first()
    assert told.verdict == "CLONE" and told.supporting == ["b", "c"] and told.uncertain and "CLONE" in told.markdown and "For: b, c" in told.markdown


def test_learned_ensemble(spark):
    frame = spark.createDataFrame([(float(i % 2) * 0.6 + (i % 7) / 20, (i % 5) / 5, float(i % 2)) for i in range(200)], "a double, b double, label double")
    scored = learn.probabilities(learn.logistic(frame, ["a", "b"]), frame)
    assert scored.filter("(score >= 0.5) = (label = 1)").count() > 190
    assert learn.importances(learn.forest(frame, ["a", "b"], trees=5, depth=3), ["a", "b"]).first().measure == "a"


def test_streaming_scores_each_pair_once(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    os.makedirs(source)
    line = lambda i: json.dumps({"pair_id": str(i), "code1": "int a = 1;", "code2": "int b = 1;", "label": 1})
    (tmp_path / "in" / "1.json").write_text(line(1))
    score_stream(spark, source, target, checkpoint, ["bow", "lev"]).awaitTermination(120)
    (tmp_path / "in" / "2.json").write_text(line(2))
    score_stream(spark, source, target, checkpoint, ["bow", "lev"]).awaitTermination(120)
    assert sorted(r.pair_id for r in spark.read.parquet(target).collect()) == ["1", "2"]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_oracle(spark, sf_dir, duck, name):
    mine, other = catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(other.columns) and len(mine) == len(other)
    keys = sorted(mine.columns, key=lambda c: (mine[c].dtype == float, c))
    a, b = (x[keys].sort_values(keys).reset_index(drop=True) for x in (mine, other))
    for c in keys:
        if a[c].dtype == float:
            assert ((a[c] - b[c]).abs().fillna(0) < 2e-6).all() or (a[c].astype(str) == b[c].astype(str)).all(), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


def test_lev_over_whole_texts(spark, tmp_path):
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return round(1 - row[-1] / max(len(a), len(b)), 6) if a or b else 0.0

    texts = ["é", "e", "für", "fur", "漢字とかな", "漢字", "😀 ñandú", "ñandú", None, "", "плохо", "плот", "a plain one", "a plain öne" * 40]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.turn: r.score for r in catalog.QUERIES["lev_whole"](spark, str(tmp_path)).collect()}
    expected = {i: plain(a or "", b or "") for i, (a, b) in enumerate(zip(texts, texts[1:]))}
    assert got == pytest.approx(expected, abs=2e-6)
    assert got[0] == 0.0 and got[2] == pytest.approx(2 / 3, abs=1e-6) and got[4] == 0.4


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_oracle_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_no_features_are_dealt_out(spark, sf_dir):
    """Behind the join only texts have been shuffled: the plan has no stored features."""
    for name in ("winn", "flagship"):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "f_winn" not in plan and "Exchange" in plan


def test_robustness_takes_all_native_measures_and_texts(spark, tmp_path):
    from pairloom.functions import native

    rows = [(0, 0, "user", "int best = 1;\nreturn best;"), (0, 1, "assistant", ""), (1, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.probe: r for r in catalog.robustness(spark, str(tmp_path)).collect()}
    assert set(got) == set(probes.PROBES) and set(got["renamed"].asDict()) == {"probe", *native.MEASURES}
    # The text is 26 long and gets 12 before it; empty texts score 0.
    assert got["commented"].lev == pytest.approx(26 / 38 / 3, abs=1e-6) and got["reordered"].bow == pytest.approx(1 / 3, abs=1e-6)


def test_counted_rows_fit_as_rows_do(spark, monkeypatch):
    """Splits read their rows once, and weights give the regression that the rows give."""
    rng = random.Random(11)
    rows = [(i, rng.randrange(5) / 4 * 0.6 + y * 0.4, rng.randrange(4) / 3, float(y)) for i in range(600) for y in [int(rng.random() < 0.4)]]
    frame = spark.createDataFrame(rows, "id int, a double, b double, label double")
    counted = frame.groupBy("a", "b", "label").agg(F.count("*").alias("n"))
    plain, weighted = (learn.probabilities(m, counted).select("a", "b", "label", "score").orderBy("a", "b", "label").collect() for m in (learn.logistic(frame, ["a", "b"]), learn.logistic(counted, ["a", "b"], weight="n")))
    assert len(plain) == len(weighted) and all(p.score == pytest.approx(w.score, abs=1e-5) for p, w in zip(plain, weighted))
    hashed, key = [], ensemble.split_key
    monkeypatch.setattr(ensemble, "split_train_test", lambda *a, **k: pytest.fail("a pass over the rows for each split"))
    monkeypatch.setattr(ensemble, "split_key", lambda *ids, seed=0: hashed.append(seed) or key(*ids, seed=seed))
    assert evaluate.repeated_splits(frame.withColumn("label", F.col("label").cast("int")), ["id"], ["a", "b"], splits=2).count() == 6 and hashed == [0, 1]
