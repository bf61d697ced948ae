"""DuckDB forms of the registered queries, built from small text templates."""

from __future__ import annotations

from pairloom.functions.native import CALL, COMMENT, DECLARATION, JAVA_KEYWORDS, METHOD, METRIC_NAMES, SHARED_KEYWORDS, TOKEN
from pairloom.functions.text import SPACE

W = r"[\p{L}\p{N}_]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PAIRS = "p AS (SELECT a.conv_id, a.turn, coalesce(a.text, '') AS c1, coalesce(b.text, '') AS c2, CASE WHEN a.role = 'user' THEN 1 ELSE 0 END AS label FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"


def measure(features: str, score: str, more: str = "") -> str:
    """features has {c} for the code; score is over f1 and f2 (and what `more`, a chain of CTEs from q, adds)."""
    f1, f2 = (features.replace("{c}", c) for c in ("c1", "c2"))
    last = "q" if not more else "r"
    return f"WITH {PAIRS}, q AS (SELECT conv_id, turn, {f1} AS f1, {f2} AS f2 FROM p){more} SELECT conv_id, turn, round(CAST({score} AS DOUBLE), 6) AS score FROM {last}"


def ratio(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0)"


def occurrences(lst: str, t: str) -> str:
    return f"len(list_filter({lst}, lambda u: u = {t}))"


def dot(a: str, b: str, weight: str = "1") -> str:
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda t: CAST({occurrences(a, 't')} * {occurrences(b, 't')} AS DOUBLE) * {weight})), 0)"


def cosine(a: str, b: str) -> str:
    return ratio(dot(a, b), f"sqrt({dot(a, a)} * {dot(b, b)})")


def jaccard(a: str, b: str, empty: str = "0") -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {union} = 0 THEN {empty} ELSE {ratio(f'len(list_intersect(list_distinct({a}), list_distinct({b})))', union)} END"


def vector_cosine(a: str, b: str) -> str:
    part = lambda x, y: f"list_sum(list_transform(range(1, len({x}) + 1), lambda i: {x}[i] * {y}[i]))"
    return ratio(part(a, b), f"sqrt({part(a, a)} * {part(b, b)})")


def substrings(keys, c: str = "{c}") -> str:
    return " + ".join(f"(length({c}) - length(replace({c}, {_q(k)}, ''))) / {len(k)}.0" for k in keys)


def depth(opening: str, closing: str, c: str = "{c}") -> str:
    chars = f"list_transform(string_split({c}, ''), lambda x: CASE WHEN x IN ({', '.join(map(_q, opening))}) THEN 1 WHEN x IN ({', '.join(map(_q, closing))}) THEN -1 ELSE 0 END)"
    steps = f"list_filter({chars}, lambda x: x <> 0)"
    return f"greatest(0, coalesce(list_max(list_transform(range(1, len({steps}) + 1), lambda i: list_sum(list_slice({steps}, 1, i)))), 0))"


WORDS = f"regexp_extract_all(lower({{c}}), '{W}{{2,}}')"
TOKENS = f"regexp_extract_all({{c}}, {_q(TOKEN)})"
KEYS = ", ".join(map(_q, SHARED_KEYWORDS))
KIND = (
    f"CASE WHEN lower(t) IN ({KEYS}) THEN 'KW:' || lower(t) WHEN regexp_matches(t, '^[\"'']') THEN 'STR' WHEN regexp_matches(t, '^\\p{{Nd}}') THEN 'NUM' "
    "WHEN regexp_matches(t, '^[A-Za-z_]') THEN 'ID' ELSE 'OP:' || t END"
)


def among(keys) -> str:
    return f"len(list_filter({TOKENS}, lambda x: lower(x) IN ({', '.join(map(_q, keys))})))"


def doubles(*parts: str) -> str:
    return "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in parts) + "]"


def apart(text: str, pattern: str, group: int = 0) -> str:
    """Matches of a pattern that ends in an opening parenthesis, without a word character before. There is no look-behind: parentheses are doubled, so that the second one can stand before the next match."""
    return f"regexp_extract_all(replace({text}, '(', '(('), {_q(f'(?:^|[^{W[1:-1]}])' + pattern)}, {group})"


_DECLARED = f"len({apart('{c}', DECLARATION)})"
_LINES = "(length({c}) - length(replace({c}, chr(10), '')) + 1)"
_METRICS = doubles(_LINES, substrings(JAVA_KEYWORDS), substrings(["for", "while"]), substrings(["if", "else", "switch"]), _DECLARED, depth("{", "}"))
_PAD = (
    ", r AS (SELECT conv_id, turn, greatest(len(t1), len(t2)) AS n, f1, f2 FROM (SELECT conv_id, turn, f1 AS t1, f2 AS t2, "
    "list_filter(list_transform(range(1, len(f1) + 1), lambda i: CASE WHEN list_position(f1, f1[i]) = i THEN f1[i] END), lambda x: x IS NOT NULL) AS f1, "
    "list_filter(list_transform(range(1, len(f2) + 1), lambda i: CASE WHEN list_position(f2, f2[i]) = i THEN f2[i] END), lambda x: x IS NOT NULL) AS f2 FROM q))"
)


def _padded(f: str) -> str:
    return f"list_concat({f}, list_transform(range(len({f}), n), lambda k: 'DUMMY_NODE_LABEL_' || k))"


MEASURES = {
    "bow": measure(WORDS, cosine("f1", "f2")),
    "fcall": measure(f"regexp_extract_all({{c}}, {_q(CALL)}, 1)", jaccard("f1", "f2")),
    "graph": measure("list_filter(regexp_split_to_array({c}, '" + SPACE + "+'), lambda x: x <> '')", ratio(f"len(list_filter(range(1, n + 1), lambda i: ({_padded('f1')})[i] = ({_padded('f2')})[i]))", f"len(list_distinct(list_concat({_padded('f1')}, {_padded('f2')})))"), _PAD),
    "jaccard": measure(
        f"regexp_extract_all(regexp_replace({{c}}, {_q(COMMENT)}, '', 'g'), '{W}+')",
        ratio(*(f"coalesce(list_sum(list_transform(list_distinct(list_concat(f1, f2)), lambda t: {f}({occurrences('f1', 't')}, {occurrences('f2', 't')}))), 0)" for f in ("least", "greatest"))),
    ),
    "lev": measure("regexp_replace({c}, '[^\\x00-\\x7F]', '', 'g')", "CASE WHEN greatest(length(f1), length(f2)) = 0 THEN 0 ELSE 1 - levenshtein(f1, f2) / CAST(greatest(length(f1), length(f2)) AS DOUBLE) END"),
    "metrics": measure(_METRICS, vector_cosine("f1", "f2")),
    "ngrams": measure("CASE WHEN length({c}) < 15 THEN [] ELSE list_distinct(list_transform(range(1, length({c}) - 13), lambda i: substr({c}, i, 15))) END", jaccard("f1", "f2")),
    "tdf": measure(
        WORDS,
        ratio("ab", "sqrt(aa * bb)"),
        ", r AS (SELECT conv_id, turn, " + dot("f1", "f2") + " AS ab, " + ", ".join(dot(x, x, f"(CASE WHEN list_contains({y}, t) THEN 1 ELSE (1 + ln(1.5)) * (1 + ln(1.5)) END)") + f" AS {n}" for x, y, n in (("f1", "f2", "aa"), ("f2", "f1", "bb"))) + " FROM q)",
    ),
    "winn": measure(
        "CASE WHEN length({c}) < 5 THEN [] ELSE list_sort(list_transform(range(1, length({c}) - 3), lambda i: md5(substr({c}, i, 5)))) END",
        ratio("len(list_filter(g1, lambda x: list_contains(g2, x)))", "least(len(g1), len(g2))"),
        ", r AS (SELECT conv_id, turn, list_slice(f1, 1, greatest(len(f1) - 9, 0)) AS g1, list_slice(f2, 1, greatest(len(f2) - 9, 0)) AS g2 FROM q)",
    ),
    "exe_zero": f"WITH {PAIRS} SELECT conv_id, turn, CAST(0 AS DOUBLE) AS score FROM p",
    "edu_jaccard_tokens": measure(TOKENS, jaccard("f1", "f2", "1")),
    "edu_ngram_cosine": measure(
        TOKENS,
        cosine("f1", "f2"),
        ", r AS (SELECT conv_id, turn, "
        + ", ".join(f"CASE WHEN len({f}) = 0 THEN [] WHEN len({f}) < 3 THEN [array_to_string({f}, chr(1))] ELSE list_transform(range(1, len({f}) - 1), lambda i: array_to_string(list_slice({f}, i, i + 2), chr(1))) END AS {f}" for f in ("f1", "f2"))
        + " FROM q)",
    ),
    "edu_token_kind_cosine": measure(f"list_transform({TOKENS}, lambda t: {KIND})", cosine("f1", "f2")),
    "edu_normalized_jaccard": measure(f"list_transform({TOKENS}, lambda t: CASE WHEN ({KIND}) = 'ID' THEN 'ID' ELSE t END)", jaccard("f1", "f2", "1")),
    "edu_metrics_cosine": measure(doubles(_LINES, among(SHARED_KEYWORDS), among(["for", "while"]), among(["if", "else", "elif", "switch"]), f"len({TOKENS})", depth("{(", "})")), vector_cosine("f1", "f2")),
}

WIDE = "w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount AS s1, l_tax AS s2, l_quantity AS s3, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem)"
LONG = WIDE + ", s AS (SELECT 's1' AS measure, s1 AS score, label FROM w UNION ALL SELECT 's2', s2, label FROM w UNION ALL SELECT 's3', s3, label FROM w)"
COUNTS = LONG + ", g AS (SELECT measure, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM s GROUP BY ALL)"
SWEEP = COUNTS + (
    ", r AS (SELECT measure, score AS threshold, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER a AS p, sum(neg) OVER a AS n FROM g "
    "WINDOW d AS (PARTITION BY measure ORDER BY score DESC ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY measure))"
    ", c AS (SELECT measure, threshold, CAST(tp AS BIGINT) AS tp, CAST(n - fp AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(p - tp AS BIGINT) AS fn FROM r)"
)


def with_metrics(table: str) -> str:
    return (
        f"(SELECT *, {ratio('2 * precision * recall', 'precision + recall')} AS f1 FROM (SELECT *, {ratio('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {ratio('tp', 'tp + fp')} AS precision, {ratio('tp', 'tp + fn')} AS recall, "
        f"{ratio('CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn', 'sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn))')} AS mcc FROM {table}))"
    )


ROUNDED = "round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(mcc, 6) AS mcc"
_CONFUSION = "SELECT measure, count(*) FILTER (score >= 0.05 AND label = 1) AS tp, count(*) FILTER (score < 0.05 AND label = 0) AS tn, count(*) FILTER (score >= 0.05 AND label = 0) AS fp, count(*) FILTER (score < 0.05 AND label = 1) AS fn FROM s GROUP BY measure"
_BEST = f"b AS (SELECT * FROM {with_metrics('c')} QUALIFY row_number() OVER (PARTITION BY measure ORDER BY round(f1, 12) DESC, threshold DESC) = 1)"
_AUC = (
    "k AS (SELECT *, coalesce(sum(pos + neg) OVER (PARTITION BY measure ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)"
    ", u AS (SELECT measure, CAST(sum(pos) AS DOUBLE) AS p, CAST(sum(neg) AS DOUBLE) AS n, CAST(sum(pos * (before + (pos + neg + 1) / 2.0)) AS DOUBLE) AS ranks FROM k GROUP BY measure)"
    ", auc AS (SELECT measure, (ranks - p * (p + 1) / 2) / (p * n) AS auc FROM u)"
)
_SCALED = ", ".join(f"(s{i} - min(s{i}) OVER ()) / CASE WHEN max(s{i}) OVER () > min(s{i}) OVER () THEN max(s{i}) OVER () - min(s{i}) OVER () ELSE 1 END AS z{i}" for i in (1, 2, 3))
IDS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
KEY = "md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, 7))"
_MEAN = f"{LONG}, z AS (SELECT {IDS}, label, {_SCALED} FROM w)"

EVALUATION = {
    "confusion": f"WITH {LONG} {_CONFUSION}",
    "metrics_at": f"WITH {LONG}, c AS ({_CONFUSION}) SELECT measure, tp, tn, fp, fn, {ROUNDED} FROM {with_metrics('c')}",
    "roc_auc": f"WITH {COUNTS}, {_AUC} SELECT measure, round(auc, 6) AS auc FROM auc",
    "youden_threshold": f"WITH {SWEEP}, j AS (SELECT measure, threshold, {ratio('tp', 'tp + fn')} - {ratio('fp', 'fp + tn')} AS j FROM c UNION ALL SELECT DISTINCT measure, CAST('inf' AS DOUBLE), 0 FROM c) SELECT measure, threshold, round(j, 6) AS j FROM j QUALIFY row_number() OVER (PARTITION BY measure ORDER BY round(j, 12) DESC, threshold DESC) = 1",
    "best_f1_threshold": f"WITH {SWEEP}, {_BEST} SELECT measure, threshold, tp, tn, fp, fn, {ROUNDED} FROM b",
    "leaderboard": f"WITH {SWEEP}, {_BEST}, {_AUC} SELECT measure, threshold, {ROUNDED}, round(auc, 6) AS auc FROM b JOIN auc USING (measure)",
    "pr_auc": f"WITH {SWEEP}, m AS (SELECT *, recall - coalesce(lag(recall) OVER (PARTITION BY measure ORDER BY threshold DESC), 0) AS step FROM {with_metrics('c')}) SELECT measure, round(sum(step * precision), 6) AS average_precision FROM m GROUP BY measure",
    "separation": f"WITH {LONG} SELECT measure, round(avg(score) FILTER (label = 1) - avg(score) FILTER (label = 0), 6) AS separation FROM s GROUP BY measure",
    "corr_pairs": f"WITH {LONG} SELECT 's1' AS a, 's2' AS b, round(corr(s1, s2), 6) AS r FROM w UNION ALL SELECT 's1', 's3', round(corr(s1, s3), 6) FROM w UNION ALL SELECT 's2', 's3', round(corr(s2, s3), 6) FROM w",
    "label_balance": f"WITH {WIDE} SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, round(avg(label), 6) AS rate FROM w",
    "by_type": "WITH s AS (SELECT 's1' AS measure, l_linestatus AS kind, l_discount AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem), c AS (SELECT measure, kind, count(*) FILTER (score >= 0.05 AND label = 1) AS tp, count(*) FILTER (score < 0.05 AND label = 0) AS tn, count(*) FILTER (score >= 0.05 AND label = 0) AS fp, count(*) FILTER (score < 0.05 AND label = 1) AS fn FROM s GROUP BY GROUPING SETS ((measure, kind), (measure))) "
    f"SELECT measure, kind, tp, tn, fp, fn, {ROUNDED} FROM {with_metrics('c')}",
    "minmax_scale": f"{'WITH ' + _MEAN} SELECT {IDS}, round(z1, 6) AS s1, round(z2, 6) AS s2, round(z3, 6) AS s3 FROM z",
    "zscore_train": f"WITH {WIDE}, x AS (SELECT *, substr({KEY}, 1, 8) < 'b3333333' AS train FROM w), m AS (SELECT "
    + ", ".join(f"avg(s{i}) FILTER (train) AS m{i}, stddev_pop(s{i}) FILTER (train) AS d{i}" for i in (1, 2, 3))
    + f" FROM x) SELECT {IDS}, " + ", ".join(f"round((s{i} - m{i}) / CASE WHEN d{i} > 0 THEN d{i} ELSE 1 END, 6) AS s{i}" for i in (1, 2, 3)) + " FROM x, m",
    "mean_ensemble": f"WITH {_MEAN} SELECT {IDS}, round((z1 + z2 + z3) / 3, 6) AS ensemble FROM z",
    "vote_ensemble": f"WITH {SWEEP}, {_BEST}, t AS (SELECT max(threshold) FILTER (measure = 's1') AS t1, max(threshold) FILTER (measure = 's2') AS t2, max(threshold) FILTER (measure = 's3') AS t3 FROM b) SELECT {IDS}, round((CAST(s1 >= t1 AS INT) + CAST(s2 >= t2 AS INT) + CAST(s3 >= t3 AS INT)) / 3.0, 6) AS ensemble FROM w, t",
    "explain": f"WITH {_MEAN}, e AS (SELECT {IDS}, z1, z2, z3, (z1 + z2 + z3) / 3.0 AS m FROM z), v AS (SELECT *, sqrt(((z1 - m) * (z1 - m) + (z2 - m) * (z2 - m) + (z3 - m) * (z3 - m)) / 3.0) AS d FROM e), "
    "y AS (SELECT *, list_sort([struct_pack(less := -z1, at := 0, measure := 's1'), struct_pack(less := -z2, at := 1, measure := 's2'), struct_pack(less := -z3, at := 2, measure := 's3')]) AS a FROM v) "
    f"SELECT {IDS}, CASE WHEN m >= 0.5 THEN 'CLONE' ELSE 'NOT A CLONE' END AS verdict, round(m, 6) AS confidence, round(d, 6) AS disagreement, d > 0.22 OR abs(m - 0.5) < 0.08 AS uncertain, "
    "array_to_string(list_transform(list_filter(a, lambda x: x.less <= -0.5), lambda x: x.measure), ',') AS supporting, array_to_string(list_transform(list_filter(a, lambda x: x.less > -0.5), lambda x: x.measure), ',') AS dissenting FROM y",
    "split_train_test": f"WITH {WIDE} SELECT {IDS}, CASE WHEN substr({KEY}, 1, 8) < 'b3333333' THEN 'train' ELSE 'test' END AS split FROM w",
    "sample_exact_k": f"WITH {WIDE} SELECT {IDS} FROM w ORDER BY {KEY}, {IDS} LIMIT 500",
    "pair_join": f"WITH {PAIRS} SELECT conv_id, turn, CAST(length(c1) AS BIGINT) AS n1, CAST(length(c2) AS BIGINT) AS n2, label FROM p WHERE c1 <> '' AND c2 <> ''",
    "embedding_cosine": "SELECT a.vec_id AS id1, b.vec_id AS id2, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "method_names": f"WITH {PAIRS} SELECT conv_id, turn, CAST(len({apart('c1', METHOD, 1)}) AS BIGINT) AS n FROM p",
    "code_metrics": f"WITH {PAIRS}, q AS (SELECT conv_id, turn, " + _METRICS.replace("{c}", "c1") + " AS v FROM p) SELECT conv_id, turn, " + ", ".join(f"round(v[{i + 1}], 6) AS {n}" for i, n in enumerate(METRIC_NAMES)) + " FROM q",
    "token_graph": f"WITH {PAIRS}, q AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(c1, '{SPACE}+'), lambda x: x <> '') AS t FROM p) SELECT conv_id, turn, CAST(len(list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || chr(1) || t[i + 1]))) AS BIGINT) AS edges, CAST(len(list_distinct(t)) AS BIGINT) AS nodes FROM q",
}

EDGES = f"WITH {PAIRS}, q AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(c1, '{SPACE}+'), lambda x: x <> '') AS t FROM p), e AS (SELECT conv_id, turn, unnest(list_transform(range(1, len(t)), lambda i: struct_pack(src := t[i], dst := t[i + 1])), recursive := true) FROM q) SELECT DISTINCT conv_id, turn, src, dst FROM e"
BEST_SINGLE = (
    f"WITH {WIDE}, x AS (SELECT *, substr({KEY}, 1, 8) < 'b3333333' AS train FROM w), s AS (SELECT 's1' AS measure, s1 AS score, label FROM x WHERE train UNION ALL SELECT 's2', s2, label FROM x WHERE train UNION ALL SELECT 's3', s3, label FROM x WHERE train)"
    + SWEEP.removeprefix(LONG)
    + f", {_BEST}, o AS (SELECT measure, threshold FROM b ORDER BY round(f1, 12) DESC, measure LIMIT 1), t AS (SELECT 's1' AS measure, s1 AS score, label FROM x WHERE NOT train UNION ALL SELECT 's2', s2, label FROM x WHERE NOT train UNION ALL SELECT 's3', s3, label FROM x WHERE NOT train), "
    "k AS (SELECT measure, threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score < threshold AND label = 0) AS tn, count(*) FILTER (score >= threshold AND label = 0) AS fp, count(*) FILTER (score < threshold AND label = 1) AS fn FROM t JOIN o USING (measure) GROUP BY ALL) "
    f"SELECT measure, threshold, tp, tn, fp, fn, {ROUNDED} FROM {with_metrics('k')}"
)
LOGITS = (
    f"WITH {WIDE}, s AS (SELECT 'logits' AS measure, CASE WHEN s2 > s1 THEN 1.0 ELSE 0.0 END AS score, label FROM w), c AS (SELECT measure, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score < 0.5 AND label = 0) AS tn, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn FROM s GROUP BY measure) "
    f"SELECT measure, tp, tn, fp, fn, {ROUNDED} FROM {with_metrics('c')}"
)
SNIPPETS = (
    f"WITH {PAIRS}, " + ", ".join(f"m_{n} AS ({MEASURES[n]})" for n in ("fcall", "graph", "jaccard")) + " SELECT conv_id || '-' || turn AS id1, conv_id || '-' || (turn + 1) AS id2, p.label, m_fcall.score AS fcall, m_graph.score AS graph, m_jaccard.score AS jaccard "
    "FROM p JOIN m_fcall USING (conv_id, turn) JOIN m_graph USING (conv_id, turn) JOIN m_jaccard USING (conv_id, turn) WHERE c1 <> '' AND c2 <> ''"
)
THREE_WAY = f"WITH {WIDE}, x AS (SELECT {IDS}, row_number() OVER (ORDER BY {KEY}, {IDS}) AS place, count(*) OVER () AS n FROM w) SELECT {IDS}, CASE WHEN place <= floor(n * 0.7) THEN 'train' WHEN place <= floor(n * 0.7) + floor(n * 0.15) THEN 'valid' ELSE 'test' END AS split FROM x"

FLAGSHIP = (
    f"WITH {PAIRS}, " + ", ".join(f"m_{n} AS ({MEASURES[n]})" for n in ("bow", "jaccard", "ngrams", "winn")) + " SELECT conv_id, turn, p.label, m_bow.score AS bow, m_jaccard.score AS jaccard, m_ngrams.score AS ngrams, m_winn.score AS winn, "
    "round((m_bow.score + m_jaccard.score + m_ngrams.score + m_winn.score) / 4, 4) AS mean FROM p JOIN m_bow USING (conv_id, turn) JOIN m_jaccard USING (conv_id, turn) JOIN m_ngrams USING (conv_id, turn) JOIN m_winn USING (conv_id, turn)"
)
