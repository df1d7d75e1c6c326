"""Queries of ranked-list evaluation. The list ``candidate`` stands for gold, ``ranked`` and ``retrieval`` are the two methods compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions.keys import plain_snapshot
from trawl.operators import evaluation as E
from trawl.operators import projections as P
from trawl.plans.text_plans import ORACLE as TEXT
from trawl.plans.text_plans import SQL_TICKETS
from trawl.sources.tables import table

_COLS = ("ticket_id", "list_name", "rank", "file_path", "symbol_qualified_name", "symbol_kind", "score")
#: Fixed value: resamples of the full evaluation; and the seed of their hashes.
SAMPLES, SEED = 10_000, 7


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ranked_symbols", *_COLS)


def _pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _rows(spark, d)
    return E.gold_files(rows), E.ranked_files(rows, "ranked"), E.ranked_files(rows, "retrieval")


def _repos(spark: SparkSession, d: str) -> DataFrame:
    return plain_snapshot(table(spark, d, "tickets", "ticket_id", "repo")).groupBy("ticket_id").agg(F.max("repo").alias("repo"))


def align_left(spark: SparkSession, d: str) -> DataFrame:
    g, a, _ = _pair(spark, d)
    return E.aligned(g, a)


def key_differences(spark: SparkSession, d: str) -> DataFrame:
    return E.key_differences(table(spark, d, "tickets", "ticket_id"), table(spark, d, "ticket_outcomes", "ticket_id"))


def suffix_join(spark: SparkSession, d: str) -> DataFrame:
    g, a, _ = _pair(spark, d)
    return E.matched(g, a)


def ticket_metrics(spark: SparkSession, d: str) -> DataFrame:
    g, a, _ = _pair(spark, d)
    return E.ticket_metrics(g, a)


def hit_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    g, a, _ = _pair(spark, d)
    return E.summary(E.ticket_metrics(g, a))


def metrics_rollup(spark: SparkSession, d: str) -> DataFrame:
    g, a, _ = _pair(spark, d)
    m = E.ticket_metrics(g, a).join(_repos(spark, d), "ticket_id", "left").withColumn("repo", F.coalesce("repo", F.lit("?")))
    return E.summary(m, "repo")


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    g, a, _ = _pair(spark, d)
    return E.outcome_lists(E.ticket_metrics(g, a))


def paired_delta(spark: SparkSession, d: str) -> DataFrame:
    g, a, b = _pair(spark, d)
    p = E.paired(E.ticket_metrics(g, b), E.ticket_metrics(g, a))
    return p.groupBy("metric", "bucket").agg(F.count(F.lit(1)).alias("tickets"), F.round(F.sum("delta"), 6).alias("delta"))


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    g, a, b = _pair(spark, d)
    return E.bootstrap(E.paired(E.ticket_metrics(g, b), E.ticket_metrics(g, a)).select("ticket_id", "metric", "delta"), SAMPLES, SEED)


def method_compare(spark: SparkSession, d: str) -> DataFrame:
    g, a, b = _pair(spark, d)
    names = ["hit", "recall", "rr", "top1", "top3", "top5"]
    long = lambda p, n: E.summary(E.ticket_metrics(g, p)).select(*names).unpivot([], names, "metric", n)
    both = long(b, "baseline").join(long(a, "method"), "metric")
    return both.withColumn("delta", F.round(F.col("method") - F.col("baseline"), 6))


def reachable_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall over the gold files that the ticket's snapshot has (as chunks), and how many it lacks."""
    g, a, _ = _pair(spark, d)
    here = plain_snapshot(table(spark, d, "tickets", "ticket_id", "repo", "base_commit")).distinct().join(table(spark, d, "chunks", "repo", "base_commit", "file_path").distinct(), ["repo", "base_commit"]).select("ticket_id", F.col("file_path").alias("gold_file")).distinct()
    reach = g.join(here, ["ticket_id", "gold_file"], "left_semi")
    found = reach.join(E.matched(reach, a).filter(f"rank <= {E.CANDIDATES}"), ["ticket_id", "gold_file"], "left")
    per = found.groupBy("ticket_id").agg(F.count(F.lit(1)).alias("reachable"), F.count("rank").alias("found"))
    total = g.groupBy("ticket_id").agg(F.count(F.lit(1)).alias("gold"))
    return total.join(per, "ticket_id", "left").agg(F.count(F.lit(1)).alias("tickets"), F.sum(F.col("gold") - F.coalesce("reachable", F.lit(0))).alias("unreachable"), F.round(F.avg(F.col("found") / F.col("reachable")), 6).alias("reachable_recall"))


def symbol_match(spark: SparkSession, d: str) -> DataFrame:
    return E.symbol_matches(*E.symbol_ranks(_rows(spark, d)))


def symbol_metrics(spark: SparkSession, d: str) -> DataFrame:
    return E.symbol_metrics(E.symbol_matches(*E.symbol_ranks(_rows(spark, d))))


def oracle_loss(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    gold, predicted = E.symbol_ranks(rows)
    return E.loss(E.symbol_matches(gold, predicted), E.ranked_files(rows, "ranked"), predicted)


def coverage_rates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "ticket_outcomes", "ticket_id", "eligible", "llm_valid", "fallback_reason", "evaluated_at")
    one = o.groupBy("ticket_id").agg(F.max(F.struct("evaluated_at", "eligible", "llm_valid", "fallback_reason")).alias("x")).select("ticket_id", "x.*")
    n = lambda c: F.count(F.when(c, 1))
    ok = F.col("eligible") & F.col("llm_valid")
    return one.groupBy(F.coalesce(F.nullif("fallback_reason", F.lit("")), F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("tickets"), n(F.col("eligible")).alias("eligible"), n(ok).alias("valid"), F.round(F.coalesce(F.try_divide(n(ok), n(F.col("eligible"))), F.lit(0.0)), 6).alias("valid_rate"))


def confidence_gate(spark: SparkSession, d: str) -> DataFrame:
    return E.confidence(E.ranked_files(_rows(spark, d), "ranked"), P.gated_input(table(spark, d, "tickets")))


QUERIES = {f.__name__: f for f in (align_left, key_differences, suffix_join, ticket_metrics, hit_recall_at_k, metrics_rollup, outcomes, paired_delta, bootstrap_ci, method_compare, reachable_recall, symbol_match, symbol_metrics, oracle_loss, coverage_rates, confidence_gate)}

_N = "regexp_replace(replace(file_path, chr(92), '/'), '^[./]+', '')"
_FILES = lambda n, out: f"""{out} AS (SELECT ticket_id, file_path, score, CAST(row_number() OVER (PARTITION BY ticket_id ORDER BY score DESC, r, file_path) AS INTEGER) AS rank FROM (
  SELECT ticket_id, {_N} AS file_path, max(score) AS score, min(coalesce(rank, 2147483647)) AS r FROM ranked_symbols WHERE list_name = '{n}' AND ticket_id IS NOT NULL AND NOT isnan(score) AND score BETWEEN 0 AND 1 GROUP BY ALL))"""  # noqa: E731
_GOLD = f"g AS (SELECT DISTINCT ticket_id, {_N} AS gold_file FROM ranked_symbols WHERE list_name = 'candidate' AND ticket_id IS NOT NULL)"
_MATCH = lambda p, out, g="g": f"""{out} AS (SELECT ticket_id, gold_file, min(rank) AS rank FROM {g} JOIN {p} USING (ticket_id) WHERE gold_file <> '' AND file_path <> '' AND (gold_file = file_path OR ends_with(gold_file, '/' || file_path) OR ends_with(file_path, '/' || gold_file)) GROUP BY ALL)"""
_METRICS = lambda m, out: f"""{out} AS (SELECT ticket_id, gold, first_rank, round(CASE WHEN first_rank <= 20 THEN 1.0 / first_rank ELSE 0.0 END, 6)::DOUBLE AS rr, (found > 0)::INT AS hit, round(found / gold, 6)::DOUBLE AS recall,
  coalesce((first_rank <= 1)::INT, 0) AS top1, coalesce((first_rank <= 3)::INT, 0) AS top3, coalesce((first_rank <= 5)::INT, 0) AS top5, CASE WHEN found = gold THEN 'full' WHEN found > 0 THEN 'partial' ELSE 'miss' END AS outcome
  FROM (SELECT ticket_id, count(*) AS gold, min(rank) AS first_rank, count(CASE WHEN rank <= 20 THEN 1 END) AS found FROM g LEFT JOIN {m} USING (ticket_id, gold_file) GROUP BY ticket_id))"""  # noqa: E731
_A = f"WITH {_GOLD}, {_FILES('ranked', 'a')}, {_MATCH('a', 'ma')}, {_METRICS('ma', 'ta')}"
_AB = _A + f", {_FILES('retrieval', 'b')}, {_MATCH('b', 'mb')}, {_METRICS('mb', 'tb')}"
_AGG = "count(*) AS tickets, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("hit", "recall", "rr", "top1", "top3", "top5")) + ", " + ", ".join(f"count(CASE WHEN outcome = '{o}' THEN 1 END) AS \"{o}\"" for o in ("full", "partial", "miss"))
_PAIRS = ", p AS (" + " UNION ALL ".join(f"SELECT tb.ticket_id, '{m}' AS metric, tb.{m}::DOUBLE AS before, ta.{m}::DOUBLE AS after FROM tb JOIN ta USING (ticket_id)" for m in ("hit", "recall", "rr", "top1")) + "), d AS (SELECT *, round(after - before, 6) AS delta, CASE WHEN before = 0 AND after = 0 THEN 'both_miss' WHEN after > before THEN 'improved' WHEN after < before THEN 'worsened' ELSE 'unchanged' END AS bucket FROM p)"
_KEY = "lower(regexp_replace(regexp_replace(replace(replace(trim(regexp_replace(trim(symbol_qualified_name), '^[\"''`.,;:()\\[\\]{}]+|[\"''`.,;:()\\[\\]{}]+$', '', 'g')), '::', '.'), '/', '.'), '\\.+', '.', 'g'), '^\\.|\\.$', '', 'g'))"
_SYM = f"""WITH base AS (SELECT ticket_id, list_name, {_N} AS file_path, {_KEY} AS name, lower(trim(coalesce(symbol_kind, ''))) AS kind, CASE WHEN NOT isnan(score) AND score BETWEEN 0 AND 1 THEN score END AS score, rank FROM ranked_symbols WHERE ticket_id IS NOT NULL),
gs AS (SELECT DISTINCT ticket_id, file_path, name, kind, split_part(name, '.', -1) AS leaf, kind = 'module' AS module FROM base WHERE list_name = 'candidate'),
ps AS (SELECT *, split_part(name, '.', -1) AS leaf, kind = 'module' AS module, row_number() OVER (PARTITION BY ticket_id ORDER BY score DESC, r, file_path, name, kind) AS rank FROM (
  SELECT ticket_id, file_path, name, kind, max(score) AS score, min(coalesce(rank, 2147483647)) AS r FROM base WHERE list_name = 'ranked' AND score IS NOT NULL GROUP BY ALL)),
sm AS (SELECT gs.ticket_id, gs.file_path, gs.name, gs.kind, CAST(min(CASE WHEN ps.file_path = gs.file_path AND ps.name = gs.name AND ps.kind = gs.kind THEN ps.rank END) AS INTEGER) AS exact_rank, CAST(min(ps.rank) AS INTEGER) AS relaxed_rank
  FROM gs LEFT JOIN ps ON ps.ticket_id = gs.ticket_id AND ps.leaf = gs.leaf AND ps.module = gs.module GROUP BY ALL)"""
_SM_COLS = [(f"{n}_hit{k}", f"max(coalesce(({n}_rank <= {k})::INT, 0))") for n in ("exact", "relaxed") for k in (1, 3, 5)] + [(f"{n}_recall{k}", f"avg(coalesce(({n}_rank <= {k})::INT, 0))") for n in ("exact", "relaxed") for k in (10, 30)]

ORACLE = {
    "align_left": f"WITH {_GOLD}, {_FILES('ranked', 'a')} SELECT x.ticket_id, gold, coalesce(candidates, 0) AS candidates, candidates IS NULL AS missing FROM (SELECT ticket_id, count(*) AS gold FROM g GROUP BY 1) x LEFT JOIN (SELECT ticket_id, count(*) AS candidates FROM a GROUP BY 1) y USING (ticket_id)",
    "key_differences": """SELECT DISTINCT 'missing' AS side, ticket_id FROM tickets WHERE ticket_id NOT IN (SELECT ticket_id FROM ticket_outcomes) UNION ALL SELECT DISTINCT 'extra', ticket_id FROM ticket_outcomes WHERE ticket_id NOT IN (SELECT ticket_id FROM tickets)
        UNION ALL SELECT 'repeated_left', ticket_id FROM tickets GROUP BY ticket_id HAVING count(*) > 1 UNION ALL SELECT 'repeated_right', ticket_id FROM ticket_outcomes GROUP BY ticket_id HAVING count(*) > 1""",
    "suffix_join": f"WITH {_GOLD}, {_FILES('ranked', 'a')}, {_MATCH('a', 'ma')} SELECT * FROM ma",
    "ticket_metrics": _A + " SELECT ticket_id, gold, first_rank, rr, hit, recall, top1, top3, top5, outcome FROM ta",
    "hit_recall_at_k": _A + f" SELECT {_AGG} FROM ta",
    "metrics_rollup": _A + f", r AS (SELECT ticket_id, max(repo) AS repo FROM {SQL_TICKETS} GROUP BY 1), x AS (SELECT ta.*, coalesce(r.repo, '?') AS repo FROM ta LEFT JOIN r USING (ticket_id)) SELECT repo, {_AGG} FROM x GROUP BY repo UNION ALL SELECT '*', {_AGG} FROM x",
    "outcomes": _A + " SELECT outcome, count(*) AS tickets, array_to_string(list_slice(list_sort(list(ticket_id)), 1, 20), ',') AS first_ids FROM ta GROUP BY outcome",
    "paired_delta": _AB + _PAIRS + " SELECT metric, bucket, count(*) AS tickets, round(sum(delta), 6) AS delta FROM d GROUP BY metric, bucket",
    "bootstrap_ci": _AB + _PAIRS + f""", n AS (SELECT metric, count(*) AS n, avg(delta) AS mean FROM d GROUP BY metric), h AS (SELECT ticket_id, ('0x' || substr(md5('{SEED}:' || ticket_id), 1, 8))::BIGINT AS h FROM (SELECT DISTINCT ticket_id FROM d)), x0 AS (SELECT ticket_id, s, (h + s * 2654435761) % 4294967296 AS x FROM h, (SELECT unnest(range(0, {SAMPLES})) AS s)),
        x1 AS (SELECT ticket_id, s, (xor(x, x >> 15) * 2146121005) % 4294967296 AS x FROM x0), x2 AS (SELECT ticket_id, s, (xor(x, x >> 13) * 1540483477) % 4294967296 AS x FROM x1), u AS (SELECT ticket_id, s, xor(x, x >> 16) AS u FROM x2), w AS (SELECT ticket_id, s, {' + '.join(f'(u >= {t})::INT' for t in E.POISSON)} AS w FROM u),
        ms AS (SELECT metric, s, round(sum(w * delta) / sum(w), 9) AS m FROM w JOIN d USING (ticket_id) WHERE w > 0 GROUP BY ALL), pl AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY m, s) - 1 AS p FROM ms)
        SELECT metric, any_value(n) AS n, round(any_value(mean), 6) AS mean, round(max(CASE WHEN p = {int(0.025 * SAMPLES)} THEN m END), 6) AS low, round(max(CASE WHEN p = {int(0.975 * SAMPLES)} THEN m END), 6) AS high FROM pl JOIN n USING (metric) GROUP BY metric""",
    "method_compare": _AB + " SELECT metric, baseline, method, round(method - baseline, 6) AS delta FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, (SELECT round(avg({m}), 6) FROM tb) AS baseline, (SELECT round(avg({m}), 6) FROM ta) AS method" for m in ("hit", "recall", "rr", "top1", "top3", "top5")) + ")",
    "reachable_recall": f"""WITH {_GOLD}, {_FILES('ranked', 'a')}, here AS (SELECT DISTINCT t.ticket_id, c.file_path AS gold_file FROM {SQL_TICKETS} t JOIN chunks c USING (repo, base_commit)), h AS (SELECT g.* FROM g SEMI JOIN here USING (ticket_id, gold_file)), {_MATCH('a', 'm', 'h')},
        per AS (SELECT ticket_id, count(*) AS reachable, count(CASE WHEN rank <= 20 THEN 1 END) AS found FROM h LEFT JOIN m USING (ticket_id, gold_file) GROUP BY 1)
        SELECT count(*) AS tickets, CAST(sum(gold - coalesce(reachable, 0)) AS BIGINT) AS unreachable, round(avg(found / reachable), 6) AS reachable_recall FROM (SELECT ticket_id, count(*) AS gold FROM g GROUP BY 1) LEFT JOIN per USING (ticket_id)""",
    "symbol_match": _SYM + " SELECT * FROM sm",
    "symbol_metrics": _SYM + ", x AS (SELECT ticket_id, " + ", ".join(f"{e} AS {n}" for n, e in _SM_COLS) + " FROM sm GROUP BY ticket_id) SELECT count(*) AS tickets, " + ", ".join(f"round(avg({n}), 6) AS {n}" for n, _ in _SM_COLS) + " FROM x",
    "oracle_loss": _SYM + f", {_FILES('ranked', 'a')}, x AS (SELECT sm.*, EXISTS (SELECT 1 FROM a WHERE a.ticket_id = sm.ticket_id AND a.file_path = sm.file_path) AS f, EXISTS (SELECT 1 FROM ps WHERE ps.ticket_id = sm.ticket_id AND ps.name = sm.name) AS p FROM sm) SELECT CASE WHEN exact_rank <= 5 THEN 'found' WHEN exact_rank <= 30 THEN 'rerank_loss' WHEN exact_rank IS NOT NULL THEN 'ranking_loss' WHEN p THEN 'file_loss' WHEN f THEN 'pool_loss' ELSE 'coverage_loss' END AS label, count(*) AS n FROM x GROUP BY 1",
    "coverage_rates": """WITH one AS (SELECT ticket_id, x.* FROM (SELECT ticket_id, max({'evaluated_at': evaluated_at, 'eligible': eligible, 'llm_valid': llm_valid, 'fallback_reason': fallback_reason}) AS x FROM ticket_outcomes GROUP BY 1))
        SELECT coalesce(nullif(fallback_reason, ''), 'none') AS reason, count(*) AS tickets, count(CASE WHEN eligible THEN 1 END) AS eligible, count(CASE WHEN eligible AND llm_valid THEN 1 END) AS valid,
        round(coalesce(count(CASE WHEN one.eligible AND llm_valid THEN 1 END) / nullif(count(CASE WHEN one.eligible THEN 1 END), 0), 0.0), 6)::DOUBLE AS valid_rate FROM one GROUP BY 1""",
    "confidence_gate": f"""WITH {_FILES('ranked', 'a')}, gate AS ({TEXT['input_gate']}), t AS (SELECT *, coalesce(lead(score) OVER (PARTITION BY ticket_id ORDER BY rank), 0.0) AS nxt FROM a),
        l AS (SELECT ticket_id, score, nxt, CASE WHEN coalesce(status, 'error') = 'error' OR regexp_matches(lower(file_path), '(^|/)(test|tests|__tests__|spec|specs)(/|$)') OR regexp_matches(split_part(lower(file_path), '/', -1), '^test_|_test\\.py$') THEN 'low' WHEN score >= 0.55 AND path_hint AND score - nxt >= 0.02 THEN 'high' WHEN score >= 0.25 THEN 'medium' ELSE 'low' END AS level FROM t LEFT JOIN gate USING (ticket_id) WHERE rank = 1)
        SELECT ticket_id, round(score, 4) AS score, round(greatest(0.0, score - nxt), 4) AS margin, level, CASE level WHEN 'high' THEN 'allow_patch_suggestion' WHEN 'medium' THEN 'manual_review_before_patch' ELSE 'block_patch_generation' END AS policy FROM l""",
}
