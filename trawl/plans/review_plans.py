"""Queries of evidence reviews, failure stages, reachability, gold rows and samples that cover strata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.functions.keys import plain_repo, plain_snapshot, ticket_key
from trawl.operators import evaluation as E
from trawl.operators import projections as P
from trawl.operators import relations as R
from trawl.operators import review as V
from trawl.operators import source as S
from trawl.plans.evaluation_plans import _A, _FILES, _N
from trawl.plans.relation_plans import _DEFS, _EDGES, _NAMES, _TK
from trawl.plans.text_plans import SQL_COMMIT, SQL_REPO, SQL_TICKETS
from trawl.sources.tables import table


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("ticket_id", ticket_key(F.col("ticket_id"))).filter("ticket_id IS NOT NULL")


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return V.gold_of(_keyed(table(spark, d, "symbol_gold", "ticket_id", "file_path", "mapping_status")))


def _ranked(spark: SparkSession, d: str, name: str = "ranked") -> DataFrame:
    return E.ranked_files(_keyed(table(spark, d, "ranked_symbols", "ticket_id", "list_name", "file_path", "score", "rank")), name)


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(plain_snapshot(table(spark, d, "tickets", "ticket_id", "repo", "base_commit"))).filter("repo IS NOT NULL AND base_commit IS NOT NULL").distinct()


def _evidence(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    names = _keyed(R.report_symbols(table(spark, d, "tickets")))
    return names, *V.lookup_evidence(names, R.lookup_keys(R.definitions(table(spark, d, "chunks"))))


def evidence_review(spark: SparkSession, d: str) -> DataFrame:
    return V.labelled_evidence(_evidence(spark, d)[1], _gold(spark, d), _ranked(spark, d))


def expansion_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return V.expansion_diagnostics(*_evidence(spark, d))


def exact_program_name(spark: SparkSession, d: str) -> DataFrame:
    tickets = plain_snapshot(table(spark, d, "tickets")).filter("repo IS NOT NULL")
    rows = tickets.select("ticket_id", "repo", "base_commit", P.bug_text(tickets).alias("text")).distinct()
    names = rows.select("ticket_id", "repo", "base_commit", F.posexplode(T.program_names(F.col("text"))).alias("at", "symbol")).distinct()
    return V.exact_names(names, table(spark, d, "chunks", "repo", "base_commit", "chunk_id", "class_name", "function_name"))


def _calls(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks", "repo", "base_commit", "file_path", "code_text")
    found = F.array_distinct(F.regexp_extract_all(T.text_or_empty(F.col("code_text")), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), F.lit(1)))
    return chunks.select("repo", "base_commit", F.col("file_path").alias("caller_file"), F.explode(found).alias("call_name")).distinct()


def call_evidence_review(spark: SparkSession, d: str) -> DataFrame:
    """Calls from a ticket's first ten files, each with what gold says of its ends."""
    refs = _ranked(spark, d).filter("rank <= 10").join(_snapshots(spark, d), "ticket_id").select("ticket_id", "repo", "base_commit", F.col("file_path").alias("caller_file"), F.col("rank").alias("reference_rank"))
    hits = refs.join(R.call_edges(table(spark, d, "chunks")), ["repo", "base_commit", "caller_file"]).withColumnRenamed("caller_file", "reference_file")
    return V.call_evidence(hits, _gold(spark, d))


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in for manual decisions: eligible tickets were found right, others wrong, and the fallback reason is the reviewer's."""
    o = _keyed(table(spark, d, "ticket_outcomes", "ticket_id", "eligible", "fallback_reason"))
    return o.select("ticket_id", F.when(F.col("eligible"), V.LABELS[0]).when(~F.col("eligible"), V.LABELS[2]).alias("label"), F.col("fallback_reason").alias("reason"))


def manual_decisions(spark: SparkSession, d: str) -> DataFrame:
    return V.decided(evidence_review(spark, d), _decisions(spark, d))[0]


def decision_issues(spark: SparkSession, d: str) -> DataFrame:
    return V.decided(evidence_review(spark, d), _decisions(spark, d), require_all=True)[1]


def failure_stages(spark: SparkSession, d: str) -> DataFrame:
    """The candidate list stands for gold, the ranked list is judged, the retrieval list is the pool."""
    gold = E.gold_files(_keyed(table(spark, d, "ranked_symbols", "ticket_id", "list_name", "file_path"))).join(_snapshots(spark, d), "ticket_id")
    chunks = table(spark, d, "chunks", "repo", "base_commit", "file_path")
    return V.failure_stages(gold, _ranked(spark, d), _ranked(spark, d, "retrieval"), chunks, chunks.withColumn("file_path", T.norm_path(F.col("file_path"))), pool=50)


def unresolved_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls in a ticket's first five files that no one place defines and that are named like a gold symbol."""
    leaf = _keyed(table(spark, d, "symbol_gold", "ticket_id", "qualified_name")).select("ticket_id", F.lower(F.substring_index("qualified_name", ".", -1)).alias("target_leaf")).filter("target_leaf <> ''").distinct()
    files = _ranked(spark, d).filter("rank <= 5").join(_snapshots(spark, d), "ticket_id").select("ticket_id", "repo", "base_commit", F.col("file_path").alias("caller_file"))
    return V.unresolved_calls(_calls(spark, d), R.call_edges(table(spark, d, "chunks")), files.join(leaf, "ticket_id"))


def call_reachability(spark: SparkSession, d: str) -> DataFrame:
    """Candidate symbols (for gold) by kind and by whether a call ties their file to a ticket's files."""
    gold = E.symbol_ranks(_keyed(table(spark, d, "ranked_symbols")))[0].select("ticket_id", F.col("file_path").alias("target_file"), "kind").join(_snapshots(spark, d), "ticket_id")
    reach = V.reachability(gold, R.call_edges(table(spark, d, "chunks")), _ranked(spark, d))
    classes = ["prefix", "outside", "none"]
    return reach.groupBy("kind").pivot("reach", classes).count().na.fill(0).select("kind", *classes)


def gold_rows(spark: SparkSession, d: str) -> DataFrame:
    files = _keyed(plain_snapshot(table(spark, d, "symbol_gold", "ticket_id", "repo", "base_commit", "file_path"))).distinct()
    p = table(spark, d, "parse_results", "repo", "base_commit", "file_path", "status", "parsed_at").withColumn("status", F.lower(F.trim("status")))
    w = Window.partitionBy("repo", "base_commit", "file_path").orderBy(F.desc_nulls_last("parsed_at"), F.desc_nulls_last("status"))
    return V.gold_rows(files, p.withColumn("k", F.row_number().over(w)).filter("k = 1").select("repo", "base_commit", "file_path", F.coalesce("status", F.lit("ok")).alias("status")))


def patch_features(spark: SparkSession, d: str) -> DataFrame:
    hunks = S.diff_hunks(table(spark, d, "documents", "doc_id", "text"))
    found = V.features(hunks.select("doc_id", "old_file", "new_file", "change", F.size("added").alias("added"), F.size("deleted").alias("deleted")))
    return found.groupBy("feature").agg(F.count(F.lit(1)).alias("texts"))


def audit_cover(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "symbol_gold", "gold_id", "ticket_id", "repo", "file_path", "mapping_status", "mapping_confidence", "symbol_kind").filter("mapping_status = 'mapped' AND gold_id IS NOT NULL").distinct()
    files = g.groupBy("ticket_id").agg(F.count_distinct("file_path").alias("files"))
    labels = F.array_compact(F.array(F.when(F.col("files") > 1, "multi_file"), F.when(F.col("mapping_confidence") < 0.6, "unsure"), F.when(F.col("symbol_kind") == "module", "module"), F.when(F.col("symbol_kind") == "class", "class")))
    rows = g.join(files, "ticket_id", "left").select(F.col("gold_id").alias("item"), F.coalesce(plain_repo(F.col("repo")), F.lit("?")).alias("repo"), labels.alias("strata"))
    return V.covering_sample(rows, {"multi_file": 5, "module": 5}, 40, 8, 23)


def review_notes(spark: SparkSession, d: str) -> DataFrame:
    """What a reviewer reads of each ticket that is no full hit."""
    rows = table(spark, d, "ranked_symbols", "ticket_id", "list_name", "file_path", "score", "rank")
    m = E.ticket_metrics(E.gold_files(rows), E.ranked_files(rows, "ranked")).filter("outcome <> 'full'").withColumn("found", F.round(F.col("recall") * F.col("gold")).cast("bigint"))
    issues = V.rank_issues(F.col("outcome"), F.col("first_rank"), F.col("found"), F.col("gold"))
    return m.select("ticket_id", issues.alias("issues"), V.note(F.col("outcome"), F.col("gold") - F.col("found"), issues).alias("note"))


QUERIES = {f.__name__: f for f in (evidence_review, expansion_diagnostics, exact_program_name, call_evidence_review, manual_decisions, decision_issues, failure_stages, unresolved_calls, call_reachability, gold_rows, patch_features, audit_cover, review_notes)}

_MAPPED = f"mg AS (SELECT DISTINCT {_TK} AS ticket_id, {_N} AS gold_file FROM symbol_gold WHERE mapping_status = 'mapped' AND {_TK} IS NOT NULL AND {_N} <> '')"
_RANKED = lambda n, out: _FILES(n, out).replace("FROM ranked_symbols", f"FROM (SELECT * REPLACE ({_TK} AS ticket_id) FROM ranked_symbols)")
_SNAP = f"snap AS (SELECT DISTINCT {_TK} AS ticket_id, repo, base_commit FROM {SQL_TICKETS} WHERE repo IS NOT NULL AND base_commit IS NOT NULL AND {_TK} IS NOT NULL)"
_LOOKUP = f"""{_DEFS}, keys AS (SELECT DISTINCT repo, base_commit, unnest([name, split_part(name, '.', -1)]) AS lookup_key, file_path FROM defs), {_NAMES},
nm AS (SELECT DISTINCT {_TK} AS ticket_id, repo, base_commit, symbol FROM names WHERE {_TK} IS NOT NULL),
h1 AS (SELECT DISTINCT ticket_id, repo, base_commit, symbol, file_path, 'exact' AS match FROM nm JOIN keys k USING (repo, base_commit) WHERE k.lookup_key = nm.symbol),
h2 AS (SELECT DISTINCT ticket_id, repo, base_commit, symbol, file_path, 'leaf' AS match FROM (SELECT * FROM nm ANTI JOIN h1 USING (ticket_id, repo, base_commit, symbol)) n JOIN keys k USING (repo, base_commit) WHERE contains(symbol, '.') AND k.lookup_key = split_part(n.symbol, '.', -1)),
hb AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2), sp AS (SELECT ticket_id, repo, base_commit, symbol, count(DISTINCT file_path) AS n FROM hb GROUP BY ALL),
ev AS (SELECT hb.* FROM hb SEMI JOIN (SELECT * FROM sp WHERE n <= 4) USING (ticket_id, repo, base_commit, symbol))"""
_REVIEW = f"""{_LOOKUP}, {_MAPPED}, {_RANKED('ranked', 'ra')}, er AS (SELECT DISTINCT ticket_id, symbol, {_N} AS file, match FROM ev), ej AS (SELECT er.*, mg.gold_file IS NOT NULL AS g, ra.rank FROM er LEFT JOIN mg ON mg.ticket_id = er.ticket_id AND mg.gold_file = er.file LEFT JOIN ra ON ra.ticket_id = er.ticket_id AND ra.file_path = er.file),
rv AS (SELECT ticket_id, CASE WHEN gold_files = 0 THEN 'incorrect_mapping' WHEN extra_files = 0 THEN 'correct_mapping' ELSE 'overly_ambiguous' END AS label, files, gold_files, extra_files, exact, leaf, best_rank FROM (
  SELECT ticket_id, count(DISTINCT file) AS files, count(DISTINCT CASE WHEN g THEN file END) AS gold_files, count(DISTINCT CASE WHEN NOT g THEN file END) AS extra_files, count(DISTINCT CASE WHEN match = 'exact' THEN symbol || chr(31) || file END) AS exact, count(DISTINCT CASE WHEN match = 'leaf' THEN symbol || chr(31) || file END) AS leaf, min(rank) AS best_rank FROM ej GROUP BY ticket_id))"""
_DECIDED = f"""{_REVIEW}, dd AS (SELECT DISTINCT {_TK} AS ticket_id, CASE WHEN eligible THEN 'correct_mapping' WHEN NOT eligible THEN 'incorrect_mapping' END AS said, trim(coalesce(fallback_reason, '')) AS reason FROM ticket_outcomes WHERE {_TK} IS NOT NULL),
dn AS (SELECT ticket_id, max({{'said': said, 'reason': reason}}) AS d, count(*) AS n FROM dd GROUP BY 1),
di AS (SELECT rv.ticket_id, label, d, CASE WHEN d IS NULL THEN 'missing' WHEN n > 1 THEN 'several' WHEN d.said IS NULL THEN 'label' WHEN d.reason = '' THEN 'reason' END AS issue FROM rv LEFT JOIN dn USING (ticket_id))"""

ORACLE = {
    "evidence_review": f"WITH {_REVIEW} SELECT * FROM rv",
    "expansion_diagnostics": f"""WITH {_LOOKUP}, a AS (SELECT ticket_id, count(DISTINCT symbol) AS names FROM nm GROUP BY 1), m AS (SELECT ticket_id, count(DISTINCT symbol) AS matched, count(DISTINCT file_path) AS files, list_sort(list(DISTINCT symbol || '=' || file_path)) AS ps FROM ev GROUP BY 1), x AS (SELECT ticket_id, count(DISTINCT symbol) AS rejected FROM sp WHERE n > 4 GROUP BY 1)
        SELECT ticket_id, names, coalesce(matched, 0) AS matched, coalesce(rejected, 0) AS rejected, names - coalesce(matched, 0) - coalesce(rejected, 0) AS unmatched, coalesce(files, 0) AS files, coalesce(array_to_string(list_slice(ps, 1, 12), ' '), '') AS evidence FROM a LEFT JOIN m USING (ticket_id) LEFT JOIN x USING (ticket_id)""",
    "exact_program_name": f"""WITH {_NAMES}, na AS (SELECT ticket_id, repo, base_commit, unnest(l) AS symbol, generate_subscripts(l, 1) AS pos FROM (SELECT ticket_id, repo, base_commit, list_slice(list_filter(ks, lambda x, i: list_position(ks, x) = i), 1, {T.MAX_NAMES}) AS l FROM ky)),
        q AS (SELECT DISTINCT repo, base_commit, chunk_id, unnest([q, split_part(q, '.', -1)]) AS symbol FROM (SELECT repo, base_commit, chunk_id, lower(concat_ws('.', nullif(class_name, ''), nullif(function_name, ''))) AS q FROM chunks) WHERE q <> '')
        SELECT ticket_id, chunk_id, x.symbol AS name FROM (SELECT ticket_id, repo, base_commit, chunk_id, min({{'pos': pos, 'symbol': symbol}}) AS x FROM na JOIN q USING (repo, base_commit, symbol) GROUP BY ALL)""",
    "call_evidence_review": f"""WITH {_EDGES}, {_MAPPED}, {_RANKED('ranked', 'ra')}, {_SNAP}, h AS (SELECT DISTINCT ra.ticket_id, e.caller_file AS reference_file, ra.rank AS reference_rank, e.target_file, e.call_name FROM ra JOIN snap USING (ticket_id) JOIN edges e ON e.repo = snap.repo AND e.base_commit = snap.base_commit AND e.caller_file = ra.file_path WHERE rank <= 10)
        SELECT 'call-' || substr(sha1(concat_ws(chr(31), ticket_id, reference_file, reference_rank, target_file, call_name)), 1, 12) AS evidence_id, ticket_id, reference_file, reference_rank, target_file, call_name, EXISTS (SELECT 1 FROM mg WHERE mg.ticket_id = h.ticket_id AND gold_file = target_file) AS target_is_gold, EXISTS (SELECT 1 FROM mg WHERE mg.ticket_id = h.ticket_id AND gold_file = reference_file) AS reference_is_gold,
        CASE WHEN EXISTS (SELECT 1 FROM mg WHERE mg.ticket_id = h.ticket_id AND gold_file = target_file) THEN 'correct_mapping' ELSE 'unreviewed' END AS hint FROM h""",
    "manual_decisions": f"WITH {_DECIDED} SELECT ticket_id, CASE WHEN d IS NOT NULL AND issue IS NULL THEN d.said ELSE label END AS label, d IS NOT NULL AND issue IS NULL AS reviewed, CASE WHEN d IS NOT NULL AND issue IS NULL THEN d.reason ELSE '' END AS reason FROM di",
    "decision_issues": f"WITH {_DECIDED} SELECT ticket_id, issue FROM di WHERE issue IS NOT NULL",
    "failure_stages": f"""WITH {_RANKED('ranked', 'fa')}, {_RANKED('retrieval', 'fb')}, {_SNAP}, g AS (SELECT DISTINCT {_TK} AS ticket_id, {_N} AS gold_file FROM ranked_symbols WHERE list_name = 'candidate' AND {_TK} IS NOT NULL), sn AS (SELECT DISTINCT repo, base_commit FROM chunks), fl AS (SELECT DISTINCT repo, base_commit, {_N} AS gold_file FROM chunks),
        m AS (SELECT g.*, repo, base_commit FROM g JOIN snap USING (ticket_id) WHERE NOT EXISTS (SELECT 1 FROM fa WHERE fa.ticket_id = g.ticket_id AND fa.file_path = g.gold_file AND rank <= 20)),
        s AS (SELECT m.ticket_id, CASE WHEN sn.repo IS NULL THEN 'u' WHEN fl.repo IS NULL THEN 'c' WHEN EXISTS (SELECT 1 FROM fb WHERE fb.ticket_id = m.ticket_id AND fb.file_path = m.gold_file AND rank <= 50) THEN 'k' ELSE 'r' END AS s FROM m LEFT JOIN sn USING (repo, base_commit) LEFT JOIN fl USING (repo, base_commit, gold_file))
        SELECT ticket_id, count(*) AS missed, CASE WHEN bool_or(s = 'u') THEN 'unavailable' WHEN bool_or(s = 'c') THEN 'coverage' WHEN bool_or(s = 'r') AND bool_or(s = 'k') THEN 'mixed' WHEN bool_or(s = 'r') THEN 'retrieval' ELSE 'rerank' END AS stage FROM s GROUP BY ticket_id""",
    "unresolved_calls": f"""WITH {_EDGES}, {_RANKED('ranked', 'ra')}, {_SNAP}, l AS (SELECT DISTINCT {_TK} AS ticket_id, lower(split_part(qualified_name, '.', -1)) AS target_leaf FROM symbol_gold WHERE {_TK} IS NOT NULL AND split_part(qualified_name, '.', -1) <> ''),
        o AS (SELECT *, lower(call_name) AS target_leaf FROM calls ANTI JOIN edges USING (repo, base_commit, caller_file, call_name))
        SELECT DISTINCT ra.ticket_id, target_leaf, caller_file, call_name FROM ra JOIN snap USING (ticket_id) JOIN l USING (ticket_id) JOIN o USING (repo, base_commit, target_leaf) WHERE ra.rank <= 5 AND o.caller_file = ra.file_path""",
    "call_reachability": f"""WITH {_EDGES}, {_RANKED('ranked', 'ra')}, {_SNAP}, t AS (SELECT DISTINCT {_TK} AS ticket_id, {_N} AS target_file, lower(trim(coalesce(symbol_kind, ''))) AS kind FROM ranked_symbols WHERE list_name = 'candidate' AND {_TK} IS NOT NULL), p AS (SELECT repo, base_commit, caller_file AS target_file, target_file AS peer FROM edges UNION SELECT repo, base_commit, target_file, caller_file FROM edges),
        b AS (SELECT t.ticket_id, t.target_file, kind, min(CASE WHEN ra.rank <= 20 THEN ra.rank END) AS r FROM t JOIN snap USING (ticket_id) LEFT JOIN p USING (repo, base_commit, target_file) LEFT JOIN ra ON ra.ticket_id = t.ticket_id AND ra.file_path = p.peer GROUP BY ALL)
        SELECT kind, count(CASE WHEN r <= 5 THEN 1 END) AS prefix, count(CASE WHEN r > 5 THEN 1 END) AS outside, count(CASE WHEN r IS NULL THEN 1 END) AS "none" FROM b GROUP BY kind""",
    "gold_rows": f"""WITH f AS (SELECT DISTINCT {_TK} AS ticket_id, {SQL_REPO} AS repo, {SQL_COMMIT} AS base_commit, file_path FROM symbol_gold WHERE {_TK} IS NOT NULL), p AS (SELECT repo, base_commit, file_path, coalesce(lower(trim(status)), 'ok') AS status FROM parse_results QUALIFY row_number() OVER (PARTITION BY repo, base_commit, file_path ORDER BY parsed_at DESC NULLS LAST, lower(trim(status)) DESC NULLS LAST) = 1),
        x AS (SELECT f.*, CASE coalesce(status, 'missing_file') WHEN 'syntax_error' THEN 'parser_failure' WHEN 'parser_error' THEN 'parser_failure' WHEN 'unsupported_language' THEN 'unsupported_language' WHEN 'missing_file' THEN 'missing_base_file' WHEN 'invalid_path' THEN 'invalid_path' WHEN 'symlink_escape' THEN 'symlink_escape' ELSE '' END AS why FROM f LEFT JOIN p USING (repo, base_commit, file_path))
        SELECT ticket_id, repo, base_commit, file_path, CASE WHEN why = '' THEN 'mapped' ELSE 'excluded' END AS mapping_status, CASE WHEN why = '' THEN 'module' END AS kind, nullif(why, '') AS reason FROM x""",
    "review_notes": _A + " SELECT ticket_id, '' AS issues, outcome || ': ' || (gold - found) || ' missed' AS note FROM (SELECT *, CAST(round(recall * gold) AS BIGINT) AS found FROM ta WHERE outcome <> 'full')",
}
