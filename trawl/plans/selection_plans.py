"""Queries of identifier evidence, symbol pools, gold lists, eligibility, histograms and audit samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.operators import evaluation as E
from trawl.operators import selection as S
from trawl.plans.evaluation_plans import _FILES, _GOLD
from trawl.plans.retrieval_plans import _ASKED, _CORPUS, _IDENT
from trawl.plans.text_plans import sql_distinct
from trawl.sources.tables import table


def identifier_signal(spark: SparkSession, d: str) -> DataFrame:
    return S.identifier_scores(table(spark, d, "tickets"), table(spark, d, "chunks")).select("ticket_id", "chunk_id", "identifier")


def symbol_pool(spark: SparkSession, d: str) -> DataFrame:
    return S.symbol_pool(table(spark, d, "chunks")).select("repo", "base_commit", "file_path", "kind", "name", "parts", F.md5("code").alias("digest"))


def gold_lists(spark: SparkSession, d: str) -> DataFrame:
    return S.gold_lists(table(spark, d, "ticket_outcomes"), table(spark, d, "symbol_gold"))


def eligible_tickets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ranked_symbols")
    return S.eligible(E.gold_files(rows), E.ranked_files(rows, "ranked"))


def status_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Parse reports per repository and status with their share of the repository, to 4 places."""
    n = table(spark, d, "parse_results", "repo", "status").groupBy("repo", F.coalesce(F.lower(F.trim("status")), F.lit("?")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("repo").agg(F.sum("n").alias("total"))
    return n.join(total, "repo").select("repo", "status", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))


def audit_sample(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "symbol_gold", "gold_id", "mapping_method")
    return S.audit_sample(g, "mapping_method", "gold_id", 5, 60, 23)


QUERIES = {f.__name__: f for f in (identifier_signal, symbol_pool, gold_lists, eligible_tickets, status_histogram, audit_sample)}

ORACLE = {
    "identifier_signal": f"WITH {_CORPUS}, {_ASKED}, {_IDENT} SELECT ticket_id, chunk_id, identifier FROM ident",
    "symbol_pool": """WITH r AS (SELECT DISTINCT repo, base_commit, file_path, chunk_id, lower(trim(coalesce(symbol_kind, 'chunk'))) AS kind, coalesce(nullif(function_name, ''), nullif(class_name, ''), '') AS name, coalesce(start_line, 2147483647) AS s, coalesce(code_text, '') AS code FROM chunks),
        m AS (SELECT DISTINCT repo, base_commit, file_path FROM r WHERE kind = 'module'), f AS (SELECT *, row_number() OVER (PARTITION BY repo, base_commit, file_path ORDER BY s, chunk_id, code) AS n FROM r ANTI JOIN m USING (repo, base_commit, file_path))
        SELECT repo, base_commit, file_path, kind, CASE WHEN kind = 'module' THEN '<module>' ELSE name END AS name, 1 AS parts, md5(code) AS digest FROM r WHERE kind IN ('module', 'function', 'async_function', 'method', 'async_method', 'class')
        UNION ALL SELECT repo, base_commit, file_path, 'module', '<module>', CAST(count(*) AS INTEGER), md5(substr(string_agg(code, chr(10) ORDER BY n), 1, 12000)) FROM f WHERE n <= 3 GROUP BY ALL""",
    "gold_lists": f"""WITH a AS (SELECT ticket_id, max(baseline_top) AS a FROM ticket_outcomes GROUP BY 1), b AS (SELECT ticket_id, list_sort(list(DISTINCT file_path)) AS b FROM symbol_gold WHERE mapping_status = 'mapped' GROUP BY 1),
        c AS (SELECT ticket_id, list_filter(list_transform(list_concat(coalesce(a, []), coalesce(b, [])), lambda x: regexp_replace(replace(x, chr(92), '/'), '^[./]+', '')), lambda x: x <> '') AS c FROM a LEFT JOIN b USING (ticket_id)) SELECT ticket_id, array_to_string({sql_distinct('c')}, '|') AS files FROM c""",
    "eligible_tickets": f"WITH {_GOLD}, {_FILES('ranked', 'a')} SELECT DISTINCT ticket_id FROM g WHERE EXISTS (SELECT 1 FROM a WHERE a.ticket_id = g.ticket_id AND a.file_path = g.gold_file AND a.rank <= 5)",
    "status_histogram": "WITH n AS (SELECT repo, coalesce(lower(trim(status)), '?') AS status, count(*) AS n FROM parse_results GROUP BY ALL) SELECT repo, status, n, round(n / sum(n) OVER (PARTITION BY repo), 4) AS share FROM n",
    "audit_sample": "WITH g AS (SELECT DISTINCT gold_id, mapping_method FROM symbol_gold), p AS (SELECT *, sha256('23:' || gold_id) AS h, (row_number() OVER (PARTITION BY mapping_method ORDER BY sha256('23:' || gold_id), gold_id) > 5)::INT AS late FROM g) SELECT gold_id, mapping_method, CASE WHEN late = 0 THEN 'stratum' ELSE 'fill' END AS reason FROM p ORDER BY late, h, gold_id, mapping_method LIMIT 60",
}
