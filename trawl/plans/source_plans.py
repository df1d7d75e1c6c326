"""Queries that parse source and diffs, pipelines, review blending, incremental indexing, gates and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.operators import evaluation as E
from trawl.operators import pipeline as P
from trawl.operators import slots as SL
from trawl.operators import source as S
from trawl.plans.evaluation_plans import _SYM
from trawl.plans.retrieval_plans import _FILES, _WEIGHTED
from trawl.plans.text_plans import ORACLE as TEXT
from trawl.sources.tables import table
from trawl.storage import cut, new_path
from trawl.streaming import resume

_OLD = "2025-01-15 00:00:00"  # the time at which the earlier index was built


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files", "repo", "base_commit", "file_path", "content")


def ast_symbols(spark: SparkSession, d: str) -> DataFrame:
    return S.symbols(_files(spark, d)).filter("kind IS NOT NULL")


def parse_status(spark: SparkSession, d: str) -> DataFrame:
    return S.symbols(_files(spark, d)).groupBy("repo", "status").agg(F.count_distinct("base_commit", "file_path").alias("files"))


def regex_declarations(spark: SparkSession, d: str) -> DataFrame:
    return S.declarations(_files(spark, d).filter("NOT file_path RLIKE '[.]pyi?$'"))


def source_facts(spark: SparkSession, d: str) -> DataFrame:
    return S.facts(_files(spark, d)).groupBy("repo", "fact").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("names"))


def import_edges(spark: SparkSession, d: str) -> DataFrame:
    return S.import_edges(S.facts(_files(spark, d)), _files(spark, d))


def resolved_calls(spark: SparkSession, d: str) -> DataFrame:
    return S.resolved_calls(S.facts(_files(spark, d)), S.symbols(_files(spark, d)))


def api_links(spark: SparkSession, d: str) -> DataFrame:
    return S.api_links(S.facts(_files(spark, d)))


def diff_hunks(spark: SparkSession, d: str) -> DataFrame:
    x = S.diff_hunks(table(spark, d, "documents", "doc_id", "text"))
    return x.select("doc_id", "old_file", "new_file", "change", "hunk", "old_start", "old_count", "new_start", "new_count", F.size("deleted").alias("deleted"), F.size("added").alias("added"), F.array_join(F.col("anchors").cast("array<string>"), ",").alias("anchors"), "complete")


def hunk_headers(spark: SparkSession, d: str) -> DataFrame:
    """Header numbers of every hunk, in the JVM; a missing count is 1 and a count of 0 stays 0."""
    shape = r"(?m)^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    part = lambda g: F.regexp_extract_all("text", F.lit(shape), F.lit(g))
    rows = table(spark, d, "documents", "doc_id", "text").filter("text IS NOT NULL").select("doc_id", F.explode(F.arrays_zip(*[part(g).alias(n) for g, n in enumerate(("a", "b", "c", "e"), 1)])).alias("h"))
    number = lambda c: F.coalesce(F.nullif(F.col(f"h.{c}"), F.lit("")), F.lit("1")).cast("bigint")
    return rows.select("doc_id", number("a").alias("old_start"), number("b").alias("old_count"), number("c").alias("new_start"), number("e").alias("new_count"))


def llm_blend(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval scores blended with review scores (the table's retrieval_score stands for the review) over the first ten of each ticket."""
    rows = table(spark, d, "ranked_symbols", "ticket_id", "chunk_id", "score", "retrieval_score").filter("ticket_id IS NOT NULL AND score >= 0 AND score <= 1")
    best = rows.groupBy("ticket_id", F.col("chunk_id").alias("item")).agg(F.max("score").alias("retrieval"), F.max("retrieval_score").alias("reviewed"))
    w = Window.partitionBy("ticket_id").orderBy(F.desc("retrieval"), "item")
    top = best.withColumn("rank", F.row_number().over(w)).filter("rank <= 10")
    return P.blended(top).select("ticket_id", "item", "rank", "batch", "blend", "accepted")


def coverage_select(spark: SparkSession, d: str) -> DataFrame:
    return P.reserved_slots(E.symbol_ranks(table(spark, d, "ranked_symbols"))[1], 10)


def symbol_slots(spark: SparkSession, d: str) -> DataFrame:
    """Ten symbols of every ticket under each mode of selection; calls tie symbols whose file calls the other's name."""
    rows = table(spark, d, "ranked_symbols", "ticket_id", "list_name", "rank", "file_path", "symbol_qualified_name", "symbol_kind", "score", "start_line", "end_line")
    best = E.symbol_ranks(rows)[1]
    kind = F.lower(F.trim(F.coalesce("symbol_kind", F.lit(""))))
    lines = rows.filter("list_name = 'ranked' AND ticket_id IS NOT NULL").groupBy("ticket_id", T.norm_path(F.col("file_path")).alias("file_path"), T.symbol_key(F.col("symbol_qualified_name")).alias("name"), kind.alias("kind")).agg(F.min(F.least("start_line", "end_line")).alias("start_line"), F.max(F.greatest("start_line", "end_line")).alias("end_line"), F.max(F.when((F.col("score") >= 0) & (F.col("score") <= 1), F.col("score"))).alias("file_score"))
    x = cut(best.join(lines, ["ticket_id", "file_path", "name", "kind"]), "symbols", compression="zstd")
    leaf = x.withColumn("leaf", F.substring_index("name", ".", -1)).filter("leaf <> ''")
    links = leaf.select("ticket_id", "leaf", F.col("rank").alias("a"), F.col("file_path").alias("fa")).join(leaf.select("ticket_id", "leaf", F.col("rank").alias("b"), F.col("file_path").alias("fb")), ["ticket_id", "leaf"]).filter("fa <> fb AND a <= 10").select("ticket_id", "a", "b")
    out = None
    for mode in SL.MODES:
        part = SL.select_symbols(x, 10, mode, links).select(F.lit(mode).alias("mode"), "ticket_id", "place", "rank", "file_path", "name", "kind")
        out = part if out is None else out.union(part)
    return out


def incremental_index(spark: SparkSession, d: str) -> DataFrame:
    now = table(spark, d, "source_files")
    return P.incremental(now.filter(F.col("loaded_at") < F.lit(_OLD).cast("timestamp_ntz")), now)


def protocol_gates(spark: SparkSession, d: str) -> DataFrame:
    t, o, g = table(spark, d, "tickets"), table(spark, d, "ticket_outcomes"), table(spark, d, "symbol_gold")
    return P.gates([
        ("tickets_have_outcome", t.select("ticket_id").distinct().join(o, "ticket_id", "left_anti")),
        ("ticket_ids_once", t.groupBy("ticket_id").count().filter("count > 1")),
        ("mapped_has_symbol", g.filter("mapping_status = 'mapped' AND coalesce(symbol_id, '') = ''")),
        ("excluded_has_reason", g.filter("mapping_status = 'excluded' AND coalesce(exclusion_reason, '') = ''")),
        ("one_split", o.filter("split_name IS NOT NULL").select("ticket_id", F.lower(F.trim("split_name")).alias("s")).distinct().groupBy("ticket_id").count().filter("count > 1")),
    ])


def pipeline_e2e(spark: SparkSession, d: str) -> DataFrame:
    return P.localize(table(spark, d, "tickets"), table(spark, d, "chunks"))


def symbol_rank_b1(spark: SparkSession, d: str) -> DataFrame:
    return P.symbol_scores(table(spark, d, "tickets"), table(spark, d, "chunks"))


def resume_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream, delivered twice, each kept once."""
    schema = table(spark, d, "events").schema
    target, state = new_path(spark, "events"), new_path(spark, "progress")
    for turn in range(2):
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{d}/event[s].parquet")
        resume.append_once(stream, "event_id", target, f"{state}-{turn}").awaitTermination()
    return spark.read.schema(schema).parquet(target).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events", "ts", "event_type").withColumn("ts", F.col("ts").cast("timestamp"))
    return resume.windowed_counts(rows, "ts", "event_type").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


QUERIES = {
    f.__name__: f
    for f in (ast_symbols, parse_status, regex_declarations, source_facts, import_edges, resolved_calls, api_links, diff_hunks, hunk_headers, llm_blend, coverage_select, symbol_slots, incremental_index, protocol_gates, pipeline_e2e, symbol_rank_b1, resume_stream, windowed_events)
}

_B1 = f"""{_WEIGHTED}, scored AS (SELECT * FROM w), {_FILES.replace('cosine', 'w_score').replace('FROM scored GROUP', 'FROM (SELECT *, score AS w_score FROM scored) GROUP')}, ff AS (SELECT * FROM fr WHERE rank <= 20),
b1 AS (SELECT w.*, round(0.5::DOUBLE * cosine + 0.2::DOUBLE * keyword + 0.15::DOUBLE * trace + 0.1::DOUBLE * symbol + 0.05::DOUBLE * coalesce(file_score, 0.0), 8) AS b1 FROM w LEFT JOIN ff USING (ticket_id, file_path))"""

ORACLE = {
    "hunk_headers": "SELECT doc_id, CAST(coalesce(nullif(a, ''), '1') AS BIGINT) AS old_start, CAST(coalesce(nullif(b, ''), '1') AS BIGINT) AS old_count, CAST(coalesce(nullif(c, ''), '1') AS BIGINT) AS new_start, CAST(coalesce(nullif(e, ''), '1') AS BIGINT) AS new_count FROM (SELECT doc_id, "
    + ", ".join(f"unnest(regexp_extract_all(text, '(?m)^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@', {g})) AS {n}" for g, n in enumerate(("a", "b", "c", "e"), 1))
    + " FROM documents WHERE text IS NOT NULL)",
    "llm_blend": """WITH b AS (SELECT ticket_id, chunk_id AS item, max(score) AS retrieval, max(retrieval_score) AS reviewed FROM ranked_symbols WHERE ticket_id IS NOT NULL AND NOT isnan(score) AND score BETWEEN 0 AND 1 GROUP BY ALL),
        t AS (SELECT *, CAST(row_number() OVER (PARTITION BY ticket_id ORDER BY retrieval DESC, item) AS INTEGER) AS rank FROM b QUALIFY rank <= 10), o AS (SELECT *, min(coalesce(NOT isnan(reviewed) AND reviewed BETWEEN 0 AND 1, false)::INT) OVER (PARTITION BY ticket_id) = 1 AS accepted FROM t)
        SELECT ticket_id, item, rank, CAST(floor((rank - 1) / 5) AS BIGINT) AS batch, round(CASE WHEN accepted THEN 0.7::DOUBLE * retrieval + 0.3::DOUBLE * reviewed ELSE retrieval END, 8) AS blend, accepted FROM o""",
    "coverage_select": _SYM + ", x AS (SELECT *, (kind = 'module' AND row_number() OVER (PARTITION BY ticket_id, file_path, kind = 'module' ORDER BY rank) = 1 AND count(*) OVER (PARTITION BY ticket_id) > 10)::INT AS sure FROM ps) SELECT ticket_id, CAST(row_number() OVER (PARTITION BY ticket_id ORDER BY sure DESC, rank) AS INTEGER) AS place, file_path, name, kind FROM x QUALIFY place <= 10",
    "incremental_index": f"""WITH b AS (SELECT repo, base_commit, file_path, max(sha256(content)) AS b FROM source_files WHERE content IS NOT NULL GROUP BY ALL), a AS (SELECT repo, base_commit, file_path, max(sha256(content)) AS a FROM source_files WHERE content IS NOT NULL AND loaded_at < TIMESTAMP '{_OLD}' GROUP BY ALL)
        SELECT repo, base_commit, file_path, CASE WHEN b IS NULL THEN 'drop' WHEN a = b THEN 'reuse' ELSE 'rebuild' END AS action FROM a FULL JOIN b USING (repo, base_commit, file_path)""",
    "protocol_gates": "SELECT \"check\", violations, violations = 0 AS passed FROM ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS \"check\", count(*) AS violations FROM ({q})"
        for n, q in (
            ("tickets_have_outcome", "SELECT DISTINCT ticket_id FROM tickets WHERE ticket_id NOT IN (SELECT ticket_id FROM ticket_outcomes)"),
            ("ticket_ids_once", "SELECT ticket_id FROM tickets GROUP BY 1 HAVING count(*) > 1"),
            ("mapped_has_symbol", "SELECT 1 FROM symbol_gold WHERE mapping_status = 'mapped' AND coalesce(symbol_id, '') = ''"),
            ("excluded_has_reason", "SELECT 1 FROM symbol_gold WHERE mapping_status = 'excluded' AND coalesce(exclusion_reason, '') = ''"),
            ("one_split", "SELECT ticket_id FROM ticket_outcomes WHERE split_name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT lower(trim(split_name))) > 1"),
        )
    )
    + ")",
    "pipeline_e2e": f"""WITH {_B1}, gate AS ({TEXT['input_gate']}), nx AS (SELECT *, coalesce(lead(file_score) OVER (PARTITION BY ticket_id ORDER BY rank), 0.0) AS nxt FROM ff),
        lv AS (SELECT n.ticket_id, CASE WHEN coalesce(status, 'error') = 'error' OR regexp_matches(lower(file_path), '(^|/)(test|tests|__tests__|spec|specs)(/|$)') OR regexp_matches(split_part(lower(file_path), '/', -1), '^test_|_test\\.py$') THEN 'low' WHEN file_score >= 0.55 AND (path_hint OR st >= 0.55) AND (file_score - nxt >= 0.02 OR st >= 0.75) THEN 'high' WHEN file_score >= 0.25 THEN 'medium' ELSE 'low' END AS level, status FROM nx n LEFT JOIN gate USING (ticket_id) LEFT JOIN (SELECT ticket_id, chunk_id, trace AS st FROM w) tw ON tw.ticket_id = n.ticket_id AND tw.chunk_id = n.chunk_id WHERE rank = 1),
        pz AS (SELECT b.ticket_id, b.chunk_id, b.file_path, ff.rank AS file_rank, b.b1 AS score, CAST(row_number() OVER (PARTITION BY b.ticket_id ORDER BY b.b1 DESC, b.kind_rank, b.span, b.chunk_id) AS INTEGER) AS place FROM b1 b JOIN ff USING (ticket_id, file_path) WHERE ff.rank <= 5)
        SELECT ticket_id, place, chunk_id, file_path, file_rank, score, level, CASE level WHEN 'high' THEN 'allow_patch_suggestion' WHEN 'medium' THEN 'manual_review_before_patch' ELSE 'block_patch_generation' END AS policy FROM pz JOIN lv USING (ticket_id) WHERE place <= 5 AND status <> 'error'""",
    "symbol_rank_b1": f"WITH {_B1} SELECT ticket_id, CAST(row_number() OVER (PARTITION BY ticket_id ORDER BY b1 DESC, kind_rank, span, chunk_id) AS INTEGER) AS rank, chunk_id, b1 FROM b1 QUALIFY rank <= 30",
    "resume_stream": "SELECT event_type, count(DISTINCT event_id) AS n, count(DISTINCT event_id) AS ids FROM events WHERE event_id IS NOT NULL GROUP BY event_type",
    "windowed_events": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}
