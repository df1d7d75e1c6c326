"""The pN_ queries and, where SQL can say the same over whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions.keys import PLACEHOLDERS
from trawl.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

#: Candidates kept per ticket by problem 3.
TOP = 5


def p1_flags(spark: SparkSession, d: str) -> DataFrame:
    """Every unparsable file with the first reason found, and what the latest earlier report said of it."""
    from trawl.llm.syntax import unparsable

    found = unparsable(table(spark, d, "source_files", "repo", "base_commit", "file_path", "content"))
    said = table(spark, d, "parse_results", "repo", "base_commit", "file_path", "status", "error_type", "parsed_at")
    latest = said.groupBy("repo", "base_commit", "file_path").agg(F.max(F.struct("parsed_at", F.lower(F.trim("status")).alias("status"), "error_type")).alias("x"))
    latest = latest.select(F.col("repo").alias("r"), F.col("base_commit").alias("b"), F.col("file_path").alias("f"), F.col("x.status").alias("reported_status"), F.col("x.error_type").alias("reported_error"))
    same = F.col("repo").eqNullSafe(F.col("r")) & F.col("base_commit").eqNullSafe(F.col("b")) & (F.col("file_path") == F.col("f"))
    return found.join(latest, same, "left").drop("r", "b", "f")


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    from trawl.llm.syntax import rates, unparsable

    files = table(spark, d, "source_files", "repo", "base_commit", "file_path", "content")
    return rates(files, unparsable(files))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from trawl.llm.syntax import unparsable

    return unparsable(table(spark, d, "source_files", "repo", "base_commit", "file_path", "content")).select("repo", "base_commit", "file_path")


def p2_reasons(spark: SparkSession, d: str) -> DataFrame:
    from trawl.llm.provenance import provenance

    chunks = table(spark, d, "chunks", "repo", "base_commit", "file_path", "symbol_kind", "code_text")
    # Attribute files, if a snapshot has any, are rows of source_files.
    attributes = table(spark, d, "source_files", "repo", "base_commit", "file_path", "content").filter("file_path RLIKE '(^|/)[.]gitattributes$'")
    return provenance(chunks, attributes)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_reasons(spark, d).select("repo", "base_commit", "file_path")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_top_candidates(spark, d).select("ticket_id", "chunk_id")


def p3_top_candidates(spark: SparkSession, d: str) -> DataFrame:
    from trawl.llm.topn import top_n

    rows = table(spark, d, "ranked_symbols", "ticket_id", "chunk_id", "score", "rank")
    return top_n(rows, "ticket_id", "chunk_id", "score", "rank", TOP)


def p3_skips(spark: SparkSession, d: str) -> DataFrame:
    """How many row groups the top candidates were found without."""
    from trawl.llm.topn import skips

    rows = table(spark, d, "ranked_symbols", "ticket_id", "chunk_id", "score", "rank")
    return skips(rows, "ticket_id", "chunk_id", "score", "rank", TOP)


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    from trawl.llm.split import split_oversized

    return split_oversized(table(spark, d, "chunks"), table(spark, d, "size_limits"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pieces(spark, d).filter("pieces > 1 AND chunk_id IS NOT NULL").select("chunk_id").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from trawl.llm.families import family_pairs

    return family_pairs(table(spark, d, "symbol_gold"), table(spark, d, "tickets"))


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    from trawl.llm.families import split_records

    return split_records(table(spark, d, "symbol_gold"), table(spark, d, "tickets"), table(spark, d, "split_targets"))


def p6_overlaps(spark: SparkSession, d: str) -> DataFrame:
    from trawl.llm.overlap import overlapping

    return overlapping(table(spark, d, "tickets"), table(spark, d, "symbol_gold"), table(spark, d, "ticket_outcomes"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_overlaps(spark, d).select("ticket_a", "ticket_b").distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    from trawl.llm.overlap import report

    return report(p6_overlaps(spark, d))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    from trawl.llm.bpe import encode

    return encode(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    from trawl.llm.pack import measured, pack

    return pack(measured(table(spark, d, "documents", "doc_id", "text")), table(spark, d, "size_limits"))


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    from trawl.llm.pii import detect

    return detect(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "name_lexicon")).select("doc_id", "redacted")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    from trawl.llm.pii import located

    return located(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "name_lexicon")).select("doc_id", "pii_type", "start_pos")


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_flags": p1_flags,
        "p1_rates": p1_rates,
        "p2_found": p2_found,
        "p2_reasons": p2_reasons,
        "p3_found": p3_found,
        "p3_top_candidates": p3_top_candidates,
        "p3_skips": p3_skips,
        "p4_found": p4_found,
        "p4_pieces": p4_pieces,
        "p5_found": p5_found,
        "p5_splits": p5_splits,
        "p6_found": p6_found,
        "p6_overlaps": p6_overlaps,
        "p6_report": p6_report,
        "p7_ids": p7_ids,
        "p8_containers": p8_containers,
        "p9_found": p9_found,
        "p9_redacted": p9_redacted,
    }


_BEST = """
WITH valid AS (
  SELECT ticket_id, chunk_id, score, rank FROM ranked_symbols
  WHERE ticket_id IS NOT NULL AND chunk_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND score BETWEEN 0 AND 1
), top AS (SELECT ticket_id, chunk_id, max(score) AS score FROM valid GROUP BY ticket_id, chunk_id),
best AS (
  SELECT t.ticket_id, t.chunk_id, t.score, min(v.rank) AS rank
  FROM top t JOIN valid v ON v.ticket_id = t.ticket_id AND v.chunk_id = t.chunk_id AND v.score = t.score
  GROUP BY t.ticket_id, t.chunk_id, t.score
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY score DESC, rank ASC NULLS LAST, chunk_id) AS position FROM best
)
"""


_TRIM = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_TICKET = f"CASE WHEN lower({_TRIM('ticket_id')}) NOT IN ({', '.join(repr(x) for x in PLACEHOLDERS)}) THEN lower({_TRIM('ticket_id')}) END"
_REPO = "nullif(regexp_extract(regexp_replace(regexp_replace(lower(regexp_replace(repo, '\\s+', '', 'g')), '/+$', ''), '\\.git$', ''), '([^/:@]+/[^/:@]+)$', 1), '')"


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": f"""
            WITH RECURSIVE known AS (SELECT DISTINCT {_TICKET} AS k FROM tickets),
            ties AS (SELECT DISTINCT {_REPO} AS r, {_TICKET} AS k FROM symbol_gold),
            edge AS (SELECT DISTINCT a.r AS a, b.r AS b FROM ties a JOIN ties b USING (k) JOIN known USING (k) WHERE a.r <> b.r),
            reach AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b)
            SELECT DISTINCT a AS repo_a, b AS repo_b FROM reach WHERE a < b""",
        "p6_found": f"""
            WITH t AS (SELECT DISTINCT {_TICKET} AS k, ticket_id, list_distinct(regexp_extract_all(lower(concat(coalesce(title, ''), chr(10), coalesce(description, ''))), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM tickets),
            g AS (SELECT DISTINCT {_TICKET} AS k, {_REPO} AS r, lower(regexp_replace(base_commit, '\\s+', '', 'g')) AS c FROM symbol_gold),
            f AS (SELECT DISTINCT r, c AS whole FROM g WHERE length(c) >= 40),
            b AS (SELECT g.k, g.r, coalesce(min(whole), g.c) AS c FROM g LEFT JOIN f ON f.r = g.r AND length(g.c) < 40 AND starts_with(f.whole, g.c) WHERE g.k IS NOT NULL AND g.r IS NOT NULL AND g.c <> '' GROUP BY g.k, g.r, g.c),
            s AS (SELECT DISTINCT {_TICKET} AS k, CASE lower({_TRIM('split_name')}) WHEN 'train' THEN 1 ELSE 2 END AS side FROM ticket_outcomes WHERE lower({_TRIM('split_name')}) IN ('train', 'validation', 'test')),
            p AS (SELECT DISTINCT x.k AS ka, y.k AS kb FROM b x JOIN b y USING (r, c) JOIN s u ON u.k = x.k AND u.side = 1 JOIN s v ON v.k = y.k AND v.side = 2)
            SELECT DISTINCT least(m.ticket_id, n.ticket_id) AS ticket_a, greatest(m.ticket_id, n.ticket_id) AS ticket_b FROM p JOIN t m ON m.k = ka JOIN t n ON n.k = kb
            WHERE m.ticket_id <> n.ticket_id AND len(list_intersect(m.w, n.w)) >= 0.6 * (len(m.w) + len(n.w) - len(list_intersect(m.w, n.w)))""",
        "p3_found": _BEST + "SELECT ticket_id, chunk_id FROM placed WHERE position <= 5",
        "p3_top_candidates": _BEST + "SELECT ticket_id, chunk_id, score, rank, CAST(position AS INTEGER) AS position FROM placed WHERE position <= 5",
        "p4_found": """
            SELECT DISTINCT c.chunk_id FROM chunks c
            JOIN (SELECT lower(trim(item_kind)) AS kind, min(max_size) AS max_size FROM size_limits WHERE unit_name = 'chars' GROUP BY 1) l
              ON l.kind = lower(regexp_replace(coalesce(c.symbol_kind, 'chunk'), '^\\s+|\\s+$', '', 'g'))
            WHERE length(c.code_text) > l.max_size AND c.chunk_id IS NOT NULL""",
    }
