"""Queries of scalar functions and projections over tickets, chunks, documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.operators import projections as P
from trawl.sources.tables import table


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return P.bug_reports(table(spark, d, "tickets"))


def tokenize_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = _reports(spark, d).select("ticket_id", F.explode(T.tokens(F.col("bug_text"))).alias("token"))
    return rows.groupBy("ticket_id", "token").agg(F.count(F.lit(1)).alias("n"))


def important_terms(spark: SparkSession, d: str) -> DataFrame:
    return _reports(spark, d).select("ticket_id", F.array_join(T.important_terms(F.col("bug_text")), " ").alias("terms"))


def report_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return _reports(spark, d).select("ticket_id", F.explode(T.report_identifiers(F.col("bug_text"))).alias("identifier")).distinct()


def symbol_norm(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "ranked_symbols", "symbol_qualified_name").distinct()
    key = T.symbol_key(F.col("symbol_qualified_name"))
    return names.select("symbol_qualified_name", key.alias("lookup_key"), F.substring_index(key, ".", -1).alias("leaf"))


def norm_paths(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "chunks", "file_path").distinct()
    path = T.norm_path(F.col("file_path"))
    return paths.select("file_path", path.alias("norm"), T.base_name(path).alias("name"), T.module_parts(F.col("file_path")).alias("module"), T.test_like(F.col("file_path")).alias("test_like"))


def trace_refs(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws("\n", T.text_or_empty(F.col("error_message")), T.text_or_empty(F.col("description")))
    rows = table(spark, d, "tickets", "ticket_id", "error_message", "description").distinct()
    return rows.select("ticket_id", F.explode(T.trace_refs(text)).alias("r")).groupBy("ticket_id", F.col("r.file").alias("file"), F.col("r.line").alias("line")).agg(F.count(F.lit(1)).alias("n"))


def search_text(spark: SparkSession, d: str) -> DataFrame:
    return P.search_documents(table(spark, d, "chunks")).select("chunk_id", F.md5("search_text").alias("digest"), F.char_length("search_text").alias("chars"))


def derived_names(spark: SparkSession, d: str) -> DataFrame:
    return P.named(table(spark, d, "chunks")).select("chunk_id", "symbol_name", "qualified_name", "evaluation_key").distinct()


def bug_text(spark: SparkSession, d: str) -> DataFrame:
    return P.bug_reports(table(spark, d, "tickets")).select("ticket_id", F.md5("bug_text").alias("digest"), F.char_length("bug_text").alias("chars"))


def input_gate(spark: SparkSession, d: str) -> DataFrame:
    return P.gated_input(table(spark, d, "tickets"))


def ticket_defaults(spark: SparkSession, d: str) -> DataFrame:
    return P.normalized_tickets(table(spark, d, "tickets")).select("ticket_id", "key", F.md5("report").alias("report_digest"), "repo_name", "nulls_filled")


def import_lines(spark: SparkSession, d: str) -> DataFrame:
    return P.import_lines(table(spark, d, "chunks", "repo", "base_commit", "file_path", "code_text"))


def line_preview(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks", "chunk_id", "start_line", "code_text").filter("start_line IS NOT NULL AND code_text IS NOT NULL").distinct()
    return rows.select("chunk_id", "start_line", F.md5(P.numbered_lines(F.col("code_text"), F.col("start_line"))).alias("digest"))


def diff_files(spark: SparkSession, d: str) -> DataFrame:
    return P.diff_files(table(spark, d, "documents", "doc_id", "text"))


def json_props(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events", "event_id", "props")
    return rows.select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(-1)).alias("k"))


def json_lines(spark: SparkSession, d: str) -> DataFrame:
    return P.json_lines(table(spark, d, "documents", "doc_id", "text"))


def json_repair(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each text, and of a fenced and a wrapped form of each event's properties."""
    props = table(spark, d, "events", "event_id", "props").select(F.col("event_id").alias("doc_id"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here it is: "), "props", F.lit(" ."))).otherwise(F.concat("props", F.lit("}"))).alias("text"))
    both = P.repaired_json(table(spark, d, "documents", "doc_id", "text")).withColumn("of", F.lit("document")).union(P.repaired_json(props).withColumn("of", F.lit("event")))
    return both.select("of", "doc_id", "way", F.md5("object").alias("digest"))


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks", "repo", "base_commit", "file_path", "function_name", "class_name", "start_line").distinct()
    text = F.concat_ws("|", *[T.text_or_empty(F.col(c).cast("string")) for c in rows.columns])
    return rows.select(F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("symbol_id"), "repo", "file_path", "start_line").distinct()


def safe_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ranked_symbols", "file_path", "symbol_qualified_name").distinct()
    return rows.select("file_path", "symbol_qualified_name", F.regexp_replace(F.concat_ws("-", "file_path", "symbol_qualified_name"), "[^A-Za-z0-9._-]+", "_").alias("safe_key"))


def validation_issues(spark: SparkSession, d: str) -> DataFrame:
    return P.gold_issues(table(spark, d, "symbol_gold"))


def source_scan(spark: SparkSession, d: str) -> DataFrame:
    return P.listed_sources(table(spark, d, "source_files", "repo", "base_commit", "file_path", "content"))


QUERIES = {f.__name__: f for f in (tokenize_terms, important_terms, report_identifiers, symbol_norm, norm_paths, trace_refs, search_text, derived_names, bug_text, input_gate, ticket_defaults, import_lines, line_preview, diff_files, json_props, json_lines, json_repair, stable_ids, safe_keys, validation_issues, source_scan)}

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def sql_tokens(text: str) -> str:
    """DuckDB list of tokens of a text expression; the look-ahead is replaced by two rewrites that give the same pieces."""
    camel = "regexp_replace(regexp_replace(replace(w, '_', ' '), '([A-Z])([0-9])', ' \\2', 'g'), '([A-Z])([a-z])', ' \\1\\2', 'g')"
    pieces = f"list_filter(regexp_extract_all({camel}, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda p: length(p) > 1)"
    words = f"regexp_extract_all(coalesce({text}, ''), '[A-Za-z][A-Za-z0-9_]*')"
    return f"list_filter(flatten(list_transform({words}, lambda w: list_concat([lower(w)], list_transform({pieces}, lambda p: lower(p))))), lambda t: length(t) > 1)"


def sql_distinct(listing: str) -> str:
    """Distinct elements of a list, the first kept in place."""
    return f"list_filter({listing}, lambda x, i: list_position({listing}, x) = i)"


def sql_terms(tokens: str) -> str:
    return f"list_slice(list_filter({sql_distinct(tokens)}, lambda t: length(t) >= 3 AND t NOT IN ({_STOP})), 1, {T.MAX_TERMS})"


def _bare(x: str) -> str:
    return f"trim(regexp_replace(trim({x}), '^[\"''`.,;:()\\[\\]{{}}]+|[\"''`.,;:()\\[\\]{{}}]+$', '', 'g'))"


_NORM = "regexp_replace(replace(file_path, '\\', '/'), '^[./]+', '')"
_SEARCH = "concat_ws(chr(10), nullif(file_path, ''), nullif(language, ''), nullif(symbol_kind, ''), nullif(function_name, ''), nullif(class_name, ''), nullif(code_text, ''))"
_NAME = "coalesce(nullif(function_name, ''), nullif(class_name, ''))"
_STRIP = lambda c: f"regexp_replace(coalesce({c}, ''), '^\\s+|\\s+$', '', 'g')"
_PARTS = "[" + ", ".join(f"{{'k': '{c}', 'v': {_STRIP(c)}, 'n': lower(regexp_replace({_STRIP(c)}, '\\s+', ' ', 'g'))}}" for c in P.REPORT_FIELDS) + "]"
_BUG = f"array_to_string(list_transform(list_filter({_PARTS}, lambda p, k: p.v <> '' AND list_position(list_transform({_PARTS}, lambda q: q.n), p.n) = k), lambda p: p.k || ': ' || p.v), chr(10))"
_CONTENT = "trim(regexp_replace(concat_ws(chr(10), " + ", ".join(f"nullif({_STRIP(c)}, '')" for c in P.CONTENT_FIELDS) + "), '\\s+', ' ', 'g'))"

#: Repository and commit in the one spelling that joins need, and tickets with both in it.
SQL_REPO = "nullif(regexp_extract(regexp_replace(regexp_replace(lower(regexp_replace(repo, '\\s+', '', 'g')), '/+$', ''), '\\.git$', ''), '([^/:@]+/[^/:@]+)$', 1), '')"
SQL_COMMIT = "nullif(lower(regexp_replace(base_commit, '\\s+', '', 'g')), '')"
SQL_TICKETS = f"(SELECT * REPLACE ({SQL_REPO} AS repo, {SQL_COMMIT} AS base_commit) FROM tickets)"
#: The first 80 code-like names of a report, shape by shape.
SQL_IDS = lambda text: sql_distinct(f"list_filter(list_transform(flatten([{', '.join(f"regexp_extract_all({text}, '" + p.replace('(?:', '(') + "')" for p in T.IDENTIFIER_SHAPES)}]), lambda x: lower(replace({_bare('x')}, '-', '_'))), lambda t: length(t) >= 3 AND t NOT IN ({_STOP}))")

ORACLE = {
    "tokenize_terms": f"SELECT ticket_id, token, count(*) AS n FROM (SELECT ticket_id, unnest({sql_tokens('s')}) AS token FROM (SELECT DISTINCT ticket_id, {_BUG} AS s FROM tickets)) GROUP BY ticket_id, token",
    "important_terms": f"SELECT ticket_id, array_to_string({sql_terms('toks')}, ' ') AS terms FROM (SELECT ticket_id, {sql_tokens('s')} AS toks FROM (SELECT DISTINCT ticket_id, {_BUG} AS s FROM tickets))",
    "report_identifiers": f"SELECT DISTINCT ticket_id, unnest(list_slice({SQL_IDS('s')}, 1, {T.MAX_IDENTIFIERS})) AS identifier FROM (SELECT DISTINCT ticket_id, {_BUG} AS s FROM tickets)",
    "symbol_norm": f"""SELECT symbol_qualified_name, k AS lookup_key, split_part(k, '.', -1) AS leaf FROM (
        SELECT symbol_qualified_name, lower(regexp_replace(regexp_replace(replace(replace({_bare('symbol_qualified_name')}, '::', '.'), '/', '.'), '\\.+', '.', 'g'), '^\\.|\\.$', '', 'g')) AS k
        FROM (SELECT DISTINCT symbol_qualified_name FROM ranked_symbols))""",
    "norm_paths": f"""SELECT file_path, norm, split_part(norm, '/', -1) AS name, replace(regexp_replace(norm, '\\.[A-Za-z0-9]+$', ''), '/', '.') AS module,
        (regexp_matches(lower(norm), '(^|/)(test|tests|__tests__|spec|specs)(/|$)') OR regexp_matches(split_part(lower(norm), '/', -1), '^test_|_test\\.py$')) AS test_like
        FROM (SELECT DISTINCT file_path, {_NORM} AS norm FROM chunks)""",
    "trace_refs": """WITH t AS (SELECT DISTINCT ticket_id, error_message, description FROM tickets),
        x AS (SELECT ticket_id, concat(coalesce(error_message, ''), chr(10), coalesce(description, '')) AS s FROM t),
        r AS ("""
    + " UNION ALL ".join(f"SELECT ticket_id, unnest(regexp_extract_all(s, '{p}', 1)) AS file, unnest(regexp_extract_all(s, '{p}', 2)) AS line FROM x" for p in (q.replace("(?:", "(?:") for q in T.TRACE_SHAPES))
    + ") SELECT ticket_id, replace(file, '\\', '/') AS file, CAST(nullif(line, '') AS BIGINT) AS line, count(*) AS n FROM r GROUP BY ALL",
    "search_text": f"SELECT chunk_id, md5(s) AS digest, CAST(length(s) AS INTEGER) AS chars FROM (SELECT DISTINCT chunk_id, {_SEARCH} AS s FROM chunks)",
    "derived_names": f"""SELECT DISTINCT chunk_id, coalesce({_NAME}, symbol_kind, '') AS symbol_name,
        CASE WHEN lower(trim(symbol_kind)) = 'module' THEN '<module>' WHEN nullif(function_name, '') IS NOT NULL AND nullif(class_name, '') IS NOT NULL THEN class_name || '.' || function_name ELSE coalesce({_NAME}, '') END AS qualified_name,
        file_path || '::' || coalesce({_NAME}, '<file>') || ':' || coalesce(CAST(start_line AS VARCHAR), '') || '-' || coalesce(CAST(end_line AS VARCHAR), '') AS evaluation_key FROM chunks""",
    "bug_text": f"SELECT DISTINCT ticket_id, md5(s) AS digest, CAST(length(s) AS INTEGER) AS chars FROM (SELECT ticket_id, {_BUG} AS s FROM tickets)",
    "input_gate": f"""WITH t AS (SELECT ticket_id, x.* FROM (SELECT ticket_id, max({{'s': {_CONTENT}, 'r': concat(coalesce(error_message, ''), chr(10), coalesce(description, ''))}}) AS x FROM tickets GROUP BY ticket_id)),
        g AS (SELECT ticket_id, CAST(length(s) AS INTEGER) AS chars, {' OR '.join(f"regexp_matches(r, '{p}')" for p in T.TRACE_SHAPES)} AS trace, regexp_matches(s, '([A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+') AS path_hint, regexp_matches(s, '[A-Za-z][A-Za-z0-9_]*[A-Z_]') AS identifier FROM t),
        w AS (SELECT *, CAST(CASE WHEN chars = 0 THEN 0 ELSE (chars < 80)::INT + (NOT (trace OR path_hint OR identifier))::INT END AS INTEGER) AS warnings FROM g)
        SELECT ticket_id, chars, trace, path_hint, identifier, CASE WHEN chars = 0 THEN 'error' WHEN warnings > 0 THEN 'warning' ELSE 'ok' END AS status, warnings FROM w""",
    "ticket_defaults": """SELECT DISTINCT ticket_id, coalesce(nullif(trim(ticket_id), ''), '') AS key, md5(coalesce(nullif(description, ''), nullif(error_message, ''), nullif(title, ''), '')) AS report_digest,
        coalesce(nullif(repo, ''), nullif(product, ''), '') AS repo_name, CAST((title IS NULL)::INT + (description IS NULL)::INT + (component IS NULL)::INT + (severity IS NULL)::INT + (priority IS NULL)::INT AS INTEGER) AS nulls_filled FROM tickets""",
    "import_lines": """WITH l AS (SELECT DISTINCT repo, base_commit, file_path, trim(line) AS line FROM (SELECT repo, base_commit, file_path, unnest(string_split(replace(code_text, chr(13), ''), chr(10))) AS line FROM chunks))
        SELECT repo, base_commit, file_path, line, CASE WHEN regexp_matches(line, '^from\\s+\\S+\\s+import') THEN 'from' WHEN regexp_matches(line, '^#include') THEN 'include' WHEN regexp_matches(line, '^import\\b') THEN 'import' ELSE 'require' END AS form
        FROM l WHERE regexp_matches(line, '^(import\\s|from\\s+\\S+\\s+import\\s|#include\\s|use\\s+[A-Za-z_]|.*\\brequire\\()')""",
    "line_preview": """SELECT DISTINCT chunk_id, start_line, md5(array_to_string(list_transform(string_split(code_text, chr(10)), lambda l, i: CAST(i - 1 + start_line AS VARCHAR) || ': ' || l), chr(10))) AS digest
        FROM (SELECT DISTINCT chunk_id, start_line, code_text FROM chunks WHERE start_line IS NOT NULL AND code_text IS NOT NULL)""",
    "diff_files": """SELECT DISTINCT doc_id, file FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '(?m)^\\+\\+\\+ (?:b/)?([^\\s]+)', 1)) AS file FROM documents) WHERE file <> '/dev/null'""",
    "json_props": "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM events",
    "json_lines": """SELECT doc_id, CAST(sum(json_valid(j)::INT) AS BIGINT) AS parsed, count(*) AS objects FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '\\{[^{}\\n]*\\}')) AS j FROM documents) GROUP BY doc_id""",
    "json_repair": """WITH x AS (SELECT 'document' AS of, doc_id, coalesce(text, '') AS s FROM documents UNION ALL SELECT 'event', event_id, coalesce(CASE event_id % 3 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN 'Here it is: ' || props || ' .' ELSE props || '}' END, '') FROM events),
        t AS (SELECT of, doc_id, regexp_replace(regexp_replace(trim(s), '(?i)^```(?:json)?\\s*', ''), '\\s*```$', '') AS t FROM x), i AS (SELECT *, regexp_extract(t, '(?s)\\{.*\\}', 0) AS i FROM t),
        w AS (SELECT *, CASE WHEN starts_with(trim(t), '{') AND json_valid(trim(t)) THEN 'whole' WHEN starts_with(i, '{') AND json_valid(i) THEN 'braces' ELSE 'none' END AS way FROM i)
        SELECT of, doc_id, way, md5(CASE way WHEN 'whole' THEN trim(t) WHEN 'braces' THEN i ELSE '{}' END) AS digest FROM w""",
    "stable_ids": """SELECT DISTINCT 'sha256:' || sha256(concat_ws('|', coalesce(repo, ''), coalesce(base_commit, ''), coalesce(file_path, ''), coalesce(function_name, ''), coalesce(class_name, ''), coalesce(CAST(start_line AS VARCHAR), ''))) AS symbol_id, repo, file_path, start_line FROM chunks""",
    "safe_keys": "SELECT file_path, symbol_qualified_name, regexp_replace(concat_ws('-', file_path, symbol_qualified_name), '[^A-Za-z0-9._-]+', '_', 'g') AS safe_key FROM (SELECT DISTINCT file_path, symbol_qualified_name FROM ranked_symbols)",
    "validation_issues": """SELECT gold_id, issue, count(*) AS n FROM (SELECT gold_id, unnest(list_filter([
        CASE WHEN trim(coalesce(ticket_id, '')) = '' THEN 'ticket_id' END, CASE WHEN NOT coalesce(regexp_matches(base_commit, '^[0-9a-f]{40}$'), false) THEN 'base_commit' END,
        CASE WHEN mapping_status NOT IN ('mapped', 'excluded') THEN 'mapping_status' END, CASE WHEN mapping_status = 'mapped' AND NOT coalesce(regexp_matches(symbol_id, '^sha256:[0-9a-f]{64}$'), false) THEN 'symbol_id' END,
        CASE WHEN start_line < 1 OR end_line < start_line THEN 'lines' END, CASE WHEN mapping_status = 'mapped' AND coalesce(exclusion_reason, '') <> '' THEN 'exclusion_reason' END,
        CASE WHEN coalesce(file_path, '') = '' OR starts_with(file_path, '/') OR contains(file_path, '..') THEN 'file_path' END], lambda x: x IS NOT NULL)) AS issue FROM symbol_gold) GROUP BY gold_id, issue""",
    "source_scan": """SELECT DISTINCT repo, base_commit, file_path, CAST(octet_length(encode(content)) AS BIGINT) AS bytes FROM source_files
        WHERE content IS NOT NULL AND NOT regexp_matches(file_path, '(^|/)(\\.git|\\.hg|\\.svn|__pycache__|\\.pytest_cache|\\.mypy_cache|\\.ruff_cache|node_modules|venv|\\.venv)/') AND NOT regexp_matches(file_path, '^(dist|build|data|models|reports)/')
        AND NOT regexp_matches(lower(file_path), '(^|/)(test|tests|__tests__|spec|specs)/') AND regexp_matches(lower(file_path), '\\.(py|pyi|js|jsx|ts|tsx|java|c|cc|cpp|h|hpp|go|rs|scala)$') AND octet_length(encode(content)) <= 500000""",
}
