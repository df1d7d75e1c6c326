"""Queries of retrieval: corpus statistics, TF-IDF, signals, weighted ranking, file aggregation, dense neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.operators import retrieval as R
from trawl.plans.text_plans import _BUG, _SEARCH, _STOP, SQL_IDS, SQL_TICKETS, sql_terms, sql_tokens
from trawl.sources.tables import table
from trawl.storage import cut


def _in(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "tickets"), cut(R.corpus(table(spark, d, "chunks")), "corpus", compression="zstd")


def doc_freq_idf(spark: SparkSession, d: str) -> DataFrame:
    docs = R.corpus(table(spark, d, "chunks"))
    terms = R.term_counts(docs, [*R.SNAPSHOT, "chunk_id"], "search_text")
    return R.document_frequencies(terms, docs).select("repo", "base_commit", "term", "df", F.round("idf", 6).alias("idf"))


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "tickets"), table(spark, d, "chunks")


def tfidf_cosine(spark: SparkSession, d: str) -> DataFrame:
    return R.tfidf(*_tables(spark, d)).drop("repo", "base_commit")


def tfidf_top20(spark: SparkSession, d: str) -> DataFrame:
    scored = R.tfidf_rows(*_tables(spark, d))
    return R.ranked(scored, "cosine", 20).select("ticket_id", "rank", "chunk_id", "file_path", "cosine")


def component_terms(spark: SparkSession, d: str) -> DataFrame:
    return R.component_terms(*_in(spark, d)).select("ticket_id", "term")


def trace_signal(spark: SparkSession, d: str) -> DataFrame:
    return R.trace_scores(*_in(spark, d)).select("ticket_id", "chunk_id", "trace")


def keyword_signal(spark: SparkSession, d: str) -> DataFrame:
    return R.lexical_signals(*_in(spark, d)).select("ticket_id", "chunk_id", "keyword", "symbol")


def path_signal(spark: SparkSession, d: str) -> DataFrame:
    return R.path_signals(*_tables(spark, d)).select("ticket_id", "file_path", "path")


def weighted_signals(spark: SparkSession, d: str) -> DataFrame:
    scores = R.weighted(*_tables(spark, d))
    return R.ranked(scores, "score", 20).select("ticket_id", "rank", "chunk_id", "cosine", "trace", "component", "keyword", "symbol", "path", "identifier", "score")


def best_chunk_per_file(spark: SparkSession, d: str) -> DataFrame:
    scored = R.tfidf_rows(*_tables(spark, d))
    return R.ranked(scored, "cosine", 1, ("ticket_id", "file_path")).select("ticket_id", "file_path", "chunk_id", "cosine")


def _light(spark: SparkSession, d: str) -> DataFrame:
    return R.tfidf_rows(*_tables(spark, d)).withColumnRenamed("cosine", "score")


def file_aggregation(spark: SparkSession, d: str) -> DataFrame:
    return R.file_scores(_light(spark, d), 20)


def file_modes(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 files of every ticket under each mode of file aggregation."""
    rows = cut(_light(spark, d), "light", compression="zstd")
    out = None
    for mode in R.AGGREGATIONS:
        part = R.file_scores(rows, 20, mode).select(F.lit(mode).alias("mode"), "ticket_id", "rank", "file_path", "file_score")
        out = part if out is None else out.union(part)
    return out


def overlap_evidence(spark: SparkSession, d: str) -> DataFrame:
    return R.independent_evidence(_light(spark, d))


def package_proximity(spark: SparkSession, d: str) -> DataFrame:
    return R.package_proximity(R.file_scores(_light(spark, d), 50))


def hybrid_semantic(spark: SparkSession, d: str) -> DataFrame:
    return R.dense_neighbours(table(spark, d, "embeddings", "vec_id", "embedding"), 10)


QUERIES = {f.__name__: f for f in (doc_freq_idf, tfidf_cosine, tfidf_top20, component_terms, trace_signal, keyword_signal, path_signal, weighted_signals, best_chunk_per_file, file_aggregation, file_modes, overlap_evidence, package_proximity, hybrid_semantic)}

_CORPUS = f"""docs AS (SELECT repo, base_commit, chunk_id, file_path, x.* FROM (
  SELECT repo, base_commit, chunk_id, file_path, min({{'search_text': {_SEARCH},
    'kind_rank': CASE WHEN contains(lower(trim(coalesce(symbol_kind, 'chunk'))), 'method') OR contains(lower(trim(coalesce(symbol_kind, 'chunk'))), 'function') THEN 0 WHEN lower(trim(symbol_kind)) = 'class' THEN 1 ELSE 2 END,
    'span': abs(coalesce(end_line - start_line, 0)), 'symbol_name': coalesce(nullif(function_name, ''), nullif(class_name, ''), ''), 'start_line': start_line, 'end_line': end_line}}) AS x
  FROM chunks GROUP BY repo, base_commit, chunk_id, file_path))"""
_ASKED = f"""asked AS (SELECT ticket_id, repo, base_commit, x.bug_text AS bug_text, x.component AS component FROM (
  SELECT ticket_id, repo, base_commit, max({{'n': length({_BUG}), 'bug_text': {_BUG}, 'component': coalesce(component, '')}}) AS x
  FROM {SQL_TICKETS} WHERE repo IS NOT NULL AND base_commit IS NOT NULL GROUP BY ticket_id, repo, base_commit))"""
_IDF = f"""terms AS (SELECT repo, base_commit, chunk_id, term, count(*) AS tf FROM (SELECT repo, base_commit, chunk_id, unnest({sql_tokens('search_text')}) AS term FROM docs) GROUP BY ALL),
total AS (SELECT repo, base_commit, count(*) AS total FROM docs GROUP BY ALL),
idf AS (SELECT repo, base_commit, term, count(*) AS df, ln((any_value(total) + 1) / (count(*) + 1)) + 1 AS idf FROM terms JOIN total USING (repo, base_commit) GROUP BY repo, base_commit, term)"""
_TFIDF = f"""{_CORPUS}, {_ASKED}, {_IDF},
vec AS (SELECT repo, base_commit, chunk_id, term, (1 + ln(tf)) * idf AS wd FROM terms JOIN idf USING (repo, base_commit, term)),
nd AS (SELECT repo, base_commit, chunk_id, sqrt(sum(wd * wd)) AS nd FROM vec GROUP BY ALL),
qt AS (SELECT ticket_id, repo, base_commit, term, count(*) AS tf FROM (SELECT ticket_id, repo, base_commit, unnest({sql_tokens('bug_text')}) AS term FROM asked) GROUP BY ALL),
qv AS (SELECT ticket_id, repo, base_commit, term, (1 + ln(tf)) * idf AS wq FROM qt JOIN idf USING (repo, base_commit, term)),
nq AS (SELECT ticket_id, repo, base_commit, sqrt(sum(wq * wq)) AS nq FROM qv GROUP BY ALL),
cos AS (SELECT ticket_id, repo, base_commit, chunk_id, round(any_value(dot) / (any_value(nd) * any_value(nq)), 6) AS cosine FROM (
  SELECT ticket_id, repo, base_commit, chunk_id, sum(wq * wd) AS dot FROM qv JOIN vec USING (repo, base_commit, term) GROUP BY ALL)
  JOIN nd USING (repo, base_commit, chunk_id) JOIN nq USING (ticket_id, repo, base_commit) GROUP BY ticket_id, repo, base_commit, chunk_id)"""
_COS = f"WITH {_TFIDF}, scored AS (SELECT c.*, d.file_path, d.kind_rank, d.span, d.symbol_name, d.start_line, d.end_line FROM cos c JOIN docs d USING (repo, base_commit, chunk_id))"
_COMPONENT = f"""files AS (SELECT DISTINCT repo, base_commit, file_path FROM chunks),
fc AS (SELECT repo, base_commit, count(*) AS files FROM files GROUP BY ALL),
have AS (SELECT repo, base_commit, term, count(*) AS n FROM (SELECT DISTINCT repo, base_commit, file_path, unnest({sql_tokens('file_path')}) AS term FROM files) GROUP BY ALL),
ct AS (SELECT a.ticket_id, a.repo, a.base_commit, a.term FROM (
  SELECT ticket_id, repo, base_commit, unnest(list_filter({sql_terms(sql_tokens('component'))}, lambda z: NOT list_contains({sql_terms(sql_tokens('repo'))}, z))) AS term FROM asked) a
  JOIN fc USING (repo, base_commit) LEFT JOIN have USING (repo, base_commit, term) WHERE coalesce(n, 0) / files < 0.35)"""
_TRACE = """refs AS (SELECT DISTINCT ticket_id, repo, base_commit, regexp_replace(replace(replace(file, chr(92), '/'), chr(92), '/'), '^[./]+', '') AS ref, line FROM ("""
_TRACE += " UNION ALL ".join(
    f"SELECT ticket_id, repo, base_commit, unnest(regexp_extract_all(s, '{p}', 1)) AS file, CAST(nullif(unnest(regexp_extract_all(s, '{p}', 2)), '') AS BIGINT) AS line FROM (SELECT ticket_id, repo, base_commit, concat(coalesce(error_message, ''), chr(10), coalesce(description, '')) AS s FROM {SQL_TICKETS} WHERE repo IS NOT NULL)"
    for p in T.TRACE_SHAPES
)
_TRACE += """)), tr AS (SELECT ticket_id, repo, base_commit, chunk_id, max(CASE WHEN line IS NULL THEN 0.35 WHEN line BETWEEN least(start_line, end_line) AND greatest(start_line, end_line) THEN 0.75
  WHEN least(abs(least(start_line, end_line) - line), abs(greatest(start_line, end_line) - line)) <= 25 THEN 0.55 ELSE 0.35 END)::DOUBLE AS trace
  FROM (SELECT *, split_part(ref, '/', -1) AS name FROM refs WHERE split_part(ref, '/', -1) <> '') r
  JOIN (SELECT *, split_part(regexp_replace(replace(file_path, chr(92), '/'), '^[./]+', ''), '/', -1) AS name FROM docs WHERE start_line IS NOT NULL AND end_line IS NOT NULL) d USING (repo, base_commit, name) GROUP BY ALL)"""
_LEX = f"""q AS (SELECT ticket_id, repo, base_commit, {sql_terms('toks')} AS ts FROM (SELECT *, {sql_tokens('bug_text')} AS toks FROM asked)),
qq AS (SELECT ticket_id, repo, base_commit, len(ts) AS n, unnest(ts) AS term FROM q),
tt AS (SELECT DISTINCT repo, base_commit, chunk_id, unnest({sql_tokens('search_text')}) AS term FROM docs),
nt AS (SELECT DISTINCT repo, base_commit, chunk_id, unnest({sql_tokens("concat_ws(' ', file_path, symbol_name)")}) AS term FROM docs),
bt AS (SELECT repo, base_commit, chunk_id, term, max(named) AS named FROM (SELECT *, 0 AS named FROM tt UNION ALL SELECT *, 1 FROM nt) GROUP BY repo, base_commit, chunk_id, term),
lex AS (SELECT ticket_id, repo, base_commit, chunk_id, round(least(1.0, count(*) / greatest(4, least(any_value(n), 12))), 6)::DOUBLE AS keyword, round(sum(named) / any_value(n), 6)::DOUBLE AS symbol FROM qq JOIN bt USING (repo, base_commit, term) GROUP BY ticket_id, repo, base_commit, chunk_id)"""
_COMP = f"""cn AS (SELECT ticket_id, repo, base_commit, count(*) AS n FROM ct GROUP BY ALL),
comp AS (SELECT ticket_id, repo, base_commit, chunk_id, round(count(*) / any_value(n), 6)::DOUBLE AS component FROM ct JOIN nt USING (repo, base_commit, term) JOIN cn USING (ticket_id, repo, base_commit) GROUP BY ticket_id, repo, base_commit, chunk_id)"""
_W = lambda x: f"list_concat({sql_tokens(x)}, regexp_extract_all({x}, '[a-z0-9]+'))"
_PATH = f"""pf AS (SELECT DISTINCT repo, base_commit, file_path, lower(regexp_replace(replace(file_path, chr(92), '/'), '^[./]+', '')) AS p FROM chunks),
pt AS (SELECT DISTINCT repo, base_commit, file_path, unnest({_W("replace(p, '/', ' ')")}) AS term, regexp_replace(split_part(p, '/', -1), '\\.[a-z0-9]+$', '') AS stem FROM pf),
pl AS (SELECT repo, base_commit, file_path, term, list_contains({_W('stem')}, term)::INT AS is_leaf FROM pt),
pq AS (SELECT DISTINCT ticket_id, repo, base_commit, unnest(list_concat({sql_terms('toks')}, regexp_extract_all(lower(bug_text), '[a-z0-9]+'))) AS term FROM (SELECT *, {sql_tokens('bug_text')} AS toks FROM asked)),
ph AS (SELECT ticket_id, repo, base_commit, file_path, sum(is_leaf) AS l, sum(1 - is_leaf) AS k FROM pq JOIN pl USING (repo, base_commit, term) WHERE term NOT IN ({_STOP}) GROUP BY ALL),
path AS (SELECT ticket_id, repo, base_commit, file_path, round(CASE WHEN l > 0 THEN least(1.0, 0.55 + 0.1 * (l - 1)) WHEN k >= 2 THEN least(0.65, 0.3 + 0.08 * k) ELSE 0.25 END, 6)::DOUBLE AS path FROM ph)"""
_PICKED = """pk AS (SELECT ticket_id, file_path, list({'score': cosine, 'kind_rank': kind_rank, 'span': span, 'chunk_id': chunk_id, 's': least(start_line, end_line), 'e': greatest(start_line, end_line), 'n': symbol_name, 'l': start_line IS NOT NULL AND end_line IS NOT NULL} ORDER BY cosine DESC, kind_rank, span, chunk_id) AS xs FROM scored GROUP BY ALL),
pp AS (SELECT ticket_id, file_path, xs, list_reduce(list_transform(xs, lambda x: [x]), lambda acc, y: CASE WHEN len(acc) < 5 AND len(list_filter(acc, lambda z: z.l AND y[1].l AND greatest(0, least(z.e, y[1].e) - greatest(z.s, y[1].s) + 1) / least(greatest(1, z.e - z.s + 1), greatest(1, y[1].e - y[1].s + 1)) >= 0.5)) = 0 THEN list_concat(acc, y) ELSE acc END) AS ps FROM pk)"""
_FILES = _PICKED + """, nr AS (SELECT ticket_id, file_path, xs, list_filter(ps, lambda z: z.score >= greatest(0.05, 0.8 * xs[1].score) - 1e-12) AS nr FROM pp),
f AS (SELECT ticket_id, file_path, xs[1].score AS score, xs[1].kind_rank AS kind_rank, xs[1].span AS span, xs[1].chunk_id AS chunk_id, CAST(len(nr) AS INTEGER) AS evidence, CAST(len(list_distinct(list_filter(list_transform(nr, lambda z: z.n), lambda n: n <> ''))) AS INTEGER) AS symbols FROM nr),
fs AS (SELECT *, round(least(1.0, score + least(0.05, 0.0125 * greatest(0, evidence - 1)) + least(0.04, 0.01 * greatest(0, symbols - 1))) + 1e-10, 6)::DOUBLE AS file_score FROM f),
fr AS (SELECT *, CAST(row_number() OVER (PARTITION BY ticket_id ORDER BY file_score DESC, kind_rank, span, chunk_id) AS INTEGER) AS rank FROM fs)"""

_VARIANTS = "list_concat([i], CASE WHEN ends_with(i, 's') AND length(i) > 4 THEN [regexp_replace(i, 's$', '')] ELSE [] END, CASE WHEN contains(i, '_') THEN list_filter(string_split(i, '_'), lambda p: length(p) >= 3) ELSE [] END, CASE WHEN contains(i, '.') THEN list_filter(string_split(i, '.'), lambda p: length(p) >= 3) ELSE [] END)"
_IDENT = f"""il AS (SELECT ticket_id, repo, base_commit, unnest(list_slice({SQL_IDS('bug_text')}, 1, {T.MAX_IDENTIFIERS})) AS i FROM asked),
iv AS (SELECT DISTINCT ticket_id, repo, base_commit, i, unnest({_VARIANTS}) AS term FROM il),
it AS (SELECT DISTINCT repo, base_commit, chunk_id, unnest(list_concat({sql_tokens('search_text')}, regexp_extract_all(lower(search_text), '[a-z0-9_]+(?:\\.[a-z0-9_]+)?'))) AS term FROM docs),
ih AS (SELECT ticket_id, repo, base_commit, chunk_id, count(DISTINCT i) AS n, max(regexp_matches(i, '^[a-z][0-9]{{2,4}}$')::INT) AS code FROM iv JOIN it USING (repo, base_commit, term) GROUP BY ALL),
ident AS (SELECT ticket_id, repo, base_commit, chunk_id, CASE WHEN code = 1 THEN 1.0 ELSE round(least(1.0, 0.5 + 0.1 * (n - 1)), 6) END::DOUBLE AS identifier FROM ih)"""

_KEYS = "ticket_id, repo, base_commit, chunk_id"
_WEIGHTED = f"""{_TFIDF}, {_TRACE}, {_LEX}, {_COMPONENT}, {_COMP}, {_PATH}, {_IDENT},
k AS (SELECT {_KEYS} FROM cos UNION SELECT {_KEYS} FROM tr UNION SELECT {_KEYS} FROM lex UNION SELECT {_KEYS} FROM comp UNION SELECT {_KEYS} FROM ident),
sig AS (SELECT ticket_id, repo, base_commit, chunk_id, d.file_path, d.kind_rank, d.span, d.symbol_name, d.start_line, d.end_line, coalesce(cosine, 0) AS cosine, coalesce(trace, 0) AS trace, coalesce(component, 0) AS component, coalesce(keyword, 0) AS keyword, coalesce(symbol, 0) AS symbol, coalesce(path, 0) AS path, coalesce(identifier, 0) AS identifier
  FROM k LEFT JOIN cos USING ({_KEYS}) LEFT JOIN tr USING ({_KEYS}) LEFT JOIN lex USING ({_KEYS}) LEFT JOIN comp USING ({_KEYS}) LEFT JOIN ident USING ({_KEYS})
  JOIN docs d USING (repo, base_commit, chunk_id) LEFT JOIN path USING (ticket_id, repo, base_commit, file_path)),
w AS (SELECT *, round(least(1.0, greatest(0.0, 0.5::DOUBLE * cosine + 0.3::DOUBLE * trace + 0.05::DOUBLE * component + 0.08::DOUBLE * keyword + 0.07::DOUBLE * symbol + 0.12::DOUBLE * path + 0.14::DOUBLE * identifier)), 8) AS score FROM sig)"""

ORACLE = {
    "doc_freq_idf": f"WITH {_CORPUS}, {_IDF} SELECT repo, base_commit, term, df, round(idf, 6) AS idf FROM idf",
    "tfidf_cosine": f"WITH {_TFIDF} SELECT ticket_id, chunk_id, cosine FROM cos",
    "tfidf_top20": _COS + " SELECT ticket_id, CAST(row_number() OVER (PARTITION BY ticket_id ORDER BY cosine DESC, kind_rank, span, chunk_id) AS INTEGER) AS rank, chunk_id, file_path, cosine FROM scored QUALIFY rank <= 20",
    "component_terms": f"WITH {_ASKED}, {_COMPONENT} SELECT ticket_id, term FROM ct",
    "trace_signal": f"WITH {_CORPUS}, {_TRACE} SELECT ticket_id, chunk_id, trace FROM tr",
    "keyword_signal": f"WITH {_CORPUS}, {_ASKED}, {_LEX} SELECT ticket_id, chunk_id, keyword, symbol FROM lex",
    "path_signal": f"WITH {_ASKED}, {_PATH} SELECT ticket_id, file_path, path FROM path",
    "weighted_signals": f"WITH {_WEIGHTED} SELECT ticket_id, CAST(row_number() OVER (PARTITION BY ticket_id ORDER BY score DESC, kind_rank, span, chunk_id) AS INTEGER) AS rank, chunk_id, cosine, trace, component, keyword, symbol, path, identifier, score FROM w QUALIFY rank <= 20",
    "best_chunk_per_file": _COS + " SELECT ticket_id, file_path, chunk_id, cosine FROM scored QUALIFY row_number() OVER (PARTITION BY ticket_id, file_path ORDER BY cosine DESC, kind_rank, span, chunk_id) = 1",
    "file_aggregation": _COS + f", {_FILES} SELECT ticket_id, rank, file_path, chunk_id, evidence, symbols, file_score FROM fr WHERE rank <= 20",
    "overlap_evidence": _COS + f", {_PICKED} SELECT ticket_id, file_path, x.chunk_id AS chunk_id, CAST(pick AS INTEGER) AS pick FROM (SELECT ticket_id, file_path, unnest(ps) AS x, generate_subscripts(ps, 1) AS pick FROM pp)",
    "file_modes": _COS + f""", {_FILES}, md AS (SELECT unnest(['basic', 'supporting-chunks', 'supporting-symbols']) AS mode, unnest([0, 1, 1]) AS c, unnest([0, 0, 1]) AS s), fm AS (SELECT mode, f.*, round(least(1.0, score + c * least(0.05, 0.0125 * greatest(0, evidence - 1)) + s * least(0.04, 0.01 * greatest(0, symbols - 1))) + 1e-10, 6)::DOUBLE AS file_score FROM f, md)
        SELECT mode, ticket_id, CAST(row_number() OVER (PARTITION BY mode, ticket_id ORDER BY file_score DESC, kind_rank, span, chunk_id) AS INTEGER) AS rank, file_path, file_score FROM fm QUALIFY rank <= 20""",
    "package_proximity": _COS + f""", {_FILES}, top AS (SELECT ticket_id, file_path, rank, list_filter(string_split(regexp_replace(file_path, '^[./]+', ''), '/'), lambda x: x <> '') AS parts FROM fr WHERE rank <= 50),
        e AS (SELECT ticket_id, file_path, rank, depth, array_to_string(list_slice(parts, 1, depth), '/') AS prefix FROM (SELECT *, unnest(range(1, len(parts))) AS depth FROM top WHERE len(parts) > 1)),
        p AS (SELECT a.ticket_id, a.file_path, a.depth, b.file_path AS neighbour FROM e a JOIN e b USING (ticket_id, depth, prefix) WHERE b.rank <= 30 AND a.file_path <> b.file_path)
        SELECT ticket_id, file_path, CAST(depth AS INTEGER) AS depth, neighbour FROM p QUALIFY row_number() OVER (PARTITION BY ticket_id, file_path ORDER BY depth DESC, neighbour DESC) = 1""",
    "hybrid_semantic": """WITH c AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS cosine FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
        SELECT query_id, vec_id, cosine, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS INTEGER) AS rank FROM c QUALIFY rank <= 10""",
}
