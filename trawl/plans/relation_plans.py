"""Queries of joins, graphs, intervals, windows, groupings, sampling and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.functions.keys import plain_repo, plain_snapshot, ticket_key
from trawl.operators import evaluation as E
from trawl.operators import relations as R
from trawl.plans.evaluation_plans import _FILES, _KEY, _N, _SYM
from trawl.plans.text_plans import SQL_IDS, SQL_TICKETS, _BUG, _bare, sql_distinct
from trawl.sources.tables import table


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks")


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    snap = plain_snapshot(table(spark, d, "tickets", "ticket_id", "repo", "base_commit")).filter("repo IS NOT NULL").distinct()
    return E.ranked_files(table(spark, d, "ranked_symbols"), "ranked").join(snap, "ticket_id")


def symbol_definitions(spark: SparkSession, d: str) -> DataFrame:
    return R.definitions(_chunks(spark, d))


def lookup_fallback(spark: SparkSession, d: str) -> DataFrame:
    return R.lookup_fallback(R.report_symbols(table(spark, d, "tickets")), R.lookup_keys(R.definitions(_chunks(spark, d))))


def call_edges(spark: SparkSession, d: str) -> DataFrame:
    return R.call_edges(_chunks(spark, d))


def transpose_edges(spark: SparkSession, d: str) -> DataFrame:
    return R.transposed(R.call_edges(_chunks(spark, d)))


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return R.adjacency(R.call_edges(_chunks(spark, d)))


def one_hop(spark: SparkSession, d: str) -> DataFrame:
    return R.one_hop(_ranked(spark, d), R.call_edges(_chunks(spark, d)))


def one_hop_hub_guard(spark: SparkSession, d: str) -> DataFrame:
    return R.one_hop(_ranked(spark, d), R.call_edges(_chunks(spark, d)), top=3, hub=2)


def longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    modules = _chunks(spark, d).select(T.module_parts(F.col("file_path")).alias("module"), "file_path").distinct()
    folder = modules.select(F.regexp_replace("module", r"\.[^.]*$", "").alias("module"), "file_path").distinct()
    return R.longest_prefix(modules.select("module").distinct(), folder)


def interval_innermost(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct line that a chunk starts at, in the shortest chunk that holds it."""
    rows = _chunks(spark, d).filter("start_line IS NOT NULL AND end_line IS NOT NULL").select(F.concat_ws(":", "repo", "base_commit", "file_path").alias("key"), F.col("chunk_id").alias("name"), F.least("start_line", "end_line").alias("start_line"), F.greatest("start_line", "end_line").alias("end_line")).distinct()
    return R.innermost(rows.select("key", F.col("start_line").alias("line")).distinct(), rows)


def nearest_band(spark: SparkSession, d: str) -> DataFrame:
    rows = R.definitions(_chunks(spark, d)).filter("start_line IS NOT NULL AND end_line IS NOT NULL").select(F.concat_ws(":", "repo", "base_commit", "file_path").alias("key"), F.concat_ws("/", "name", "kind").alias("name"), "start_line", "end_line")
    return R.nearest_disjoint(rows)


def gaps(spark: SparkSession, d: str) -> DataFrame:
    return R.gaps(_chunks(spark, d))


def line_windows(spark: SparkSession, d: str) -> DataFrame:
    return R.line_windows(table(spark, d, "source_files", "repo", "base_commit", "file_path", "content"))


def insertion_runs(spark: SparkSession, d: str) -> DataFrame:
    return R.insertion_runs(table(spark, d, "documents", "doc_id", "text"))


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    return E.symbol_ranks(table(spark, d, "ranked_symbols"))[1]


def quota_backfill(spark: SparkSession, d: str) -> DataFrame:
    return R.quota_backfill(_symbols(spark, d), 2, 10)


def within_group_rank(spark: SparkSession, d: str) -> DataFrame:
    """Of each symbol its place among the symbols of its file, in rank order."""
    w = Window.partitionBy("ticket_id", "file_path").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return _symbols(spark, d).select("ticket_id", "rank", "file_path", "name", F.count(F.lit(1)).over(w).alias("place"))


def margin(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("ticket_id").orderBy("rank")
    top = E.ranked_files(table(spark, d, "ranked_symbols"), "ranked")
    decay = F.greatest(F.lit(0.0), 1 - 0.08 * (F.col("rank") - 1))
    return top.select("ticket_id", "rank", F.round(F.greatest(F.lit(0.0), F.col("score") - F.lead("score").over(w)), 6).alias("margin"), F.round(decay, 6).alias("decay")).filter("rank <= 5")


def round_robin(spark: SparkSession, d: str) -> DataFrame:
    return R.round_robin(plain_snapshot(table(spark, d, "tickets", "repo", "ticket_id")).filter("repo IS NOT NULL"), "repo", "ticket_id", 100)


def stratified_hash_split(spark: SparkSession, d: str) -> DataFrame:
    return R.stratified(plain_snapshot(table(spark, d, "tickets", "repo", "ticket_id")).filter("repo IS NOT NULL"), "repo", "ticket_id", 3, 11)


def largest_remainder(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "documents", "doc_type").groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"))
    return R.largest_remainder(counts, "doc_type", "n", 101)


def size_groups_ntile(spark: SparkSession, d: str) -> DataFrame:
    return R.size_groups(_chunks(spark, d))


def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return R.fingerprints(table(spark, d, "source_files"))


def repository_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per repository tickets, commits and products, with the grand total, in one ROLLUP."""
    t = plain_snapshot(table(spark, d, "tickets", "ticket_id", "repo", "base_commit", "product")).distinct().withColumn("repo", F.coalesce("repo", F.lit("?")))
    return t.rollup("repo").agg(F.grouping("repo").alias("g"), F.count(F.lit(1)).alias("n"), F.count_distinct("ticket_id").alias("tickets"), F.count_distinct("base_commit").alias("commits")).select(F.when(F.col("g") == 1, "*").otherwise(F.col("repo")).alias("repo"), "n", "tickets", "commits")


def runtime_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sums and means of a measure by method, by group, by both and in total."""
    rows = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity")
    return rows.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"), F.round(F.avg("l_quantity"), 6).alias("mean")).select(F.coalesce("l_returnflag", F.lit("*")).alias("method"), F.coalesce("l_linestatus", F.lit("*")).alias("grp"), "n", "total", "mean")


def micro_macro(spark: SparkSession, d: str) -> DataFrame:
    """Mean score over rows, and mean of the tickets' means, per list."""
    rows = table(spark, d, "ranked_symbols", "ticket_id", "list_name", "score").filter("score >= 0 AND score <= 1 AND ticket_id IS NOT NULL")
    per = rows.groupBy("list_name", "ticket_id").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("list_name").agg(F.round(F.sum("s") / F.sum("n"), 6).alias("micro"), F.round(F.avg(F.col("s") / F.col("n")), 6).alias("macro"), F.min("n").alias("least"), F.max("n").alias("most"), F.median("n").alias("median"))


def crosstab(spark: SparkSession, d: str) -> DataFrame:
    kinds = ["module", "class", "function", "method"]
    g = table(spark, d, "symbol_gold", "mapping_method", "symbol_kind")
    return g.groupBy("mapping_method").pivot("symbol_kind", kinds).count().na.fill(0).select("mapping_method", *kinds)


def mapping_summary(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "symbol_gold", "mapping_status", "mapping_method", "exclusion_reason", "mapping_confidence", "repo")
    return g.groupBy("mapping_status", "mapping_method", F.coalesce("exclusion_reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("mapping_confidence"), 6).alias("confidence"), F.count_distinct(plain_repo(F.col("repo"))).alias("repos"))


def index_stats(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "parse_results", "repo", "base_commit", "file_path", "language", "status", "symbol_count")
    return p.groupBy(F.lower(F.trim("language")).alias("language"), F.lower(F.trim("status")).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("symbol_count").alias("symbols"), F.count_distinct(F.struct("repo", "base_commit", "file_path")).alias("files"))


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank percentiles of event values per type."""
    x = R.nearest_rank(table(spark, d, "events", "event_type", "value"), "event_type", "value", {"p50": 0.5, "p95": 0.95})
    return x.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "most")])


def variant_argmax(spark: SparkSession, d: str) -> DataFrame:
    """Per ticket the list with the highest mean score; ties go to more rows, then to the smaller name."""
    rows = table(spark, d, "ranked_symbols", "ticket_id", "list_name", "score").filter("score >= 0 AND score <= 1 AND ticket_id IS NOT NULL")
    per = rows.groupBy("ticket_id", "list_name").agg(F.round(F.avg("score"), 10).alias("mean"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("ticket_id").orderBy(F.desc("mean"), F.desc("n"), "list_name")
    return per.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def candidates_per_ticket(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "ranked_symbols", "ticket_id", "chunk_id").filter("ticket_id IS NOT NULL").groupBy("ticket_id").agg(F.count_distinct("chunk_id").alias("n"))
    size = F.when(F.col("n") < 20, "short").when(F.col("n") == 20, "exact").otherwise("long")
    return per.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("tickets"), F.min("n").alias("least"), F.max("n").alias("most"))


def audit_strata(spark: SparkSession, d: str) -> DataFrame:
    """Multi-label strata of gold rows: one row can be in several."""
    g = table(spark, d, "symbol_gold", "gold_id", "ticket_id", "file_path", "mapping_status", "mapping_confidence", "symbol_kind").distinct()
    files = g.groupBy("ticket_id").agg(F.count_distinct("file_path").alias("files"))
    rows = g.join(files, "ticket_id", "left")
    labels = F.array_compact(F.array(F.when(F.col("files") > 1, "multi_file"), F.when(F.col("mapping_status") == "excluded", "excluded"), F.when(F.col("mapping_confidence") < 0.6, "unsure"), F.when(F.col("symbol_kind") == "module", "module")))
    return rows.select("gold_id", F.explode(labels).alias("stratum")).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("gold_id").alias("golds"))


def anti_seen(spark: SparkSession, d: str) -> DataFrame:
    """Tickets that are in no training split and whose repository has no training ticket."""
    t = plain_snapshot(table(spark, d, "tickets", "ticket_id", "repo")).distinct()
    seen = table(spark, d, "ticket_outcomes", "ticket_id", "split_name").filter("lower(trim(split_name)) = 'train'").select("ticket_id").distinct()
    repos = t.join(seen, "ticket_id", "left_semi").select("repo").filter("repo IS NOT NULL").distinct()
    return t.join(seen, "ticket_id", "left_anti").join(repos, "repo", "left_anti").select("ticket_id", "repo")


def residual_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Gold rows whose ticket names another repository or commit."""
    t = table(spark, d, "tickets", "ticket_id", "repo", "base_commit").distinct().select(ticket_key(F.col("ticket_id")).alias("k"), plain_repo(F.col("repo")).alias("tr"), F.lower("base_commit").alias("tc"))
    g = table(spark, d, "symbol_gold", "gold_id", "ticket_id", "repo", "base_commit").distinct().select("gold_id", ticket_key(F.col("ticket_id")).alias("k"), plain_repo(F.col("repo")).alias("gr"), F.lower("base_commit").alias("gc"))
    return g.join(t, "k").select("gold_id", "k", (F.col("gr") != F.col("tr")).alias("other_repo"), (~F.col("tc").startswith(F.col("gc"))).alias("other_commit")).filter("other_repo OR other_commit").distinct()


def dim_join(spark: SparkSession, d: str) -> DataFrame:
    """Tickets by the size group of their repository; a missing group is its own row."""
    groups = R.size_groups(_chunks(spark, d))
    t = plain_snapshot(table(spark, d, "tickets", "ticket_id", "repo")).distinct().join(groups, "repo", "left")
    return t.groupBy(F.coalesce("size_group", F.lit("none")).alias("size_group")).agg(F.count(F.lit(1)).alias("tickets"), F.count_distinct("repo").alias("repos"))


def full_outer_compare(spark: SparkSession, d: str) -> DataFrame:
    """What became of each (ticket, file) between the first ten of two lists."""
    rows = table(spark, d, "ranked_symbols")
    a = E.ranked_files(rows, "retrieval").filter("rank <= 10").select("ticket_id", "file_path", F.lit(1).alias("a"))
    b = E.ranked_files(rows, "ranked").filter("rank <= 10").select("ticket_id", "file_path", F.lit(1).alias("b"))
    both = a.join(b, ["ticket_id", "file_path"], "full_outer")
    state = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "retained").when(F.col("b").isNotNull(), "recovered").otherwise("lost")
    return both.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def backfill_code(spark: SparkSession, d: str) -> DataFrame:
    """Code of each distinct ranked chunk, taken from the chunks where it is known."""
    ids = table(spark, d, "ranked_symbols", "chunk_id").distinct()
    code = _chunks(spark, d).groupBy("chunk_id").agg(F.max("code_text").alias("code"))
    return ids.join(code, "chunk_id", "left").select("chunk_id", F.coalesce(F.md5("code"), F.lit("")).alias("digest"))


def union_seen(spark: SparkSession, d: str) -> DataFrame:
    """Ids of three tables with the number of tables that have each."""
    ids = [table(spark, d, t, "ticket_id").select(ticket_key(F.col("ticket_id")).alias("k")).filter("k IS NOT NULL").distinct() for t in ("tickets", "ticket_outcomes", "symbol_gold")]
    return ids[0].unionByName(ids[1]).unionByName(ids[2]).groupBy("k").agg(F.count(F.lit(1)).alias("tables"))


def split_checks(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of every two splits, and how many tickets no split has."""
    o = table(spark, d, "ticket_outcomes", "ticket_id", "split_name").select("ticket_id", F.lower(F.trim("split_name")).alias("s")).filter("s IS NOT NULL").distinct()
    pairs = o.alias("a").join(o.alias("b"), "ticket_id").filter("a.s < b.s").groupBy(F.concat_ws("&", F.col("a.s"), F.col("b.s")).alias("check")).agg(F.count(F.lit(1)).alias("n"))
    lone = table(spark, d, "tickets", "ticket_id").distinct().join(o, "ticket_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unsplit").alias("check"), "n")
    sizes = o.groupBy(F.col("s").alias("check")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.union(lone).union(sizes)


def leakage_counts(spark: SparkSession, d: str) -> DataFrame:
    """Repositories that two splits share."""
    o = table(spark, d, "ticket_outcomes", "ticket_id", "split_name").select("ticket_id", F.lower(F.trim("split_name")).alias("s")).filter("s IS NOT NULL").distinct()
    r = o.join(plain_snapshot(table(spark, d, "tickets", "ticket_id", "repo")).filter("repo IS NOT NULL").distinct(), "ticket_id").select("s", "repo").distinct()
    return r.groupBy("repo").agg(F.count(F.lit(1)).alias("splits"), F.array_join(F.array_sort(F.collect_list("s")), ",").alias("names")).filter("splits > 1")


def priority_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Tickets by priority and by whether their gold rows touch more top-level folders than the median ticket."""
    g = table(spark, d, "symbol_gold", "ticket_id", "file_path").select(ticket_key(F.col("ticket_id")).alias("k"), F.split_part("file_path", F.lit("/"), F.lit(1)).alias("top")).filter("k IS NOT NULL").groupBy("k").agg(F.count_distinct("top").alias("tops"))
    limit = g.agg(F.floor(F.median("tops")).alias("limit"))
    t = table(spark, d, "tickets", "ticket_id", "priority").select(ticket_key(F.col("ticket_id")).alias("k"), F.coalesce(F.upper(F.trim("priority")), F.lit("?")).alias("priority")).distinct()
    rows = t.join(g, "k").crossJoin(F.broadcast(limit))  # one row
    return rows.groupBy("priority", (F.col("tops") > F.col("limit")).alias("wide")).agg(F.count(F.lit(1)).alias("tickets"))


def first_row_per_key(spark: SparkSession, d: str) -> DataFrame:
    """The latest report of each file; of equal times the larger status, then language."""
    p = table(spark, d, "parse_results", "repo", "base_commit", "file_path", "language", "status", "parsed_at")
    w = Window.partitionBy("repo", "base_commit", "file_path").orderBy(F.desc_nulls_last("parsed_at"), F.desc_nulls_last("status"), F.desc_nulls_last("language"))
    return p.withColumn("r", F.row_number().over(w)).filter("r = 1").select("repo", "base_commit", "file_path", F.lower(F.trim("status")).alias("status"))


QUERIES = {
    f.__name__: f
    for f in (
        symbol_definitions, lookup_fallback, call_edges, transpose_edges, adjacency, one_hop, one_hop_hub_guard, longest_prefix, interval_innermost, nearest_band, gaps, line_windows, insertion_runs, quota_backfill, within_group_rank, margin, round_robin,
        stratified_hash_split, largest_remainder, size_groups_ntile, fingerprint, repository_totals, runtime_grouping_sets, micro_macro, crosstab, mapping_summary, index_stats, latency_percentiles, variant_argmax, candidates_per_ticket, audit_strata, anti_seen,
        residual_consistency, dim_join, full_outer_compare, backfill_code, union_seen, split_checks, leakage_counts, priority_matrix, first_row_per_key,
    )
}

_TRIM = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_TK = f"CASE WHEN lower({_TRIM('ticket_id')}) NOT IN ('', '-', 'n/a', 'na', 'none', 'null', 'tbd', 'unknown', 'todo') THEN lower({_TRIM('ticket_id')}) END"
_PR = "nullif(regexp_extract(regexp_replace(regexp_replace(lower(regexp_replace(repo, '\\s+', '', 'g')), '/+$', ''), '\\.git$', ''), '([^/:@]+/[^/:@]+)$', 1), '')"
_DEFS = """defs AS (SELECT repo, base_commit, file_path, name, kind, min(a) AS start_line, max(b) AS end_line FROM (SELECT repo, base_commit, file_path, lower(concat_ws('.', nullif(class_name, ''), nullif(function_name, ''))) AS name, lower(trim(symbol_kind)) AS kind,
  CASE WHEN start_line IS NULL THEN end_line WHEN end_line IS NULL THEN start_line ELSE least(start_line, end_line) END AS a, CASE WHEN start_line IS NULL THEN end_line WHEN end_line IS NULL THEN start_line ELSE greatest(start_line, end_line) END AS b FROM chunks) WHERE name <> '' GROUP BY ALL)"""
_EDGES = """calls AS (SELECT DISTINCT repo, base_commit, file_path AS caller_file, unnest(regexp_extract_all(coalesce(code_text, ''), '([A-Za-z_][A-Za-z0-9_]*)\\(', 1)) AS call_name FROM chunks),
own AS (SELECT repo, base_commit, function_name AS call_name, min(file_path) AS target_file FROM chunks WHERE function_name <> '' GROUP BY ALL HAVING count(DISTINCT file_path) = 1),
edges AS (SELECT DISTINCT repo, base_commit, caller_file, target_file, call_name FROM calls JOIN own USING (repo, base_commit, call_name) WHERE caller_file <> target_file)"""
_HOP = lambda top, hub: f"""WITH {_FILES('ranked', 'a')}, snap AS (SELECT DISTINCT ticket_id, repo, base_commit FROM {SQL_TICKETS} WHERE repo IS NOT NULL), {_EDGES}, pr AS (SELECT DISTINCT repo, base_commit, caller_file, target_file FROM edges),
  sm AS (SELECT repo, base_commit, caller_file FROM pr GROUP BY ALL HAVING count(*) <= {hub}), h AS (SELECT ticket_id, target_file, max(0.9::DOUBLE * greatest(0.0, 1 - 0.08::DOUBLE * (rank - 1))) AS signal FROM a JOIN snap USING (ticket_id) JOIN pr ON pr.repo = snap.repo AND pr.base_commit = snap.base_commit AND pr.caller_file = a.file_path
  SEMI JOIN sm ON sm.repo = pr.repo AND sm.base_commit = pr.base_commit AND sm.caller_file = pr.caller_file WHERE rank <= {top} GROUP BY ALL) SELECT ticket_id, target_file, round(signal, 6) AS signal, round(0.08::DOUBLE * signal, 6) AS bonus FROM h"""  # noqa: E731
_MODULE = f"replace(regexp_replace({_N}, '\\.[A-Za-z0-9]+$', ''), '/', '.')"
_KEYED = "concat_ws(':', repo, base_commit, file_path)"
_SPLITS = "o AS (SELECT DISTINCT ticket_id, lower(trim(split_name)) AS s FROM ticket_outcomes WHERE split_name IS NOT NULL)"
_GROUPS = "pg AS (SELECT repo, base_commit, count(DISTINCT file_path) AS n FROM chunks GROUP BY ALL), rg AS (SELECT repo, median(n)::DOUBLE AS files, min(n) AS least, max(n) AS most FROM pg GROUP BY repo), sg AS (SELECT repo, files, least, most, ['small', 'medium', 'large'][ntile(3) OVER (ORDER BY files, repo)] AS size_group FROM rg)"

_NAME = "[A-Za-z_][A-Za-z0-9_]*(\\.[A-Za-z_][A-Za-z0-9_]*)*"
_LEAF = "split_part(k, '.', -1)"
#: The first 20 lookup keys of a report; look-arounds are replaced by steps that give the same names.
_NAMES = f"""raw AS (SELECT DISTINCT ticket_id, repo, base_commit, {_BUG} AS s FROM {SQL_TICKETS} WHERE repo IS NOT NULL),
        ex AS (SELECT ticket_id, repo, base_commit, list_concat(regexp_extract_all(regexp_replace(s, '``+', chr(10), 'g'), '`([^`\\n]+)`', 1), list_filter(regexp_extract_all(s, '([A-Za-z0-9_.]+)\\s*\\(', 1), lambda x: regexp_full_match(x, '{_NAME}')), list_slice({SQL_IDS('s')}, 1, {T.MAX_IDENTIFIERS})) AS xs FROM raw),
        ky AS (SELECT ticket_id, repo, base_commit, list_filter(list_transform(list_filter(list_transform(xs, lambda x: {_bare('x')}), lambda x: regexp_full_match(x, '{_NAME}')), lambda x: {_KEY.replace('symbol_qualified_name', 'x')}), lambda k: length({_LEAF}) >= 3 AND {_LEAF} NOT IN ({', '.join(repr(w) for w in [*T.STOP_WORDS, *T.NO_NAMES])})) AS ks FROM ex),
        names AS (SELECT DISTINCT ticket_id, repo, base_commit, unnest(list_slice({sql_distinct('ks')}, 1, {T.MAX_NAMES})) AS symbol FROM ky)"""

ORACLE = {
    "symbol_definitions": f"WITH {_DEFS} SELECT * FROM defs",
    "lookup_fallback": f"""WITH {_DEFS}, keys AS (SELECT DISTINCT repo, base_commit, unnest([name, split_part(name, '.', -1)]) AS lookup_key, file_path FROM defs),
        {_NAMES},
        first AS (SELECT DISTINCT ticket_id, repo, base_commit, symbol, file_path, 0.06::DOUBLE AS bonus FROM names n JOIN keys k USING (repo, base_commit) WHERE k.lookup_key = n.symbol),
        second AS (SELECT DISTINCT ticket_id, repo, base_commit, symbol, file_path, 0.04::DOUBLE AS bonus FROM (SELECT * FROM names ANTI JOIN first USING (ticket_id, repo, base_commit, symbol)) n JOIN keys k USING (repo, base_commit) WHERE contains(symbol, '.') AND k.lookup_key = split_part(n.symbol, '.', -1)),
        b AS (SELECT * FROM first UNION ALL SELECT * FROM second), s AS (SELECT ticket_id, repo, base_commit, symbol FROM b GROUP BY ALL HAVING count(DISTINCT file_path) <= 4)
        SELECT ticket_id, file_path, round(least(0.10, sum(bonus)), 6)::DOUBLE AS bonus, count(*) AS evidence FROM b SEMI JOIN s USING (ticket_id, repo, base_commit, symbol) GROUP BY ALL""",
    "call_edges": f"WITH {_EDGES} SELECT * FROM edges",
    "transpose_edges": f"WITH {_EDGES} SELECT repo, base_commit, file_path, CAST(sum(i) AS BIGINT) AS incoming, CAST(sum(o) AS BIGINT) AS outgoing FROM (SELECT repo, base_commit, caller_file AS file_path, 1 AS o, 0 AS i FROM edges UNION ALL SELECT repo, base_commit, target_file, 0, 1 FROM edges) GROUP BY ALL",
    "adjacency": f"WITH {_EDGES}, b AS (SELECT repo, base_commit, caller_file AS file_path, target_file AS peer FROM edges UNION SELECT repo, base_commit, target_file, caller_file FROM edges) SELECT repo, base_commit, file_path, count(*) AS degree, array_to_string(list_slice(list_sort(list(peer)), 1, 5), ',') AS peers FROM b GROUP BY ALL",
    "one_hop": _HOP(5, 8),
    "one_hop_hub_guard": _HOP(3, 2),
    "longest_prefix": f"""WITH m AS (SELECT DISTINCT {_MODULE} AS module, file_path FROM chunks), f AS (SELECT DISTINCT regexp_replace(module, '\\.[^.]*$', '') AS prefix, file_path FROM m),
        e AS (SELECT DISTINCT module, parts, array_to_string(list_slice(string_split(module, '.'), 1, parts), '.') AS prefix FROM (SELECT module, unnest(range(1, len(string_split(module, '.')) + 1)) AS parts FROM m))
        SELECT module, file_path, parts FROM (SELECT DISTINCT module, file_path, CAST(parts AS INTEGER) AS parts FROM e JOIN f USING (prefix) QUALIFY parts = max(parts) OVER (PARTITION BY module)) QUALIFY row_number() OVER (PARTITION BY module ORDER BY file_path) <= 4""",
    "interval_innermost": f"""WITH r AS (SELECT DISTINCT {_KEYED} AS key, chunk_id AS name, least(start_line, end_line) AS s, greatest(start_line, end_line) AS e FROM chunks WHERE start_line IS NOT NULL AND end_line IS NOT NULL), p AS (SELECT DISTINCT key, s AS line FROM r),
        h AS (SELECT p.key, line, name, rank() OVER (PARTITION BY p.key, line ORDER BY e - s) AS r FROM p JOIN r ON r.key = p.key AND line BETWEEN s AND e) SELECT key, line, min(name) AS name, count(*) AS ties FROM h WHERE r = 1 GROUP BY ALL""",
    "nearest_band": f"""WITH {_DEFS}, r AS (SELECT {_KEYED} AS key, concat_ws('/', name, kind) AS name, start_line AS s, end_line AS e FROM defs WHERE start_line IS NOT NULL AND end_line IS NOT NULL),
        p AS (SELECT a.key, a.name, a.s, b.name AS neighbour, greatest(b.s - a.e, a.s - b.e) AS gap FROM r a JOIN r b ON a.key = b.key WHERE greatest(b.s - a.e, a.s - b.e) BETWEEN 1 AND 100)
        SELECT key, name, start_line, x.gap AS gap, x.neighbour AS neighbour FROM (SELECT key, name, s AS start_line, min({{'gap': gap, 'neighbour': neighbour}}) AS x FROM p GROUP BY ALL)""",
    "gaps": """WITH s AS (SELECT DISTINCT repo, base_commit, file_path, least(start_line, end_line) AS s, greatest(start_line, end_line) AS e FROM chunks WHERE start_line IS NOT NULL AND end_line IS NOT NULL AND (function_name <> '' OR class_name <> '')),
        t AS (SELECT *, coalesce(max(e) OVER (PARTITION BY repo, base_commit, file_path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM s) SELECT repo, base_commit, file_path, top + 1 AS gap_start, s - 1 AS gap_end FROM t WHERE s > top + 1""",
    "line_windows": """WITH f AS (SELECT repo, base_commit, file_path, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM source_files WHERE content IS NOT NULL), w AS (SELECT *, unnest(range(0, greatest(0, CAST(ceil((len(l) - 80) / 60) AS INTEGER)) + 1)) AS i FROM f)
        SELECT DISTINCT repo, base_commit, file_path, CAST(i * 60 + 1 AS INTEGER) AS start_line, CAST(least(len(l), i * 60 + 80) AS INTEGER) AS end_line, md5(array_to_string(list_slice(l, i * 60 + 1, i * 60 + 80), chr(10))) AS digest FROM w""",
    "insertion_runs": """WITH l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS ln FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
        m AS (SELECT doc_id, ln, CASE WHEN starts_with(line, '+') AND NOT starts_with(line, '+++ ') THEN 1 WHEN starts_with(line, '-') AND NOT starts_with(line, '--- ') THEN 2 ELSE 0 END AS m FROM l), b AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY doc_id ORDER BY ln), 0) AS p FROM m)
        SELECT doc_id, count(CASE WHEN m = 1 AND p <> 1 THEN 1 END) AS runs, count(CASE WHEN m = 1 THEN 1 END) AS added, count(CASE WHEN m = 2 THEN 1 END) AS removed FROM b GROUP BY doc_id""",
    "quota_backfill": _SYM + ", q AS (SELECT *, (row_number() OVER (PARTITION BY ticket_id, file_path ORDER BY rank) > 2)::INT AS late FROM ps) SELECT ticket_id, CAST(row_number() OVER (PARTITION BY ticket_id ORDER BY late, rank) AS INTEGER) AS place, file_path, name, kind FROM q QUALIFY place <= 10",
    "within_group_rank": _SYM + " SELECT ticket_id, CAST(rank AS INTEGER) AS rank, file_path, name, count(*) OVER (PARTITION BY ticket_id, file_path ORDER BY rank ROWS UNBOUNDED PRECEDING) AS place FROM ps",
    "margin": f"WITH {_FILES('ranked', 'a')}, l AS (SELECT ticket_id, rank, score - lead(score) OVER (PARTITION BY ticket_id ORDER BY rank) AS m FROM a) SELECT ticket_id, rank, round(greatest(0.0, m), 6) AS margin, round(greatest(0.0, 1 - 0.08::DOUBLE * (rank - 1)), 6) AS decay FROM l WHERE rank <= 5",
    "round_robin": f"WITH t AS (SELECT DISTINCT repo, ticket_id FROM {SQL_TICKETS} WHERE repo IS NOT NULL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY ticket_id) AS INTEGER) AS turn FROM t) SELECT repo, ticket_id, turn FROM r ORDER BY turn, repo LIMIT 100",
    "stratified_hash_split": f"SELECT repo, ticket_id, CAST(row_number() OVER (PARTITION BY repo ORDER BY sha256('11:' || ticket_id)) AS INTEGER) AS place FROM (SELECT DISTINCT repo, ticket_id FROM {SQL_TICKETS} WHERE repo IS NOT NULL) QUALIFY place <= 3",
    "largest_remainder": "WITH c AS (SELECT doc_type, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT *, n * 101 / (SELECT sum(n) FROM c) AS raw FROM c), b AS (SELECT *, floor(raw) AS base FROM r), p AS (SELECT *, 101 - sum(base) OVER () AS rest, row_number() OVER (ORDER BY round(raw - base, 9) DESC, n DESC, doc_type DESC) AS place FROM b) SELECT doc_type, n, CAST(base + (place <= rest)::INT AS BIGINT) AS seats FROM p",
    "size_groups_ntile": f"WITH {_GROUPS} SELECT * FROM sg",
    "fingerprint": "WITH e AS (SELECT repo, base_commit, file_path, max(sha256(content)) AS h FROM source_files WHERE content IS NOT NULL GROUP BY ALL), p AS (SELECT repo, base_commit, substr(md5(file_path), 1, 2) AS b, count(*) AS n, sha256(array_to_string(list_sort(list(concat_ws(':', file_path, h))), chr(10))) AS d FROM e GROUP BY ALL) SELECT repo, base_commit, CAST(sum(n) AS BIGINT) AS files, sha256(array_to_string(list_sort(list(concat_ws(':', b, d))), chr(10))) AS fingerprint FROM p GROUP BY ALL",
    "repository_totals": f"WITH t AS (SELECT DISTINCT ticket_id, coalesce(repo, '?') AS repo, base_commit, product FROM {SQL_TICKETS}) SELECT repo, count(*) AS n, count(DISTINCT ticket_id) AS tickets, count(DISTINCT base_commit) AS commits FROM t GROUP BY repo UNION ALL SELECT '*', count(*), count(DISTINCT ticket_id), count(DISTINCT base_commit) FROM t",
    "runtime_grouping_sets": "SELECT coalesce(l_returnflag, '*') AS method, coalesce(l_linestatus, '*') AS grp, count(*) AS n, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "micro_macro": "WITH p AS (SELECT list_name, ticket_id, sum(score) AS s, count(*) AS n FROM ranked_symbols WHERE NOT isnan(score) AND score BETWEEN 0 AND 1 AND ticket_id IS NOT NULL GROUP BY ALL) SELECT list_name, round(sum(s) / sum(n), 6) AS micro, round(avg(s / n), 6) AS macro, min(n) AS least, max(n) AS most, median(n)::DOUBLE AS median FROM p GROUP BY list_name",
    "crosstab": "SELECT mapping_method, " + ", ".join(f"count(CASE WHEN symbol_kind = '{k}' THEN 1 END) AS \"{k}\"" for k in ("module", "class", "function", "method")) + " FROM symbol_gold GROUP BY mapping_method",
    "mapping_summary": f"SELECT mapping_status, mapping_method, coalesce(exclusion_reason, '') AS reason, count(*) AS n, round(avg(mapping_confidence), 6) AS confidence, count(DISTINCT {_PR}) AS repos FROM symbol_gold GROUP BY ALL",
    "index_stats": "SELECT lower(trim(language)) AS language, lower(trim(status)) AS status, count(*) AS n, CAST(sum(symbol_count) AS BIGINT) AS symbols, count(DISTINCT {'r': repo, 'b': base_commit, 'f': file_path}) AS files FROM parse_results GROUP BY ALL",
    "latency_percentiles": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(n) AS n, round(max(CASE WHEN r = ceil(0.5 * n) THEN value END), 6) AS p50, round(max(CASE WHEN r = ceil(0.95 * n) THEN value END), 6) AS p95, round(max(value), 6) AS most FROM r GROUP BY event_type",
    "variant_argmax": "WITH p AS (SELECT ticket_id, list_name, round(avg(score), 10) AS mean, count(*) AS n FROM ranked_symbols WHERE NOT isnan(score) AND score BETWEEN 0 AND 1 AND ticket_id IS NOT NULL GROUP BY ALL) SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY mean DESC, n DESC, list_name) = 1",
    "candidates_per_ticket": "WITH p AS (SELECT ticket_id, count(DISTINCT chunk_id) AS n FROM ranked_symbols WHERE ticket_id IS NOT NULL GROUP BY 1) SELECT CASE WHEN n < 20 THEN 'short' WHEN n = 20 THEN 'exact' ELSE 'long' END AS size, count(*) AS tickets, min(n) AS least, max(n) AS most FROM p GROUP BY 1",
    "audit_strata": """WITH g AS (SELECT DISTINCT gold_id, ticket_id, file_path, mapping_status, mapping_confidence, symbol_kind FROM symbol_gold), f AS (SELECT ticket_id, count(DISTINCT file_path) AS files FROM g GROUP BY 1),
        s AS (SELECT gold_id, unnest(list_filter([CASE WHEN files > 1 THEN 'multi_file' END, CASE WHEN mapping_status = 'excluded' THEN 'excluded' END, CASE WHEN mapping_confidence < 0.6 THEN 'unsure' END, CASE WHEN symbol_kind = 'module' THEN 'module' END], lambda x: x IS NOT NULL)) AS stratum FROM g LEFT JOIN f USING (ticket_id)) SELECT stratum, count(*) AS n, count(DISTINCT gold_id) AS golds FROM s GROUP BY 1""",
    "anti_seen": f"WITH t AS (SELECT DISTINCT ticket_id, repo FROM {SQL_TICKETS}), s AS (SELECT DISTINCT ticket_id FROM ticket_outcomes WHERE lower(trim(split_name)) = 'train'), r AS (SELECT DISTINCT repo FROM t SEMI JOIN s USING (ticket_id) WHERE repo IS NOT NULL) SELECT ticket_id, repo FROM t ANTI JOIN s USING (ticket_id) ANTI JOIN r USING (repo)",
    "residual_consistency": f"WITH t AS (SELECT DISTINCT {_TK} AS k, {_PR} AS tr, lower(base_commit) AS tc FROM tickets), g AS (SELECT DISTINCT gold_id, {_TK} AS k, {_PR} AS gr, lower(base_commit) AS gc FROM symbol_gold) SELECT DISTINCT gold_id, k, gr <> tr AS other_repo, NOT starts_with(tc, gc) AS other_commit FROM g JOIN t USING (k) WHERE gr <> tr OR NOT starts_with(tc, gc)",
    "dim_join": f"WITH {_GROUPS} SELECT coalesce(size_group, 'none') AS size_group, count(*) AS tickets, count(DISTINCT t.repo) AS repos FROM (SELECT DISTINCT ticket_id, repo FROM {SQL_TICKETS}) t LEFT JOIN sg USING (repo) GROUP BY 1",
    "full_outer_compare": f"WITH {_FILES('retrieval', 'a')}, {_FILES('ranked', 'b')}, x AS (SELECT ticket_id, file_path, 1 AS a FROM a WHERE rank <= 10), y AS (SELECT ticket_id, file_path, 1 AS b FROM b WHERE rank <= 10) SELECT CASE WHEN x.a IS NOT NULL AND y.b IS NOT NULL THEN 'retained' WHEN y.b IS NOT NULL THEN 'recovered' ELSE 'lost' END AS state, count(*) AS n FROM x FULL JOIN y USING (ticket_id, file_path) GROUP BY 1",
    "backfill_code": "SELECT chunk_id, coalesce(md5(code), '') AS digest FROM (SELECT DISTINCT chunk_id FROM ranked_symbols) LEFT JOIN (SELECT chunk_id, max(code_text) AS code FROM chunks GROUP BY 1) USING (chunk_id)",
    "union_seen": "SELECT k, count(*) AS tables FROM (" + " UNION ALL ".join(f"SELECT DISTINCT {_TK} AS k FROM {t}" for t in ("tickets", "ticket_outcomes", "symbol_gold")) + ") WHERE k IS NOT NULL GROUP BY k",
    "split_checks": f"WITH {_SPLITS} SELECT a.s || '&' || b.s AS \"check\", count(*) AS n FROM o a JOIN o b USING (ticket_id) WHERE a.s < b.s GROUP BY 1 UNION ALL SELECT 'unsplit', count(*) FROM (SELECT DISTINCT ticket_id FROM tickets) ANTI JOIN o USING (ticket_id) UNION ALL SELECT s, count(*) FROM o GROUP BY s",
    "leakage_counts": f"WITH {_SPLITS}, r AS (SELECT DISTINCT s, repo FROM o JOIN (SELECT DISTINCT ticket_id, repo FROM {SQL_TICKETS} WHERE repo IS NOT NULL) USING (ticket_id)) SELECT repo, count(*) AS splits, array_to_string(list_sort(list(s)), ',') AS names FROM r GROUP BY repo HAVING count(*) > 1",
    "priority_matrix": f"WITH g AS (SELECT k, count(DISTINCT top) AS tops FROM (SELECT {_TK} AS k, split_part(file_path, '/', 1) AS top FROM symbol_gold) WHERE k IS NOT NULL GROUP BY 1), t AS (SELECT DISTINCT {_TK} AS k, coalesce(upper(trim(priority)), '?') AS priority FROM tickets) SELECT priority, tops > (SELECT floor(median(tops)) FROM g) AS wide, count(*) AS tickets FROM t JOIN g USING (k) GROUP BY ALL",
    "first_row_per_key": "SELECT repo, base_commit, file_path, lower(trim(status)) AS status FROM parse_results QUALIFY row_number() OVER (PARTITION BY repo, base_commit, file_path ORDER BY parsed_at DESC NULLS LAST, status DESC NULLS LAST, language DESC NULLS LAST) = 1",
}
