"""Queries of comparisons between methods, coverage, contracts and audits: what a frozen evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.functions.keys import plain_repo, plain_snapshot
from trawl.operators import evaluation as E
from trawl.operators import relations as R
from trawl.operators import retrieval as RT
from trawl.operators import selection as SL
from trawl.plans.evaluation_plans import _AB, _FILES, _GOLD, _N, _SYM
from trawl.plans.relation_plans import _DEFS, _EDGES, _NAMES
from trawl.plans.retrieval_plans import _COS
from trawl.plans.retrieval_plans import _FILES as _AGG
from trawl.plans.retrieval_plans import _WEIGHTED
from trawl.plans.text_plans import SQL_REPO, SQL_TICKETS, _STOP, sql_tokens
from trawl.sources.tables import table
from trawl.storage import cut


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ranked_symbols", "ticket_id", "list_name", "rank", "file_path", "symbol_qualified_name", "symbol_kind", "score", "chunk_id")


def _metrics(spark: SparkSession, d: str, name: str) -> DataFrame:
    rows = _rows(spark, d)
    return E.ticket_metrics(E.gold_files(rows), E.ranked_files(rows, name))


def _symbols(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Exact and relaxed first ranks of gold symbols under one list."""
    rows = _rows(spark, d).withColumn("list_name", F.when(F.col("list_name") == name, "ranked").when(F.col("list_name") == "candidate", "candidate"))
    return E.symbol_matches(*E.symbol_ranks(rows))


def oracle_blocker(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent loss that is no hit; of equal counts the larger name."""
    rows = _rows(spark, d)
    gold, predicted = E.symbol_ranks(rows)
    x = E.loss(E.symbol_matches(gold, predicted), E.ranked_files(rows, "ranked"), predicted).filter("label <> 'found'")
    return x.agg(F.max(F.struct("n", "label")).alias("x")).select(F.coalesce("x.label", F.lit("none")).alias("blocker"), F.coalesce("x.n", F.lit(0)).cast("bigint").alias("n"))


def repository_lists(spark: SparkSession, d: str) -> DataFrame:
    """Per repository how many tickets and commits it has, its versions in order, and how many spellings name it (more than one is a conflict)."""
    t = table(spark, d, "tickets", "ticket_id", "repo", "base_commit", "version").withColumn("spelled", F.col("repo")).withColumn("repo", plain_repo(F.col("repo"))).filter("repo IS NOT NULL").distinct()
    x = t.groupBy("repo").agg(F.count_distinct("ticket_id").alias("tickets"), F.count_distinct(F.lower("base_commit")).alias("commits"), F.array_join(F.array_sort(F.collect_set("version")), ",").alias("versions"), F.count_distinct("spelled").alias("spellings"))
    return x.withColumn("conflict", F.col("spellings") > 1)


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per snapshot calls, distinct file pairs, callers, targets and the largest number of targets of one file."""
    e = R.call_edges(table(spark, d, "chunks"))
    out = e.groupBy("repo", "base_commit", "caller_file").agg(F.count(F.lit(1)).alias("c"), F.count_distinct("target_file").alias("t"))
    a = out.groupBy("repo", "base_commit").agg(F.sum("c").alias("calls"), F.sum("t").alias("pairs"), F.count(F.lit(1)).alias("callers"), F.max("t").alias("widest"))
    b = e.groupBy("repo", "base_commit").agg(F.count_distinct("target_file").alias("targets"))
    return a.join(b, ["repo", "base_commit"]).select("repo", "base_commit", "calls", "pairs", "callers", "targets", "widest")


def variant_choice(spark: SparkSession, d: str) -> DataFrame:
    """The list to use: the control (retrieval), unless the best other one has a strictly higher recall; others are compared by recall, reciprocal rank and name."""
    rows = _rows(spark, d)
    gold = E.gold_files(rows)
    parts = [E.summary(E.ticket_metrics(gold, E.ranked_files(rows, n))).select(F.lit(n).alias("variant"), "recall", "rr") for n in ("retrieval", "ranked", "candidate")]
    x = parts[0].union(parts[1]).union(parts[2])
    best = x.filter("variant <> 'retrieval'").agg(F.max(F.struct("recall", "rr", "variant")).alias("b"))
    control = x.filter("variant = 'retrieval'").select("recall")
    one = control.crossJoin(F.broadcast(best))  # one row each
    return one.select(F.when(F.col("b.recall") > F.col("recall"), F.col("b.variant")).otherwise("retrieval").alias("chosen"), F.round("recall", 6).alias("control_recall"), F.round("b.recall", 6).alias("best_recall"))


def review_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per split: eligible tickets, valid reviews among all, among eligible and among eligible with an own list, and fallbacks."""
    o = table(spark, d, "ticket_outcomes", "ticket_id", "split_name", "eligible", "llm_valid", "fallback_reason", "baseline_top", "evaluated_at")
    one = o.groupBy("ticket_id").agg(F.max(F.struct("evaluated_at", "eligible", "llm_valid", "fallback_reason", F.lower(F.trim("split_name")).alias("split"), (F.size(F.coalesce("baseline_top", F.array().cast("array<string>"))) > 0).alias("own"))).alias("x")).select("x.*")
    n = lambda c: F.count(F.when(c, 1))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(n(a), n(b)), F.lit(0.0)), 6)
    ok, el, own = F.coalesce("llm_valid", F.lit(False)), F.coalesce("eligible", F.lit(False)), F.col("own")
    return one.groupBy(F.coalesce("split", F.lit("none")).alias("split")).agg(F.count(F.lit(1)).alias("tickets"), n(el).alias("eligible"), n(el & own).alias("conditional"), rate(ok, F.lit(True)).alias("valid_of_all"), rate(ok & el, el).alias("valid_of_eligible"), rate(ok & el & own, el & own).alias("valid_of_conditional"), n(F.coalesce(F.nullif("fallback_reason", F.lit("")), F.lit("none")) != "none").alias("fallbacks"))


def outcome_transitions(spark: SparkSession, d: str) -> DataFrame:
    """What became of each gold symbol's hit among the first ten between two lists: retained, recovered, lost or still missed."""
    keys = ["ticket_id", "file_path", "name", "kind"]
    a = _symbols(spark, d, "retrieval").select(*keys, F.coalesce(F.col("exact_rank") <= 10, F.lit(False)).alias("a"))
    b = _symbols(spark, d, "ranked").select(*keys, F.coalesce(F.col("exact_rank") <= 10, F.lit(False)).alias("b"))
    state = F.when(F.col("a") & F.col("b"), "retained").when(F.col("b"), "recovered").when(F.col("a"), "lost").otherwise("still_missed")
    return a.join(b, keys, "full_outer").groupBy("kind", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def symbol_suffix_match(spark: SparkSession, d: str) -> DataFrame:
    """First rank of a symbol that equals a gold symbol or is its tail at a dot, or the reverse. Both imply the same last name, which is the join key."""
    gold, predicted = E.symbol_ranks(_rows(spark, d))
    leaf = F.substring_index("name", ".", -1)
    g = gold.select("ticket_id", F.col("name").alias("gold"), leaf.alias("leaf")).filter("gold <> ''").distinct()
    p = predicted.select("ticket_id", "name", leaf.alias("leaf"), "rank").filter("name <> ''")
    tail = lambda a, b: F.col(a).endswith(F.concat(F.lit("."), F.col(b)))
    hits = g.join(p, ["ticket_id", "leaf"]).filter((F.col("gold") == F.col("name")) | tail("gold", "name") | tail("name", "gold"))
    return hits.groupBy("ticket_id", "gold").agg(F.min("rank").alias("rank"))


def paired_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Tickets by what happened to their symbol hits at 1, 3 and 5 between two lists, with the mean difference of recall."""
    at = lambda m, k: m.groupBy("ticket_id").agg(F.max(F.coalesce((F.col("exact_rank") <= k).cast("int"), F.lit(0))).alias("hit"), F.avg(F.coalesce((F.col("exact_rank") <= k).cast("int"), F.lit(0))).alias("recall"))
    a, b = _symbols(spark, d, "retrieval"), _symbols(spark, d, "ranked")
    out = None
    for k in E.KS:
        both = at(a, k).select("ticket_id", F.col("hit").alias("h0"), F.col("recall").alias("r0")).join(at(b, k).select("ticket_id", F.col("hit").alias("h1"), F.col("recall").alias("r1")), "ticket_id")
        bucket = F.when((F.col("h0") == 0) & (F.col("h1") == 0), "both_miss").when(F.col("h1") > F.col("h0"), "improved").when(F.col("h1") < F.col("h0"), "worsened").otherwise("unchanged")
        part = both.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("tickets"), F.round(F.avg(F.col("r1") - F.col("r0")), 6).alias("recall_delta")).select(F.lit(k).alias("k"), "bucket", "tickets", "recall_delta")
        out = part if out is None else out.union(part)
    return out


def symbol_conditional(spark: SparkSession, d: str) -> DataFrame:
    """Symbol metrics over all tickets, over those with a gold file among the first five files, and of the control; with the rows that no evaluation can use."""
    rows = _rows(spark, d)
    m = _symbols(spark, d, "ranked")
    reach = SL.eligible(E.gold_files(rows), E.ranked_files(rows, "ranked"))
    invalid = rows.filter("list_name = 'ranked'").agg(F.count(F.when(F.col("ticket_id").isNull() | F.col("score").isNull() | ~((F.col("score") >= 0) & (F.col("score") <= 1)), 1)).alias("invalid"))
    part = lambda x, n: E.symbol_metrics(x).select(F.lit(n).alias("population"), "tickets", "exact_hit1", "exact_hit5", "exact_recall10")
    out = part(m, "all").union(part(m.join(reach, "ticket_id", "left_semi"), "conditional")).union(part(_symbols(spark, d, "retrieval"), "control"))
    return out.crossJoin(F.broadcast(invalid))  # one row


def compare_warnings(spark: SparkSession, d: str) -> DataFrame:
    """What two methods cannot be compared on: tickets that only one has, and tickets without a list in both, which are not evaluated."""
    rows = _rows(spark, d)
    gold = E.gold_files(rows).select("ticket_id").distinct()
    has = lambda n: E.ranked_files(rows, n).select("ticket_id").distinct()
    x = gold.join(has("retrieval").withColumn("a", F.lit(1)), "ticket_id", "left").join(has("ranked").withColumn("b", F.lit(1)), "ticket_id", "left")
    n = lambda c: F.count(F.when(c, 1))
    counts = x.agg(F.count(F.lit(1)).alias("gold"), n(F.col("a").isNotNull()).alias("baseline"), n(F.col("b").isNotNull()).alias("method"), n(F.col("a").isNull() & F.col("b").isNull()).alias("not_evaluated"))
    return counts.withColumn("denominators_differ", F.col("baseline") != F.col("method"))


def audit_gates(spark: SparkSession, d: str) -> DataFrame:
    """The gates of an audit over mapped gold rows: enough rows and repositories, provenance of every row, and the share of rows mapped by an exact method; all together decide."""
    g = table(spark, d, "symbol_gold", "gold_id", "repo", "base_commit", "file_path", "symbol_id", "mapping_status", "mapping_confidence").filter("mapping_status = 'mapped'").withColumn("repo", plain_repo(F.col("repo"))).distinct()
    a = g.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("repo").alias("repos"), F.count(F.when(F.col("file_path").isNull() | F.col("base_commit").isNull() | F.col("repo").isNull(), 1)).alias("lacking"), F.coalesce(F.avg((F.col("mapping_confidence") >= 0.95).cast("int")), F.lit(0.0)).alias("sure"))
    checks = F.array(*[F.struct(F.lit(n).alias("gate"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in (("sample", F.col("n") >= 100), ("repositories", F.col("repos") >= 8), ("provenance", F.col("lacking") == 0), ("exact_rate", F.col("sure") >= 0.95))])
    each = a.select(F.explode(checks).alias("x")).select("x.*")
    return each.union(each.agg(F.min(F.col("passed").cast("int")).alias("m")).select(F.lit("overall"), F.col("m") == 1))


def symbol_rank_b0(spark: SparkSession, d: str) -> DataFrame:
    """The lexical symbol ranking: the first 30 chunks of a pool kind by text alone."""
    scored = RT.tfidf_rows(table(spark, d, "tickets"), table(spark, d, "chunks")).filter("symbol_name <> ''")
    return RT.ranked(scored, "cosine", 30).select("ticket_id", "rank", "chunk_id", "cosine")


def dataset_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a dataset as ticket rows: title from the first line of text, missing values as empty text, listed tests kept as a list."""
    t = table(spark, d, "tickets", "ticket_id", "description", "repo", "base_commit", "version", "fail_to_pass").distinct()
    lines = F.filter(F.transform(F.split(F.replace(F.coalesce("description", F.lit("")), F.lit("\r"), F.lit("\n")), "\n"), F.trim), lambda x: x != "")
    none = F.array().cast("array<string>")
    text = lambda c: F.coalesce(c, F.lit(""))
    return t.select("ticket_id", F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")).alias("title"), text(plain_repo(F.col("repo"))).alias("repo"), text(F.col("base_commit")).alias("base_commit"), text(F.col("version")).alias("version"), F.size(F.coalesce("fail_to_pass", none)).alias("tests")).distinct()


def lookup_guarded(spark: SparkSession, d: str) -> DataFrame:
    """Lookups of a report's names whose leaves are asked only for telling names."""
    return R.lookup_fallback(R.report_symbols(table(spark, d, "tickets")), R.lookup_keys(R.definitions(table(spark, d, "chunks"))), policy="guarded")


def package_boost(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 files of every ticket after evidence of a shared folder with a strong file has raised their scores."""
    tickets = table(spark, d, "tickets")
    filed = RT.files_with_chunks(RT.weighted(tickets, table(spark, d, "chunks")), "identifier", "path").filter(F.col("rank") <= 50)
    best = F.col("xs")[0]
    files = cut(filed.select("ticket_id", "chunk_id", "rank", "file_path", "evidence", "symbols", "file_score", "kind_rank", "span", best["identifier"].alias("identifier"), best["path"].alias("path")), "files", compression="zstd")
    return RT.package_boosted(files, RT.reports(tickets), 20)


QUERIES = {
    f.__name__: f
    for f in (oracle_blocker, repository_lists, graph_stats, variant_choice, review_rates, outcome_transitions, symbol_suffix_match, paired_symbols, symbol_conditional, compare_warnings, audit_gates, symbol_rank_b0, dataset_rows, lookup_guarded, package_boost)
}

#: Exact ranks of gold symbols under both lists.
_S2 = _SYM + ", pt AS (SELECT *, split_part(name, '.', -1) AS leaf, kind = 'module' AS module, row_number() OVER (PARTITION BY ticket_id ORDER BY score DESC, r, file_path, name, kind) AS rank FROM (SELECT ticket_id, file_path, name, kind, max(score) AS score, min(coalesce(rank, 2147483647)) AS r FROM base WHERE list_name = 'retrieval' AND score IS NOT NULL GROUP BY ALL)), st AS (SELECT gs.ticket_id, gs.file_path, gs.name, gs.kind, CAST(min(CASE WHEN pt.file_path = gs.file_path AND pt.name = gs.name AND pt.kind = gs.kind THEN pt.rank END) AS INTEGER) AS exact_rank FROM gs LEFT JOIN pt ON pt.ticket_id = gs.ticket_id AND pt.leaf = gs.leaf AND pt.module = gs.module GROUP BY ALL)"
_AT = lambda t, k, out: f"{out} AS (SELECT ticket_id, max(coalesce((exact_rank <= {k})::INT, 0)) AS h, avg(coalesce((exact_rank <= {k})::INT, 0)) AS r FROM {t} GROUP BY 1)"
_PART = lambda t, n: f"SELECT '{n}' AS population, count(*) AS tickets, round(avg(h1), 6) AS exact_hit1, round(avg(h5), 6) AS exact_hit5, round(avg(r10), 6) AS exact_recall10 FROM (SELECT ticket_id, max(coalesce((exact_rank <= 1)::INT, 0)) AS h1, max(coalesce((exact_rank <= 5)::INT, 0)) AS h5, avg(coalesce((exact_rank <= 10)::INT, 0)) AS r10 FROM {t} GROUP BY ticket_id)"
_BUCKET = "CASE WHEN a.h = 0 AND b.h = 0 THEN 'both_miss' WHEN b.h > a.h THEN 'improved' WHEN b.h < a.h THEN 'worsened' ELSE 'unchanged' END"

ORACLE = {
    "oracle_blocker": _SYM + f", {_FILES('ranked', 'a')}, x AS (SELECT sm.*, EXISTS (SELECT 1 FROM a WHERE a.ticket_id = sm.ticket_id AND a.file_path = sm.file_path) AS f, EXISTS (SELECT 1 FROM ps WHERE ps.ticket_id = sm.ticket_id AND ps.name = sm.name) AS p FROM sm), l AS (SELECT CASE WHEN exact_rank <= 5 THEN 'found' WHEN exact_rank <= 30 THEN 'rerank_loss' WHEN exact_rank IS NOT NULL THEN 'ranking_loss' WHEN p THEN 'file_loss' WHEN f THEN 'pool_loss' ELSE 'coverage_loss' END AS label, count(*) AS n FROM x GROUP BY 1) SELECT label AS blocker, n FROM l WHERE label <> 'found' ORDER BY n DESC, label DESC LIMIT 1",
    "repository_lists": f"WITH t AS (SELECT DISTINCT ticket_id, {SQL_REPO} AS p, repo, base_commit, version FROM tickets WHERE {SQL_REPO} IS NOT NULL) SELECT p AS repo, count(DISTINCT ticket_id) AS tickets, count(DISTINCT lower(base_commit)) AS commits, coalesce(array_to_string(list_sort(list(DISTINCT version) FILTER (version IS NOT NULL)), ','), '') AS versions, count(DISTINCT repo) AS spellings, count(DISTINCT repo) > 1 AS conflict FROM t GROUP BY p",
    "graph_stats": f"WITH {_EDGES}, o AS (SELECT repo, base_commit, caller_file, count(*) AS c, count(DISTINCT target_file) AS t FROM edges GROUP BY ALL), b AS (SELECT repo, base_commit, count(DISTINCT target_file) AS targets FROM edges GROUP BY ALL) SELECT repo, base_commit, CAST(sum(c) AS BIGINT) AS calls, CAST(sum(t) AS BIGINT) AS pairs, count(*) AS callers, any_value(targets) AS targets, max(t) AS widest FROM o JOIN b USING (repo, base_commit) GROUP BY repo, base_commit",
    "variant_choice": f"WITH {_GOLD}, " + ", ".join(f"{_FILES(n, f'l{k}')}" for k, n in enumerate(("retrieval", "ranked", "candidate"))) + ", m AS (" + " UNION ALL ".join(f"SELECT '{n}' AS variant, g.ticket_id, g.gold_file, min(rank) AS rank FROM g LEFT JOIN l{k} ON l{k}.ticket_id = g.ticket_id AND g.gold_file <> '' AND l{k}.file_path <> '' AND (g.gold_file = l{k}.file_path OR ends_with(g.gold_file, '/' || l{k}.file_path) OR ends_with(l{k}.file_path, '/' || g.gold_file)) GROUP BY ALL" for k, n in enumerate(("retrieval", "ranked", "candidate"))) + "), p AS (SELECT variant, ticket_id, round(count(CASE WHEN rank <= 20 THEN 1 END) / count(*), 6)::DOUBLE AS recall, round(CASE WHEN min(rank) <= 20 THEN 1.0 / min(rank) ELSE 0.0 END, 6)::DOUBLE AS rr FROM m GROUP BY ALL), s AS (SELECT variant, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS rr FROM p GROUP BY 1), b AS (SELECT * FROM s WHERE variant <> 'retrieval' ORDER BY recall DESC, rr DESC, variant DESC LIMIT 1) SELECT CASE WHEN b.recall > c.recall THEN b.variant ELSE 'retrieval' END AS chosen, c.recall AS control_recall, b.recall AS best_recall FROM (SELECT recall FROM s WHERE variant = 'retrieval') c, b",
    "review_rates": """WITH one AS (SELECT x.* FROM (SELECT ticket_id, max({'evaluated_at': evaluated_at, 'eligible': eligible, 'llm_valid': llm_valid, 'fallback_reason': fallback_reason, 'split': lower(trim(split_name)), 'own': len(coalesce(baseline_top, [])) > 0}) AS x FROM ticket_outcomes GROUP BY 1)), y AS (SELECT coalesce(split, 'none') AS split, coalesce(eligible, false) AS el, coalesce(llm_valid, false) AS ok, own, coalesce(nullif(fallback_reason, ''), 'none') AS why FROM one)
        SELECT split, count(*) AS tickets, count(CASE WHEN el THEN 1 END) AS eligible, count(CASE WHEN el AND own THEN 1 END) AS conditional, round(count(CASE WHEN ok THEN 1 END) / count(*), 6)::DOUBLE AS valid_of_all, round(coalesce(count(CASE WHEN ok AND el THEN 1 END) / nullif(count(CASE WHEN el THEN 1 END), 0), 0.0), 6)::DOUBLE AS valid_of_eligible, round(coalesce(count(CASE WHEN ok AND el AND own THEN 1 END) / nullif(count(CASE WHEN el AND own THEN 1 END), 0), 0.0), 6)::DOUBLE AS valid_of_conditional, count(CASE WHEN why <> 'none' THEN 1 END) AS fallbacks FROM y GROUP BY split""",
    "outcome_transitions": _S2 + " SELECT kind, CASE WHEN a AND b THEN 'retained' WHEN b THEN 'recovered' WHEN a THEN 'lost' ELSE 'still_missed' END AS state, count(*) AS n FROM (SELECT sm.kind, coalesce(st.exact_rank <= 10, false) AS a, coalesce(sm.exact_rank <= 10, false) AS b FROM sm JOIN st USING (ticket_id, file_path, name, kind)) GROUP BY ALL",
    "symbol_suffix_match": _SYM + ", x AS (SELECT DISTINCT ticket_id, name AS gold FROM gs WHERE name <> '') SELECT x.ticket_id, gold, CAST(min(ps.rank) AS INTEGER) AS rank FROM x JOIN ps ON ps.ticket_id = x.ticket_id AND ps.name <> '' AND (gold = ps.name OR ends_with(gold, '.' || ps.name) OR ends_with(ps.name, '.' || gold)) GROUP BY ALL",
    "paired_symbols": _S2 + ", " + ", ".join(f"{_AT('st', k, f'a{k}')}, {_AT('sm', k, f'b{k}')}" for k in (1, 3, 5)) + " " + " UNION ALL ".join(f"SELECT {k} AS k, {_BUCKET} AS bucket, count(*) AS tickets, round(avg(b.r - a.r), 6) AS recall_delta FROM a{k} a JOIN b{k} b USING (ticket_id) GROUP BY ALL" for k in (1, 3, 5)),
    "symbol_conditional": _S2 + f", {_GOLD}, {_FILES('ranked', 'a')}, el AS (SELECT DISTINCT g.ticket_id FROM g JOIN a ON a.ticket_id = g.ticket_id AND a.file_path = g.gold_file WHERE a.rank <= 5), sc AS (SELECT sm.* FROM sm SEMI JOIN el USING (ticket_id)), p AS ({_PART('sm', 'all')} UNION ALL {_PART('sc', 'conditional')} UNION ALL {_PART('st', 'control')}) SELECT p.*, (SELECT count(*) FROM ranked_symbols WHERE list_name = 'ranked' AND (ticket_id IS NULL OR score IS NULL OR isnan(score) OR NOT score BETWEEN 0 AND 1)) AS invalid FROM p",
    "compare_warnings": f"WITH {_GOLD}, {_FILES('retrieval', 'b')}, {_FILES('ranked', 'a')}, t AS (SELECT DISTINCT ticket_id FROM g), x AS (SELECT EXISTS (SELECT 1 FROM b WHERE b.ticket_id = t.ticket_id) AS p, EXISTS (SELECT 1 FROM a WHERE a.ticket_id = t.ticket_id) AS q FROM t), c AS (SELECT count(*) AS gold, count(CASE WHEN p THEN 1 END) AS baseline, count(CASE WHEN q THEN 1 END) AS method, count(CASE WHEN NOT p AND NOT q THEN 1 END) AS not_evaluated FROM x) SELECT *, baseline <> method AS denominators_differ FROM c",
    "audit_gates": f"WITH g AS (SELECT DISTINCT gold_id, {SQL_REPO} AS repo, base_commit, file_path, symbol_id, mapping_confidence FROM symbol_gold WHERE mapping_status = 'mapped'), a AS (SELECT count(*) AS n, count(DISTINCT repo) AS repos, count(CASE WHEN file_path IS NULL OR base_commit IS NULL OR repo IS NULL THEN 1 END) AS lacking, coalesce(avg((mapping_confidence >= 0.95)::INT), 0.0) AS sure FROM g), c AS (SELECT 'sample' AS gate, n >= 100 AS passed FROM a UNION ALL SELECT 'repositories', repos >= 8 FROM a UNION ALL SELECT 'provenance', lacking = 0 FROM a UNION ALL SELECT 'exact_rate', sure >= 0.95 FROM a) SELECT * FROM c UNION ALL SELECT 'overall', bool_and(passed) FROM c",
    "symbol_rank_b0": _COS + " SELECT ticket_id, CAST(row_number() OVER (PARTITION BY ticket_id ORDER BY cosine DESC, kind_rank, span, chunk_id) AS INTEGER) AS rank, chunk_id, cosine FROM scored WHERE symbol_name <> '' QUALIFY rank <= 30",
    "dataset_rows": f"SELECT DISTINCT ticket_id, coalesce(list_filter(list_transform(string_split(replace(coalesce(description, ''), chr(13), chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '') AS title, coalesce({SQL_REPO}, '') AS repo, coalesce(base_commit, '') AS base_commit, coalesce(version, '') AS version, CAST(len(coalesce(fail_to_pass, [])) AS INTEGER) AS tests FROM tickets",
    "lookup_guarded": f"""WITH {_DEFS}, keys AS (SELECT DISTINCT repo, base_commit, unnest([name, split_part(name, '.', -1)]) AS lookup_key, file_path FROM defs), {_NAMES},
        first AS (SELECT DISTINCT ticket_id, repo, base_commit, symbol, file_path, 0.06::DOUBLE AS bonus FROM names n JOIN keys k USING (repo, base_commit) WHERE k.lookup_key = n.symbol),
        second AS (SELECT DISTINCT ticket_id, repo, base_commit, symbol, file_path, 0.04::DOUBLE AS bonus FROM (SELECT * FROM names ANTI JOIN first USING (ticket_id, repo, base_commit, symbol)) n JOIN keys k USING (repo, base_commit) WHERE contains(symbol, '.') AND k.lookup_key = split_part(n.symbol, '.', -1)
          AND split_part(symbol, '.', 1) NOT IN ({', '.join(repr(x) for x in R.NO_RECEIVERS)}) AND length(split_part(symbol, '.', 1)) > 1 AND split_part(symbol, '.', -1) NOT IN ({', '.join(repr(x) for x in R.GENERIC_LEAVES)}) AND length(split_part(symbol, '.', -1)) >= 5),
        b AS (SELECT * FROM first UNION ALL SELECT * FROM second), s AS (SELECT ticket_id, repo, base_commit, symbol FROM b GROUP BY ALL HAVING count(DISTINCT file_path) <= 4)
        SELECT ticket_id, file_path, round(least(0.10, sum(bonus)), 6)::DOUBLE AS bonus, count(*) AS evidence FROM b SEMI JOIN s USING (ticket_id, repo, base_commit, symbol) GROUP BY ALL""",
    "package_boost": f"""WITH {_WEIGHTED}, scored AS (SELECT * FROM w), {_AGG.replace('cosine', 'w_score').replace('FROM scored GROUP', 'FROM (SELECT *, score AS w_score FROM scored) GROUP')}, top AS (SELECT fr.*, w.identifier, w.path, list_filter(string_split({_N.replace('file_path', 'fr.file_path')}, '/'), lambda x: x <> '') AS parts FROM fr JOIN w USING (ticket_id, chunk_id) WHERE fr.rank <= 50),
        e AS (SELECT ticket_id, file_path, rank, depth, array_to_string(list_slice(parts, 1, depth), '/') AS prefix FROM (SELECT *, unnest(range(1, len(parts))) AS depth FROM top WHERE len(parts) > 1)), dp AS (SELECT a.ticket_id, a.file_path, max(a.depth) AS depth FROM e a JOIN e b USING (ticket_id, depth, prefix) WHERE b.rank <= 30 AND a.file_path <> b.file_path GROUP BY ALL),
        rt AS (SELECT DISTINCT ticket_id, unnest(list_concat(ts, vs)) AS term FROM (SELECT q.ticket_id, q.ts, coalesce(v.vs, []) AS vs FROM q LEFT JOIN (SELECT ticket_id, repo, base_commit, list(term) AS vs FROM iv GROUP BY ALL) v USING (ticket_id, repo, base_commit))),
        pt2 AS (SELECT DISTINCT ticket_id, file_path, unnest({sql_tokens(_N)}) AS term FROM top), ov AS (SELECT ticket_id, file_path, count(*) AS n FROM pt2 SEMI JOIN rt USING (ticket_id, term) WHERE term NOT IN ({_STOP}) GROUP BY ALL),
        bs AS (SELECT top.*, coalesce(depth, 0) AS depth, coalesce(n, 0) AS n, greatest(identifier, path) AS local FROM top LEFT JOIN dp USING (ticket_id, file_path) LEFT JOIN ov USING (ticket_id, file_path)),
        sc2 AS (SELECT *, CASE WHEN depth < 2 OR (n = 0 AND local <= 0) THEN 0.0::DOUBLE ELSE least(0.10::DOUBLE, 0.12::DOUBLE * least(1.0::DOUBLE, 0.35::DOUBLE + 0.12::DOUBLE * greatest(0, depth - 2) + 0.20::DOUBLE * local + 0.04::DOUBLE * n)) END AS boost FROM bs),
        sc3 AS (SELECT ticket_id, file_path, chunk_id, kind_rank, span, round(boost + 1e-10, 6)::DOUBLE AS boost, round(least(1.0, file_score + boost) + 1e-10, 6)::DOUBLE AS score FROM sc2)
        SELECT ticket_id, CAST(row_number() OVER (PARTITION BY ticket_id ORDER BY score DESC, kind_rank, span, chunk_id) AS INTEGER) AS rank, file_path, boost, score FROM sc3 QUALIFY rank <= 20""",
}
