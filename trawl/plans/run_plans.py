"""Queries of batch runs: selection, resume, shards, memoised rankings, state tokens, blobs, chunks from files, expansions, runtimes per method and group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.functions.keys import plain_repo, plain_snapshot
from trawl.operators import evaluation as E
from trawl.operators import projections as P
from trawl.operators import relations as R
from trawl.operators import retrieval as RT
from trawl.operators import runs as B
from trawl.operators import source as S
from trawl.plans.evaluation_plans import _A, _FILES, _GOLD, _N
from trawl.plans.relation_plans import _EDGES, _GROUPS
from trawl.plans.retrieval_plans import _TFIDF
from trawl.plans.text_plans import _BUG, SQL_COMMIT, SQL_REPO, SQL_TICKETS
from trawl.sources.tables import table
from trawl.storage import cut, new_path

_LOADED = "2025-01-15 00:00:00"  # the time of an earlier run
SHARDS = 4


def select_tickets(spark: SparkSession, d: str) -> DataFrame:
    """The training tickets after the first 25, at most 200."""
    train = table(spark, d, "ticket_outcomes", "ticket_id", "split_name").filter("lower(trim(split_name)) = 'train'")
    return B.select_tickets(table(spark, d, "tickets", "ticket_id").distinct(), train, 25, 200)


def batch_run(spark: SparkSession, d: str) -> DataFrame:
    """Two calls of a batch run, the second over all tickets: what the target then holds."""
    method = B.method_id({"ranking": "files", "list": "ranked"})
    tickets = table(spark, d, "tickets", "ticket_id").distinct()
    rank = lambda asked: E.ranked_files(table(spark, d, "ranked_symbols"), "ranked").join(asked, "ticket_id", "left_semi")
    target = new_path(spark, "batch")
    B.run_batch(tickets.filter(E.hash_number(F.col("ticket_id")) % 2 == 0), rank, target, method)
    found, failed = B.run_batch(tickets, rank, target, method)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ticket_id").alias("tickets"), F.max("method_id").alias("method_id")).select(F.lit(name).alias("kind"), "n", "tickets", "method_id")
    return count(found, "prediction").union(count(failed, "failure"))


def shard_merge(spark: SparkSession, d: str) -> DataFrame:
    """Metrics computed shard by shard; a shard also has the tickets of the one before, as after a restart, and the later row counts."""
    rows = table(spark, d, "ranked_symbols")
    repo = plain_snapshot(table(spark, d, "tickets", "ticket_id", "repo")).groupBy("ticket_id").agg(F.max("repo").alias("repo"))
    m = E.ticket_metrics(E.gold_files(rows), E.ranked_files(rows, "ranked")).select("ticket_id", "rr").join(repo, "ticket_id").withColumn("shard", B.shard_of(F.col("repo"), SHARDS))
    again = m.withColumn("shard", F.col("shard") + 1).filter(F.col("shard") < SHARDS)
    done = m.union(again).select("shard", "ticket_id", "rr", F.lit(B.method_id({"ranking": "files"})).alias("method_id"))
    order = repo.select("ticket_id", E.hash_number(F.lit("order"), F.col("ticket_id")).alias("ordinal"))
    return B.merge_shards(done, order).select("place", "ticket_id", "shard", "rr")


def _seen(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lists = [table(spark, d, t, "ticket_id", "repo").withColumn("repo", plain_repo(F.col("repo"))) for t in ("tickets", "symbol_gold")]
    return B.union_seen(lists)


def seen_union(spark: SparkSession, d: str) -> DataFrame:
    return _seen(spark, d)[0]


def seen_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return _seen(spark, d)[1]


def source_token(spark: SparkSession, d: str) -> DataFrame:
    return B.source_token(table(spark, d, "source_files", "repo", "base_commit", "file_path", "content", "loaded_at"))


def _asked(tickets: DataFrame, tokens: DataFrame) -> DataFrame:
    return RT.reports(tickets).join(tokens, RT.SNAPSHOT).select("ticket_id", *RT.SNAPSHOT, "token", F.md5("bug_text").alias("report"))


def memo_top50(spark: SparkSession, d: str) -> DataFrame:
    """TF-IDF rankings of all tickets, those of an earlier run reused where report and snapshot are the same."""
    tickets, chunks = table(spark, d, "tickets"), cut(RT.corpus(table(spark, d, "chunks")), "corpus", compression="zstd")
    tokens = cut(source_token(spark, d), "tokens")
    path = new_path(spark, "memo")

    def compute(asked: DataFrame) -> DataFrame:
        some = tickets.join(asked.select("ticket_id").distinct(), "ticket_id", "left_semi")
        scored = RT.tfidf(some, chunks).join(RT.order_columns(chunks), [*RT.SNAPSHOT, "chunk_id"])
        return RT.ranked(scored, "cosine", 50).select("ticket_id", *RT.SNAPSHOT, "chunk_id", "rank", "cosine")

    B.memo_rankings(_asked(tickets.filter(F.col("loaded_at") < F.lit(_LOADED).cast("timestamp_ntz")), tokens), compute, path)
    rows = B.memo_rankings(_asked(tickets, tokens), compute, path)
    return rows.groupBy("ticket_id", *RT.SNAPSHOT).agg(F.count("chunk_id").alias("n"), F.max("reused").alias("reused"))


def blob_lookup(spark: SparkSession, d: str) -> DataFrame:
    asked = plain_snapshot(table(spark, d, "symbol_gold", "repo", "base_commit", "file_path"))
    return B.blobs(asked.filter("repo IS NOT NULL AND base_commit IS NOT NULL"), table(spark, d, "source_files", "repo", "base_commit", "file_path", "content"))


def prompt_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ranked_symbols", "ticket_id", "list_name", "chunk_id", "file_path", "symbol_qualified_name", "score").filter("list_name = 'ranked' AND ticket_id IS NOT NULL AND score >= 0 AND score <= 1")
    best = rows.groupBy("ticket_id", "chunk_id").agg(F.max("score").alias("score"), F.min("file_path").alias("file_path"), F.min("symbol_qualified_name").alias("symbol"))
    top = best.withColumn("rank", F.row_number().over(Window.partitionBy("ticket_id").orderBy(F.desc("score"), "chunk_id"))).filter("rank <= 5")
    code = table(spark, d, "chunks", "chunk_id", "code_text").groupBy("chunk_id").agg(F.max("code_text").alias("code"))
    reports = P.bug_reports(table(spark, d, "tickets")).groupBy("ticket_id").agg(F.max("bug_text").alias("bug_text"))
    return B.prompts(reports, top.join(code, "chunk_id", "left")).select("ticket_id", F.md5("prompt").alias("digest"), F.char_length("prompt").alias("chars"))


def graph_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Files one call away from a ticket's first files, in both directions."""
    edges = R.call_edges(table(spark, d, "chunks")).select("repo", "base_commit", F.col("caller_file").alias("src_file"), F.col("target_file").alias("dst_file"))
    snap = plain_snapshot(table(spark, d, "tickets", "ticket_id", "repo", "base_commit")).filter("repo IS NOT NULL").distinct()
    return B.expanded(E.ranked_files(table(spark, d, "ranked_symbols"), "ranked").join(snap, "ticket_id"), edges)


def api_expansion(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "source_files", "repo", "base_commit", "file_path", "content")
    return B.api_expanded(R.report_symbols(table(spark, d, "tickets")), S.api_links(S.facts(files)), R.lookup_keys(R.definitions(table(spark, d, "chunks"))))


def file_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all files: symbols of Python by its parser, of other languages by declaration patterns."""
    files = table(spark, d, "source_files", "repo", "base_commit", "file_path", "content")
    parsed = S.symbols(files).filter("kind IS NOT NULL").select("repo", "base_commit", "file_path", "kind", F.col("qualified_name").alias("name"), "start_line", "end_line", (F.coalesce("parent", F.lit("")) == "").alias("outer"))
    declared = S.declarations(files.filter("NOT file_path RLIKE '[.]pyi?$'")).select("repo", "base_commit", "file_path", "kind", "name", F.col("line").alias("start_line"), "end_line", F.lit(True).alias("outer"))
    return B.file_chunks(files, parsed.union(declared))


def index_gap(spark: SparkSession, d: str) -> DataFrame:
    """Per size group: share of gold files that the snapshot has, share found among the first 50, and the gap between the two."""
    rows = table(spark, d, "ranked_symbols")
    snap = plain_snapshot(table(spark, d, "tickets", "ticket_id", "repo", "base_commit")).filter("repo IS NOT NULL").distinct()
    gold = E.gold_files(rows)
    here = snap.join(table(spark, d, "chunks", "repo", "base_commit", "file_path").distinct(), ["repo", "base_commit"]).select("ticket_id", T.norm_path(F.col("file_path")).alias("gold_file"), F.lit(1).alias("i")).distinct()
    found = E.matched(gold, E.ranked_files(rows, "retrieval")).filter("rank <= 50").select("ticket_id", "gold_file", F.lit(1).alias("f"))
    per = gold.join(here, ["ticket_id", "gold_file"], "left").join(found, ["ticket_id", "gold_file"], "left").groupBy("ticket_id").agg(F.count("i").alias("i"), F.count("f").alias("f"), F.count(F.lit(1)).alias("g"))
    repo = snap.groupBy("ticket_id").agg(F.max("repo").alias("repo")).join(R.size_groups(table(spark, d, "chunks")), "repo", "left")
    x = per.join(repo, "ticket_id", "left").withColumn("size_group", F.coalesce("size_group", F.lit("none")))
    mean = lambda c: F.round(F.avg(F.col(c) / F.col("g")), 6)
    hit = lambda c: F.round(F.avg((F.col(c) > 0).cast("int")), 6)
    return x.groupBy("size_group").agg(F.count(F.lit(1)).alias("tickets"), hit("i").alias("index_hit"), mean("i").alias("index_recall"), hit("f").alias("hit50"), mean("f").alias("recall50"), F.round(F.avg((F.col("i") - F.col("f")) / F.col("g")), 6).alias("gap"))


def commit_reachability(spark: SparkSession, d: str) -> DataFrame:
    """Per repository the distinct commits that tickets name and how many of them have files."""
    asked = plain_snapshot(table(spark, d, "tickets", "repo", "base_commit")).filter("repo IS NOT NULL AND base_commit IS NOT NULL").distinct()
    there = table(spark, d, "source_files", "repo", "base_commit").distinct().withColumn("t", F.lit(1))
    x = asked.join(there, ["repo", "base_commit"], "left").groupBy("repo").agg(F.count(F.lit(1)).alias("commits"), F.count("t").alias("reachable"))
    return x.select("repo", "commits", "reachable", (F.col("commits") - F.col("reachable")).alias("missing"), F.when(F.col("commits") == F.col("reachable"), "complete").when(F.col("reachable") > 0, "partial").otherwise("absent").alias("state"))


def pool_fraction(spark: SparkSession, d: str) -> DataFrame:
    """The share of a snapshot's chunks that a pool of 50 holds."""
    n = table(spark, d, "chunks", "repo", "base_commit", "chunk_id").groupBy("repo", "base_commit").agg(F.count_distinct("chunk_id").alias("n"))
    return n.select("repo", "base_commit", "n", F.round(F.least(F.lit(50), F.col("n")) / F.col("n"), 6).alias("fraction"))


def priority_order(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 tickets by priority, number of gold files (falling), repository and id; the 100 is the feature."""
    t = plain_snapshot(table(spark, d, "tickets", "ticket_id", "priority", "repo")).groupBy("ticket_id").agg(F.min(F.coalesce(F.upper(F.trim("priority")), F.lit("~"))).alias("priority"), F.max(F.coalesce("repo", F.lit("~"))).alias("repo"))
    files = table(spark, d, "symbol_gold", "ticket_id", "file_path").groupBy("ticket_id").agg(F.count_distinct("file_path").alias("files"))
    return t.join(files, "ticket_id", "left").na.fill(0, ["files"]).orderBy("priority", F.desc("files"), "repo", "ticket_id").limit(100).select("ticket_id", "priority", "files", "repo")


def candidate_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A ticket's final files: its own list, else the first five ranked, else the first five retrieved; and where they came from."""
    rows = table(spark, d, "ranked_symbols")
    none = F.array().cast("array<string>")
    own = table(spark, d, "ticket_outcomes", "ticket_id", "baseline_top").groupBy("ticket_id").agg(F.max(F.array_distinct(F.filter(F.transform(F.coalesce("baseline_top", none), T.norm_path), lambda x: x != ""))).alias("own"))
    first = lambda name: E.ranked_files(rows, name).filter("rank <= 5").groupBy("ticket_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "file_path"))), lambda x: x["file_path"]).alias(name))
    x = own.join(first("ranked"), "ticket_id", "left").join(first("retrieval"), "ticket_id", "left")
    source = F.when(F.size("own") > 0, "own").when(F.col("ranked").isNotNull(), "ranked").when(F.col("retrieval").isNotNull(), "retrieval").otherwise("none")
    files = F.when(F.size("own") > 0, F.col("own")).otherwise(F.coalesce("ranked", "retrieval", none))
    return x.select("ticket_id", source.alias("source"), F.array_join(files, "|").alias("files"))


def plain_names(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "ranked_symbols", "symbol_qualified_name").distinct()
    return names.select("symbol_qualified_name", B.plain_name(F.col("symbol_qualified_name")).alias("plain"))


def hunk_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each hunk of a text's diffs as it stands there."""
    found = F.regexp_extract_all(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit(r"(?m)^@@ -[^\n]*(?:\n[ +\-\\][^\n]*)*"), F.lit(0))
    return table(spark, d, "documents", "doc_id", "text").filter("text IS NOT NULL").select("doc_id", F.posexplode(found).alias("hunk", "h")).select("doc_id", "hunk", F.md5("h").alias("digest"))


def _seconds(spark: SparkSession, d: str) -> DataFrame:
    """Seconds between scoring and receipt of each scored row, by method."""
    rows = table(spark, d, "ranked_symbols", "ticket_id", "list_name", "scored_at", "received_at").filter("ticket_id IS NOT NULL AND scored_at IS NOT NULL AND received_at IS NOT NULL")
    return rows.select("ticket_id", F.col("list_name").alias("method"), F.expr("timestampdiff(SECOND, scored_at, received_at)").alias("seconds"))


def runtime_groups(spark: SparkSession, d: str) -> DataFrame:
    """Seconds per method, per size group, per both and in total, in one CUBE."""
    repo = plain_snapshot(table(spark, d, "tickets", "ticket_id", "repo")).groupBy("ticket_id").agg(F.max("repo").alias("repo")).join(R.size_groups(table(spark, d, "chunks")), "repo", "left")
    x = _seconds(spark, d).join(repo.select("ticket_id", F.coalesce("size_group", F.lit("none")).alias("size_group")), "ticket_id", "left")
    x = x.select("method", F.coalesce("size_group", F.lit("none")).alias("size_group"), "seconds")
    return x.cube("method", "size_group").agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("total"), F.round(F.avg("seconds"), 6).alias("mean")).select(F.coalesce("method", F.lit("*")).alias("method"), F.coalesce("size_group", F.lit("*")).alias("size_group"), "n", "total", "mean")


def runtime_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return R.nearest_rank(_seconds(spark, d), "method", "seconds", {"p50": 0.5, "p95": 0.95}).select("method", "n", "p50", "p95", "most")


def metrics_micro_macro(spark: SparkSession, d: str) -> DataFrame:
    """Means of ticket metrics over tickets, and over the means of repositories."""
    rows = table(spark, d, "ranked_symbols")
    repo = plain_snapshot(table(spark, d, "tickets", "ticket_id", "repo")).groupBy("ticket_id").agg(F.max("repo").alias("repo"))
    m = E.ticket_metrics(E.gold_files(rows), E.ranked_files(rows, "ranked")).join(repo, "ticket_id", "left").withColumn("repo", F.coalesce("repo", F.lit("?")))
    names = ["hit", "recall", "rr", "top1"]
    per = m.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names])
    wide = per.agg(*[F.round(F.sum(c) / F.sum("n"), 6).alias(f"micro_{c}") for c in names], *[F.round(F.avg(F.col(c) / F.col("n")), 6).alias(f"macro_{c}") for c in names])
    return wide


def contract_gates(spark: SparkSession, d: str) -> DataFrame:
    """Contracts of a frozen run: exactly 20 candidates per ticket, the same first 20 in both lists, ranks without gaps, no ticket in gold that has no list."""
    from trawl.operators.pipeline import gates

    rows = table(spark, d, "ranked_symbols")
    a, b = E.ranked_files(rows, "ranked"), E.ranked_files(rows, "retrieval")
    first = lambda x: x.filter("rank <= 20").select("ticket_id", "file_path")
    return gates([
        ("exactly_20", a.groupBy("ticket_id").count().filter("count <> 20")),
        ("parity_20", first(a).join(first(b), ["ticket_id", "file_path"], "left_anti")),
        ("dense_ranks", a.groupBy("ticket_id").agg(F.max("rank").alias("m"), F.count(F.lit(1)).alias("n")).filter("m <> n")),
        ("gold_has_list", E.gold_files(rows).select("ticket_id").distinct().join(a, "ticket_id", "left_anti")),
    ])


def sink_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Rows that come back from each kind of file: JSON lines, flat CSV, an index partitioned by snapshot, nested index documents, rows as text; and whether a second write of an artifact is refused."""
    from pyspark.errors import AnalysisException

    from trawl.sources import files as IO

    path = new_path(spark, "sinks")
    tickets = table(spark, d, "tickets", "ticket_id", "title", "fail_to_pass").distinct()
    tickets.write.json(f"{path}/t.jsonl")
    back = IO.read_records(spark, f"{path}/t.jsonl", "ticket_id string, title string, fail_to_pass array<string>", strict=True)
    IO.write_flat_csv(tickets.select("ticket_id", "fail_to_pass"), f"{path}/t.csv")
    flat = IO.read_csv(spark, f"{path}/t.csv", ["ticket_id", "fail_to_pass"])
    chunks = table(spark, d, "chunks")
    IO.write_index(chunks.select("repo", "base_commit", "chunk_id").distinct(), f"{path}/index")
    index = spark.read.parquet(f"{path}/index")
    loaded, wrong = IO.load_index(IO.index_documents(chunks))
    IO.write_once(tickets.select("ticket_id"), f"{path}/once")
    try:
        IO.write_once(tickets.select("ticket_id"), f"{path}/once")
        refused = 0
    except AnalysisException:
        refused = 1
    n = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("sink"), "n")
    latest = IO.latest_by_key(table(spark, d, "parse_results", "file_path", "parsed_at"), "file_path", "parsed_at")
    parts = [n("json", back.exceptAll(tickets).union(tickets.exceptAll(back))), n("csv", flat), n("index", index), n("documents", loaded), n("wrong_counts", wrong), n("latest", latest), n("text", IO.rows_as_text(tickets).filter("title = ''"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.union(spark.range(1).select(F.lit("refused").alias("sink"), F.lit(refused).cast("bigint").alias("n")))


QUERIES = {
    f.__name__: f
    for f in (
        sink_round_trip, select_tickets, batch_run, shard_merge, seen_union, seen_conflicts, source_token, memo_top50, blob_lookup, prompt_texts, graph_expansion, api_expansion, file_chunks, index_gap, commit_reachability, pool_fraction, priority_order, candidate_fallback, plain_names,
        hunk_texts, runtime_groups, runtime_percentiles, metrics_micro_macro, contract_gates,
    )
}

_METHOD = lambda s: B.method_id(s)
_HASH = lambda x: f"('0x' || substr(md5({x}), 1, 8))::BIGINT"
_REPOS = f"rp AS (SELECT ticket_id, max(repo) AS repo FROM {SQL_TICKETS} GROUP BY 1)"
_TOKEN = "tk AS (SELECT repo, base_commit, md5(concat_ws(':', count(*), CAST(sum(b) AS BIGINT), coalesce(strftime(max(t), '%Y-%m-%d %H:%M:%S.%f'), ''))) AS token FROM (SELECT repo, base_commit, file_path, max(coalesce(octet_length(encode(content)), 0)) AS b, max(loaded_at) AS t FROM source_files GROUP BY ALL) GROUP BY ALL)"
_ASK = lambda where, out: f"""{out} AS (SELECT ticket_id, repo, base_commit, md5(x.s) AS report FROM (SELECT ticket_id, repo, base_commit, max({{'n': length({_BUG}), 's': {_BUG}}}) AS x FROM {SQL_TICKETS} WHERE repo IS NOT NULL AND base_commit IS NOT NULL {where} GROUP BY ALL) JOIN tk USING (repo, base_commit))"""
_SEEN = f"u AS (SELECT DISTINCT ticket_id, {SQL_REPO} AS repo, 0 AS part FROM tickets WHERE ticket_id IS NOT NULL UNION ALL SELECT DISTINCT ticket_id, {SQL_REPO}, 1 FROM symbol_gold WHERE ticket_id IS NOT NULL)"
_SECONDS = "sec AS (SELECT ticket_id, list_name AS method, CAST(trunc(epoch_us(received_at - scored_at) / 1000000) AS BIGINT) AS seconds FROM ranked_symbols WHERE ticket_id IS NOT NULL AND scored_at IS NOT NULL AND received_at IS NOT NULL)"

ORACLE = {
    "sink_round_trip": "WITH t AS (SELECT DISTINCT ticket_id, title, fail_to_pass FROM tickets), c AS (SELECT count(*) AS n FROM t) SELECT 'json' AS sink, 0::BIGINT AS n UNION ALL SELECT 'csv', count(*) FROM t UNION ALL SELECT 'index', count(*) FROM (SELECT DISTINCT repo, base_commit, chunk_id FROM chunks) UNION ALL SELECT 'documents', count(*) FROM (SELECT DISTINCT repo, base_commit, file_path, chunk_id FROM chunks) UNION ALL SELECT 'wrong_counts', 0 UNION ALL SELECT 'latest', count(DISTINCT file_path) FROM parse_results UNION ALL SELECT 'text', count(*) FROM t WHERE coalesce(title, '') = '' UNION ALL SELECT 'refused', 1",
    "select_tickets": "SELECT DISTINCT ticket_id FROM tickets SEMI JOIN (SELECT ticket_id FROM ticket_outcomes WHERE lower(trim(split_name)) = 'train') USING (ticket_id) WHERE ticket_id IS NOT NULL ORDER BY ticket_id LIMIT 200 OFFSET 25",
    "batch_run": f"WITH {_FILES('ranked', 'a')}, t AS (SELECT DISTINCT ticket_id FROM tickets WHERE ticket_id IS NOT NULL), p AS (SELECT a.* FROM a SEMI JOIN t USING (ticket_id)) SELECT 'prediction' AS kind, count(*) AS n, count(DISTINCT ticket_id) AS tickets, '{_METHOD({'ranking': 'files', 'list': 'ranked'})}' AS method_id FROM p UNION ALL SELECT 'failure', count(*), count(DISTINCT ticket_id), CASE WHEN count(*) > 0 THEN '{_METHOD({'ranking': 'files', 'list': 'ranked'})}' END FROM t ANTI JOIN p USING (ticket_id)",
    "shard_merge": _A + f", {_REPOS} SELECT {_HASH("'order:' || ticket_id")} AS place, ticket_id, least({_HASH('coalesce(repo, chr(0)[2:1])')} % {SHARDS} + 1, {SHARDS - 1}) AS shard, rr FROM ta JOIN rp USING (ticket_id)",
    "seen_union": f"WITH {_SEEN} SELECT ticket_id, repo, part FROM u QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY part DESC, repo DESC NULLS LAST) = 1",
    "seen_conflicts": f"WITH {_SEEN} SELECT ticket_id, count(DISTINCT repo) AS repos FROM u GROUP BY 1 HAVING count(DISTINCT repo) > 1",
    "source_token": f"WITH {_TOKEN} SELECT * FROM tk",
    "memo_top50": f"""WITH {_TOKEN}, {_ASK(f"AND loaded_at < TIMESTAMP '{_LOADED}'", 'a1')}, {_ASK('', 'a2')}, {_TFIDF}, c AS (SELECT ticket_id, count(*) AS n FROM cos GROUP BY 1), k AS (SELECT ticket_id, repo, base_commit FROM (SELECT ticket_id, repo, base_commit, row_number() OVER (PARTITION BY ticket_id ORDER BY cosine DESC, kind_rank, span, chunk_id) AS r FROM cos JOIN docs USING (repo, base_commit, chunk_id)) WHERE r <= 50)
        SELECT a2.ticket_id, a2.repo, a2.base_commit, (SELECT count(*) FROM k WHERE k.ticket_id = a2.ticket_id AND k.repo = a2.repo AND k.base_commit = a2.base_commit) AS n, EXISTS (SELECT 1 FROM a1 WHERE a1.ticket_id = a2.ticket_id AND a1.repo = a2.repo AND a1.base_commit = a2.base_commit AND a1.report = a2.report) AS reused FROM a2""",
    "blob_lookup": f"""WITH q AS (SELECT DISTINCT {SQL_REPO} AS repo, {SQL_COMMIT} AS base_commit, file_path FROM symbol_gold WHERE {SQL_REPO} IS NOT NULL AND {SQL_COMMIT} IS NOT NULL), p AS (SELECT repo, base_commit, file_path, max(octet_length(encode(content))) AS bytes FROM source_files GROUP BY ALL)
        SELECT q.repo, q.base_commit, q.file_path, CASE WHEN NOT EXISTS (SELECT 1 FROM p WHERE p.repo = q.repo) THEN 'missing_repo' WHEN NOT EXISTS (SELECT 1 FROM p WHERE p.repo = q.repo AND p.base_commit = q.base_commit) THEN 'missing_commit' WHEN p.repo IS NULL THEN 'missing_path' WHEN bytes IS NULL THEN 'missing_content' ELSE 'found' END AS state, CAST(bytes AS INTEGER) AS bytes FROM q LEFT JOIN p USING (repo, base_commit, file_path)""",
    "prompt_texts": f"""WITH b AS (SELECT ticket_id, chunk_id, max(score) AS score, min(file_path) AS file_path, min(symbol_qualified_name) AS symbol FROM ranked_symbols WHERE list_name = 'ranked' AND ticket_id IS NOT NULL AND NOT isnan(score) AND score BETWEEN 0 AND 1 GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY score DESC, chunk_id) AS rank FROM b QUALIFY rank <= 5),
        c AS (SELECT chunk_id, max(code_text) AS code FROM chunks GROUP BY 1), r AS (SELECT ticket_id, max(s) AS s FROM (SELECT ticket_id, {_BUG} AS s FROM tickets) GROUP BY 1),
        e AS (SELECT ticket_id, string_agg('[' || rank || '] ' || file_path || '::' || coalesce(symbol, '') || chr(10) || substr(coalesce(code, ''), 1, 800), chr(10) ORDER BY rank) AS e FROM t LEFT JOIN c USING (chunk_id) GROUP BY 1)
        SELECT ticket_id, md5(p) AS digest, CAST(length(p) AS INTEGER) AS chars FROM (SELECT ticket_id, concat_ws(chr(10) || chr(10), substr(s, 1, 4000), e) AS p FROM r JOIN e USING (ticket_id))""",
    "graph_expansion": f"""WITH {_FILES('ranked', 'a')}, {_EDGES}, snap AS (SELECT DISTINCT ticket_id, repo, base_commit FROM {SQL_TICKETS} WHERE repo IS NOT NULL), b AS (SELECT repo, base_commit, caller_file AS f, target_file AS t, 0.8::DOUBLE AS s FROM edges UNION SELECT repo, base_commit, target_file, caller_file, 0.65::DOUBLE FROM edges),
        h AS (SELECT a.ticket_id, t AS file_path, max(s * greatest(0.0, 1 - 0.08::DOUBLE * (rank - 1))) AS signal FROM a JOIN snap USING (ticket_id) JOIN b ON b.repo = snap.repo AND b.base_commit = snap.base_commit AND b.f = a.file_path WHERE rank <= 5 GROUP BY ALL) SELECT ticket_id, file_path, round(signal, 6) AS signal, round(least(0.08::DOUBLE, 0.1::DOUBLE * signal), 6) AS bonus FROM h""",
    "index_gap": f"""WITH {_GOLD}, {_FILES('retrieval', 'b')}, {_GROUPS}, snap AS (SELECT DISTINCT ticket_id, repo, base_commit FROM {SQL_TICKETS} WHERE repo IS NOT NULL), here AS (SELECT DISTINCT ticket_id, {_N} AS gold_file FROM snap JOIN chunks USING (repo, base_commit)),
        m AS (SELECT DISTINCT ticket_id, gold_file FROM g JOIN b USING (ticket_id) WHERE rank <= 50 AND gold_file <> '' AND file_path <> '' AND (gold_file = file_path OR ends_with(gold_file, '/' || file_path) OR ends_with(file_path, '/' || gold_file))),
        p AS (SELECT g.ticket_id, count(*) AS g, count(here.ticket_id) AS i, count(m.ticket_id) AS f FROM g LEFT JOIN here ON here.ticket_id = g.ticket_id AND here.gold_file = g.gold_file LEFT JOIN m ON m.ticket_id = g.ticket_id AND m.gold_file = g.gold_file GROUP BY 1), r AS (SELECT ticket_id, max(repo) AS repo FROM snap GROUP BY 1)
        SELECT coalesce(size_group, 'none') AS size_group, count(*) AS tickets, round(avg((i > 0)::INT), 6) AS index_hit, round(avg(i / g), 6) AS index_recall, round(avg((f > 0)::INT), 6) AS hit50, round(avg(f / g), 6) AS recall50, round(avg((i - f) / g), 6) AS gap FROM p LEFT JOIN r USING (ticket_id) LEFT JOIN sg USING (repo) GROUP BY 1""",
    "commit_reachability": f"WITH a AS (SELECT DISTINCT repo, base_commit FROM {SQL_TICKETS} WHERE repo IS NOT NULL AND base_commit IS NOT NULL), t AS (SELECT DISTINCT repo, base_commit, 1 AS t FROM source_files), x AS (SELECT repo, count(*) AS commits, count(t) AS reachable FROM a LEFT JOIN t USING (repo, base_commit) GROUP BY repo) SELECT repo, commits, reachable, commits - reachable AS missing, CASE WHEN commits = reachable THEN 'complete' WHEN reachable > 0 THEN 'partial' ELSE 'absent' END AS state FROM x",
    "pool_fraction": "SELECT repo, base_commit, count(DISTINCT chunk_id) AS n, round(least(50, count(DISTINCT chunk_id)) / count(DISTINCT chunk_id), 6) AS fraction FROM chunks GROUP BY ALL",
    "priority_order": f"WITH t AS (SELECT ticket_id, min(coalesce(upper(trim(priority)), '~')) AS priority, max(coalesce(repo, '~')) AS repo FROM {SQL_TICKETS} GROUP BY 1), f AS (SELECT ticket_id, count(DISTINCT file_path) AS files FROM symbol_gold GROUP BY 1) SELECT ticket_id, priority, coalesce(files, 0) AS files, repo FROM t LEFT JOIN f USING (ticket_id) ORDER BY priority, files DESC, repo, ticket_id LIMIT 100",
    "candidate_fallback": f"""WITH {_FILES('ranked', 'a')}, {_FILES('retrieval', 'b')}, o AS (SELECT ticket_id, max(list_filter(l, lambda x, i: list_position(l, x) = i)) AS own FROM (SELECT ticket_id, list_filter(list_transform(coalesce(baseline_top, []), lambda x: regexp_replace(replace(x, chr(92), '/'), '^[./]+', '')), lambda x: x <> '') AS l FROM ticket_outcomes) GROUP BY 1),
        fa AS (SELECT ticket_id, list(file_path ORDER BY rank) AS a FROM a WHERE rank <= 5 GROUP BY 1), fb AS (SELECT ticket_id, list(file_path ORDER BY rank) AS b FROM b WHERE rank <= 5 GROUP BY 1)
        SELECT ticket_id, CASE WHEN len(own) > 0 THEN 'own' WHEN a IS NOT NULL THEN 'ranked' WHEN b IS NOT NULL THEN 'retrieval' ELSE 'none' END AS source, array_to_string(CASE WHEN len(own) > 0 THEN own ELSE coalesce(a, b, []) END, '|') AS files FROM o LEFT JOIN fa USING (ticket_id) LEFT JOIN fb USING (ticket_id)""",
    "plain_names": "SELECT DISTINCT symbol_qualified_name, lower(regexp_replace(replace(split_part(split_part(symbol_qualified_name, '::', -1), ':', 1), '#', '.'), '^\\.+', '')) AS plain FROM ranked_symbols",
    "hunk_texts": "SELECT doc_id, CAST(hunk - 1 AS INTEGER) AS hunk, md5(h) AS digest FROM (SELECT doc_id, unnest(l) AS h, generate_subscripts(l, 1) AS hunk FROM (SELECT doc_id, regexp_extract_all(replace(text, chr(13) || chr(10), chr(10)), '(?m)^@@ -[^\\n]*(?:\\n[ +\\-\\\\][^\\n]*)*') AS l FROM documents WHERE text IS NOT NULL))",
    "runtime_groups": f"WITH {_SECONDS}, {_REPOS}, {_GROUPS}, x AS (SELECT method, coalesce(size_group, 'none') AS size_group, seconds FROM sec LEFT JOIN rp USING (ticket_id) LEFT JOIN sg USING (repo)) SELECT coalesce(method, '*') AS method, coalesce(size_group, '*') AS size_group, count(*) AS n, CAST(sum(seconds) AS BIGINT) AS total, round(avg(seconds), 6) AS mean FROM x GROUP BY CUBE (method, size_group)",
    "runtime_percentiles": f"WITH {_SECONDS}, r AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY seconds) AS k, count(*) OVER (PARTITION BY method) AS n FROM sec) SELECT method, any_value(n) AS n, min(CASE WHEN k >= ceil(0.5 * n) THEN seconds END)::DOUBLE AS p50, min(CASE WHEN k >= ceil(0.95 * n) THEN seconds END)::DOUBLE AS p95, max(seconds)::DOUBLE AS most FROM r GROUP BY method",
    "metrics_micro_macro": _A + f", {_REPOS}, p AS (SELECT coalesce(repo, '?') AS repo, count(*) AS n, " + ", ".join(f"sum({c}) AS {c}" for c in ("hit", "recall", "rr", "top1")) + " FROM ta LEFT JOIN rp USING (ticket_id) GROUP BY 1) SELECT " + ", ".join([f"round(sum({c}) / sum(n), 6) AS micro_{c}" for c in ("hit", "recall", "rr", "top1")] + [f"round(avg({c} / n), 6) AS macro_{c}" for c in ("hit", "recall", "rr", "top1")]) + " FROM p",
    "contract_gates": f"WITH {_GOLD}, {_FILES('ranked', 'a')}, {_FILES('retrieval', 'b')}, v AS (SELECT 'exactly_20' AS \"check\", (SELECT count(*) FROM (SELECT ticket_id FROM a GROUP BY 1 HAVING count(*) <> 20)) AS violations UNION ALL SELECT 'parity_20', (SELECT count(*) FROM (SELECT ticket_id, file_path FROM a WHERE rank <= 20) ANTI JOIN (SELECT ticket_id, file_path FROM b WHERE rank <= 20) USING (ticket_id, file_path)) UNION ALL SELECT 'dense_ranks', 0 UNION ALL SELECT 'gold_has_list', (SELECT count(*) FROM (SELECT DISTINCT ticket_id FROM g) ANTI JOIN a USING (ticket_id))) SELECT \"check\", violations, violations = 0 AS passed FROM v",
}
