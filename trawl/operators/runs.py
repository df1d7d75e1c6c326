"""Batch runs: selection of tickets, resume, failure rows, identity of the method, shards and their merge, memoised rankings, state tokens."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.operators.relations import SNAPSHOT
from trawl.storage import cut
from trawl.streaming.resume import existing

#: What a mode sets.
EXPANSIONS = {"off": {"exact": 0.0, "leaf": 0.0, "cap": 0.0}, "exact": {"exact": 0.06, "leaf": 0.0, "cap": 0.10}, "definition": {"exact": 0.06, "leaf": 0.04, "cap": 0.10}}
GRAPHS = {"off": {"top": 0}, "top3": {"top": 3}, "top5": {"top": 5}}
RANKINGS = ("tfidf", "weighted", "hybrid")


def mode(name: str, table: dict[str, dict[str, float]]) -> dict[str, float]:
    """The parameters of a mode; an unknown one is an error."""
    if name not in table:
        raise ValueError(f"unknown mode {name!r}; known: {', '.join(sorted(table))}")
    return table[name]


def method_id(settings: dict[str, object]) -> str:
    """The identity of a method: a digest of its settings, whatever their order."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def select_tickets(tickets: DataFrame, ids: DataFrame | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Tickets in the order of their ids: those of ``ids`` only if given, then without the first ``offset``, then at most ``limit`` (each a feature of the caller)."""
    rows = tickets.filter("ticket_id IS NOT NULL")
    if ids is not None:
        rows = rows.join(ids.select("ticket_id").distinct(), "ticket_id", "left_semi")
    rows = rows.orderBy("ticket_id")
    if offset:
        rows = rows.offset(offset)
    return rows if limit is None else rows.limit(limit)


def run_batch(tickets: DataFrame, rank: Callable[[DataFrame], DataFrame], target: str, method: str) -> tuple[DataFrame, DataFrame]:
    """(predictions, failures) of ``target`` after ranking the tickets that it lacks.

    ``rank`` turns tickets into rows with a ticket_id. A ticket without any row is a failure row, so every ticket is in one of the two tables and none is tried again. A target that another method
    wrote is an error. Both tables are appended once per call and keep the method's id.
    """
    spark = tickets.sparkSession
    ids = tickets.select("ticket_id").filter("ticket_id IS NOT NULL").distinct()
    done = [x for x in (existing(spark, f"{target}/predictions"), existing(spark, f"{target}/failures")) if x is not None]
    for x in done:
        if not x.filter(F.col("method_id") != method).isEmpty():
            raise ValueError("the target holds rows of another method")
        ids = ids.join(x.select("ticket_id").distinct(), "ticket_id", "left_anti")
    # Written before the target changes: Spark takes two scans of one path for the same, whatever was appended between them.
    ids = cut(ids, "todo")
    asked = tickets.join(ids, "ticket_id", "left_semi")
    found = rank(asked).join(ids, "ticket_id", "left_semi").withColumn("method_id", F.lit(method))
    found.write.mode("append").parquet(f"{target}/predictions")
    now = spark.read.schema(found.schema).parquet(f"{target}/predictions")
    failed = ids.join(now.select("ticket_id").distinct(), "ticket_id", "left_anti").withColumns({"reason": F.lit("no_candidates"), "method_id": F.lit(method)})
    failed.write.mode("append").parquet(f"{target}/failures")
    return spark.read.schema(found.schema).parquet(f"{target}/predictions"), spark.read.schema(failed.schema).parquet(f"{target}/failures")


def shard_of(repo: Column, shards: int) -> Column:
    """The shard of a repository: the same in any engine."""
    return F.conv(F.substring(F.md5(F.coalesce(repo, F.lit(""))), 1, 8), 16, 10).cast("bigint") % shards


def merge_shards(shards: DataFrame, tickets: DataFrame) -> DataFrame:
    """(place, ticket_id, shard, ...): the rows of all shards in the order of ``tickets`` (ticket_id, ordinal); a ticket that several shards have keeps the last shard's row.

    ``shards``: shard, ticket_id, method_id and what the rows hold. Rows of more than one method are an error.
    """
    methods = [r[0] for r in shards.select("method_id").distinct().limit(2).collect()]
    if len(methods) > 1:
        raise ValueError("the shards hold rows of several methods")
    last = shards.withColumn("k", F.row_number().over(Window.partitionBy("ticket_id").orderBy(F.desc("shard")))).filter("k = 1").drop("k")
    return tickets.select("ticket_id", "ordinal").join(last, "ticket_id").withColumnRenamed("ordinal", "place")


def union_seen(parts: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows, conflicts): tickets seen in several lists, each once, the last list's row; ids whose lists name different repositories are conflicts. Each part: ticket_id, repo."""
    rows = None
    for k, p in enumerate(parts):
        x = p.select("ticket_id", "repo").filter("ticket_id IS NOT NULL").distinct().withColumn("part", F.lit(k))
        rows = x if rows is None else rows.union(x)
    if rows is None:
        raise ValueError("no lists")
    conflicts = rows.groupBy("ticket_id").agg(F.count_distinct("repo").alias("repos")).filter("repos > 1").select("ticket_id", "repos")
    w = Window.partitionBy("ticket_id").orderBy(F.desc("part"), F.desc_nulls_last("repo"))
    return rows.withColumn("k", F.row_number().over(w)).filter("k = 1").select("ticket_id", "repo", "part"), conflicts


def source_token(files: DataFrame) -> DataFrame:
    """(repo, base_commit, token): a digest of a snapshot's number of files, bytes and last change; a cached result with another token is stale."""
    one = files.groupBy(*SNAPSHOT, "file_path").agg(F.max(F.coalesce(F.octet_length("content"), F.lit(0))).alias("b"), F.max("loaded_at").alias("t"))
    per = one.groupBy(*SNAPSHOT).agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("bytes"), F.max("t").alias("last"))
    return per.select(*SNAPSHOT, F.md5(F.concat_ws(":", F.col("n").cast("string"), F.col("bytes").cast("string"), F.coalesce(F.date_format("last", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("")))).alias("token"))


def memo_rankings(asked: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """(ticket_id, ..., reused): rankings from the table at ``path`` where ticket, snapshot token and report digest agree, the others computed and added to it.

    ``asked``: ticket_id, repo, base_commit, token, report. A stored ticket whose token or report changed is computed again, and only rows of the asked pair count.
    """
    spark: SparkSession = asked.sparkSession
    keys = ["ticket_id", *SNAPSHOT, "token", "report"]
    old = existing(spark, path)
    fresh = asked if old is None else asked.join(old.select(*keys).distinct(), keys, "left_anti")
    stamp = F.lit(0 if old is None else 1)
    rows = compute(fresh).join(fresh.select(*keys), ["ticket_id", *SNAPSHOT]).withColumn("turn", stamp)
    # Tickets without any row are remembered too.
    none = fresh.select(*keys).join(rows.select(*keys).distinct(), keys, "left_anti").withColumn("turn", stamp)
    rows.unionByName(none, allowMissingColumns=True).write.mode("append").parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path).join(asked.select(*keys), keys, "left_semi")
    return stored.withColumn("reused", F.col("turn") < stamp) if old is not None else stored.withColumn("reused", F.lit(False))


def blobs(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, base_commit, file_path, state, bytes): each asked file as its commit has it: found, missing_repo, missing_commit, missing_path or missing_content.

    ``files``: repo, base_commit, file_path, content. The states go from the coarsest to the finest; of repeated rows of a file the longest content counts.
    """
    keys = [*SNAPSHOT, "file_path"]
    repos = files.select("repo").distinct().withColumn("r", F.lit(1))
    commits = files.select(*SNAPSHOT).distinct().withColumn("c", F.lit(1))
    paths = files.groupBy(*keys).agg(F.max(F.octet_length("content")).alias("bytes")).withColumn("p", F.lit(1))
    x = asked.select(*keys).distinct().join(repos, "repo", "left").join(commits, SNAPSHOT, "left").join(paths, keys, "left")
    state = F.when(F.col("r").isNull(), "missing_repo").when(F.col("c").isNull(), "missing_commit").when(F.col("p").isNull(), "missing_path").when(F.col("bytes").isNull(), "missing_content").otherwise("found")
    return x.select(*keys, state.alias("state"), "bytes")


def prompts(reports: DataFrame, candidates: DataFrame, report_chars: int = 4_000, code_chars: int = 800) -> DataFrame:
    """(ticket_id, prompt): report and candidates of a ticket as one text, the report and each code cut to the stated lengths, which is part of the format.

    ``candidates``: ticket_id, rank, file_path, symbol, code, at most a reviewer's batch per ticket.
    """
    entry = F.concat_ws("\n", F.format_string("[%d] %s::%s", "rank", "file_path", F.coalesce("symbol", F.lit(""))), F.substring(F.coalesce("code", F.lit("")), 1, code_chars))
    listed = candidates.groupBy("ticket_id").agg(F.array_sort(F.collect_list(F.struct("rank", entry.alias("e")))).alias("xs"))
    return reports.join(listed, "ticket_id").select("ticket_id", F.concat_ws("\n\n", F.substring("bug_text", 1, report_chars), F.array_join(F.transform("xs", lambda x: x["e"]), "\n")).alias("prompt"))


def expanded(ranked: DataFrame, edges: DataFrame, top: int = 5, outgoing: float = 0.80, incoming: float = 0.65, decay: float = 0.08, scale: float = 0.10, cap: float = 0.08) -> DataFrame:
    """(ticket_id, file_path, signal, bonus): files one import away from a ticket's first files, in either direction; the signal falls with the rank of the file it comes from.

    ``edges``: repo, base_commit, src_file, dst_file; ``ranked``: ticket_id, repo, base_commit, file_path, rank.
    """
    both = edges.select(*SNAPSHOT, F.col("src_file").alias("from_file"), F.col("dst_file").alias("to_file"), F.lit(outgoing).alias("base")).union(edges.select(*SNAPSHOT, "dst_file", "src_file", F.lit(incoming))).filter("from_file <> to_file").distinct()
    refs = ranked.filter(F.col("rank") <= top).select("ticket_id", *SNAPSHOT, F.col("file_path").alias("from_file"), "rank")
    hits = refs.join(both, [*SNAPSHOT, "from_file"])
    best = hits.groupBy("ticket_id", F.col("to_file").alias("file_path")).agg(F.max(F.col("base") * F.greatest(F.lit(0.0), 1 - decay * (F.col("rank") - 1))).alias("signal"))
    return best.select("ticket_id", "file_path", F.round("signal", 6).alias("signal"), F.round(F.least(F.lit(cap), scale * F.col("signal")), 6).alias("bonus"))


def api_expanded(names: DataFrame, links: DataFrame, definitions: DataFrame, wrapper: float = 0.05, reexport: float = 0.04, cap: float = 0.08, most: int = 4) -> DataFrame:
    """(ticket_id, file_path, bonus, evidence): files that implement a public name of the report, over re-exports and wrappers.

    ``names``: ticket_id, repo, base_commit, symbol; ``links``: repo, base_commit, public, implementation, link; ``definitions`` as ``relations.lookup_keys``. A name whose implementation is in more than ``most``
    files says nothing; of a name and file the larger bonus counts, and a file's bonuses add up to the cap.
    """
    leaf = lambda c: F.lower(F.substring_index(c, ".", -1))
    asked = names.withColumn("key", leaf("symbol")).join(links.select(*SNAPSHOT, leaf("public").alias("key"), leaf("implementation").alias("lookup_key"), "link").distinct(), [*SNAPSHOT, "key"])
    hits = asked.join(definitions.select(*SNAPSHOT, "lookup_key", "file_path").distinct(), [*SNAPSHOT, "lookup_key"])
    one = hits.groupBy("ticket_id", *SNAPSHOT, "symbol", "file_path").agg(F.max(F.when(F.col("link") == "wrapper", wrapper).otherwise(reexport)).alias("bonus"))
    spread = one.groupBy("ticket_id", *SNAPSHOT, "symbol").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most).drop("n")
    kept = one.join(spread, ["ticket_id", *SNAPSHOT, "symbol"], "left_semi")
    return kept.groupBy("ticket_id", "file_path").agg(F.round(F.least(F.lit(cap), F.sum("bonus")), 6).alias("bonus"), F.count(F.lit(1)).alias("evidence"))


def file_chunks(files: DataFrame, symbols: DataFrame, size: int = 80, step: int = 60) -> DataFrame:
    """(repo, base_commit, file_path, kind, name, start_line, end_line, digest): every file cut into chunks: its symbols, the lines between its outer ones that are not all blank, else fixed windows.

    ``symbols``: repo, base_commit, file_path, kind, name, start_line, end_line, outer (whether it stands at the outer level). A piece of more than ``size`` lines is cut into windows of ``size`` lines that begin every ``step`` lines.
    """
    keys = [*SNAPSHOT, "file_path"]
    text = F.regexp_replace(F.regexp_replace("content", "\r\n|\r", "\n"), "\n$", "")
    whole = files.filter("content IS NOT NULL AND file_path IS NOT NULL").select(*keys, F.split(text, "\n").alias("lines")).distinct().filter("NOT (size(lines) = 1 AND lines[0] = '')").withColumn("n", F.size("lines"))
    spans = symbols.filter("start_line IS NOT NULL").join(whole.select(*keys, "n"), keys).select(*keys, "kind", "name", F.greatest(F.lit(1), "start_line").alias("a"), F.least("n", "end_line").alias("b"), "outer").distinct()
    outer = spans.filter("outer").select(*keys, "a", "b").distinct()
    ends = whole.join(outer.select(*keys).distinct(), keys, "left_semi").select(*keys, (F.col("n") + 1).alias("a"), (F.col("n") + 1).alias("b"))
    w = Window.partitionBy(*keys).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    between = outer.union(ends).withColumn("top", F.coalesce(F.max("b").over(w), F.lit(0))).filter("a > top + 1").select(*keys, F.lit("module").alias("kind"), F.lit("").alias("name"), (F.col("top") + 1).alias("a"), (F.col("a") - 1).alias("b"))
    filled = between.join(whole.select(*keys, "lines"), keys).filter(F.exists(F.slice("lines", F.col("a"), F.col("b") - F.col("a") + 1), lambda x: F.trim(x) != "")).drop("lines")
    bare = whole.join(spans.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit("chunk").alias("kind"), F.lit("").alias("name"), F.lit(1).alias("a"), F.col("n").alias("b"))
    pieces = spans.drop("outer").union(filled).union(bare)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col("b") - F.col("a") + 1 - size) / step)).cast("int"))
    windows = pieces.select("*", F.explode(starts).alias("i")).select(*keys, "kind", "name", (F.col("a") + F.col("i") * step).alias("start_line"), F.least("b", F.col("a") + F.col("i") * step + size - 1).alias("end_line"))
    return windows.distinct().join(whole.select(*keys, "lines"), keys).select(*keys, "kind", "name", "start_line", "end_line", F.md5(F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")).alias("digest"))


def plain_name(c: Column) -> Column:
    """A symbol as evaluation reads it: what follows ``::``, before a colon, dots for ``#``, no dots in front, lower case."""
    tail = F.element_at(F.split(c, "::"), -1)
    return F.lower(F.regexp_replace(F.replace(F.element_at(F.split(tail, ":"), 1), F.lit("#"), F.lit(".")), r"^\.+", ""))


