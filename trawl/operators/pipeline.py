"""Whole pipelines and protocol gates: report to files to symbols, blending of reviewed scores, incremental indexing, slot selection, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.operators import evaluation as E
from trawl.operators import projections as P
from trawl.operators import retrieval as R
from trawl.storage import cut

#: Weights of retrieval and of reviewed scores, and rows of a review batch.
BLEND, BATCH = (0.70, 0.30), 5
#: Fixed value: files of a ticket whose scores count.
FILES = 20
#: Weights of the structured symbol score.
SYMBOL_WEIGHTS = {"cosine": 0.50, "keyword": 0.20, "trace": 0.15, "symbol": 0.10, "file_score": 0.05}
#: Of them those that a chunk has.
SIGNALS = ("cosine", "keyword", "trace", "symbol")


def localize(tickets: DataFrame, chunks: DataFrame, files: int = 5, symbols: int = 5) -> DataFrame:
    """(ticket_id, place, chunk_id, file_path, file_rank, score, level, policy): all signals give the best files of each ticket, the structured symbol score the best symbols in them.

    A ticket whose input gate says error has no rows; level and policy are those of the confidence gate over the ticket's files.
    """
    # Chunks stay in their file's row until the file has its rank: of a file only its best symbols can be among the ticket's best.
    filed = _structured(R.files_with_chunks(R.weighted(tickets, chunks), *SIGNALS)).filter(F.col("rank") <= FILES)
    order = F.transform("xs", lambda x: F.struct((-x["b1"]).alias("b"), x["kind_rank"].alias("kind_rank"), x["span"].alias("span"), x["chunk_id"].alias("chunk_id")))
    few = F.when(F.col("rank") <= files, F.slice(F.array_sort(order), 1, symbols))
    best = cut(filed.select("ticket_id", "file_path", "rank", F.col("file_score").alias("score"), F.col("xs")[0]["trace"].alias("stack"), few.alias("few")), "files", compression="zstd")
    gate = P.gated_input(tickets)
    sure = E.confidence(best.drop("few"), gate).select("ticket_id", "level", "policy")
    allowed = gate.filter("status <> 'error'").select("ticket_id").join(sure, "ticket_id")
    inside = best.select("ticket_id", "file_path", F.col("rank").alias("file_rank"), F.explode("few").alias("x")).select("ticket_id", "file_path", "file_rank", (-F.col("x.b")).alias("score"), "x.kind_rank", "x.span", "x.chunk_id")
    top = R.ranked(inside, "score", symbols).withColumnRenamed("rank", "place")
    return top.join(allowed, "ticket_id").select("ticket_id", "place", "chunk_id", "file_path", "file_rank", "score", "level", "policy")


def _structured(filed: DataFrame) -> DataFrame:
    """Files with b1 in their chunks, the structured symbol score over the signals and, of the first files, the file's score."""
    file = F.when(F.col("rank") <= FILES, F.col("file_score")).otherwise(F.lit(0.0))
    b1 = lambda x: F.round(sum(F.lit(w) * (file if c == "file_score" else x[c]) for c, w in SYMBOL_WEIGHTS.items()), 8)
    return filed.withColumn("xs", F.transform("xs", lambda x: x.withField("b1", b1(x))))


def symbol_scores(tickets: DataFrame, chunks: DataFrame, k: int = 30) -> DataFrame:
    """(ticket_id, rank, chunk_id, b1): the structured symbol score, k per ticket: text .50, terms .20, trace .15, name .10, file .05."""
    x = _structured(R.files_with_chunks(R.weighted(tickets, chunks), *SIGNALS)).select("ticket_id", F.explode("xs").alias("x"))
    return R.ranked(x.select("ticket_id", "x.chunk_id", "x.kind_rank", "x.span", "x.b1"), "b1", k).select("ticket_id", "rank", "chunk_id", "b1")


def blended(rows: DataFrame) -> DataFrame:
    """(ticket_id, item, rank, batch, retrieval, reviewed, blend, accepted): retrieval and reviewed scores blended where every batch of the ticket is valid.

    A batch is valid if each of its rows has a review score between 0 and 1; one invalid batch sends the whole ticket back to its retrieval scores.
    """
    x = rows.withColumn("batch", F.floor((F.col("rank") - 1) / BATCH))
    good = F.coalesce((F.col("reviewed") >= 0) & (F.col("reviewed") <= 1), F.lit(False))
    ok = F.min(good.cast("int")).over(Window.partitionBy("ticket_id")) == 1
    mixed = F.when(ok, BLEND[0] * F.col("retrieval") + BLEND[1] * F.col("reviewed")).otherwise(F.col("retrieval"))
    return x.select("ticket_id", "item", "rank", "batch", "retrieval", "reviewed", F.round(mixed, 8).alias("blend"), ok.alias("accepted"))


def reserved_slots(rows: DataFrame, k: int) -> DataFrame:
    """(ticket_id, place, file_path, name, kind): the first module symbol of every file is sure of a slot, the others follow by rank, k per ticket; a ticket with at most k rows keeps its order."""
    first = Window.partitionBy("ticket_id", "file_path", F.col("kind") == "module").orderBy("rank")
    whole = F.count(F.lit(1)).over(Window.partitionBy("ticket_id"))
    x = rows.withColumn("sure", ((F.col("kind") == "module") & (F.row_number().over(first) == 1) & (whole > k)).cast("int"))
    w = Window.partitionBy("ticket_id").orderBy(F.desc("sure"), "rank")
    return x.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("ticket_id", "place", "file_path", "name", "kind")


def incremental(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(repo, base_commit, file_path, action): reuse where the content digest is unchanged, rebuild where it changed or is new, drop where the file is gone."""
    d = lambda x: x.filter("content IS NOT NULL").groupBy("repo", "base_commit", "file_path").agg(F.max(F.sha2("content", 256)).alias("h"))
    keys = ["repo", "base_commit", "file_path"]
    both = d(previous).withColumnRenamed("h", "a").join(d(current).withColumnRenamed("h", "b"), keys, "full_outer")
    action = F.when(F.col("b").isNull(), "drop").when(F.col("a") == F.col("b"), "reuse").otherwise("rebuild")
    return both.select(*keys, action.alias("action"))


def gates(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """(check, violations, passed): one row per named frame of violations; a gate holds if its frame is empty."""
    out = None
    for name, frame in checks:
        row = frame.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations", (F.col("violations") == 0).alias("passed"))
        out = row if out is None else out.union(row)
    return out
