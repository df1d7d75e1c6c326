"""Evaluation of ranked lists against gold: matching, first ranks, hit and recall, paired comparison, bootstrap, loss decomposition."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.storage import settings

KS = (1, 3, 5)
#: Tasks over which the samples of a bootstrap are spread.
DRAW_TASKS = 48
CANDIDATES = 20


def ranked_files(rows: DataFrame, list_name: str) -> DataFrame:
    """(ticket_id, file_path, rank): files of one list by best valid score, lowest rank, path; ranks are given after removing repeated files."""
    valid = rows.filter((F.col("list_name") == list_name) & F.col("ticket_id").isNotNull() & (F.col("score") >= 0) & (F.col("score") <= 1))
    files = valid.groupBy("ticket_id", T.norm_path(F.col("file_path")).alias("file_path")).agg(F.max("score").alias("score"), F.min(F.coalesce("rank", F.lit(2**31 - 1))).alias("r"))
    w = Window.partitionBy("ticket_id").orderBy(F.desc("score"), "r", "file_path")
    return files.select("ticket_id", "file_path", "score", F.row_number().over(w).alias("rank"))


def gold_files(rows: DataFrame, list_name: str = "candidate") -> DataFrame:
    """(ticket_id, gold_file): distinct normalised files of the list that stands for gold."""
    return rows.filter((F.col("list_name") == list_name) & F.col("ticket_id").isNotNull()).select("ticket_id", T.norm_path(F.col("file_path")).alias("gold_file")).distinct()


def aligned(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(ticket_id, gold, candidates, missing): every gold ticket stays, with or without a prediction."""
    g = gold.groupBy("ticket_id").agg(F.count(F.lit(1)).alias("gold"))
    p = predicted.groupBy("ticket_id").agg(F.count(F.lit(1)).alias("candidates"))
    return g.join(p, "ticket_id", "left").select("ticket_id", "gold", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.col("candidates").isNull().alias("missing"))


def key_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, ticket_id): keys that one side lacks, and keys that a side has twice; empty if both are the same set."""
    a, b = left.select("ticket_id"), right.select("ticket_id")
    twice = lambda x, s: x.groupBy("ticket_id").count().filter("count > 1").select(F.lit(s).alias("side"), "ticket_id")
    return (
        a.join(b, "ticket_id", "left_anti").distinct().select(F.lit("missing").alias("side"), "ticket_id")
        .union(b.join(a, "ticket_id", "left_anti").distinct().select(F.lit("extra").alias("side"), "ticket_id"))
        .union(twice(a, "repeated_left")).union(twice(b, "repeated_right"))
    )


def matched(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(ticket_id, gold_file, rank): the first rank at which a predicted file equals the gold file or is its tail or the reverse.

    The tail predicate implies equal file names, so the join is on (ticket, file name) and never pairs all rows.
    """
    g = gold.withColumn("name", T.base_name(F.col("gold_file")))
    p = predicted.withColumn("name", T.base_name(F.col("file_path")))
    return g.join(p, ["ticket_id", "name"]).filter(T.same_path(F.col("gold_file"), F.col("file_path"))).groupBy("ticket_id", "gold_file").agg(F.min("rank").alias("rank"))


def ticket_metrics(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row per gold ticket: first relevant rank, reciprocal rank, hit and recall at the candidate depth, top-k hits, outcome. Tickets without prediction count as misses."""
    hits = gold.join(matched(gold, predicted), ["ticket_id", "gold_file"], "left")
    row = hits.groupBy("ticket_id").agg(F.count(F.lit(1)).alias("gold"), F.min("rank").alias("first_rank"), F.count(F.when(F.col("rank") <= CANDIDATES, 1)).alias("found"))
    rr = F.when(F.col("first_rank") <= CANDIDATES, 1 / F.col("first_rank")).otherwise(0.0)
    outcome = F.when(F.col("found") == F.col("gold"), "full").when(F.col("found") > 0, "partial").otherwise("miss")
    tops = [F.coalesce((F.col("first_rank") <= k).cast("int"), F.lit(0)).alias(f"top{k}") for k in KS]
    return row.select("ticket_id", "gold", "first_rank", F.round(rr, 6).alias("rr"), (F.col("found") > 0).cast("int").alias("hit"), F.round(F.col("found") / F.col("gold"), 6).alias("recall"), *tops, outcome.alias("outcome"))


def summary(metrics: DataFrame, by: str | None = None) -> DataFrame:
    """Means and outcome counts, as grand total and, with ``by``, per group: one pass with ROLLUP (the total's group is ``*``)."""
    aggs = [F.count(F.lit(1)).alias("tickets"), *[F.round(F.avg(c), 6).alias(c) for c in ("hit", "recall", "rr", "top1", "top3", "top5")], *[F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in ("full", "partial", "miss")]]
    if by is None:
        return metrics.agg(*aggs)
    return metrics.rollup(by).agg(F.grouping(by).alias("g"), *aggs).withColumn(by, F.when(F.col("g") == 1, "*").otherwise(F.col(by))).drop("g")


def outcome_lists(metrics: DataFrame, k: int = 20) -> DataFrame:
    """(outcome, tickets, first_ids): how many tickets ended so, and the first k ids of each outcome."""
    w = Window.partitionBy("outcome").orderBy("ticket_id")
    heads = metrics.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).groupBy("outcome").agg(F.array_join(F.array_sort(F.collect_list("ticket_id")), ",").alias("first_ids"))
    return metrics.groupBy("outcome").agg(F.count(F.lit(1)).alias("tickets")).join(heads, "outcome")


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """(ticket_id, metric, before, after, delta, bucket) of tickets that both methods have."""
    names = ("hit", "recall", "rr", "top1")
    long = lambda m, out: m.select("ticket_id", *[F.col(n).cast("double").alias(n) for n in names]).unpivot("ticket_id", list(names), "metric", out)
    both = long(a, "before").join(long(b, "after"), ["ticket_id", "metric"])
    bucket = F.when((F.col("before") == 0) & (F.col("after") == 0), "both_miss").when(F.col("after") > F.col("before"), "improved").when(F.col("after") < F.col("before"), "worsened").otherwise("unchanged")
    return both.withColumns({"delta": F.round(F.col("after") - F.col("before"), 6), "bucket": bucket})


def hash_number(*parts: Column) -> Column:
    """A whole number from the first 32 bits of an MD5 digest: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("bigint")


#: Bounds of a 32-bit number from which on a Poisson number of mean 1 is at least 1, 2, 3, ...
POISSON = tuple(int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**32) for k in range(12))


#: Shifts and factors by which a ticket's hash and a resample's number are mixed to 32 bits, and tickets that are mixed at once.
MIX, AT_ONCE = ((15, 2146121005), (13, 1540483477)), 256


def _drawn(frames: Iterator[pd.DataFrame], samples: int, metrics: int) -> Iterator[pd.DataFrame]:
    """Sums of weighted deltas and of weights per resample, one partial table per task: whole-number steps on arrays, which any engine repeats."""
    import numpy as np

    low = np.uint64((1 << 32) - 1)
    number = np.arange(samples, dtype=np.uint64) * np.uint64(2654435761)
    sums = np.zeros((2 * metrics, samples))
    for f in frames:
        values = f[[f"d{k}" for k in range(metrics)]].to_numpy(float)
        both = np.hstack([np.nan_to_num(values), ~np.isnan(values)])
        for i in range(0, len(f), AT_ONCE):
            x = (f["h"].to_numpy(np.uint64)[i : i + AT_ONCE, None] + number) & low
            for shift, factor in MIX:
                x = ((x ^ (x >> np.uint64(shift))) * np.uint64(factor)) & low
            x ^= x >> np.uint64(16)
            weight = np.zeros(x.shape, np.int8)
            for t in POISSON:
                weight += x >= np.uint64(t)
            sums += both[i : i + AT_ONCE].T @ weight
    out = {"s": np.arange(samples, dtype=np.int32)} | {f"{c}{k}": sums[k + (metrics if c == "w" else 0)] for c in "tw" for k in range(metrics)}
    yield pd.DataFrame(out)


def bootstrap(deltas: DataFrame, samples: int, seed: int) -> DataFrame:
    """(metric, n, mean, low, high): percentile interval of the mean delta over ``samples`` resamples.

    In a resample each ticket counts as often as a Poisson number of mean 1 says, drawn by hash of seed, ticket and sample; so tickets never have to
    meet, and sums are made per sample where the tickets are. All metrics of a ticket share its draws, as a paired comparison needs. Tickets whose
    deltas are null are left out; no tickets, no rows.
    """
    metrics = [r["metric"] for r in settings(deltas.select("metric").distinct().orderBy("metric"), 64)]
    if not metrics:
        return deltas.select("metric", F.lit(0).cast("bigint").alias("n"), *[F.lit(0.0).alias(c) for c in ("mean", "low", "high")]).limit(0)
    wide = deltas.groupBy("ticket_id").agg(*[F.max(F.when(F.col("metric") == m, F.col("delta"))).alias(f"d{k}") for k, m in enumerate(metrics)])
    base = wide.repartition(DRAW_TASKS, "ticket_id").select(hash_number(F.lit(str(seed)), F.col("ticket_id")).alias("h"), *[f"d{k}" for k in range(len(metrics))])
    cols = [f"t{k}" for k in range(len(metrics))] + [f"w{k}" for k in range(len(metrics))]
    parts = base.mapInPandas(lambda it: _drawn(it, samples, len(metrics)), "s int, " + ", ".join(f"{c} double" for c in cols))
    per = parts.groupBy("s").agg(*[F.sum(c).alias(c) for c in cols])
    means = per.select("s", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"t{k}").alias("t"), F.col(f"w{k}").alias("w")) for k, m in enumerate(metrics)])).alias("x")).filter("x.w > 0").select("s", "x.metric", F.round(F.col("x.t") / F.col("x.w"), 9).alias("m"))
    place = Window.partitionBy("metric").orderBy("m", "s")  # one row per sample, whatever the number of tickets
    low, high = int(0.025 * samples), int(0.975 * samples)
    at = means.withColumn("p", F.row_number().over(place) - 1).groupBy("metric").agg(F.max(F.when(F.col("p") == low, F.col("m"))).alias("low"), F.max(F.when(F.col("p") == high, F.col("m"))).alias("high"))
    n = deltas.groupBy("metric").agg(F.count("delta").alias("n"), F.avg("delta").alias("mean"))
    return n.join(at, "metric").select("metric", "n", F.round("mean", 6).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def symbol_ranks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gold symbols, ranked symbols): the candidate list stands for gold, the ranked list is judged; kinds are compared in lower case."""
    key = lambda c: T.symbol_key(F.col(c))
    kind = F.lower(F.trim(F.coalesce("symbol_kind", F.lit(""))))
    base = rows.filter("ticket_id IS NOT NULL").select("ticket_id", "list_name", T.norm_path(F.col("file_path")).alias("file_path"), key("symbol_qualified_name").alias("name"), kind.alias("kind"), F.when((F.col("score") >= 0) & (F.col("score") <= 1), F.col("score")).alias("score"), "rank")
    gold = base.filter("list_name = 'candidate'").select("ticket_id", "file_path", "name", "kind").distinct()
    best = base.filter("list_name = 'ranked' AND score IS NOT NULL").groupBy("ticket_id", "file_path", "name", "kind").agg(F.max("score").alias("score"), F.min(F.coalesce("rank", F.lit(2**31 - 1))).alias("r"))
    w = Window.partitionBy("ticket_id").orderBy(F.desc("score"), "r", "file_path", "name", "kind")
    return gold, best.select("ticket_id", "file_path", "name", "kind", F.row_number().over(w).alias("rank"))


def symbol_matches(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(ticket_id, file_path, name, kind, exact_rank, relaxed_rank): exact needs file, name and kind; relaxed only the same leaf, and modules match modules only. The join key is the leaf, which both imply."""
    leaf = lambda x: x.withColumn("leaf", F.substring_index("name", ".", -1)).withColumn("module", F.col("kind") == "module")
    p = leaf(predicted).select("ticket_id", "leaf", "module", F.col("file_path").alias("pf"), F.col("name").alias("pn"), F.col("kind").alias("pk"), "rank")
    both = leaf(gold).join(p, ["ticket_id", "leaf", "module"], "left")
    exact = (F.col("pf") == F.col("file_path")) & (F.col("pn") == F.col("name")) & (F.col("pk") == F.col("kind"))
    return both.groupBy("ticket_id", "file_path", "name", "kind").agg(F.min(F.when(exact, F.col("rank"))).alias("exact_rank"), F.min("rank").alias("relaxed_rank"))


def symbol_metrics(matches: DataFrame) -> DataFrame:
    """Means over tickets of exact and relaxed hit at 1, 3, 5 and recall at 10 and 30."""
    at = lambda c, k: F.max(F.coalesce((F.col(c) <= k).cast("int"), F.lit(0)))
    part = lambda c, k: F.avg(F.coalesce((F.col(c) <= k).cast("int"), F.lit(0)))
    cols = {f"{n}_hit{k}": at(f"{n}_rank", k) for n in ("exact", "relaxed") for k in KS} | {f"{n}_recall{k}": part(f"{n}_rank", k) for n in ("exact", "relaxed") for k in (10, 30)}
    per = matches.groupBy("ticket_id").agg(*[c.alias(n) for n, c in cols.items()])
    return per.agg(F.count(F.lit(1)).alias("tickets"), *[F.round(F.avg(n), 6).alias(n) for n in cols])


def loss(matches: DataFrame, predicted_files: DataFrame, pool: DataFrame, depth: int = 30) -> DataFrame:
    """(label, n): where each gold symbol was lost: file not ranked, not in the pool, ranked too low, or found."""
    files = predicted_files.select("ticket_id", F.col("file_path"), F.lit(1).alias("f"))
    names = pool.select("ticket_id", "name", F.lit(1).alias("p")).distinct()
    x = matches.join(files, ["ticket_id", "file_path"], "left").join(names, ["ticket_id", "name"], "left")
    label = F.when(F.col("exact_rank") <= 5, "found").when(F.col("exact_rank") <= depth, "rerank_loss").when(F.col("exact_rank").isNotNull(), "ranking_loss").when(F.col("p") == 1, "file_loss").when(F.col("f") == 1, "pool_loss").otherwise("coverage_loss")
    return x.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def confidence(ranked: DataFrame, gate: DataFrame) -> DataFrame:
    """(ticket_id, score, margin, level, policy): rule gate over the first two files of a ticket and its input gate; a column ``stack`` of ``ranked``, if there is one, is the trace evidence of the file."""
    stack = F.coalesce("stack", F.lit(0.0)) if "stack" in ranked.columns else F.lit(0.0)
    w = Window.partitionBy("ticket_id").orderBy("rank")
    top = ranked.withColumn("next", F.lead("score").over(w)).filter("rank = 1")
    rows = top.join(gate, "ticket_id", "left")
    margin = F.round(F.greatest(F.lit(0.0), F.col("score") - F.coalesce("next", F.lit(0.0))), 4)
    level = (
        F.when((F.coalesce("status", F.lit("error")) == "error") | T.test_like(F.col("file_path")), "low")
        .when((F.col("score") >= 0.55) & (F.col("path_hint") | (stack >= 0.55)) & ((F.col("score") - F.coalesce("next", F.lit(0.0)) >= 0.02) | (stack >= 0.75)), "high")
        .when(F.col("score") >= 0.25, "medium").otherwise("low")
    )
    policy = F.when(level == "high", "allow_patch_suggestion").when(level == "medium", "manual_review_before_patch").otherwise("block_patch_generation")
    return rows.select("ticket_id", F.round("score", 4).alias("score"), margin.alias("margin"), level.alias("level"), policy.alias("policy"))
