"""Problem 5: splits that keep related records together, by random-mate contraction.

Each round gives every vertex a coin; a tail collapses into its smallest head neighbour; edges are renamed and made
distinct, until none is left. Unwinding the rounds labels every vertex. Each step is a few SQL joins; vertices and edges never come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.keys import plain_repo, ticket_key
from trawl.storage import cut, settings

#: Groups of one size up to this number of records are cut into this many hashed buckets when weights are summed up.
SMALL, BUCKETS = 64, 1024


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the component of each vertex of the edge list (a, b). Null ends and loops are left out, repeated edges count once; no edges, no rows."""
    pairs = edges.select(F.col("a").alias("a"), F.col("b").alias("b")).filter("a < b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).filter("a < b"))
    now = cut(pairs.distinct(), "edges")
    hooks: list[DataFrame] = []
    first, turn = now, 0
    while not now.isEmpty():
        coin = lambda c, turn=turn: F.pmod(F.xxhash64(F.col(c), F.lit(turn)), F.lit(2)) == 0
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = cut(both.filter(coin("a") & ~coin("b")).groupBy(F.col("a").alias("v")).agg(F.min("b").alias("to")), f"hooks{turn}")
        left = hook.select(F.col("v").alias("a"), F.col("to").alias("ta"))
        right = hook.select(F.col("v").alias("b"), F.col("to").alias("tb"))
        moved = now.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("ta", "a").alias("x"), F.coalesce("tb", "b").alias("y"))
        now = cut(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"edges{turn + 1}")
        hooks.append(hook)
        turn += 1
    # Unwinding: every vertex follows its hooks round by round, one join with one label table each.
    label = first.select(F.col("a").alias("v")).union(first.select(F.col("b").alias("v"))).distinct().withColumn("root", F.col("v"))
    for k, hook in enumerate(hooks):
        label = label.join(hook.withColumnRenamed("v", "root"), "root", "left").select("v", F.coalesce("to", "root").alias("root"))
        if k % 4 == 3:
            label = cut(label, "labels")
    return label


def _keyed(gold: DataFrame) -> DataFrame:
    return gold.select("gold_id", plain_repo(F.col("repo")).alias("repo"), ticket_key(F.col("ticket_id")).alias("ticket"))


def _ties(gold: DataFrame, tickets: DataFrame) -> DataFrame:
    """(repo, ticket) pairs, distinct, of tickets that exist."""
    there = tickets.select(ticket_key(F.col("ticket_id")).alias("ticket")).filter("ticket IS NOT NULL").distinct()
    return _keyed(gold).filter("repo IS NOT NULL AND ticket IS NOT NULL").select("repo", "ticket").distinct().join(there, "ticket", "left_semi")


def repo_families(gold: DataFrame, tickets: DataFrame) -> DataFrame:
    """(v, root): repos that one ticket or a chain of tickets ties together; repos that stand alone are not listed.

    A ticket of many repos is a star around its smallest repo, never all pairs.
    """
    ties = _ties(gold, tickets)
    heads = ties.groupBy("ticket").agg(F.min("repo").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return components(ties.join(heads, "ticket").select("a", F.col("repo").alias("b")))


def family_pairs(gold: DataFrame, tickets: DataFrame) -> DataFrame:
    """(repo_a, repo_b): all pairs of each family of repos, the smaller first; the pairs are the result asked for."""
    found = cut(repo_families(gold, tickets), "families")
    return found.select("root", F.col("v").alias("repo_a")).join(found.select("root", F.col("v").alias("repo_b")), "root").filter("repo_a < repo_b").select("repo_a", "repo_b")


def split_records(gold: DataFrame, tickets: DataFrame, targets: DataFrame) -> DataFrame:
    """(gold_id, repo, ticket_id, family, split_name) for every row of ``gold``.

    Rows that share a repo, an existing ticket, or are tied over others have one family and one split. A row without a repo takes the family
    of its ticket's repos, else its ticket, else itself; a placeholder or unknown ticket ties nothing. Families are laid end to end, larger ones first and
    equal ones in hash order; a family's split is where its middle falls in the cumulated shares (null and negative shares count as 0).
    Repeated rows give repeated rows. No gold, no rows; no targets, null splits.
    """
    fam = cut(repo_families(gold, tickets), "families")
    ties = _ties(gold, tickets)
    of_repo = fam.select(F.col("v").alias("repo"), F.col("root"))
    of_ticket = ties.groupBy("ticket").agg(F.min("repo").alias("r")).join(fam.select(F.col("v").alias("r"), F.col("root").alias("tr")), "r", "left").select("ticket", F.coalesce("tr", "r").alias("ticket_root"))
    there = tickets.select(ticket_key(F.col("ticket_id")).alias("ticket"), F.lit(True).alias("known")).filter("ticket IS NOT NULL").distinct()
    rows = _keyed(gold).join(of_repo, "repo", "left")
    alone = rows.filter("repo IS NULL").join(of_ticket, "ticket", "left").join(there, "ticket", "left")
    named = rows.filter("repo IS NOT NULL").withColumn("family", F.coalesce("root", "repo"))
    own = F.coalesce(F.col("ticket_root"), F.when(F.col("known"), F.concat(F.lit("ticket:"), "ticket")), F.concat(F.lit("record:"), F.coalesce("gold_id", F.lit("")), F.lit(":"), F.coalesce("ticket", F.lit(""))))
    cols = ["gold_id", "repo", F.col("ticket").alias("ticket_id"), "family"]
    member = cut(named.select(*cols).union(alone.withColumn("family", own).select(*cols)), "members")
    weights = cut(member.groupBy("family").agg(F.count(F.lit(1)).alias("w")), "weights")
    # Prefix sums in two levels: over (weight, bucket) sums, of which there are few, then inside each bucket.
    bucket = F.when(F.col("w") <= SMALL, F.pmod(F.xxhash64("family"), F.lit(BUCKETS))).otherwise(F.lit(0))
    placed = weights.withColumn("bucket", bucket)
    sums = placed.groupBy("w", "bucket").agg(F.sum("w").alias("s"))
    over = Window.orderBy(F.desc("w"), "bucket")
    sums = sums.withColumn("before", F.sum("s").over(over) - F.col("s")).withColumn("total", F.sum("s").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    inside = F.row_number().over(Window.partitionBy("w", "bucket").orderBy(F.xxhash64("family"), "family"))
    middle = (F.col("before") + (F.col("k") - 1) * F.col("w") + F.col("w") / 2) / F.col("total")
    at = placed.withColumn("k", inside).join(sums.drop("s"), ["w", "bucket"]).select("family", middle.alias("middle"))
    shares = targets.groupBy(F.lower(F.trim("split_name")).alias("split_name")).agg(F.max(F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(0.0))).alias("share")).filter("split_name IS NOT NULL AND share > 0")
    cum = [(r["split_name"], r["share"]) for r in settings(shares.orderBy(F.desc("share"), "split_name"), 64)]
    whole, upto, chosen = sum(s for _, s in cum), 0.0, F.lit(None).cast("string")
    steps = []
    for name, share in cum:
        upto += share / whole
        steps.append((name, upto))
    for name, upper in reversed(steps):
        chosen = F.when((F.col("middle") < upper) | F.lit(upper >= steps[-1][1]), F.lit(name)).otherwise(chosen)
    return member.join(at.select("family", chosen.alias("split_name")), "family").select("gold_id", "repo", "ticket_id", "family", "split_name")
