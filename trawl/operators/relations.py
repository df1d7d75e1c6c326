"""Joins, windows, groupings, sampling and set operations over the domain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.functions.keys import plain_snapshot
from trawl.operators import projections as P
from trawl.operators.evaluation import hash_number

SNAPSHOT = ["repo", "base_commit"]


# --- symbols and lookups ------------------------------------------------------------------------------------------------------
def definitions(chunks: DataFrame) -> DataFrame:
    """(snapshot, file_path, name, kind, start_line, end_line): chunks of one symbol merged, with its qualified name in lower case."""
    name = F.concat_ws(".", F.nullif(F.col("class_name"), F.lit("")), F.nullif(F.col("function_name"), F.lit("")))
    rows = chunks.select(*SNAPSHOT, "file_path", F.lower(name).alias("name"), F.lower(F.trim("symbol_kind")).alias("kind"), F.least("start_line", "end_line").alias("a"), F.greatest("start_line", "end_line").alias("b")).filter("name <> ''")
    return rows.groupBy(*SNAPSHOT, "file_path", "name", "kind").agg(F.min("a").alias("start_line"), F.max("b").alias("end_line"))


def lookup_keys(defs: DataFrame) -> DataFrame:
    """(snapshot, lookup_key, file_path, name): the qualified name and its leaf as keys."""
    keys = F.array_distinct(F.array("name", F.substring_index("name", ".", -1)))
    return defs.select(*SNAPSHOT, F.explode(keys).alias("lookup_key"), "file_path", "name").distinct()


#: Heads of dotted names that say nothing, and leaves too common to be looked up alone.
NO_RECEIVERS = ("self", "other", "cls", "super")
GENERIC_LEAVES = (
    "check copy data fit fits flush from_columns getdata group html info masked name quantity read to_table unit units version view wcs write writeto"
).split()


def telling(symbol: Column) -> Column:
    """Whether the leaf of a dotted name may be looked up alone: its head is a name of its own, its leaf neither common nor shorter than five letters."""
    head, leaf = F.substring_index(symbol, ".", 1), F.substring_index(symbol, ".", -1)
    return ~head.isin(*NO_RECEIVERS) & (F.length(head) > 1) & ~leaf.isin(*GENERIC_LEAVES) & (F.length(leaf) >= 5)


def lookup_fallback(names: DataFrame, keys: DataFrame, max_files: int = 4, exact: float = 0.06, leaf: float = 0.04, cap: float = 0.10, policy: str = "all") -> DataFrame:
    """(ticket_id, file_path, bonus, evidence): names that hit definitions, by exact key first and by leaf for dotted names that found nothing.

    A name that hits more than ``max_files`` files says nothing and is skipped; bonuses of a file add up to the cap. ``policy`` says which leaves are looked up: all, guarded
    (those of ``telling`` names) or none.
    """
    hit = lambda n, key, value: n.join(keys.withColumnRenamed("lookup_key", key), [*SNAPSHOT, key]).select("ticket_id", *SNAPSHOT, "symbol", "file_path", F.lit(value).alias("bonus")).distinct()
    first = hit(names.withColumn("key", F.col("symbol")), "key", exact)
    rest = names.join(first.select("ticket_id", *SNAPSHOT, "symbol").distinct(), ["ticket_id", *SNAPSHOT, "symbol"], "left_anti").filter(F.col("symbol").contains("."))
    if policy not in ("all", "guarded", "none"):
        raise ValueError(f"unknown policy {policy!r}")
    rest = rest.filter(telling(F.col("symbol"))) if policy == "guarded" else rest.filter(F.lit(policy == "all"))
    second = hit(rest.withColumn("key", F.substring_index("symbol", ".", -1)), "key", leaf)
    both = first.union(second)
    spread = both.groupBy("ticket_id", *SNAPSHOT, "symbol").agg(F.count_distinct("file_path").alias("files"))
    kept = both.join(spread.filter(F.col("files") <= max_files), ["ticket_id", *SNAPSHOT, "symbol"])
    return kept.groupBy("ticket_id", "file_path").agg(F.round(F.least(F.lit(cap), F.sum("bonus")), 6).alias("bonus"), F.count(F.lit(1)).alias("evidence"))


def report_symbols(tickets: DataFrame) -> DataFrame:
    """(ticket_id, snapshot, symbol): code-like names of the report, the first ones only (see ``program_names``)."""
    found = plain_snapshot(tickets).filter("repo IS NOT NULL").select("ticket_id", *SNAPSHOT, P.bug_text(tickets).alias("text")).distinct()
    return found.select("ticket_id", *SNAPSHOT, F.explode(T.program_names(F.col("text"))).alias("symbol")).distinct()


# --- graphs -------------------------------------------------------------------------------------------------------------------
def call_edges(chunks: DataFrame) -> DataFrame:
    """(snapshot, caller_file, target_file, call_name): calls whose name exactly one other place of the snapshot defines."""
    calls = chunks.select(*SNAPSHOT, F.col("file_path").alias("caller_file"), F.explode(F.array_distinct(F.regexp_extract_all(T.text_or_empty(F.col("code_text")), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), F.lit(1)))).alias("call_name")).distinct()
    owners = chunks.filter("function_name <> ''").groupBy(*SNAPSHOT, F.col("function_name").alias("call_name")).agg(F.count_distinct("file_path").alias("n"), F.min("file_path").alias("target_file")).filter("n = 1").drop("n")
    return calls.join(owners, [*SNAPSHOT, "call_name"]).filter("caller_file <> target_file").select(*SNAPSHOT, "caller_file", "target_file", "call_name").distinct()


def transposed(edges: DataFrame) -> DataFrame:
    """(snapshot, file_path, incoming, outgoing): degrees of the graph and of its transpose."""
    out = edges.select(*SNAPSHOT, F.col("caller_file").alias("file_path"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    inn = edges.select(*SNAPSHOT, F.col("target_file").alias("file_path"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    return out.union(inn).groupBy(*SNAPSHOT, "file_path").agg(F.sum("i").alias("incoming"), F.sum("o").alias("outgoing"))


def one_hop(ranked: DataFrame, edges: DataFrame, top: int = 5, signal: float = 0.9, decay: float = 0.08, scale: float = 0.08, hub: int = 8) -> DataFrame:
    """(ticket_id, target_file, signal, bonus): files called from a ticket's first files; the signal falls with the reference's rank, a reference with more than ``hub`` target files is skipped whole."""
    refs = ranked.filter(F.col("rank") <= top).select("ticket_id", *SNAPSHOT, F.col("file_path").alias("caller_file"), "rank")
    pairs = edges.select(*SNAPSHOT, "caller_file", "target_file").distinct()
    small = pairs.groupBy(*SNAPSHOT, "caller_file").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= hub).drop("n")
    hits = refs.join(small, [*SNAPSHOT, "caller_file"]).join(pairs, [*SNAPSHOT, "caller_file"])
    best = hits.groupBy("ticket_id", "target_file").agg(F.max(signal * F.greatest(F.lit(0.0), 1 - decay * (F.col("rank") - 1))).alias("signal"))
    return best.select("ticket_id", "target_file", F.round("signal", 6).alias("signal"), F.round(scale * F.col("signal"), 6).alias("bonus"))


def adjacency(edges: DataFrame, peers: int = 5) -> DataFrame:
    """(snapshot, file_path, degree, peers): undirected neighbours of each file, the first few by name."""
    both = edges.select(*SNAPSHOT, F.col("caller_file").alias("file_path"), F.col("target_file").alias("peer")).union(edges.select(*SNAPSHOT, "target_file", "caller_file")).distinct()
    w = Window.partitionBy(*SNAPSHOT, "file_path").orderBy("peer")
    rows = both.withColumn("n", F.row_number().over(w))
    return rows.groupBy(*SNAPSHOT, "file_path").agg(F.count(F.lit(1)).alias("degree"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") <= peers, F.col("peer")))), ",").alias("peers"))


def longest_prefix(names: DataFrame, modules: DataFrame, most: int = 4) -> DataFrame:
    """(module, file_path, parts): for a dotted name the first files (by name) whose dotted module is its longest known prefix; every prefix is an equi join key."""
    parts = F.split("module", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("parts"), F.array_join(F.slice(parts, 1, n), ".").alias("prefix")))
    each = names.select("module", F.explode(prefixes).alias("p")).select("module", "p.*")
    hits = each.join(modules.select(F.col("module").alias("prefix"), "file_path").distinct(), "prefix")
    best = hits.groupBy("module").agg(F.max("parts").alias("parts"))
    place = F.row_number().over(Window.partitionBy("module").orderBy("file_path"))
    return hits.join(best, ["module", "parts"]).select("module", "file_path", "parts").distinct().withColumn("k", place).filter(F.col("k") <= most).drop("k")


# --- intervals ------------------------------------------------------------------------------------------------------------------
LINE_BUCKET = 64


def innermost(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """(key, line, name, ties): the shortest interval that contains each line.

    Intervals are spread over buckets of lines, so that the join has (key, bucket) as equi keys and long files do not meet pair by pair.
    """
    spread = intervals.select("key", "name", "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / LINE_BUCKET), F.floor(F.col("end_line") / LINE_BUCKET))).alias("bucket"))
    hits = points.withColumn("bucket", F.floor(F.col("line") / LINE_BUCKET)).join(spread, ["key", "bucket"]).filter(F.col("line").between(F.col("start_line"), F.col("end_line")))
    w = Window.partitionBy("key", "line").orderBy((F.col("end_line") - F.col("start_line")))
    rows = hits.withColumn("r", F.rank().over(w)).filter("r = 1")
    return rows.groupBy("key", "line").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("ties"))


def nearest_disjoint(intervals: DataFrame, reach: int = 100) -> DataFrame:
    """(key, name, start_line, neighbour, gap): the nearest other interval of the same key that is disjoint, before or after, at most ``reach`` lines away; of equal gaps the smaller name.

    gap is the later start less the earlier end. Ends before a start and starts behind an end are found with two running windows, not with a self-join.
    """
    own = intervals.select("key", "name", "start_line", "end_line").distinct()
    w = Window.partitionBy("key").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def side(at: str, edge: str, sign: int) -> DataFrame:
        # Walking up (sign 1): the largest end before each start. Walking down (sign -1): the smallest start behind each end. Of equal edges the smallest name.
        edges = own.groupBy("key", F.col(edge).alias("line")).agg(F.min("name").alias("found")).select("key", (sign * F.col("line")).alias("at"), F.lit(0).alias("side"), F.struct((sign * F.col("line")).alias("at"), "found").alias("e"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("line"))
        asks = own.select("key", (sign * F.col(at) - 1).alias("at"), F.lit(1).alias("side"), F.lit(None).cast("struct<at:int,found:string>").alias("e"), "name", "start_line", F.col(at).alias("line"))
        seen = edges.unionByName(asks).withColumn("b", F.last("e", ignorenulls=True).over(w)).filter("side = 1 AND b IS NOT NULL")
        return seen.select("key", "name", "start_line", F.col("b.found").alias("neighbour"), (sign * F.col("line") - F.col("b.at")).alias("gap"))

    both = side("start_line", "end_line", 1).union(side("end_line", "start_line", -1)).filter(F.col("gap").between(1, reach))
    best = both.groupBy("key", "name", "start_line").agg(F.min(F.struct("gap", "neighbour")).alias("x"))
    return best.select("key", "name", "start_line", "x.neighbour", "x.gap")


def gaps(chunks: DataFrame) -> DataFrame:
    """(snapshot, file_path, gap_start, gap_end): lines between the spans of a file's named symbols."""
    spans = chunks.filter("start_line IS NOT NULL AND end_line IS NOT NULL AND (function_name <> '' OR class_name <> '')").select(*SNAPSHOT, "file_path", F.least("start_line", "end_line").alias("s"), F.greatest("start_line", "end_line").alias("e")).distinct()
    w = Window.partitionBy(*SNAPSHOT, "file_path").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.withColumn("top", F.coalesce(F.max("e").over(w), F.lit(0)))
    return rows.filter("s > top + 1").select(*SNAPSHOT, "file_path", (F.col("top") + 1).alias("gap_start"), (F.col("s") - 1).alias("gap_end"))


def line_windows(files: DataFrame, size: int = 80, step: int = 60) -> DataFrame:
    """(snapshot, file_path, start_line, end_line, digest): sliding windows of lines that stop when the end is reached."""
    lines = F.split(F.replace("content", F.lit("\r\n"), F.lit("\n")), "\n")
    rows = files.filter("content IS NOT NULL").select(*SNAPSHOT, "file_path", lines.alias("lines")).withColumn("n", F.size("lines"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col("n") - size) / step)).cast("int"))
    cut = rows.select(*SNAPSHOT, "file_path", "lines", "n", F.explode(starts).alias("i"))
    start = F.col("i") * step + 1
    return cut.select(*SNAPSHOT, "file_path", start.alias("start_line"), F.least(F.col("n"), start + size - 1).alias("end_line"), F.md5(F.array_join(F.slice("lines", start, size), "\n")).alias("digest")).distinct()


def insertion_runs(documents: DataFrame) -> DataFrame:
    """(doc_id, runs, added, removed): runs of added lines in the diffs of a text."""
    lines = documents.filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n")).alias("at", "line"))
    mark = F.when(F.col("line").rlike(r"^\+(?!\+\+ )"), 1).when(F.col("line").rlike(r"^-(?!-- )"), 2).otherwise(0)
    w = Window.partitionBy("doc_id").orderBy("at")
    rows = lines.withColumn("m", mark).withColumn("b", F.coalesce(F.lag("m").over(w), F.lit(0)))
    return rows.groupBy("doc_id").agg(F.count(F.when((F.col("m") == 1) & (F.col("b") != 1), 1)).alias("runs"), F.count(F.when(F.col("m") == 1, 1)).alias("added"), F.count(F.when(F.col("m") == 2, 1)).alias("removed"))


# --- rankings ---------------------------------------------------------------------------------------------------------------------
def quota_backfill(rows: DataFrame, quota: int, k: int) -> DataFrame:
    """(ticket_id, place, file_path, name): first ``quota`` symbols of each file in rank order, then the others, k per ticket."""
    per_file = Window.partitionBy("ticket_id", "file_path").orderBy("rank")
    placed = rows.withColumn("late", (F.row_number().over(per_file) > quota).cast("int"))
    w = Window.partitionBy("ticket_id").orderBy("late", "rank")
    return placed.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("ticket_id", "place", "file_path", "name", "kind")


def round_robin(rows: DataFrame, group: str, item: str, size: int) -> DataFrame:
    """The first ``size`` items, one of each group in turn."""
    w = Window.partitionBy(group).orderBy(item)
    turn = rows.select(group, item).distinct().withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= size)
    return turn.orderBy("turn", group).limit(size).select(group, item, "turn")


def seeded(seed: int, c: Column) -> Column:
    """The order of a seeded hash: the same in any engine."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), c), 256)


def stratified(rows: DataFrame, group: str, item: str, quota: int, seed: int) -> DataFrame:
    """``quota`` items of each group in hash order."""
    w = Window.partitionBy(group).orderBy(seeded(seed, F.col(item)))
    return rows.select(group, item).distinct().withColumn("place", F.row_number().over(w)).filter(F.col("place") <= quota)


def largest_remainder(counts: DataFrame, key: str, n: str, target: int) -> DataFrame:
    """(key, n, seats): ``target`` seats in proportion to n; remainders by fraction, size and key, all descending. The table has one row per stratum."""
    total = counts.agg(F.sum(n).alias("total"))
    rows = counts.crossJoin(total).withColumn("raw", F.col(n) * target / F.col("total")).withColumn("base", F.floor("raw"))
    rest = target - F.sum("base").over(Window.partitionBy(F.lit(1)))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round(F.col("raw") - F.col("base"), 9)), F.desc(n), F.desc(key)))
    return rows.withColumns({"rest": rest, "place": place}).select(key, n, (F.col("base") + F.when(F.col("place") <= F.col("rest"), 1).otherwise(0)).cast("bigint").alias("seats"))


def size_groups(files: DataFrame) -> DataFrame:
    """(repo, files, least, most, size_group): repositories by the median number of files of their snapshots, in three groups of nearly equal count; and the least and most files of one."""
    per = files.groupBy(*SNAPSHOT).agg(F.count_distinct("file_path").alias("n")).groupBy("repo").agg(F.median("n").alias("files"), F.min("n").alias("least"), F.max("n").alias("most"))
    group = F.ntile(3).over(Window.orderBy("files", "repo"))
    return per.select("repo", "files", "least", "most", F.element_at(F.array(F.lit("small"), F.lit("medium"), F.lit("large")), group).alias("size_group"))


def fingerprints(files: DataFrame) -> DataFrame:
    """(snapshot, files, fingerprint): one digest over the sorted (path, content digest) pairs of a snapshot, by way of 256 buckets of paths."""
    each = files.filter("content IS NOT NULL").select(*SNAPSHOT, "file_path", F.sha2("content", 256).alias("h")).groupBy(*SNAPSHOT, "file_path").agg(F.max("h").alias("h"))
    # In two levels, so that no row holds all files of a snapshot: a digest per bucket of paths, then one over the buckets' digests in order.
    bucket = F.substring(F.md5("file_path"), 1, 2)
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "file_path", "h")))
    parts = each.groupBy(*SNAPSHOT, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(lines, "\n"), 256).alias("d"))
    return parts.groupBy(*SNAPSHOT).agg(F.sum("n").alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "bucket", "d"))), "\n"), 256).alias("fingerprint"))


def number_below(n: int, *parts: Column) -> Column:
    return hash_number(*parts) % n


#: Buckets in which a value range is cut to find a rank.
RANK_BUCKETS = 1024


def nearest_rank(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, n, one column per share, most): exact nearest-rank percentiles, the smallest value with at least the share of rows at or below it.

    Rows are counted by value, values by bucket of the group's range; running counts over buckets name the bucket that holds a rank, and only that bucket's
    values are ordered. No task sorts a whole group, however many rows or equal values it has. Null values are left out.
    """
    kept = rows.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    span = kept.groupBy(group).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("c").alias("n"))
    cell = F.when(F.col("high") > F.col("low"), F.least(F.lit(RANK_BUCKETS - 1), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * RANK_BUCKETS))).otherwise(F.lit(0))
    placed = kept.join(span, group).select(group, "v", "c", cell.cast("int").alias("b"))
    over = Window.partitionBy(group).orderBy("b")
    sums = placed.groupBy(group, "b").agg(F.sum("c").alias("s")).withColumn("before", F.sum("s").over(over) - F.col("s"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.ceil(F.lit(p) * F.col("n")).alias("r")) for name, p in shares.items()])).alias("x")
    at = span.select(group, wanted).select(group, "x.name", "x.r").join(sums, group).filter((F.col("before") < F.col("r")) & (F.col("r") <= F.col("before") + F.col("s"))).select(group, "b", "name", (F.col("r") - F.col("before")).alias("k"))
    inside = placed.join(at.select(group, "b").distinct(), [group, "b"], "left_semi").withColumn("upto", F.sum("c").over(Window.partitionBy(group, "b").orderBy("v")))
    found = inside.join(at, [group, "b"]).filter((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("c") < F.col("k")))
    values = found.groupBy(group).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares])
    return span.select(group, "n", F.col("high").alias("most")).join(values, group)
