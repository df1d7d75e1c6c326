"""Selection of a ticket's symbols by slots: a prefix of the ranking, one module per file, neighbours of the prefix, and the rest by rank.

The choice is sequential, but what it can look at is bounded by the number of slots: the first ranks, the first modules, and of each prefix symbol its nearest few
relatives. Windows and equi joins bring these rows together, and only they reach the worker that chooses, however many symbols a ticket has.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Relatives that may be added, and lines within which a definition is a neighbour.
RELATIVES, REACH = 5, 100
MODES = ("global", "module-reserved", "family", "source", "call")
_COLUMNS = "ticket_id string, rank int, file_path string, name string, kind string, start_line int, end_line int, file_place int"


def family(kind: str, file: str, name: str) -> tuple[str, str] | None:
    """The class that a class or method belongs to."""
    if kind == "class":
        return file, name
    if kind in ("method", "async_method") and "." in name:
        return file, name.rsplit(".", 1)[0]
    return None


def choose(rows: list[tuple], k: int, mode: str, links: set[tuple[int, int]]) -> list[tuple]:
    """The chosen rows in order. ``rows``: (rank, file, name, kind, first line, last line, place of the file), in rank order; ``links``: pairs of ranks that a call ties."""
    if len(rows) <= k:
        return rows
    modules: dict[str, tuple] = {}
    for r in rows:
        if r[3] == "module":
            modules.setdefault(r[1], r)
    reserved = sorted(modules.values(), key=lambda r: r[6])[:k] if mode != "global" else []
    extra = min(RELATIVES, max(0, k - len(reserved) - 1)) if mode in ("family", "source", "call") else 0
    prefix = rows[: max(1, k - len(reserved) - extra)] if mode != "global" else rows[:k]
    out: list[tuple] = []
    seen: set[int] = set()

    def take(r: tuple) -> None:
        if r[0] not in seen and len(out) < k:
            out.append(r)
            seen.add(r[0])

    for r in (*prefix, *reserved):
        take(r)
    if mode == "family" and extra:
        anchors: dict[tuple[str, str], tuple] = {}
        for r in prefix:
            if f := family(r[3], r[1], r[2]):
                anchors.setdefault(f, r)
        for f, a in list(anchors.items())[:extra]:
            members = [r for r in rows if r[0] not in seen and family(r[3], r[1], r[2]) == f]
            if members:
                take(min(members, key=lambda r: (r[2].rsplit(".", 1)[-1] != "__init__", abs(r[4] - a[4]), r[0])))
    elif extra:
        added = 0
        for a in prefix:
            if a[3] == "module" or added == extra:
                continue
            others = [r for r in rows if r[0] not in seen and r[3] != "module"]
            if mode == "source":
                near = [(max(r[4] - a[5], a[4] - r[5]), r[0], r) for r in others if r[1] == a[1] and 0 < max(r[4] - a[5], a[4] - r[5]) <= REACH]
            else:
                near = [(0, r[0], r) for r in others if (a[0], r[0]) in links or (r[0], a[0]) in links]
            if near:
                take(min(near)[2])
                added += 1
    for r in rows:
        take(r)
    return out


def select_symbols(rows: DataFrame, k: int, mode: str, links: DataFrame | None = None) -> DataFrame:
    """(ticket_id, place, rank, file_path, name, kind): k symbols of every ticket; a ticket with at most k keeps its order.

    ``rows``: ticket_id, rank (1 without gaps), file_path, name, kind, start_line, end_line, file_score; ``links`` (mode call): ticket_id, a, b, ranks of symbols that a call ties.
    Modes: global, module-reserved, family (members of the prefix's classes, constructors first), source (nearest disjoint definitions of the same file), call. Missing lines count as 0. An unknown mode is an error.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")
    if mode == "call" and links is None:
        raise ValueError("mode call needs links")
    files = rows.groupBy("ticket_id", "file_path").agg(F.max(F.coalesce("file_score", F.lit(0.0))).alias("s"))
    files = files.withColumn("file_place", F.row_number().over(Window.partitionBy("ticket_id").orderBy(F.desc("s"), "file_path"))).drop("s")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c)
    x = rows.select("ticket_id", F.col("rank").cast("int").alias("rank"), "file_path", "name", "kind", zero("start_line"), zero("end_line")).join(files, ["ticket_id", "file_path"])
    x = x.select(*[c.split()[0] for c in _COLUMNS.split(", ")])
    parts = [x.filter(F.col("rank") <= 2 * k)]
    if mode != "global":
        first = Window.partitionBy("ticket_id", "file_path").orderBy("rank")
        # A file without a module symbol gives its slot to the next file that has one.
        mods = x.filter("kind = 'module'").withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k").withColumn("k", F.row_number().over(Window.partitionBy("ticket_id").orderBy("file_place"))).filter(F.col("k") <= k).drop("k")
        parts.append(mods)
    anchors = x.filter(F.col("rank") <= k)
    if mode == "family":
        of = F.when(F.col("kind") == "class", F.col("name")).when(F.col("kind").isin("method", "async_method") & F.col("name").contains("."), F.expr("substring_index(name, '.', size(split(name, '[.]')) - 1)"))
        lead = anchors.withColumn("family", of).filter("family IS NOT NULL").groupBy("ticket_id", "file_path", "family").agg(F.min(F.struct("rank", "start_line")).alias("a"))
        near = x.withColumn("family", of).join(lead, ["ticket_id", "file_path", "family"])
        order = Window.partitionBy("ticket_id", "file_path", "family").orderBy((F.substring_index("name", ".", -1) != "__init__").cast("int"), F.abs(F.col("start_line") - F.col("a.start_line")), "rank")
        parts.append(near.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= k + 1).select(*x.columns))
    if mode == "source":
        a = anchors.filter("kind <> 'module'").select("ticket_id", "file_path", F.col("rank").alias("ar"), F.col("start_line").alias("s"), F.col("end_line").alias("e"))
        gap = F.greatest(F.col("start_line") - F.col("e"), F.col("s") - F.col("end_line"))
        near = x.filter("kind <> 'module'").join(a, ["ticket_id", "file_path"]).withColumn("gap", gap).filter(F.col("gap").between(1, REACH))
        order = Window.partitionBy("ticket_id", "ar").orderBy("gap", "rank")
        parts.append(near.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= k + RELATIVES + 1).select(*x.columns))
    tied = None
    if mode == "call":
        both = links.select("ticket_id", F.col("a").alias("ar"), F.col("b").alias("rank")).union(links.select("ticket_id", "b", "a")).filter((F.col("ar") <= k) & (F.col("ar") != F.col("rank"))).distinct()
        near = x.filter("kind <> 'module'").join(both, ["ticket_id", "rank"])
        order = Window.partitionBy("ticket_id", "ar").orderBy("rank")
        near = near.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= k + RELATIVES + 1)
        parts.append(near.select(*x.columns))
        tied = near.groupBy("ticket_id", "rank").agg(F.collect_set("ar").alias("ties"))
    some = parts[0]
    for p in parts[1:]:
        some = some.union(p)
    some = some.distinct()
    some = some.join(tied, ["ticket_id", "rank"], "left") if tied is not None else some.withColumn("ties", F.lit(None).cast("array<int>"))

    def apply(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rank", kind="stable")
        items = list(f[["rank", "file_path", "name", "kind", "start_line", "end_line", "file_place"]].itertuples(index=False, name=None))
        pairs = {(int(b), r) for r, t in zip(f["rank"], f["ties"], strict=True) if t is not None for b in t}
        picked = choose(items, k, mode, pairs)
        return pd.DataFrame([(f["ticket_id"].iloc[0], n, *r[:4]) for n, r in enumerate(picked, 1)], columns=["ticket_id", "place", "rank", "file_path", "name", "kind"])

    return some.groupBy("ticket_id").applyInPandas(apply, "ticket_id string, place int, rank int, file_path string, name string, kind string")
