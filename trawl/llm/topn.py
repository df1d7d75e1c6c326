"""Problem 3: the N best candidates of every group, by statistics-guided skipping.

1. Rows are range-partitioned by (group, hash of the item), so that a hot group is cut over many files, and sorted by group and
   falling score inside each file; files are written with small row groups to the shared folder. So a large group fills row groups of its own, and small
   groups do not stand in their way.
2. One task per file reads the footer, takes the row groups in descending maximum score and skips those whose maximum lies strictly below the
   current N-th score of every group they contain. Which groups those are is known from the statistics where there is one, else from the cheap group column.
3. The N survivors of each (file, group) are merged with one window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.storage import new_path

#: Bytes of a row group of the clustered copy.
ROW_GROUP_BYTES = 1 << 18
_FIELDS = [("g", pa.string()), ("i", pa.string()), ("s", pa.float64()), ("r", pa.int32())]
_WORST = 2**31 - 1  # stands for a missing rank, after all numbers


def _survivors(paths: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    for batch in paths:
        for uri in batch.column(0).to_pylist():
            files, path = fs.FileSystem.from_uri(uri)
            with files.open_input_file(path) as f:
                kept, groups, skipped = scan(pq.ParquetFile(f), n)
            one = pa.table([pa.nulls(1, t) for _, t in _FIELDS], pa.schema(_FIELDS))
            out = pa.concat_tables([one, *([kept.select([c for c, _ in _FIELDS]).cast(pa.schema(_FIELDS))] if kept is not None else [])])  # the first row carries what was read of the file
            out = out.append_column("row_groups", pa.array([groups] * out.num_rows, pa.int32())).append_column("skipped", pa.array([skipped] * out.num_rows, pa.int32()))
            yield from out.combine_chunks().to_batches()


def scan(file, n: int) -> tuple[pa.Table | None, int, int]:  # noqa: ANN001
    """(survivors, row groups, row groups skipped) of one clustered file.

    A group's N-th score counts distinct items. Only groups that may stand in several row groups need one.
    """
    import math

    import pyarrow.compute

    meta, schema = file.metadata, file.schema_arrow
    at = {c: schema.get_field_index(c) for c in ("g", "s")}

    def span(k: int, c: str) -> tuple | None:
        stats = meta.row_group(k).column(at[c]).statistics
        return (stats.min, stats.max) if stats is not None and stats.has_min_max else None

    ranges = {k: span(k, "g") for k in range(meta.num_row_groups)}
    tops = sorted(((x[1] if (x := span(k, "s")) else math.inf, k) for k in ranges), key=lambda x: (-x[0], x[1]))
    left = set(ranges)
    bound: dict[str, float] = {}
    items: dict[str, dict[str, float]] = {}
    parts, skipped = [], 0
    for top, k in tops:
        left.discard(k)
        r = ranges[k]
        single = r is not None and r[0] == r[1]
        if bound and (not single or r[0] in bound):
            own = [r[0]] if single else pa.compute.unique(file.read_row_group(k, columns=["g"]).column(0)).to_pylist()
            if all(top < bound.get(x, -math.inf) for x in own):
                skipped += 1
                continue
        part = _first(file.read_row_group(k), n)
        parts.append(part)
        open_ranges = [ranges[j] for j in left]
        if not open_ranges:
            continue
        for g, i, s in zip(part["g"].to_pylist(), part["i"].to_pylist(), part["s"].to_pylist(), strict=True):
            if any(x is None or x[0] <= g <= x[1] for x in open_ranges):
                best = items.setdefault(g, {})
                best[i] = max(s, best.get(i, -math.inf))
                if len(best) >= n:
                    order = sorted(best.items(), key=lambda x: -x[1])[:n]
                    items[g], bound[g] = dict(order), order[-1][1]
    return (_first(pa.concat_tables(parts), n) if parts else None), meta.num_row_groups, skipped


def _first(t: pa.Table, n: int) -> pa.Table:
    """The first n distinct items of each group of a small table, in the operator's order."""
    import numpy as np

    t = t.combine_chunks().sort_by([("g", "ascending"), ("i", "ascending"), ("s", "descending"), ("r", "ascending")])
    code = lambda c: t[c].combine_chunks().dictionary_encode()
    g, i = (code(c).indices.to_numpy(zero_copy_only=False) for c in ("g", "i"))
    t = t.filter(pa.array(np.r_[True, (g[1:] != g[:-1]) | (i[1:] != i[:-1])]))
    t = t.sort_by([("g", "ascending"), ("s", "descending"), ("r", "ascending"), ("i", "ascending")])
    g = t["g"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    start = np.maximum.accumulate(np.where(np.r_[True, g[1:] != g[:-1]], np.arange(len(g)), 0)) if len(g) else g
    return t.filter(pa.array(np.arange(len(g)) - start < n))


def top_n(df: DataFrame, group: str, item: str, score: str, rank: str, n: int) -> DataFrame:
    """(group, item, score, rank, position): of each group the first ``n`` distinct items.

    An item is ranked by its highest score and, among the rows with that score, its lowest rank; a null rank comes after all
    numbers. Order: higher score, lower rank, smaller item; so ties and repeated rows have one answer. Rows with a null
    group or item, or with a score that is null, NaN, infinite, below 0 or above 1, do not count. A group with fewer than n items gives
    them all; an empty table gives no rows. Other columns, whatever their names, are not read.
    """
    local = _scanned(df, group, item, score, rank, n).filter("g IS NOT NULL")
    once = Window.partitionBy("g", "i").orderBy(F.desc("s"), "r")
    order = Window.partitionBy("g").orderBy(F.desc("s"), "r", "i")
    return (
        local.withColumn("k", F.row_number().over(once))
        .filter("k = 1")
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= n)
        .select(
            F.col("g").alias(group),
            F.col("i").alias(item),
            F.col("s").alias(score),
            F.when(F.col("r") < _WORST, F.col("r")).alias(rank),
            "position",
        )
    )


def skips(df: DataFrame, group: str, item: str, score: str, rank: str, n: int) -> DataFrame:
    """(files, row_groups, skipped): what ``top_n`` reads of its clustered copy. An empty table gives one row of zeros."""
    seen = _scanned(df, group, item, score, rank, n).filter("g IS NULL")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return seen.agg(F.count(F.lit(1)).alias("files"), zero("row_groups").alias("row_groups"), zero("skipped").alias("skipped"))


def _scanned(df: DataFrame, group: str, item: str, score: str, rank: str, n: int) -> DataFrame:
    """Survivors of each file, and of each file a row without a group."""
    if n < 1:
        raise ValueError("n must be positive")
    spark = df.sparkSession
    kept = df.select(
        F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).cast("double").alias("s"), F.coalesce(F.col(rank).cast("int"), F.lit(_WORST)).alias("r")
    ).filter("g IS NOT NULL AND i IS NOT NULL AND s >= 0 AND s <= 1")  # NaN is above 1 in Spark's order
    path = new_path(spark, "topn")
    (
        kept.repartitionByRange(F.col("g"), F.xxhash64("i"))
        .sortWithinPartitions("g", F.desc("s"))
        .write.option("parquet.block.size", ROW_GROUP_BYTES)
        .option("compression", "zstd")
        .parquet(path)
    )
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    files = files.repartition(max(1, len(files.inputFiles())), "path")  # a fixed number: adaptive execution would put all files in one task
    return files.mapInArrow(lambda it: _survivors(it, n), "g string, i string, s double, r int, row_groups int, skipped int")
