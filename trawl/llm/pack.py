"""Problem 8: filling containers of fixed capacity by vector best-fit.

Items are dealt into blocks by a hash of their id (ids are unique, so blocks are even whatever the data); inside a block items are placed in
falling size. Among the open containers that have room in every dimension (tokens, documents, attention cost) the one with the smallest
weighted norm of what would remain is taken, ties going to the larger weighted dot-product of item and residual and then to the older container.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.storage import settings

#: Items of a block: what one task holds at once; and partitions that blocks are dealt to at most.
BLOCK, MOST_TASKS = 8192, 20_000
#: Documents that a container may hold; the share of the squared capacity that the squared sizes in it may sum up to (its attention cost); the weights of tokens,
#: documents and attention cost in the norm.
MAX_DOCUMENTS = 64
COST_SHARE = 0.9
WEIGHTS = (1.0, 0.05, 0.05)


def place(sizes: np.ndarray, capacity: int, max_documents: int = MAX_DOCUMENTS, cost_share: float = COST_SHARE, weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """The container number of each item (numbers from 0 by first use). Sizes must be within the capacity; an item of size 0 takes a document place only.

    The sum of squared sizes in a container stays within ``cost_share`` times the squared capacity; an item that costs more alone fills a container's cost, so only items of size 0 can join it.
    """
    sizes = np.asarray(sizes, np.float64)
    if len(sizes) and sizes.max() > capacity:
        raise ValueError("an item is larger than the capacity")
    cost_cap = cost_share * float(capacity) ** 2
    full = np.array([capacity, max_documents, cost_cap], np.float64)
    w = np.array(weights, np.float64)
    vectors = np.stack([sizes, np.ones_like(sizes), np.minimum(sizes**2, cost_cap)], 1)
    free = np.empty((0, 3))
    number = np.empty(0, np.int64)
    out = np.empty(len(sizes), np.int64)
    made = 0
    order = np.lexsort((np.arange(len(sizes)), -sizes))
    least = sizes[sizes > 0].min() if (sizes > 0).any() else 0.0
    for step, k in enumerate(order):
        v = vectors[k]
        fits = np.flatnonzero((free >= v).all(1)) if len(free) else np.empty(0, np.int64)
        if len(fits):
            share = free[fits] / full
            rest = share - v / full
            norm = (w * rest * rest).sum(1)
            dot = (w * share * (v / full)).sum(1)
            best = fits[np.lexsort((number[fits], -dot, norm))[0]]
            free[best] -= v
            out[k] = number[best]
        else:
            free = np.vstack([free, full - v])
            number = np.append(number, made)
            out[k] = made
            made += 1
        if step % 256 == 255:  # full containers are put aside
            keep = (free[:, 1] >= 1) & (free[:, 0] >= min(least, 1))
            free, number = free[keep], number[keep]
    return out


_OUT = "kind string, doc_id bigint, part int, parts int, tokens int, first_token int, container string, offset int"


def _block(frame: pd.DataFrame, capacities: list[tuple[str, int]], max_documents: int, cost_share: float) -> pd.DataFrame:
    block = int(frame["block"].iloc[0])
    frame = frame.sort_values("doc_id", kind="stable")
    ids, tokens = frame["doc_id"].to_numpy(), frame["tokens"].to_numpy().astype(np.int64)
    out = []
    for kind, capacity in capacities:
        parts = np.maximum(1, -(-tokens // capacity))
        row = np.repeat(np.arange(len(ids)), parts)
        part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        first = part * capacity
        size = np.minimum(tokens[row] - first, capacity)
        at = place(size, capacity, max_documents, cost_share)
        o = np.lexsort((part, ids[row], at))
        total = np.cumsum(size[o]) - size[o]
        fresh = np.r_[True, at[o][1:] != at[o][:-1]] if len(o) else np.empty(0, bool)
        base = np.maximum.accumulate(np.where(fresh, total, 0)) if len(o) else total
        offset = np.empty(len(o), np.int64)
        offset[o] = total - base
        out.append(pd.DataFrame({"kind": kind, "doc_id": ids[row], "part": part + 1, "parts": parts[row], "tokens": size, "first_token": first, "container": [f"{kind}-{block}-{c}" for c in at], "offset": offset}))
    return pd.concat(out).astype({"part": "int32", "parts": "int32", "tokens": "int32", "first_token": "int32", "offset": "int32"})


def pack(items: DataFrame, limits: DataFrame, max_documents: int = MAX_DOCUMENTS, block: int = BLOCK, cost_share: float = COST_SHARE) -> DataFrame:
    """One row per item and container kind: ``items`` (doc_id, tokens) into the containers of ``limits`` measured in tokens.

    Only an item larger than a container is divided, into full parts and a rest (part 1..parts, first_token). offset is the place of the
    part's first token in its container. Every row is placed: null or negative tokens count as 0, rows of a null doc_id are not items,
    repeated ids are items of their own. No limits, no rows.
    """
    rules = limits.filter("lower(trim(unit_name)) = 'tokens' AND max_size > 0").groupBy("item_kind").agg(F.min("max_size").alias("m")).orderBy("item_kind")
    capacities = [(r["item_kind"], int(r["m"])) for r in settings(rules, 64)]
    kept = items.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).cast("int").alias("tokens"))
    blocks = max(1, -(-kept.count() // block))
    dealt = kept.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    if not capacities:
        return items.sparkSession.createDataFrame([], _OUT)
    # A stated number of partitions: adaptive execution would put all blocks, whose rows are few bytes, in one task.
    spread = dealt.repartition(min(blocks, MOST_TASKS), "block")
    return spread.groupBy("block").applyInPandas(lambda f: _block(f, capacities, max_documents, cost_share), _OUT)


def measured(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, tokens) of documents, written once to the shared folder, as packing reads it twice."""
    from trawl.llm.bpe import TOKENIZERS, VOCABULARY, token_counts
    from trawl.storage import cut

    return cut(token_counts(documents, "doc_id", "text", vocabulary or f"{TOKENIZERS}/{VOCABULARY}"), "tokens")
