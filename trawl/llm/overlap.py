"""Problem 6: the same or nearly the same record on both sides of a split.

1. Hash join: each text is canonicalised (lower case, punctuation and white space to single blanks) and hashed; texts that hash alike are one class per
   block (repo and commit), and evaluation hashes are joined with training hashes of the block. This gives all equal pairs.
2. Equal hashes cannot give the nearly equal pairs that are asked for too (six tenths of all words in both). The classes of a block whose texts
   fit one task (BLOCK_CHARS) are sent to one place and compared there: words that one side lacks are dropped, a class that keeps less than the share is out, and
   the others meet over the words of their prefixes, ordered by rarity in the block. A larger block has the same steps as joins: prefix words,
   weighed by counts in hash buckets, give candidates; bit signatures bound the share; whole texts are compared. Both ways are exact.
Members are joined to classes at the end, so copies are compared once.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.keys import commit_key, plain_repo, ticket_key
from trawl.storage import cut

#: Two sets are nearly the same if at least this share of all their words occurs in both.
SHARE = 0.6
#: Characters of a block's distinct texts up to which one task compares them.
BLOCK_CHARS = 4_000_000
#: Buckets in which word frequencies of larger blocks are counted (the bound of what every task receives).
BUCKETS = 1 << 16
#: Bits of a set's signature; a bit of one set that another lacks proves a word that the other lacks.
SIGNATURE = 512
_WORD = re.compile(r"\w+")


def _words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def _prefix_size(n: int, share: float) -> int:
    """How many of n ordered words two sets that reach the share must have one in common of."""
    return n - math.ceil(share * n - 1e-9) + 1


# --- blocks that fit one task --------------------------------------------------------------------------------------------------


def near_pairs(texts: list[str], train: list[bool], test: list[bool], share: float) -> Iterator[tuple[int, int, float]]:
    """(training text, evaluation text, share) of one block: all pairs that reach the share and are no pair of a text with itself."""
    sets = [_words(t) for t in texts]
    left, right = set().union(*(s for s, x in zip(sets, train, strict=True) if x)), set().union(*(s for s, x in zip(sets, test, strict=True) if x))
    common = left & right
    kept = [s & common for s in sets]
    alive = [k for k, s in enumerate(sets) if s and len(kept[k]) >= share * len(s) - 1e-9]
    if not any(train[k] for k in alive) or not any(test[k] for k in alive):
        return
    often = Counter(w for k in alive for w in kept[k])
    lists: dict[str, list[int]] = defaultdict(list)
    prefix = {}
    for k in alive:
        # Words of one side only come first in the order and match nothing, so the prefix loses as many places.
        places = _prefix_size(len(sets[k]), share) - (len(sets[k]) - len(kept[k]))
        prefix[k] = sorted(kept[k], key=lambda w: (often[w], w))[: max(0, places)]
        if train[k]:
            for w in prefix[k]:
                lists[w].append(k)
    for b in alive:
        if test[b]:
            n = len(sets[b])
            for a in {a for w in prefix[b] for a in lists.get(w, ())}:
                m = len(sets[a])
                if a != b and m >= share * n - 1e-9 and n >= share * m - 1e-9:
                    both = len(kept[a] & kept[b])
                    if both >= share * (n + m - both) - 1e-9:
                        yield a, b, both / (n + m - both)


def _compared(frames: Iterator[pd.DataFrame], share: float) -> Iterator[pd.DataFrame]:
    """Rows sorted by block -> pairs; a block may go on in the next batch."""
    rest: pd.DataFrame | None = None

    def pairs(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        block, code, text = f["block"].to_numpy(), f["hash"].to_numpy(), f["text"].tolist()
        train, test = f["train"].tolist(), f["eval"].tolist()
        edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(f)] if len(f) else [0]
        for i, j in zip(edges, edges[1:], strict=False):
            if j - i > 1:
                out += [(block[i], code[i + a], code[i + b], s) for a, b, s in near_pairs(text[i:j], train[i:j], test[i:j], share)]
        return pd.DataFrame(out, columns=["block", "ha", "hb", "share"])

    for f in frames:
        if rest is not None:
            f = pd.concat([rest, f], ignore_index=True)
        last = f["block"].to_numpy() == f["block"].iloc[-1] if len(f) else np.empty(0, bool)
        yield pairs(f[~last])
        rest = f[last]
    if rest is not None:
        yield pairs(rest)


# --- larger blocks ---------------------------------------------------------------------------------------------------------------


def _codes(words: set[str], block: int) -> np.ndarray:
    """64-bit hashes of a block's words, sorted."""
    import xxhash

    return np.sort(np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"), block & (2**64 - 1)) - (1 << 63) for w in words), "i8", len(words)))


def _spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many texts of each side have a word in each bucket, one partial count per batch."""
    for f in frames:
        sums = np.zeros((2, BUCKETS), "i8")
        for block, text, train, test in zip(f["block"], f["text"], f["train"], f["eval"], strict=True):
            own = np.unique(_codes(_words(text), block) & (BUCKETS - 1))
            sums[0, own] += train
            sums[1, own] += test
        b = np.flatnonzero(sums.any(0))
        yield pd.DataFrame({"b": b, "t": sums[0, b], "e": sums[1, b]})


def _prefixes(frames: Iterator[pd.DataFrame], counts: object, share: float) -> Iterator[pd.DataFrame]:
    """Size, signature and the prefix words that the other side may have too."""
    sums = np.frombuffer(counts.value, "<i8").reshape(2, BUCKETS)
    for f in frames:
        sizes, prefixes, marks = [], [], []
        for block, text in zip(f["block"], f["text"], strict=True):
            w = _codes(_words(text), block)
            at = w & (BUCKETS - 1)
            two = sums[:, at].all(0)
            often = np.where(two, sums[:, at].sum(0), 0)  # words that one side lacks come first and match nothing
            order = np.lexsort((w, often))[: _prefix_size(len(w), share) if len(w) else 0]
            sizes.append(len(w))
            prefixes.append(w[order][two[order]].tolist())
            bits = np.zeros(SIGNATURE, "u1")
            bits[(w >> 20) % SIGNATURE] = 1
            marks.append(np.packbits(bits).view("<i8").tolist())
        yield f[["block", "hash", "train", "eval"]].assign(n=np.array(sizes, "i4"), prefix=prefixes, marks=marks)


def _measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for a, b in zip(f["texta"], f["textb"], strict=True):
            x, y = _words(a), _words(b)
            out.append(len(x & y) / len(x | y) if x or y else 1.0)
        yield f[["block", "ha", "hb"]].assign(share=np.array(out, "f8"))


def _joined(large: DataFrame, share: float) -> DataFrame:
    """(block, ha, hb, share) of blocks of any size, by joins: ``large`` has block, hash, train, eval, text, a row per class."""
    spark = large.sparkSession
    counts = np.zeros((2, BUCKETS), "<i8")
    for r in large.mapInPandas(_spread, "b bigint, t bigint, e bigint").groupBy("b").agg(F.sum("t").alias("t"), F.sum("e").alias("e")).collect():  # at most BUCKETS rows
        counts[0, r["b"]], counts[1, r["b"]] = r["t"], r["e"]
    sent = spark.sparkContext.broadcast(counts.tobytes())
    sets = cut(large.mapInPandas(lambda it: _prefixes(it, sent, share), "block bigint, hash bigint, train boolean, eval boolean, n int, prefix array<bigint>, marks array<bigint>"), "sets", compression="zstd")
    posting = sets.select("block", "hash", "n", "train", "eval", F.explode("prefix").alias("k"))
    a = posting.filter("train").select("block", "k", F.col("hash").alias("ha"), F.col("n").alias("na"))
    b = posting.filter("eval").select("block", "k", F.col("hash").alias("hb"), F.col("n").alias("nb"))
    fit = (F.col("na") * F.lit(share) <= F.col("nb") + 1e-9) & (F.col("nb") * F.lit(share) <= F.col("na") + 1e-9)
    met = a.join(b, ["block", "k"]).filter(fit & (F.col("ha") != F.col("hb"))).select("block", "ha", "hb").distinct()
    of = lambda x: sets.select("block", F.col("hash").alias(f"h{x}"), F.col("n").alias(f"n{x}"), F.col("marks").alias(f"m{x}"))
    lacks = lambda x, y: sum(F.bit_count(F.col(f"m{x}")[i].bitwiseAND(F.bitwise_not(F.col(f"m{y}")[i]))) for i in range(SIGNATURE // 64))
    both = F.least(F.col("na") - lacks("a", "b"), F.col("nb") - lacks("b", "a"))
    bound = both >= F.lit(share) * (F.col("na") + F.col("nb") - both) - 1e-9
    asked = cut(met.join(of("a"), ["block", "ha"]).join(of("b"), ["block", "hb"]).filter(bound).select("block", "ha", "hb"), "asked")
    text = lambda x: large.select("block", F.col("hash").alias(f"h{x}"), F.col("text").alias(f"text{x}"))
    whole = asked.join(text("a"), ["block", "ha"]).join(text("b"), ["block", "hb"])
    return whole.mapInPandas(_measure, "block bigint, ha bigint, hb bigint, share double").filter(F.col("share") >= share - 1e-9)


# --- the operator --------------------------------------------------------------------------------------------------------------


def _blocks(gold: DataFrame) -> DataFrame:
    """(ticket, repo, commit), distinct; an abbreviated commit is replaced by the smallest full one of its repo that it begins."""
    rows = gold.select(ticket_key(F.col("ticket_id")).alias("ticket"), plain_repo(F.col("repo")).alias("repo"), commit_key(F.col("base_commit")).alias("commit")).dropna().distinct()
    head = lambda c: F.substring(c, 1, 4)
    whole = rows.filter(F.length("commit") >= 40).select("repo", F.col("commit").alias("full"), head("commit").alias("head")).distinct()
    short = rows.filter(F.length("commit") < 40)
    known = (
        short.select("repo", "commit", head("commit").alias("head")).distinct()
        .join(whole, ["repo", "head"]).filter(F.col("full").startswith(F.col("commit")))
        .groupBy("repo", "commit").agg(F.min("full").alias("full"))
    )
    fixed = short.join(known, ["repo", "commit"], "left").select("ticket", "repo", F.coalesce("full", "commit").alias("commit"))
    return rows.filter(F.length("commit") >= 40).select("ticket", "repo", "commit").union(fixed).distinct()


def _side(c: Column) -> Column:
    low = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(low == "train", 1).when(low.isin("validation", "test"), 2)


def _members(tickets: DataFrame, gold: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(ticket, ticket_id, side, split, repo, commit): every ticket of a split in every block that it has a record in; blocks with one side only are left out."""
    sides = outcomes.select(ticket_key(F.col("ticket_id")).alias("ticket"), _side(F.col("split_name")).alias("side"), F.lower(F.trim(F.regexp_replace("split_name", r"^\s+|\s+$", ""))).alias("split")).dropna().distinct()
    names = tickets.select(ticket_key(F.col("ticket_id")).alias("ticket"), "ticket_id").dropna().distinct()
    rows = _blocks(gold).join(sides, "ticket").join(names, "ticket")
    both = rows.groupBy("repo", "commit").agg(F.max((F.col("side") == 1).cast("int")).alias("t"), F.max((F.col("side") == 2).cast("int")).alias("e")).filter("t = 1 AND e = 1").select("repo", "commit")
    return rows.join(both, ["repo", "commit"]).withColumn("block", F.xxhash64("repo", "commit"))


def canonical(text: Column) -> Column:
    """Lower case, every run of other characters than letters, digits and underscores one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def overlapping(tickets: DataFrame, gold: DataFrame, outcomes: DataFrame, share: float = SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(ticket_a, ticket_b, repo, split, share, way): pairs of tickets with the smaller id first, one in train and one in an evaluation split.

    Both have a record of the same repo and commit, and of all distinct lower-case words of title and description at least ``share`` occur
    in both. way is hash where the canonical texts are equal, else near. Missing title or description is empty text; a ticket without any word matches
    only another such. Of repeated rows every text counts, and the pair has its highest share. Rows with null or placeholder keys pair with nothing;
    empty tables give no rows; other columns are not read.
    """
    members = cut(_members(tickets, gold, outcomes), "members", compression="zstd")
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    texts = tickets.select(ticket_key(F.col("ticket_id")).alias("ticket"), text.alias("text")).filter("ticket IS NOT NULL")
    texts = cut(texts.select("ticket", F.xxhash64(canonical(F.col("text"))).alias("hash"), F.char_length("text").alias("chars"), "text"), "texts", compression="zstd")
    side = lambda k: F.max(F.col("side") == k)
    rows = cut(members.join(texts.select("ticket", "hash", "chars").distinct(), "ticket"), "rows", compression="zstd")
    classes = rows.groupBy("block", "hash").agg(side(1).alias("train"), side(2).alias("eval"), F.min(F.struct("ticket", "chars")).alias("x")).select("block", "hash", "train", "eval", "x.*")
    classes = cut(classes, "classes", compression="zstd")
    same = classes.filter("train AND eval").select("block", F.col("hash").alias("ha"), F.col("hash").alias("hb"), F.lit(1.0).alias("share"), F.lit("hash").alias("way"))
    size = classes.groupBy("block").agg(F.sum("chars").alias("size"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    sized = classes.select("block", "hash", "train", "eval", "ticket").join(size, "block")
    one_text = texts.select("ticket", "hash", "text").dropDuplicates(["ticket", "hash"])
    of = lambda which: sized.filter(which).drop("size", "classes").join(one_text, ["ticket", "hash"]).select("block", "hash", "train", "eval", "text")
    tasks = int(tickets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = of(F.col("size") <= block_chars).repartition(tasks, "block").sortWithinPartitions("block")
    near = small.mapInPandas(lambda it: _compared(it, share), "block bigint, ha bigint, hb bigint, share double")
    if not size.filter(F.col("size") > block_chars).isEmpty():
        near = near.union(_joined(cut(of(F.col("size") > block_chars), "large", compression="zstd"), share))
    linked = cut(near.select("*", F.lit("near").alias("way")).union(same), "linked")
    left = rows.filter("side = 1").select("block", F.col("hash").alias("ha"), F.col("ticket_id").alias("ta"), "repo")
    right = rows.filter("side = 2").select("block", F.col("hash").alias("hb"), F.col("ticket_id").alias("tb"), "split")
    pairs = linked.join(left, ["block", "ha"]).join(right, ["block", "hb"]).filter("ta <> tb")
    best = F.max(F.struct("share", F.when(F.col("way") == "hash", 1).otherwise(0).alias("h"), "way")).alias("x")
    return pairs.groupBy(F.least("ta", "tb").alias("ticket_a"), F.greatest("ta", "tb").alias("ticket_b"), "repo", "split").agg(best).select("ticket_a", "ticket_b", "repo", "split", "x.share", "x.way")


def report(pairs: DataFrame) -> DataFrame:
    """(split, repo, pairs, by_hash, near): overlaps of each evaluation split and repo, how many have the same canonical text and how many nearly the same."""
    n = lambda way: F.count(F.when(F.col("way") == way, 1))
    return pairs.groupBy("split", "repo").agg(F.count(F.lit(1)).alias("pairs"), n("hash").alias("by_hash"), n("near").alias("near"))
