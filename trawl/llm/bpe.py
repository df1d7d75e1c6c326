"""Problem 7: exact byte-pair encoding by dynamic programming over the prefixes of each pre-token.

Every prefix of a byte string has one encoding, so one last token per prefix is enough. A token that ends at a prefix (found
by the vocabulary's suffix-link automaton) is that last token if it stands next to the last token of the shorter prefix in
no other way, which a table of merges decides. Back-pointers then give the ids.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of the public vocabularies, and the one that problem 7 names.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens whose ids a worker remembers at most; when full it starts anew (only speed depends on it).
REMEMBERED = 400_000
#: Splitting pattern of the vocabulary (fixed value), and the same for texts of ASCII only.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable Latin-1 as itself, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder(dict):
    """Pre-token -> ids as little-endian int32 bytes; missing ones are computed and remembered."""

    def __init__(self, path: str):
        import re

        import ahocorasick
        import regex

        super().__init__()
        model = json.load(open(path, encoding="utf-8"))["model"]
        letters = _byte_letters()
        latin = lambda t: "".join(chr(letters[c]) for c in t)
        ids = {latin(t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.turn: dict[int, int] = {i: -1 for i in ids.values()}
        for turn, pair in enumerate(model["merges"]):
            a, b = (latin(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = ids[a + b]
            if whole not in self.halves:
                self.halves[whole], self.turn[whole] = (ids[a], ids[b]), turn
            self.joined[ids[a], ids[b]] = turn
        self.automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.any, self.ascii = regex.compile(PATTERN).findall, re.compile(ASCII).findall

    def compatible(self, left: int, right: int) -> bool:
        """Whether encoding the two tokens' bytes gives just the two tokens: undoing their merges from the latest on, no merge across the border comes before the merges that hide its halves."""
        a, b, until = left, right, len(self.joined) + 1
        while True:
            turn = self.joined.get((a, b))
            if turn is not None and turn < until:
                return False
            ta, tb = self.turn[a], self.turn[b]
            if ta < 0 and tb < 0:
                return True
            if ta > tb:  # the later merge is undone first; on the left side it is only in the way of merges that come after it
                until, a = ta, self.halves[a][1]
            else:
                until, b = tb + 1, self.halves[b][0]

    def __missing__(self, piece: str) -> bytes:
        text = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        n = len(text)
        last, came = [-1] * (n + 1), [0] * (n + 1)
        known = self.fits.get
        for end, (token, size) in self.automaton.iter(text):  # of each end the longest first
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:  # single bytes are tokens, so the shorter prefix has its last token
                key = last[start] << 20 | token
                ok = known(key)
                if ok is None:
                    if len(self.fits) >= REMEMBERED:
                        self.fits.clear()
                    ok = self.fits[key] = self.compatible(last[start], token)
                if not ok:
                    continue
            last[end], came[end] = token, start
        out = []
        while n:
            out.append(last[n])
            n = came[n]
        out.reverse()
        found = array("i", out).tobytes()
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, (self.ascii if text.isascii() else self.any)(text)))


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, the driver's copy of it where that was shipped; it is read once per worker."""
    if path not in _LOADED:
        from pyspark import SparkFiles

        try:
            here = SparkFiles.get(os.path.basename(path))
        except Exception:  # no Spark in this process
            here = path
        _LOADED[path] = Encoder(here if os.path.exists(here) else path)
    return _LOADED[path]


def ship(spark: SparkSession, path: str) -> str:
    """Give the executors the driver's copy of a vocabulary file, once per application; a path that only they have is left as it is."""
    sc = spark.sparkContext
    sent = sc.__dict__.setdefault("_trawl_files", {})
    name = os.path.basename(path)
    if os.path.exists(path) and name not in sent:
        sc.addFile(path)
        sent[name] = path
    if sent.get(name, path) != path:
        raise ValueError(f"another vocabulary is named {name} too")
    return path


def _ids(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in batches:
        parts = [enc.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
        offsets = np.zeros(len(parts) + 1, "<i4")
        np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))
        yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["key", "ids"])


def encode(df: DataFrame, key: str, text: str, vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(key, ids): the ids of each text, one row per input row, without special tokens; their strings are ordinary text.

    A null and an empty text both give an empty list. Texts are encoded whole, however long. There is no shuffle.
    """
    kind = df.schema[key].dataType.simpleString()
    ship(df.sparkSession, vocabulary)
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(lambda it: _ids(it, vocabulary), f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)


def _counts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in batches:
        n = [len(enc.encode(t)) // 4 if t else 0 for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32())], ["key", "tokens"])


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(key, tokens): the number of ids that ``encode`` gives; 0 for null and empty texts."""
    kind = df.schema[key].dataType.simpleString()
    ship(df.sparkSession, vocabulary)
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(lambda it: _counts(it, vocabulary), f"key {kind}, tokens int")
    return out.withColumnRenamed("key", key)
