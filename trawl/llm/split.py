"""Problem 4: cutting oversized texts into balanced pieces at natural boundaries, with overlap."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
_OPENS = re.compile(r"\s*(?:@|def |async |class |func |function |export |public |private |protected |static |import |package |#include|#define|type |interface |struct |enum )")
_PAUSE = re.compile(r"[;},)\]]\s*|\s+")
#: How strong a place is: before a declaration at the outer level, after a blank line, before a line at the outer level, at a line end, at a pause inside a line.
OUTER, BLANK, LEVEL, LINE, PAUSE = 5, 4, 3, 2, 1


def _lines(text: str) -> list[int]:
    """Offsets at which lines start, then the length of the text."""
    at = [m.start() for m in _LINE.finditer(text) if m.end() > m.start()]
    return [*at, len(text)] if at else [0, len(text)]


def boundaries(text: str, limit: int) -> tuple[list[int], list[int], list[int]]:
    """(line starts, boundary offsets, strengths). Pauses inside a line are listed only for lines that no few pieces could hold whole."""
    starts = _lines(text)
    rows = [text[a:b] for a, b in zip(starts, starts[1:], strict=False)]
    indents = [len(r) - len(r.lstrip()) for r in rows if r.strip()]
    inner = sorted(indents)[len(indents) // 4] if indents else 0
    offs, strong = [], []
    for k, (a, row) in enumerate(zip(starts, rows, strict=False)):
        if k:
            blank_before, indent = not rows[k - 1].strip(), len(row) - len(row.lstrip())
            if not row.strip():
                s = LINE
            elif indent <= inner and _OPENS.match(row):
                s = OUTER
            elif blank_before:
                s = BLANK
            elif indent <= inner and not row.lstrip().startswith(("}", ")", "]", "else", "elif", "except", "finally", "catch")):
                s = LEVEL
            else:
                s = LINE
            offs.append(a)
            strong.append(s)
        if len(row) > limit // 4:
            for m in _PAUSE.finditer(row):
                if 0 < m.end() < len(row):
                    offs.append(a + m.end())
                    strong.append(PAUSE)
    return starts, offs, strong


def _back(starts: list[int], cut: int, size: int, unit: str) -> int:
    """Where the stated overlap before ``cut`` begins: ``size`` lines (a cut line counts as one) or characters earlier."""
    if size <= 0:
        return cut
    return starts[max(0, bisect_left(starts, cut) - size)] if unit == "lines" else max(0, cut - size)


def cut(text: str, limit: int, overlap: int, unit: str = "lines") -> list[tuple[int, int, int]]:
    """Pieces (start with overlap, own start, end) in code points: every one within ``limit``, together the whole text.

    The smallest piece count that could do is tried first; equal-length targets are snapped to the strongest boundary within
    a quarter piece whose overlap leaves room (the nearest among equals, the earlier among those); when a piece is too long, one more piece is tried.
    A piece begins with the stated overlap; only where that has more characters than the limit less ``step_room`` is it cut to half the limit.
    A text within the limit is one piece.
    """
    n, limit = len(text), max(1, limit)
    if n <= limit:
        return [(0, 0, n)]
    starts, offs, strong = boundaries(text, limit)
    most = limit - step_room(limit)
    back = [_back(starts, o, overlap, unit) for o in offs]
    k = -(-n // limit)
    while True:
        step, pieces, own, begin = n / k, [], 0, 0
        for i in range(1, k + 1):
            if i == k:
                end = n
            else:
                target = round(i * step)
                low, high = max(own + 1, int(target - step / 4)), min(begin + limit, int(target + step / 4), n - 1)
                a, b = bisect_left(offs, low), bisect_right(offs, high)
                if a < b:
                    end = offs[min(range(a, b), key=lambda j: (offs[j] - back[j] > most, -strong[j], abs(offs[j] - target), offs[j]))]
                else:
                    end = min(max(target, own + 1), begin + limit)
            if end - begin > limit or end <= own:
                break
            pieces.append((begin, own, end))
            whole = _back(starts, end, overlap, unit)
            begin, own = whole if whole >= begin and end - whole <= most else max(whole, begin, end - limit // 2), end
        else:
            return pieces
        k += 1


def step_room(limit: int) -> int:
    """Characters that a piece keeps free for text that the piece before lacks: an eighth of the limit."""
    return max(1, limit // 8)


_OUT = "repo string, base_commit string, chunk_id string, file_path string, symbol_kind string, piece int, pieces int, start_line int, end_line int, overlap_chars int, overlap_whole boolean, piece_text string"


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for r in f.itertuples(index=False):
            starts = _lines(r.code_text)
            lines = len(starts) - 1
            known = [int(x) for x in (r.start_line, r.end_line) if pd.notna(x)]
            first = min(known) if len(known) == 2 or pd.notna(r.start_line) else known[0] - lines + 1 if known else None
            first = None if first is None else max(1, first)
            parts = cut(r.code_text, int(r.max_size), int(r.overlap_size), r.overlap_unit)
            for i, (begin, own, end) in enumerate(parts, 1):
                a, b = bisect_right(starts, begin) - 1, bisect_left(starts, end) - 1
                at = (None, None) if first is None else (first + a, first + max(a, b))
                out.append((r.repo, r.base_commit, r.chunk_id, r.file_path, r.symbol_kind, i, len(parts), *at, own - begin, begin == (0 if i == 1 else _back(starts, own, int(r.overlap_size), r.overlap_unit)), r.code_text[begin:end]))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])
        yield frame.astype({c: "Int32" for c in ("start_line", "end_line")})


def split_oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """One row per piece of each chunk whose text has more code points than the limit of its kind.

    ``limits``: item_kind, unit_name, max_size, overlap_size, overlap_unit; only rows in characters count, of a repeated
    kind the smallest limit. Kinds are compared without surrounding white space and case, a null kind is ``chunk``, a kind
    without a limit is never cut. Null and empty texts are within every limit. Of repeated rows each is cut once. Lines:
    swapped numbers are put in order, a missing first line is counted back from the last, with neither both stay null.
    The pieces overlap by what is stated; overlap_whole is false for the pieces where that cannot be, because the lines before the cut alone have more characters
    than seven eighths of the limit or go further back than the piece before.
    """
    kind = F.lower(F.trim(F.regexp_replace(F.coalesce("symbol_kind", F.lit("chunk")), r"^\s+|\s+$", "")))
    rules = (
        limits.filter("lower(trim(unit_name)) = 'chars' AND max_size > 0")
        .groupBy(F.lower(F.trim("item_kind")).alias("kind"))
        .agg(F.min(F.struct("max_size", F.coalesce("overlap_size", F.lit(0)).alias("overlap_size"), F.lower(F.coalesce("overlap_unit", F.lit("lines"))).alias("overlap_unit"))).alias("x"))
        .select("kind", "x.*")
    )
    big = (
        chunks.select("repo", "base_commit", "chunk_id", "file_path", kind.alias("symbol_kind"), "start_line", "end_line", "code_text")
        .join(rules, F.col("symbol_kind") == F.col("kind"))
        .filter(F.char_length("code_text") > F.col("max_size"))
        .drop("kind")
        .dropDuplicates()
    )
    return big.mapInPandas(_pieces, _OUT)
