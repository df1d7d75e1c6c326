"""Text signals of reports against the chunks of their snapshot, a snapshot at a time.

Chunks and reports are shuffled once, by snapshot; terms are counted where the snapshot's rows meet and are never rows of a table. Results are those of
the joins in ``retrieval``, which take the snapshots that are too large for one task (``LARGEST``).
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from trawl.functions import text as T
from trawl.functions.keys import plain_snapshot
from trawl.operators import projections as P
from trawl.operators import retrieval as R
from trawl.storage import cut

#: What one task holds of a snapshot; beyond any of these it goes through joins, so the limits bound memory and never the result.
LARGEST = {"chunks": 20_000, "characters": 64_000_000, "pairs": 1_000_000}
SIGNALS = ("trace", "component", "keyword", "symbol", "identifier", "path")
_WORD, _PIECE, _DOTTED, _PLAIN = re.compile(T._WORD), re.compile(T._PIECE), re.compile(r"[a-z0-9_]+(?:\.[a-z0-9_]+)?"), re.compile("[a-z0-9]+")
_STOP, _CODE = frozenset(T.STOP_WORDS), re.compile("[a-z][0-9]{2,4}")


class _Spread(dict):
    """The tokens of each word seen so far; emptied when it grows beyond a bound."""

    def __missing__(self, word: str) -> list[str]:
        if len(self) >= 300_000:
            self.clear()
        self[word] = found = [t for t in (word.lower(), *[p.lower() for p in _PIECE.findall(word)]) if len(t) > 1]
        return found


_SPREAD = _Spread()


def tokens(text: str | None) -> list[str]:
    """``text.tokens`` of one text."""
    return [t for w in _WORD.findall(text or "") for t in _SPREAD[w]]


def token_counts(text: str | None) -> dict[str, int]:
    found: dict[str, int] = {}
    for w, n in Counter(_WORD.findall(text or "")).items():
        for t in _SPREAD[w]:
            found[t] = found.get(t, 0) + n
    return found


def important(text: str | None) -> list[str]:
    """``text.important_terms`` of one text."""
    return [t for t in dict.fromkeys(tokens(text)) if len(t) >= 3 and t not in _STOP][: T.MAX_TERMS]


def variants(name: str) -> list[str]:
    """``text.identifier_variants`` of one name."""
    single = [name[:-1]] if name.endswith("s") and len(name) > 4 else []
    return list(dict.fromkeys([name, *single, *[p for sep in "_." if sep in name for p in name.split(sep) if len(p) >= 3]]))


def norm_path(path: str) -> str:
    return path.replace("\\", "/").lstrip("./")


def _words(text: str) -> list[str]:
    return list(dict.fromkeys([*tokens(text), *_PLAIN.findall(text)]))


def _file_words(paths: Iterable[str | None]) -> dict:
    """Of each word of paths the files that have it: twice the file's place, and one more if the file's name has the word."""
    import numpy as np

    found = defaultdict(list)
    for k, path in enumerate(paths):
        if path is None:
            continue
        low = norm_path(path).lower()
        leaf = set(_words(re.sub(r"\.[a-z0-9]+\Z", "", low.rpartition("/")[2])))
        for t in _words(low.replace("/", " ")):
            found[t].append(2 * k + (t in leaf))
    return {t: np.array(x) for t, x in found.items()}


def _path_scores(text: str | None, query: list[str], by_file: dict, files: int):  # noqa: ANN202
    """The path signal of a report by file; 0 is none."""
    import numpy as np

    asked = [by_file[t] for t in set(query).union(_PLAIN.findall((text or "").lower())) if t in by_file and t not in _STOP]
    if not asked:
        return np.zeros(files)
    hits = np.bincount(np.concatenate(asked), minlength=2 * files).reshape(-1, 2)
    other, leaf = hits[:, 0], hits[:, 1]
    return np.where(leaf > 0, np.minimum(1.0, 0.55 + 0.1 * (leaf - 1)), np.where(other >= 2, np.minimum(0.65, 0.3 + 0.08 * other), np.where(other > 0, 0.25, 0.0)))


class _Snapshot:
    """The chunks of one snapshot, indexed by term."""

    def __init__(self, docs: dict[str, list], wanted: set[str] | None) -> None:
        import numpy as np

        self.np, self.docs = np, docs
        ids: dict[str | None, int] = {}
        self.chunk_of = np.array([ids.setdefault(x, len(ids)) for x in docs["chunk_id"]], dtype=np.int64)
        self.n, self.named_chunk = len(ids), np.array([x is not None for x in docs["chunk_id"]])
        self.first = np.unique(self.chunk_of, return_index=True)[1]
        counts: list[dict[str, int]] = [{} for _ in range(self.n)]
        self.wanted, self.having = defaultdict(set), {}
        dotted = [t for t in wanted or () if "." in t or not t[0].isalpha()]
        for c, text in zip(self.chunk_of.tolist(), docs["search_text"], strict=True):
            tf = token_counts(text)
            if wanted:
                has, low = wanted.intersection(tf), (text or "").lower()
                # In ASCII text a run of word characters that begins with a letter is a token already.
                if not low.isascii() or not (text or "").isascii() or any(t in low for t in dotted):
                    has |= wanted.intersection(_DOTTED.findall(low))
                for t in has:
                    self.wanted[t].add(c)
            if counts[c]:  # a chunk id in two files is one document
                for t, n in tf.items():
                    counts[c][t] = counts[c].get(t, 0) + n
            else:
                counts[c] = tf
        self.terms: dict[str, int] = {}
        term = np.array([self.terms.setdefault(t, len(self.terms)) for x in counts for t in x], dtype=np.int64)
        tf = np.array([n for x in counts for n in x.values()], dtype=np.float64)
        chunk = np.repeat(np.arange(self.n), [len(x) for x in counts])
        df = np.bincount(term, minlength=len(self.terms))
        self.idf = np.log((len(docs["chunk_id"]) + 1) / (df + 1)) + 1
        weight = (1 + np.log(tf)) * self.idf[term]
        self.norm = np.sqrt(np.bincount(chunk, weight * weight, minlength=self.n))
        order = np.argsort(term, kind="stable")
        self.chunk, self.weight, self.at = chunk[order], weight[order], np.concatenate(([0], np.cumsum(df)))
        if wanted is not None:
            self._index_names()

    def _index_names(self) -> None:
        self.names, self.by_file, self.traced, of_path = defaultdict(list), _file_words(dict.fromkeys(self.docs["file_path"])), defaultdict(list), {}
        paths = self.docs["file_path"]
        for i, (c, path, name) in enumerate(zip(self.chunk_of.tolist(), paths, self.docs["symbol_name"], strict=True)):
            if path not in of_path:
                of_path[path] = set(tokens(path))
            for t in of_path[path].union(tokens(name)) if name else of_path[path]:
                self.names[t].append(c)
            if path is not None and self.docs["start_line"][i] is not None and self.docs["end_line"][i] is not None:
                self.traced[norm_path(path).rpartition("/")[2]].append((c, *sorted((self.docs["start_line"][i], self.docs["end_line"][i]))))
        files = {p: k for k, p in enumerate(dict.fromkeys(paths))}
        self.file_of, self.files, self.in_files = self.np.array([files[p] for p in paths], dtype=self.np.int64), len(files), Counter()
        for path in files:
            if path is None:
                continue
            self.in_files.update(set(tokens(path)))
        unique = len(self.first) == len(paths)
        self.names = {t: self.np.array(x if unique else sorted(set(x))) for t, x in self.names.items()}

    def cosine(self, text: str | None):  # noqa: ANN201
        np = self.np
        asked = [(self.terms[t], n) for t, n in token_counts(text).items() if t in self.terms]
        if not asked:
            return np.zeros(self.n)
        ids = np.array([t for t, _ in asked])
        query = (1 + np.log(np.array([n for _, n in asked], dtype=np.float64))) * self.idf[ids]
        low, high = self.at[ids], self.at[ids + 1]
        where = np.concatenate([self.chunk[a:b] for a, b in zip(low, high, strict=True)])
        each = np.concatenate([self.weight[a:b] for a, b in zip(low, high, strict=True)]) * np.repeat(query, high - low)
        dot = np.bincount(where, each, minlength=self.n)
        return np.divide(dot, self.norm * np.sqrt(np.sum(query * query)), out=np.zeros(self.n), where=dot > 0)

    def signals(self, report: dict) -> dict:
        """Each signal by chunk; path by file."""
        np = self.np
        text = report["bug_text"]
        query = important(text)
        held = [self.terms[t] for t in query if t in self.terms]
        found = {"keyword": np.minimum(1.0, self._counted([self.chunk[self.at[t] : self.at[t + 1]] for t in held], self.n) / max(4, min(len(query), 12)))}
        found["symbol"] = self._counted([self.names[t] for t in query if t in self.names], self.n) / max(1, len(query))
        own = set(important(report["repo"]))
        part = [t for t in important(report["component"]) if t not in own and self.in_files[t] / self.files < 0.35]
        found["component"] = self._counted([self.names[t] for t in part if t in self.names], self.n) / max(1, len(part))
        names = report["identifiers"] or ()
        n = self._counted([self._having(x) for x in names], self.n)
        code = self._counted([self._having(x) for x in names if len(x) < 6 and _CODE.fullmatch(x)], self.n) > 0
        found["identifier"] = np.where(code, 1.0, np.where(n > 0, np.minimum(1.0, 0.5 + 0.1 * (n - 1)), 0.0))
        found["trace"] = np.zeros(self.n)
        for r in report["refs"] or ():
            ref = norm_path(r["file"]).rpartition("/")[2]
            for c, low, high in self.traced.get(ref, ()) if ref else ():
                line = r["line"]
                score = 0.35 if line is None else 0.75 if low <= line <= high else 0.55 if min(abs(low - line), abs(high - line)) <= 25 else 0.35
                found["trace"][c] = max(found["trace"][c], score)
        found["path"] = _path_scores(text, query, self.by_file, self.files)
        return found

    def _counted(self, places: list, n: int):  # noqa: ANN202
        return self.np.bincount(self.np.concatenate(places), minlength=n) if places else self.np.zeros(n)

    def _having(self, name: str):  # noqa: ANN202
        """The chunks that have a name or one of its variants."""
        if name not in self.having:
            self.having[name] = self.np.array(list(set().union(*[self.wanted.get(v, ()) for v in variants(name)])), dtype=self.np.int64)
        return self.having[name]


def _meet(whole: bool, rows: bool):  # noqa: ANN202
    def meet(docs, asked):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        kept = [c for c in docs.column_names if c != "search_text"]
        reports = asked.to_pylist() if docs.num_rows else []
        wanted = {v for r in reports for name in r["identifiers"] or () for v in variants(name)} if whole else None
        index = _Snapshot(docs.to_pydict(), wanted) if reports else None
        at, ticket, values = [], [], defaultdict(list)
        for k, report in enumerate(reports):
            cosine = index.cosine(report["bug_text"])
            found, hit = {}, cosine > 0
            if whole:
                found = index.signals(report)
                path = found.pop("path")
                for x in found.values():
                    hit = hit | (x > 0)
            take = np.flatnonzero(hit[index.chunk_of] & index.named_chunk) if rows else index.first[hit & index.named_chunk[index.first]]
            at.append(take)
            ticket.append(np.full(len(take), k))
            c = index.chunk_of[take]
            for name, x in ({"cosine": cosine} | found).items():
                values[name].append(x[c])
            if whole:
                values["path"].append(path[index.file_of[take]])
        none, join = np.zeros(0, dtype=np.int64), lambda xs: np.concatenate(xs) if xs else np.zeros(0)
        out = docs.select(kept).take(pa.array(join([none, *at])))
        who = asked.column("ticket_id").take(pa.array(join([none, *ticket])))
        out = out.add_column(0, "ticket_id", who)
        for name in ("cosine", *SIGNALS) if whole else ("cosine",):
            out = out.append_column(name, pa.array(join(values[name]), type=pa.float64()))
        return out

    return meet


def _asked(tickets: DataFrame) -> DataFrame:
    """Reports with their identifiers and the references of all rows of the ticket and snapshot."""
    text = F.concat_ws("\n", T.text_or_empty(F.col("error_message")), T.text_or_empty(F.col("description")))
    rows = plain_snapshot(tickets).filter("ticket_id IS NOT NULL AND repo IS NOT NULL AND base_commit IS NOT NULL")
    rows = rows.select("ticket_id", *R.SNAPSHOT, P.bug_text(tickets).alias("bug_text"), T.text_or_empty(F.col("component")).alias("component"), T.trace_refs(text).alias("refs"))
    best = F.max(F.struct(F.char_length("bug_text"), "bug_text", "component"))
    one = rows.groupBy("ticket_id", *R.SNAPSHOT).agg(best.alias("x"), F.array_distinct(F.flatten(F.collect_list("refs"))).alias("refs"))
    return one.select("ticket_id", *R.SNAPSHOT, "x.bug_text", "x.component", "refs", T.report_identifiers(F.col("x.bug_text")).alias("identifiers"))


def too_large(tickets: DataFrame, chunks: DataFrame) -> DataFrame:
    """The snapshots that no single task should hold."""
    text = next(c for c in ("search_text", "code_text", "file_path") if c in chunks.columns)
    have = chunks.groupBy(*R.SNAPSHOT).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length(text), F.lit(0))).alias("characters"))
    asked = plain_snapshot(tickets).groupBy(*R.SNAPSHOT).agg(F.count(F.lit(1)).alias("m"))
    big = (F.col("n") > LARGEST["chunks"]) | (F.col("characters") > LARGEST["characters"]) | (F.col("n") * F.col("m") > LARGEST["pairs"])
    return have.join(asked, R.SNAPSHOT).filter(big).select(*R.SNAPSHOT)


def meeting(tickets: DataFrame, chunks: DataFrame, whole: bool, rows: bool = True) -> DataFrame:
    """(ticket_id, snapshot, chunk_id, order columns, cosine, with ``whole`` the other signals) of chunks with evidence, values not rounded; without ``rows`` one row per chunk id."""
    docs = R.corpus(chunks.filter("repo IS NOT NULL AND base_commit IS NOT NULL").repartition(*R.SNAPSHOT))
    docs = docs.select(*R.SNAPSHOT, "chunk_id", "file_path", "search_text", "kind_rank", "span", "symbol_name", "start_line", "end_line")
    asked = _asked(tickets) if whole else R.reports(tickets.filter("ticket_id IS NOT NULL"))
    fields = [S.StructField("ticket_id", S.StringType()), *[f for f in docs.schema if f.name != "search_text"], *[S.StructField(s, S.DoubleType()) for s in (("cosine", *SIGNALS) if whole else ("cosine",))]]
    return docs.groupBy(*R.SNAPSHOT).cogroup(asked.groupBy(*R.SNAPSHOT)).applyInArrow(_meet(whole, rows), S.StructType(fields))


def _meet_paths(files, asked):  # noqa: ANN001, ANN202
    import numpy as np
    import pyarrow as pa

    paths, texts = files.column("file_path").to_pylist(), asked.column("bug_text").to_pylist()
    by_file = _file_words(paths) if texts else {}
    none = np.zeros(0, dtype=np.int64)
    at, ticket, values = [none], [none], [np.zeros(0)]
    for k, text in enumerate(texts if by_file else ()):
        score = _path_scores(text, important(text), by_file, len(paths))
        at.append(take := np.flatnonzero(score))
        ticket.append(np.full(len(take), k))
        values.append(score[take])
    out = files.take(pa.array(np.concatenate(at))).add_column(0, "ticket_id", asked.column("ticket_id").take(pa.array(np.concatenate(ticket))))
    return out.append_column("path", pa.array(np.concatenate(values)))


def meeting_paths(tickets: DataFrame, chunks: DataFrame) -> DataFrame:
    """(ticket_id, snapshot, file_path, path) of files with evidence, values not rounded."""
    files = chunks.select(*R.SNAPSHOT, "file_path").filter("repo IS NOT NULL AND base_commit IS NOT NULL").distinct()
    asked = R.reports(tickets).select("ticket_id", *R.SNAPSHOT, "bug_text")
    return files.groupBy(*R.SNAPSHOT).cogroup(asked.groupBy(*R.SNAPSHOT)).applyInArrow(_meet_paths, S.StructType([S.StructField("ticket_id", S.StringType()), *files.schema, S.StructField("path", S.DoubleType())]))


def split(tickets: DataFrame, chunks: DataFrame) -> Iterable[tuple[bool, DataFrame, DataFrame]]:
    """(is it large, tickets, chunks): the snapshots for single tasks and, if there are any, the large ones."""
    large = cut(too_large(tickets, chunks), "large")
    if large.isEmpty():
        return [(False, tickets, chunks)]
    plain = plain_snapshot(tickets)
    return [(False, plain.join(large, R.SNAPSHOT, "left_anti"), chunks.join(large, R.SNAPSHOT, "left_anti")), (True, plain.join(large, R.SNAPSHOT, "left_semi"), chunks.join(large, R.SNAPSHOT, "left_semi"))]
