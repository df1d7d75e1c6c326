"""Retrieval: TF-IDF of reports against the chunks of their snapshot, bounded evidence signals, weighted scores, rankings and file scores.

A snapshot is (repo, base_commit). Terms are kept as counts, so every join is an equi join on (snapshot, term) whose two sides carry
one row per distinct term; corpus statistics are counted over all chunks of the snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.functions.keys import plain_snapshot
from trawl.operators import projections as P
from trawl.storage import cut

SNAPSHOT = ["repo", "base_commit"]
#: Weights of the signals in a chunk's score.
WEIGHTS = {"embedding": 0.50, "trace": 0.30, "component": 0.05, "keyword": 0.08, "symbol": 0.07, "path": 0.12, "identifier": 0.14, "package": 0.12}
#: Added before rounding, so that a value that lies just between two does so on every engine in the same way.
HALF = 1e-10
#: File aggregation.
EVIDENCE = {"ratio": 0.80, "floor": 0.05, "chunk_bonus": 0.0125, "chunk_cap": 0.05, "symbol_bonus": 0.01, "symbol_cap": 0.04, "package_cap": 0.10, "max_chunks": 5, "overlap": 0.5}


def corpus(chunks: DataFrame) -> DataFrame:
    """One row per chunk with its search text and the columns that rankings order by; of repeated rows one is kept. A corpus is returned as it is."""
    if "search_text" in chunks.columns:
        return chunks
    text = F.concat_ws("\n", *[F.nullif(F.col(c), F.lit("")) for c in ("file_path", "language", "symbol_kind", "function_name", "class_name", "code_text")])
    lines = F.abs(F.coalesce(F.col("end_line") - F.col("start_line"), F.lit(0)))
    kind = F.lower(F.trim(F.coalesce("symbol_kind", F.lit("chunk"))))
    rank = F.when(kind.contains("method") | kind.contains("function"), 0).when(kind == "class", 1).otherwise(2)
    name = F.coalesce(F.nullif(F.col("function_name"), F.lit("")), F.nullif(F.col("class_name"), F.lit("")), F.lit(""))
    row = F.struct(text.alias("search_text"), rank.alias("kind_rank"), lines.alias("span"), name.alias("symbol_name"), "start_line", "end_line")
    return chunks.groupBy(*SNAPSHOT, "chunk_id", "file_path").agg(F.min(row).alias("x")).select(*SNAPSHOT, "chunk_id", "file_path", "x.*")


def reports(tickets: DataFrame) -> DataFrame:
    """One row per ticket and snapshot with its report text; of repeated rows the longest text is kept, then the largest."""
    rows = plain_snapshot(tickets).filter("repo IS NOT NULL AND base_commit IS NOT NULL").select("ticket_id", *SNAPSHOT, P.bug_text(tickets).alias("bug_text"), T.text_or_empty(F.col("component")).alias("component"))
    best = F.max(F.struct(F.char_length("bug_text"), "bug_text", "component"))
    return rows.groupBy("ticket_id", *SNAPSHOT).agg(best.alias("x")).select("ticket_id", *SNAPSHOT, "x.bug_text", "x.component")


def term_counts(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, term, tf)."""
    return rows.select(*keys, F.explode(T.tokens(F.col(text))).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(terms: DataFrame, docs: DataFrame) -> DataFrame:
    """(snapshot, term, df, idf): idf = ln((N + 1) / (df + 1)) + 1 over the snapshot's chunks."""
    n = docs.groupBy(*SNAPSHOT).agg(F.count(F.lit(1)).alias("total"))
    df = terms.groupBy(*SNAPSHOT, "term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(n, SNAPSHOT).select(*SNAPSHOT, "term", "df", (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def numbered_chunks(chunks: DataFrame) -> DataFrame:
    """The corpus with 64-bit numbers of its snapshots (snap) and chunks (c)."""
    return corpus(chunks).withColumns({"snap": F.xxhash64(*SNAPSHOT), "c": F.xxhash64("chunk_id")})


def numbered_reports(tickets: DataFrame) -> DataFrame:
    """Reports with 64-bit numbers of their snapshots (snap) and tickets (t)."""
    return reports(tickets).withColumns({"snap": F.xxhash64(*SNAPSHOT), "t": F.xxhash64("ticket_id")})


def renamed(rows: DataFrame, asked: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows by number with the names of their tickets, snapshots and chunks."""
    named = rows.join(docs.select("snap", "c", "chunk_id").distinct(), ["snap", "c"])
    return named.join(asked.select("t", "snap", "ticket_id", *SNAPSHOT).distinct(), ["t", "snap"])


def tfidf(tickets: DataFrame, chunks: DataFrame) -> DataFrame:
    """(ticket_id, snapshot, chunk_id, cosine) of chunks (or of a corpus of them) that share a term with the report, cosine rounded to 6 places.

    Weight (1 + ln tf) idf; terms that no chunk has are left out of the report's vector. A snapshot is scored in one task (see ``snapshots``), a very large one by joins.
    """
    return _scored(tickets, chunks, rows=False).select("ticket_id", *SNAPSHOT, "chunk_id", "cosine")


def tfidf_rows(tickets: DataFrame, chunks: DataFrame) -> DataFrame:
    """``tfidf`` with the columns that rankings order by, a row for each file of a chunk id."""
    return _scored(tickets, chunks, rows=True)


def _scored(tickets: DataFrame, chunks: DataFrame, rows: bool) -> DataFrame:
    from trawl.operators import snapshots as SN

    out = None
    for large, some, docs in SN.split(tickets, chunks):
        if large:
            part = tfidf_joined(some, docs)
            part = part.join(order_columns(docs), [*SNAPSHOT, "chunk_id"]) if rows else part
        else:
            part = SN.meeting(some, docs, whole=False, rows=rows).withColumn("cosine", F.round("cosine", 6))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def tfidf_joined(tickets: DataFrame, chunks: DataFrame) -> DataFrame:
    """``tfidf`` by joins on terms, for snapshots of any size."""
    # Terms are counted once and kept in the shared folder: they are read for frequencies, vectors and norms. Snapshots, chunks, tickets and terms go by
    # 64-bit numbers, so that rows that are shuffled are few bytes; names come back at the end.
    docs, asked = numbered_chunks(chunks), numbered_reports(tickets)
    count = lambda df, key, text: df.select("snap", key, F.explode(T.tokens(F.col(text))).alias("term")).select("snap", key, F.xxhash64("term").alias("term")).groupBy("snap", key, "term").agg(F.count(F.lit(1)).alias("tf"))
    terms = cut(count(docs, "c", "search_text"), "terms", compression="zstd")
    query_terms = count(asked, "t", "bug_text")
    n = chunks.groupBy(F.xxhash64(*SNAPSHOT).alias("snap")).agg(F.count_distinct("chunk_id", "file_path").alias("total"))
    weight = (1 + F.log("tf")) * F.col("idf")
    # Counted with partial sums and joined back: a common term of a hot snapshot is split by the join like any skewed key, and nothing is sorted by term.
    counts = terms.groupBy("snap", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = cut(counts.join(n, "snap").select("snap", "term", (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("idf")), "idf", compression="zstd")
    vectors = cut(terms.join(idf, ["snap", "term"]).select("snap", "c", "term", weight.alias("wd")), "vectors", compression="zstd")
    norms = vectors.groupBy("snap", "c").agg(F.sqrt(F.sum(F.col("wd") * F.col("wd"))).alias("nd"))
    query = cut(query_terms.join(idf, ["snap", "term"]).select("t", "snap", "term", weight.alias("wq")), "query", compression="zstd")
    qnorms = query.groupBy("t", "snap").agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("nq"))
    dots = query.join(vectors, ["snap", "term"]).groupBy("t", "snap", "c").agg(F.sum(F.col("wq") * F.col("wd")).alias("dot"))
    chunk = norms.join(docs.select("snap", "c", "chunk_id").distinct(), ["snap", "c"])
    report = qnorms.join(asked.select("t", "snap", "ticket_id", *SNAPSHOT), ["t", "snap"])
    return dots.join(chunk, ["snap", "c"]).join(report, ["t", "snap"]).select("ticket_id", *SNAPSHOT, "chunk_id", F.round(F.col("dot") / (F.col("nd") * F.col("nq")), 6).alias("cosine"))


def ranked(scores: DataFrame, score: str, k: int, per: tuple[str, ...] = ("ticket_id",)) -> DataFrame:
    """The k best rows per ticket by score, kind rank, span and chunk id (a total order)."""
    w = Window.partitionBy(*per).orderBy(F.desc(score), "kind_rank", "span", "chunk_id")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def order_columns(chunks: DataFrame) -> DataFrame:
    return corpus(chunks).select(*SNAPSHOT, "chunk_id", "file_path", "kind_rank", "span", "symbol_name", "start_line", "end_line")


def component_terms(tickets: DataFrame, chunks: DataFrame) -> DataFrame:
    """(ticket_id, snapshot, term): component terms that the repository's name lacks and that fewer than 35 % of the snapshot's files have."""
    files = chunks.select(*SNAPSHOT, "file_path").distinct()
    total = files.groupBy(*SNAPSHOT).agg(F.count(F.lit(1)).alias("files"))
    have = files.select(*SNAPSHOT, "file_path", F.explode(F.array_distinct(T.tokens(F.col("file_path")))).alias("term")).groupBy(*SNAPSHOT, "term").agg(F.count(F.lit(1)).alias("n"))
    asked = reports(tickets).select("ticket_id", *SNAPSHOT, F.explode(F.array_except(T.important_terms(F.col("component")), T.important_terms(F.col("repo")))).alias("term"))
    joined = asked.join(total, SNAPSHOT).join(have, [*SNAPSHOT, "term"], "left")
    return joined.filter(F.coalesce("n", F.lit(0)) / F.col("files") < 0.35).select("ticket_id", *SNAPSHOT, "term")


def trace_scores(tickets: DataFrame, chunks: DataFrame) -> DataFrame:
    """(ticket_id, snapshot, chunk_id, trace): best evidence of file references; the join is on the file's name, which every match implies.

    .75 for a line inside the chunk, .55 within 25 lines of its edges, .35 for another line or none.
    """
    text = F.concat_ws("\n", T.text_or_empty(F.col("error_message")), T.text_or_empty(F.col("description")))
    refs = plain_snapshot(tickets).filter("repo IS NOT NULL").select("ticket_id", *SNAPSHOT, F.explode(T.trace_refs(text)).alias("r")).select("ticket_id", *SNAPSHOT, T.norm_path(F.col("r.file")).alias("ref"), F.col("r.line").alias("line")).distinct()
    refs = refs.withColumn("name", T.base_name(F.col("ref"))).filter("name <> ''")
    at = order_columns(chunks).filter("start_line IS NOT NULL AND end_line IS NOT NULL").withColumn("name", T.base_name(T.norm_path(F.col("file_path"))))
    low, high = F.least("start_line", "end_line"), F.greatest("start_line", "end_line")
    near = F.least(F.abs(low - F.col("line")), F.abs(high - F.col("line"))) <= 25
    score = F.when(F.col("line").isNull(), 0.35).when(F.col("line").between(low, high), 0.75).when(near, 0.55).otherwise(0.35)
    return refs.join(at, [*SNAPSHOT, "name"]).groupBy("ticket_id", *SNAPSHOT, "chunk_id").agg(F.max(score).alias("trace"))


def lexical_signals(tickets: DataFrame, chunks: DataFrame) -> DataFrame:
    """(ticket_id, snapshot, chunk_id, keyword, symbol): both from the report's important terms, joined by term and counted, never pair by pair."""
    # Names are in the search text, so a term needs only a mark. Rows go by 64-bit numbers, as in ``tfidf``.
    asked = numbered_reports(tickets)
    query = asked.select("snap", "t", T.important_terms(F.col("bug_text")).alias("terms")).select("snap", "t", F.size("terms").alias("n"), F.explode("terms").alias("term")).withColumn("term", F.xxhash64("term"))
    docs = numbered_chunks(chunks)
    names = F.array_distinct(T.tokens(F.concat_ws(" ", "file_path", "symbol_name")))
    terms = docs.select("snap", "c", names.alias("names"), F.explode(F.array_distinct(T.tokens(F.col("search_text")))).alias("term")).select("snap", "c", F.xxhash64("term").alias("term"), F.array_contains("names", F.col("term")).cast("int").alias("named"))
    hits = query.join(terms, ["snap", "term"]).groupBy("t", "snap", "n", "c").agg(F.count(F.lit(1)).alias("k"), F.sum("named").alias("s"))
    keyword = F.least(F.lit(1.0), F.col("k") / F.greatest(F.lit(4), F.least(F.col("n"), F.lit(12))))
    return renamed(hits, asked, docs).select("ticket_id", *SNAPSHOT, "chunk_id", F.round(keyword, 6).alias("keyword"), F.round(F.col("s") / F.col("n"), 6).alias("symbol"))


def component_scores(tickets: DataFrame, chunks: DataFrame) -> DataFrame:
    """(ticket_id, snapshot, chunk_id, component): share of the component terms in the chunk's path and name."""
    asked = component_terms(tickets, chunks)
    n = asked.groupBy("ticket_id", *SNAPSHOT).agg(F.count(F.lit(1)).alias("n"))
    docs = corpus(chunks)
    terms = docs.select(*SNAPSHOT, "chunk_id", F.explode(F.array_distinct(T.tokens(F.concat_ws(" ", "file_path", "symbol_name")))).alias("term"))
    hits = asked.join(terms, [*SNAPSHOT, "term"]).groupBy("ticket_id", *SNAPSHOT, "chunk_id").agg(F.count(F.lit(1)).alias("k"))
    return hits.join(n, ["ticket_id", *SNAPSHOT]).select("ticket_id", *SNAPSHOT, "chunk_id", F.round(F.col("k") / F.col("n"), 6).alias("component"))


def path_signals(tickets: DataFrame, chunks: DataFrame) -> DataFrame:
    """(ticket_id, snapshot, file_path, path): overlap of the report's words with the file's name, else with its folders.

    A snapshot is scored in one task (see ``snapshots``), a very large one by joins.
    """
    from trawl.operators import snapshots as SN

    out = None
    for large, some, docs in SN.split(tickets, chunks.select(*SNAPSHOT, "file_path")):
        part = path_joined(some, docs) if large else SN.meeting_paths(some, docs).withColumn("path", F.round("path", 6))
        out = part if out is None else out.unionByName(part)
    return out


def path_joined(tickets: DataFrame, chunks: DataFrame) -> DataFrame:
    """``path_signals`` by joins on words, for snapshots of any size.

    Words are many rows for each report and file, which the size checks do not count, so the join is merged at any size: its sides never go through the driver.
    """
    stem = F.regexp_replace(T.base_name(F.col("p")), r"\.[a-z0-9]+\z", "")
    words = lambda c: F.array_distinct(F.concat(T.tokens(c), F.regexp_extract_all(c, F.lit("[a-z0-9]+"), F.lit(0))))
    files = chunks.select(*SNAPSHOT, "file_path", F.lower(T.norm_path(F.col("file_path"))).alias("p")).distinct().select(*SNAPSHOT, "file_path", words(stem).alias("leaf"), words(F.replace("p", F.lit("/"), F.lit(" "))).alias("all"))
    terms = files.select(*SNAPSHOT, "file_path", F.explode("all").alias("term"), "leaf").select(*SNAPSHOT, "file_path", "term", F.array_contains("leaf", F.col("term")).cast("int").alias("is_leaf"))
    query = reports(tickets).select("ticket_id", *SNAPSHOT, F.explode(F.array_distinct(F.concat(T.important_terms(F.col("bug_text")), F.regexp_extract_all(F.lower("bug_text"), F.lit("[a-z0-9]+"), F.lit(0))))).alias("term")).filter(~F.col("term").isin(*T.STOP_WORDS))
    hits = query.hint("merge").join(terms, [*SNAPSHOT, "term"]).groupBy("ticket_id", *SNAPSHOT, "file_path").agg(F.sum("is_leaf").alias("l"), F.sum(1 - F.col("is_leaf")).alias("q"))
    score = F.when(F.col("l") > 0, F.least(F.lit(1.0), 0.55 + 0.1 * (F.col("l") - 1))).when(F.col("q") >= 2, F.least(F.lit(0.65), 0.3 + 0.08 * F.col("q"))).otherwise(0.25)
    return hits.select("ticket_id", *SNAPSHOT, "file_path", F.round(score, 6).alias("path"))


def weighted(tickets: DataFrame, chunks: DataFrame) -> DataFrame:
    """(ticket_id, snapshot, chunk_id, file_path, kind_rank, span, signals..., score): the clamped weighted sum of all signals (each with 6 places), rounded to 8 places.

    A snapshot is scored in one task (see ``snapshots``), a very large one by joins.
    """
    from trawl.operators import snapshots as SN

    out = None
    for large, some, docs in SN.split(tickets, chunks):
        if large:
            part = weighted_joined(some, cut(corpus(docs), "corpus", compression="zstd"))
        else:
            rows = SN.meeting(some, docs, whole=True)
            part = _weighed(rows.withColumns({s: F.round(s, 6) for s in ("cosine", *SN.SIGNALS)}))
        out = part if out is None else out.unionByName(part)
    return out


def _weighed(rows: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    total = sum(F.lit(w) * zero(c) for c, w in (("cosine", WEIGHTS["embedding"]), ("trace", WEIGHTS["trace"]), ("component", WEIGHTS["component"]), ("keyword", WEIGHTS["keyword"]), ("symbol", WEIGHTS["symbol"]), ("path", WEIGHTS["path"]), ("identifier", WEIGHTS["identifier"])))
    names = ("cosine", "trace", "component", "keyword", "symbol", "path", "identifier")
    return rows.select("ticket_id", *SNAPSHOT, "chunk_id", "file_path", "kind_rank", "span", "symbol_name", "start_line", "end_line", *[zero(c).alias(c) for c in names], F.round(T.clamp(total), 8).alias("score"))


def weighted_joined(tickets: DataFrame, chunks: DataFrame) -> DataFrame:
    """``weighted`` by joins on terms, for snapshots of any size."""
    from trawl.operators.selection import identifier_scores

    keys = ["ticket_id", *SNAPSHOT, "chunk_id"]
    parts = [tfidf_joined(tickets, chunks), trace_scores(tickets, chunks), lexical_signals(tickets, chunks), component_scores(tickets, chunks), identifier_scores(tickets, chunks)]
    joined = parts[0]
    for p in parts[1:]:
        joined = joined.join(p, keys, "full_outer")
    return _weighed(joined.join(order_columns(chunks), [*SNAPSHOT, "chunk_id"]).join(path_joined(tickets, chunks), ["ticket_id", *SNAPSHOT, "file_path"], "left"))


#: What each mode of file aggregation adds to a file's best chunk.
AGGREGATIONS = {"basic": (0, 0), "supporting-chunks": (1, 0), "supporting-symbols": (1, 1)}


def _picked(scores: DataFrame, *extra: str) -> DataFrame:
    """(ticket_id, file_path, xs, picks): a file's chunks in rank order, and of them up to five that overlap no earlier pick by half of the shorter one.

    The choice depends on earlier choices, so it folds over each file's sorted chunks inside the JVM; a file's chunks are the bound of an array. Chunks without lines overlap nothing.
    """
    item = F.struct((-F.col("score")).alias("a"), "kind_rank", "span", "chunk_id", F.least("start_line", "end_line").alias("s"), F.greatest("start_line", "end_line").alias("e"), (F.col("symbol_name") if "symbol_name" in scores.columns else F.lit("")).alias("symbol_name"), *extra)
    rows = scores.groupBy("ticket_id", "file_path").agg(F.array_sort(F.collect_list(item)).alias("xs"))
    empty = F.filter("xs", lambda x: F.lit(False))
    whole = lambda x: F.greatest(F.lit(1), x["e"] - x["s"] + 1)
    shares = lambda x, y: F.greatest(F.lit(0), F.least(x["e"], y["e"]) - F.greatest(x["s"], y["s"]) + 1) / F.least(whole(x), whole(y))
    apart = lambda x, y: x["s"].isNull() | x["e"].isNull() | y["s"].isNull() | y["e"].isNull() | (shares(x, y) < EVIDENCE["overlap"])
    take = lambda acc, x: F.when((F.size(acc) < EVIDENCE["max_chunks"]) & F.forall(acc, lambda y: apart(x, y)), F.concat(acc, F.array(x))).otherwise(acc)
    return rows.withColumn("picks", F.aggregate("xs", empty, take))


def file_scores(scores: DataFrame, k: int, mode: str = "supporting-symbols") -> DataFrame:
    """(ticket_id, rank, file_path, chunk_id, evidence, symbols, file_score): the best chunk of each file, raised by independent further chunks and distinct symbols near its score.

    basic adds nothing, supporting-chunks adds for chunks, supporting-symbols for both. An unknown mode is an error.
    """
    return ranked(_filed(scores, mode), "file_score", k).select("ticket_id", "rank", "file_path", "chunk_id", "evidence", "symbols", "file_score")


def files_with_chunks(scores: DataFrame, *extra: str) -> DataFrame:
    """All files of ``file_scores`` with kind_rank, span and xs, their chunks with the ``extra`` columns, best first. Rows are shuffled once, by ticket."""
    # Scores have 8 places and signals 6: as whole numbers they are half the bytes, and the quotient is the same double.
    places = {"score": 1e8} | dict.fromkeys(extra, 1e6)
    moved = scores.withColumns({c: F.round(F.col(c) * n).cast("bigint") for c, n in places.items()}).repartition("ticket_id")
    filed = _filed(moved.withColumns({c: F.col(c) / n for c, n in places.items()}), "supporting-symbols", *extra)
    w = Window.partitionBy("ticket_id").orderBy(F.desc("file_score"), "kind_rank", "span", "chunk_id")
    return filed.withColumn("rank", F.row_number().over(w))


def _filed(scores: DataFrame, mode: str, *extra: str) -> DataFrame:
    if mode not in AGGREGATIONS:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(AGGREGATIONS)}")
    chunks, names = AGGREGATIONS[mode]
    best = F.col("xs")[0]
    score = -best["a"]
    near = F.filter("picks", lambda x: -x["a"] >= F.greatest(F.lit(EVIDENCE["floor"]), score * EVIDENCE["ratio"]) - 1e-12)
    symbols = F.size(F.array_distinct(F.filter(F.transform("near", lambda x: x["symbol_name"]), lambda n: n != "")))
    files = _picked(scores, *extra).withColumn("near", near).select("ticket_id", "file_path", score.alias("score"), best["kind_rank"].alias("kind_rank"), best["span"].alias("span"), best["chunk_id"].alias("chunk_id"), F.size("near").alias("evidence"), symbols.alias("symbols"), *["xs"] * bool(extra))
    bonus = chunks * F.least(F.lit(EVIDENCE["chunk_cap"]), EVIDENCE["chunk_bonus"] * F.greatest(F.lit(0), F.col("evidence") - 1)) + names * F.least(F.lit(EVIDENCE["symbol_cap"]), EVIDENCE["symbol_bonus"] * F.greatest(F.lit(0), F.col("symbols") - 1))
    return files.withColumn("file_score", F.round(T.clamp(F.col("score") + bonus) + HALF, 6))


def independent_evidence(scores: DataFrame) -> DataFrame:
    """(ticket_id, file_path, chunk_id, pick): the independent chunks of each file (see ``_picked``) in rank order."""
    picked = _picked(scores).select("ticket_id", "file_path", F.posexplode("picks").alias("pick", "x"))
    return picked.select("ticket_id", "file_path", F.col("x.chunk_id").alias("chunk_id"), (F.col("pick") + 1).alias("pick"))


def package_proximity(files: DataFrame, references: int = 30) -> DataFrame:
    """(ticket_id, file_path, depth, neighbour): the deepest folder that a ranked file shares with one of the first files of its ticket, and the largest such file.

    Every shared prefix is an equi join key; per (ticket, prefix) only the two largest file names are kept, so no pairs are listed.
    """
    parts = F.filter(F.split(T.norm_path(F.col("file_path")), "/"), lambda x: x != "")
    # A file's own name can only be shared with itself, so folders are enough.
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("prefix")))
    each = files.filter(F.size(parts) > 1).select("ticket_id", "file_path", "rank", F.explode(prefixes).alias("p")).select("ticket_id", "file_path", "rank", "p.*")
    heads = each.filter(F.col("rank") <= references).groupBy("ticket_id", "depth", "prefix").agg(F.slice(F.reverse(F.array_sort(F.collect_set("file_path"))), 1, 2).alias("heads"))
    other = F.when(F.col("heads")[0] != F.col("file_path"), F.col("heads")[0]).otherwise(F.try_element_at("heads", F.lit(2)))
    found = each.join(heads, ["ticket_id", "depth", "prefix"]).withColumn("neighbour", other).filter("neighbour IS NOT NULL")
    best = found.groupBy("ticket_id", "file_path").agg(F.max(F.struct("depth", "neighbour")).alias("x"))
    return best.select("ticket_id", "file_path", "x.depth", "x.neighbour")


def package_boosted(files: DataFrame, reports: DataFrame, k: int) -> DataFrame:
    """(ticket_id, rank, file_path, boost, score): files raised where they share two folders or more with another strong file and have evidence of their own.

    ``files``: ticket_id, rank, file_path, chunk_id, file_score, kind_rank, span, identifier, path. Own evidence is a word of the path that the report has, or an identifier or path signal.
    """
    near = package_proximity(files).select("ticket_id", "file_path", "depth")
    variants = F.flatten(F.transform(T.report_identifiers(F.col("bug_text")), T.identifier_variants))
    asked = reports.select("ticket_id", F.explode(F.array_union(T.important_terms(F.col("bug_text")), variants)).alias("term")).distinct()
    words = files.select("ticket_id", "file_path", F.explode(F.array_distinct(T.tokens(T.norm_path(F.col("file_path"))))).alias("term")).filter(~F.col("term").isin(*T.STOP_WORDS))
    shared = words.join(asked, ["ticket_id", "term"], "left_semi").groupBy("ticket_id", "file_path").agg(F.count(F.lit(1)).alias("n"))
    x = files.join(near, ["ticket_id", "file_path"], "left").join(shared, ["ticket_id", "file_path"], "left").na.fill(0, ["depth", "n"]).withColumn("local", F.greatest("identifier", "path"))
    score = F.least(F.lit(1.0), 0.35 + 0.12 * F.greatest(F.lit(0), F.col("depth") - 2) + 0.20 * F.col("local") + 0.04 * F.col("n"))
    boost = F.when((F.col("depth") < 2) | ((F.col("n") == 0) & (F.col("local") <= 0)), 0.0).otherwise(F.least(F.lit(EVIDENCE["package_cap"]), WEIGHTS["package"] * score))
    raised = x.withColumn("raw", boost).select("ticket_id", "file_path", "chunk_id", "kind_rank", "span", F.round(F.col("raw") + HALF, 6).alias("boost"), F.round(T.clamp(F.col("file_score") + F.col("raw")) + HALF, 6).alias("score"))
    return ranked(raised, "score", k).select("ticket_id", "rank", "file_path", "boost", "score")


def dense_neighbours(vectors: DataFrame, k: int, every: int = 100, block: int = 2048) -> DataFrame:
    """(query_id, vec_id, cosine, rank): the k nearest vectors of every query (ids divisible by ``every``), searched in blocks against all rows.

    Queries and rows are cut into blocks of bounded size; a block of rows meets each block of queries as one matrix product, keeps k rows per query, and
    the partial lists are merged. Ties go to the smaller id. Null vectors are left out.
    """
    import numpy as np
    import pandas as pd

    rows = vectors.filter("embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    queries = rows.filter(F.col("vec_id") % every == 0)
    n = max(1, -(-queries.count() // block))
    asked = queries.select((F.pmod(F.xxhash64("vec_id"), F.lit(n))).alias("q"), F.struct("vec_id", "v").alias("x")).groupBy("q").agg(F.array_sort(F.collect_list("x")).alias("queries"))

    def best(qi, q, ri, r):  # noqa: ANN001, ANN202
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        c = np.round(unit(q) @ unit(r).T, 6)
        for i, query in enumerate(qi):
            keep = np.lexsort((ri, -c[i]))
            keep = keep[ri[keep] != query][:k]
            yield pd.DataFrame({"query_id": query, "vec_id": ri[keep], "cosine": c[i][keep]})

    def nearest(frames):  # noqa: ANN001, ANN202
        for f in frames:
            for qs, part in zip(f["queries"], f["rows"], strict=True):
                yield from best(np.array([x["vec_id"] for x in qs]), np.array([x["v"] for x in qs]), np.array([x["vec_id"] for x in part]), np.array([x["v"] for x in part]))

    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    if n == 1:  # one block of queries is small whatever the table: every task gets it, and rows are read once where they are
        few = queries.collect()
        if not few:
            return vectors.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, cosine double, rank int")
        sent = vectors.sparkSession.sparkContext.broadcast((np.array([x["vec_id"] for x in few]), np.array([x["v"] for x in few])))

        def scan(frames):  # noqa: ANN001, ANN202
            for f in frames:
                if len(f):
                    yield from best(*sent.value, f["vec_id"].to_numpy(), np.array(f["v"].tolist()))

        near = rows.mapInPandas(scan, "query_id bigint, vec_id bigint, cosine double")
        return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    blocks = max(1, -(-rows.count() // block))
    parts = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("b"), F.struct("vec_id", "v").alias("x")).groupBy("b").agg(F.collect_list("x").alias("rows"))
    cells = parts.select("b", "rows", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("q")).join(asked, "q")
    local = cells.select("queries", "rows").mapInPandas(nearest, "query_id bigint, vec_id bigint, cosine double")
    return local.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
