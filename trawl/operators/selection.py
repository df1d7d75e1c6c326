"""Identifier evidence, symbol pools, gold lists, eligibility and audit samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.operators import retrieval as R
from trawl.operators.relations import seeded

#: Symbol kinds that a pool holds, and the code that a made-up module row takes.
POOL_KINDS = ("module", "function", "async_function", "method", "async_method", "class")
MODULE_CHUNKS, MODULE_CHARS = 3, 12_000


def identifier_scores(tickets: DataFrame, chunks: DataFrame) -> DataFrame:
    """(ticket_id, snapshot, chunk_id, identifier): report identifiers that a chunk has, themselves or as singular or part; 1.0 for a letter-and-digits code, else .5 and .1 for each further one.

    Variants are join keys against the chunk's distinct tokens and dotted names.
    """
    asked, docs = R.numbered_reports(tickets), R.numbered_chunks(chunks)
    names = asked.select("snap", "t", F.explode(T.report_identifiers(F.col("bug_text"))).alias("identifier"))
    code = F.col("identifier").rlike(r"^[a-z]\d{2,4}$").cast("int").alias("code")
    variants = names.select("snap", "t", F.xxhash64("identifier").alias("i"), code, F.explode(T.identifier_variants(F.col("identifier"))).alias("term")).select("snap", "t", "i", "code", F.xxhash64("term").alias("term"))
    text = F.lower("search_text")
    words = F.array_distinct(F.concat(T.tokens(F.col("search_text")), F.regexp_extract_all(text, F.lit(r"[a-z0-9_]+(?:\.[a-z0-9_]+)?"), F.lit(0))))
    terms = docs.select("snap", "c", F.explode(words).alias("term")).select("snap", "c", F.xxhash64("term").alias("term"))
    # One row per name and chunk first, so that names are counted and not held as a set.
    once = variants.join(terms, ["snap", "term"]).groupBy("t", "snap", "c", "i").agg(F.max("code").alias("code"))
    hits = R.renamed(once.groupBy("t", "snap", "c").agg(F.count(F.lit(1)).alias("n"), F.max("code").alias("code")), asked, docs)
    return hits.select("ticket_id", *R.SNAPSHOT, "chunk_id", F.when(F.col("code") == 1, F.lit(1.0)).otherwise(F.round(F.least(F.lit(1.0), 0.5 + 0.1 * (F.col("n") - 1)), 6)).alias("identifier"))


def symbol_pool(chunks: DataFrame) -> DataFrame:
    """(snapshot, file_path, kind, name, parts, code): symbols of the pool's kinds; a file without a module chunk gets a ``<module>`` row from its first three chunks, cut to 12,000 characters."""
    kind = F.lower(F.trim(F.coalesce("symbol_kind", F.lit("chunk"))))
    rows = chunks.select(*R.SNAPSHOT, "file_path", "chunk_id", kind.alias("kind"), F.coalesce(F.nullif(F.col("function_name"), F.lit("")), F.nullif(F.col("class_name"), F.lit("")), F.lit("")).alias("name"), F.coalesce("start_line", F.lit(2**31 - 1)).alias("at"), T.text_or_empty(F.col("code_text")).alias("code")).distinct()
    own = rows.filter(F.col("kind").isin(*POOL_KINDS)).select(*R.SNAPSHOT, "file_path", "kind", F.when(F.col("kind") == "module", "<module>").otherwise(F.col("name")).alias("name"), F.lit(1).alias("parts"), "code")
    bare = rows.join(rows.filter("kind = 'module'").select(*R.SNAPSHOT, "file_path").distinct(), [*R.SNAPSHOT, "file_path"], "left_anti")
    w = Window.partitionBy(*R.SNAPSHOT, "file_path").orderBy("at", "chunk_id", "code")
    first = bare.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= MODULE_CHUNKS)
    made = first.groupBy(*R.SNAPSHOT, "file_path").agg(F.array_sort(F.collect_list(F.struct("n", "code"))).alias("xs"), F.count(F.lit(1)).cast("int").alias("parts"))
    code = F.substring(F.array_join(F.transform("xs", lambda x: x["code"]), "\n"), 1, MODULE_CHARS)
    return own.union(made.select(*R.SNAPSHOT, "file_path", F.lit("module"), F.lit("<module>"), "parts", code))


def gold_lists(outcomes: DataFrame, gold: DataFrame) -> DataFrame:
    """(ticket_id, files): per ticket its listed files and then its gold files, normalised, each once, the first kept in place."""
    listed = outcomes.groupBy("ticket_id").agg(F.max("baseline_top").alias("a"))
    mapped = gold.filter("mapping_status = 'mapped'").groupBy("ticket_id").agg(F.array_sort(F.collect_set("file_path")).alias("b"))
    both = listed.join(mapped, "ticket_id", "left")
    none = F.array().cast("array<string>")
    files = F.array_distinct(F.filter(F.transform(F.concat(F.coalesce("a", none), F.coalesce("b", none)), T.norm_path), lambda x: x != ""))
    return both.select("ticket_id", F.array_join(files, "|").alias("files"))


def eligible(gold: DataFrame, ranked: DataFrame, k: int = 5) -> DataFrame:
    """Tickets of which some gold file is among the first k ranked files."""
    top = ranked.filter(F.col("rank") <= k).select("ticket_id", F.col("file_path").alias("gold_file"))
    return gold.join(top, ["ticket_id", "gold_file"], "left_semi").select("ticket_id").distinct()


def audit_sample(rows: DataFrame, stratum: str, item: str, quota: int, size: int, seed: int) -> DataFrame:
    """(item, stratum, reason): ``quota`` items of each stratum in hash order, then others in hash order until ``size``; the sample size is the feature."""
    w = Window.partitionBy(stratum).orderBy(seeded(seed, F.col(item)), item)
    placed = rows.select(item, stratum).distinct().withColumn("late", (F.row_number().over(w) > quota).cast("int"))
    chosen = placed.orderBy("late", seeded(seed, F.col(item)), item, stratum).limit(size)
    return chosen.select(item, stratum, F.when(F.col("late") == 0, "stratum").otherwise("fill").alias("reason"))
