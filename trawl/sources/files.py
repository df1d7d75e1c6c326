"""Readers and writers of record files, tables of settings and snapshots."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_records(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines (``.jsonl``), or a ``.json`` file that holds an array, one object, or an object with ``records``. Lenient: rows that are no objects are dropped; strict: they are an error."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    reader = spark.read.schema(schema).option("mode", mode)
    if path.endswith(".jsonl"):
        return reader.json(path)
    wrapped = T.StructType([T.StructField("records", T.ArrayType(T._parse_datatype_string(schema)))])
    inner = spark.read.schema(wrapped).option("multiLine", True).json(path).filter("records IS NOT NULL").select(F.explode("records").alias("r")).select("r.*")
    plain = reader.option("multiLine", True).json(path)
    return plain.filter(" OR ".join(f"`{c}` IS NOT NULL" for c in plain.columns)).unionByName(inner)


def read_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """CSV with a header, a byte-order mark on it removed; a missing required column is an error."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def latest_by_key(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The last row of each key by its ordinal; rows without a key are left out."""
    w = Window.partitionBy(key).orderBy(F.desc(ordinal))
    return rows.filter(F.col(key).isNotNull()).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def size_map(spark: SparkSession, groups: dict[str, list[str]]) -> DataFrame:
    """(repo, size_group) from groups of repositories; a repository in two groups is an error."""
    rows = [(repo, g) for g, repos in groups.items() for repo in repos]
    if len({r for r, _ in rows}) != len(rows):
        raise ValueError("a repository is in several groups")
    return spark.createDataFrame(rows, "repo string, size_group string")


def snapshot_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("py", "js", "ts", "java", "go", "c"), max_bytes: int = 500_000) -> DataFrame:
    """(file_path, content, length) of a folder's source files; suffixes and sizes are filtered before contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(root).filter(F.col("length") <= max_bytes)
    base = root.rstrip("/").removeprefix("file://")
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^{re.escape(base)}/", "")
    return files.select(relative.alias("file_path"), F.decode("content", "UTF-8").alias("content"), "length")


def write_flat_csv(df: DataFrame, path: str, separator: str = "|") -> None:
    """CSV with a header; arrays of strings become one field joined by the separator."""
    flat = [F.array_join(c, separator).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_index(df: DataFrame, path: str) -> None:
    """A table partitioned by snapshot, so that a ticket's read prunes to its own files."""
    df.write.mode("overwrite").partitionBy("repo", "base_commit").parquet(path)


def write_once(df: DataFrame, path: str) -> None:
    """An artifact that is never written over: an existing path is an error."""
    df.write.mode("errorifexists").parquet(path)


def labelled(inputs: dict[str, DataFrame]) -> DataFrame:
    """Several frames of one schema under their labels; the first label is the baseline."""
    out = None
    for k, (label, df) in enumerate(inputs.items()):
        part = df.withColumns({"label": F.lit(label), "baseline": F.lit(k == 0)})
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no inputs")
    return out


def index_documents(chunks: DataFrame) -> DataFrame:
    """(repo, base_commit, file_path, document): a file's chunks as one nested JSON document with their number; chunks of a file are the bound of a document."""
    row = F.struct("chunk_id", F.col("symbol_kind").alias("kind"), F.coalesce("function_name", F.lit("")).alias("function"), F.coalesce("class_name", F.lit("")).alias("class"), "start_line", "end_line", F.md5(F.coalesce("code_text", F.lit(""))).alias("code_digest"))
    per = chunks.dropDuplicates(["repo", "base_commit", "file_path", "chunk_id"]).groupBy("repo", "base_commit", "file_path").agg(F.array_sort(F.collect_list(row)).alias("chunks"))
    return per.select("repo", "base_commit", "file_path", F.to_json(F.struct(F.size("chunks").alias("count"), "chunks")).alias("document"))


_DOCUMENT = "count int, chunks array<struct<chunk_id:string,kind:string,function:string,class:string,start_line:int,end_line:int,code_digest:string,symbol_name:string>>"


def load_index(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, documents whose number of chunks is not what they say): nested index documents as rows; a chunk's name comes from symbol_name, function or class, the first that is filled."""
    x = documents.select("repo", "base_commit", "file_path", F.from_json("document", _DOCUMENT).alias("d"))
    wrong = x.filter("d IS NULL OR d.count IS NULL OR d.count <> size(coalesce(d.chunks, array()))").select("repo", "base_commit", "file_path")
    rows = x.select("repo", "base_commit", "file_path", F.explode("d.chunks").alias("c")).select("repo", "base_commit", "file_path", "c.*")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.withColumn("name", F.coalesce(filled("symbol_name"), filled("function"), filled("class"), F.lit(""))).drop("symbol_name"), wrong


def rows_as_text(df: DataFrame) -> DataFrame:
    """Missing and not-a-number values of single columns as empty text, lists kept as lists."""
    number = lambda c, t: F.when(F.isnan(c), None).otherwise(F.col(c)) if t in ("double", "float") else F.col(c)
    return df.select(*[F.coalesce(F.col(c), F.array().cast(t)).alias(c) if t.startswith("array") else F.coalesce(number(c, t).cast("string"), F.lit("")).alias(c) for c, t in df.dtypes])
