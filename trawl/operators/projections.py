"""Projections and filters: searchable documents, derived names, reports, gates, validation, scans of source text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions import text as T


def _filled(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def search_documents(chunks: DataFrame) -> DataFrame:
    """Distinct chunks with ``search_text``: the non-empty parts path, language, kind, function, class and code, a line each."""
    text = F.concat_ws("\n", *[_filled(c) for c in ("file_path", "language", "symbol_kind", "function_name", "class_name", "code_text")])
    return chunks.select("repo", "base_commit", "chunk_id", "file_path", text.alias("search_text")).dropDuplicates(["chunk_id", "search_text"])


def named(chunks: DataFrame) -> DataFrame:
    """Chunks with symbol_name (function, class, else kind), qualified_name (``<module>`` for modules) and evaluation_key."""
    name = F.coalesce(_filled("function_name"), _filled("class_name"))
    both = F.concat("class_name", F.lit("."), "function_name")
    qualified = F.when(F.lower(F.trim("symbol_kind")) == "module", "<module>").when(_filled("function_name").isNotNull() & _filled("class_name").isNotNull(), both).otherwise(F.coalesce(name, F.lit("")))
    line = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.concat("file_path", F.lit("::"), F.coalesce(name, F.lit("<file>")), F.lit(":"), line("start_line"), F.lit("-"), line("end_line"))
    return chunks.withColumns({"symbol_name": F.coalesce(name, F.col("symbol_kind"), F.lit("")), "qualified_name": qualified, "evaluation_key": key})


#: Report fields in order, and those that the input gate reads; test names, hints and ids never enter.
REPORT_FIELDS = ("title", "description", "bug_type", "product", "component", "severity", "priority", "error_message", "version")
CONTENT_FIELDS = ("title", "description", "error_message")


def stripped(c: Column) -> Column:
    """Without white space at the ends; empty for null."""
    return F.regexp_replace(T.text_or_empty(c), r"^\s+|\s+$", "")


def bug_text(tickets: DataFrame) -> Column:
    """The report's filled fields as ``name: value``, a line each; of values that agree but for white space and case the first is kept. Fields that a table lacks are left out."""
    fields = [c for c in REPORT_FIELDS if c in tickets.columns]
    parts = F.array(*[F.struct(F.lit(c).alias("k"), stripped(F.col(c)).alias("v")) for c in fields])
    plain = F.transform(parts, lambda x: x.withField("plain", F.lower(F.regexp_replace(x["v"], r"\s+", " "))))
    # An array of one binds the fields to a name, so that they are made once and not again for each field.
    kept = F.transform(F.array(plain), lambda xs: F.filter(xs, lambda x, i: (x["v"] != "") & (F.array_position(F.transform(xs, lambda y: y["plain"]), x["plain"]) == i + 1)))[0]
    return F.array_join(F.transform(kept, lambda x: F.concat(x["k"], F.lit(": "), x["v"])), "\n")


def bug_reports(tickets: DataFrame) -> DataFrame:
    return tickets.select("ticket_id", bug_text(tickets).alias("bug_text")).distinct()


def normalized_tickets(tickets: DataFrame) -> DataFrame:
    """Key, report text and repository name from the first field that is filled, and how many fields are missing."""
    report = F.coalesce(_filled("description"), _filled("error_message"), _filled("title"), F.lit(""))
    missing = sum(F.col(c).isNull().cast("int") for c in ("title", "description", "component", "severity", "priority"))
    return tickets.select(
        "ticket_id", F.coalesce(F.nullif(F.trim("ticket_id"), F.lit("")), F.lit("")).alias("key"), report.alias("report"), F.coalesce(_filled("repo"), _filled("product"), F.lit("")).alias("repo_name"), missing.alias("nulls_filled")
    ).distinct()


def gated_input(tickets: DataFrame, min_chars: int = 20, short_chars: int = 80) -> DataFrame:
    """Per ticket: characters of its content, whether it has a trace, a path or a code-like name, status (error if empty, warning with any warning) and the number of warnings.

    A warning is given for a text that is too short or sparse, and for one without trace, path and name. Of several texts of a ticket the largest counts.
    """
    content = F.concat_ws("\n", *[F.nullif(stripped(F.col(c)), F.lit("")) for c in CONTENT_FIELDS])
    refs = F.concat_ws("\n", T.text_or_empty(F.col("error_message")), T.text_or_empty(F.col("description")))
    one = tickets.groupBy("ticket_id").agg(F.max(F.struct(F.trim(F.regexp_replace(content, r"\s+", " ")).alias("s"), refs.alias("r"))).alias("x")).select("ticket_id", "x.*")
    facts = one.select(
        "ticket_id",
        F.char_length("s").alias("chars"),
        F.col("r").rlike("|".join(f"(?:{p})" for p in T.TRACE_SHAPES)).alias("trace"),
        F.col("s").rlike(r"(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+").alias("path_hint"),
        F.col("s").rlike(r"[A-Za-z][A-Za-z0-9_]*[A-Z_]").alias("identifier"),
    )
    bare = ~(F.col("trace") | F.col("path_hint") | F.col("identifier"))
    warnings = F.when(F.col("chars") == 0, 0).otherwise((F.col("chars") < max(min_chars, short_chars)).cast("int") + bare.cast("int"))
    return facts.withColumns({"status": F.when(F.col("chars") == 0, "error").when(warnings > 0, "warning").otherwise("ok"), "warnings": warnings})


def import_lines(chunks: DataFrame) -> DataFrame:
    """Distinct import-like lines of each file, with their form."""
    lines = chunks.select("repo", "base_commit", "file_path", F.explode(F.split(F.replace("code_text", F.lit("\r"), F.lit("")), "\n")).alias("line"))
    lines = lines.select("repo", "base_commit", "file_path", F.trim("line").alias("line")).filter(F.col("line").rlike(r"^(import\s|from\s+\S+\s+import\s|#include\s|use\s+[A-Za-z_]|.*\brequire\()")).distinct()
    form = F.when(F.col("line").rlike(r"^from\s+\S+\s+import"), "from").when(F.col("line").startswith("#include"), "include").when(F.col("line").rlike(r"^import\b"), "import").otherwise("require")
    return lines.withColumn("form", form)


def numbered_lines(code: Column, start: Column) -> Column:
    """``n: line`` for every line, counted from ``start``."""
    return F.array_join(F.transform(F.split(code, "\n"), lambda x, i: F.concat((i + start).cast("string"), F.lit(": "), x)), "\n")


def diff_files(documents: DataFrame) -> DataFrame:
    """(doc_id, file): distinct new-side files of the diffs in a text."""
    files = F.regexp_extract_all(T.text_or_empty(F.col("text")), F.lit(r"(?m)^\+\+\+ (?:b/)?([^\s]+)"), F.lit(1))
    return documents.select("doc_id", F.explode(files).alias("file")).filter("file <> '/dev/null'").distinct()


def repaired_json(documents: DataFrame) -> DataFrame:
    """(doc_id, way, object): the JSON object of a text: the whole text without code fences at its ends, else what its outermost braces hold, else an empty object.

    way is whole, braces or none. A null text is an empty one.
    """
    text = F.regexp_replace(F.regexp_replace(F.trim(T.text_or_empty(F.col("text"))), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    inner = F.regexp_extract("t", r"\{[\s\S]*\}", 0)
    # Alone in a list: the parser does not look behind the end of a value.
    listed = lambda c: F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    whole = lambda c: c.startswith("{") & listed(c).isNotNull() & F.try_variant_get(listed(c), "$[1]", "string").isNull()
    x = documents.select("doc_id", text.alias("t")).withColumn("i", inner)
    way = F.when(whole(F.trim("t")), "whole").when(whole(F.col("i")), "braces").otherwise("none")
    return x.withColumn("way", way).select("doc_id", "way", F.when(F.col("way") == "whole", F.trim("t")).when(F.col("way") == "braces", F.col("i")).otherwise("{}").alias("object"))


def json_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, parsed, objects): one-line objects in a text and how many of them are valid JSON."""
    each = documents.select("doc_id", F.explode(F.regexp_extract_all(T.text_or_empty(F.col("text")), F.lit(r"\{[^{}\n]*\}"), F.lit(0))).alias("j"))
    return each.groupBy("doc_id").agg(F.sum(F.try_parse_json("j").isNotNull().cast("bigint")).alias("parsed"), F.count(F.lit(1)).alias("objects"))


def gold_issues(gold: DataFrame) -> DataFrame:
    """(gold_id, issue, n): constraints that a gold row breaks."""
    checks = {
        "ticket_id": F.trim(T.text_or_empty(F.col("ticket_id"))) == "",
        "base_commit": ~F.coalesce(F.col("base_commit").rlike("^[0-9a-f]{40}$"), F.lit(False)),
        "mapping_status": ~F.col("mapping_status").isin("mapped", "excluded"),
        "symbol_id": (F.col("mapping_status") == "mapped") & ~F.coalesce(F.col("symbol_id").rlike("^sha256:[0-9a-f]{64}$"), F.lit(False)),
        "lines": (F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")),
        "exclusion_reason": (F.col("mapping_status") == "mapped") & (T.text_or_empty(F.col("exclusion_reason")) != ""),
        "file_path": (T.text_or_empty(F.col("file_path")) == "") | F.col("file_path").startswith("/") | F.col("file_path").contains(".."),
    }
    issues = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return gold.select("gold_id", F.explode(issues).alias("issue")).groupBy("gold_id", "issue").agg(F.count(F.lit(1)).alias("n"))


#: Folders and suffixes of a source listing.
IGNORED_ANYWHERE = r"(^|/)(\.git|\.hg|\.svn|__pycache__|\.pytest_cache|\.mypy_cache|\.ruff_cache|node_modules|venv|\.venv)/"
IGNORED_AT_ROOT = r"^(dist|build|data|models|reports)/"
TEST_FOLDERS = r"(^|/)(test|tests|__tests__|spec|specs)/"
SOURCE_SUFFIX = r"\.(py|pyi|js|jsx|ts|tsx|java|c|cc|cpp|h|hpp|go|rs|scala)$"


def listed_sources(files: DataFrame, include_tests: bool = False, max_bytes: int = 500_000) -> DataFrame:
    """(repo, base_commit, file_path, bytes): the source files that an index takes."""
    size = F.octet_length("content").cast("bigint")
    kept = files.filter("content IS NOT NULL").filter(~F.col("file_path").rlike(IGNORED_ANYWHERE) & ~F.col("file_path").rlike(IGNORED_AT_ROOT) & F.lower("file_path").rlike(SOURCE_SUFFIX) & (size <= max_bytes))
    if not include_tests:
        kept = kept.filter(~F.lower("file_path").rlike(TEST_FOLDERS))
    return kept.select("repo", "base_commit", "file_path", size.alias("bytes")).distinct()
