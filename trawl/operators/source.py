"""Operators that must parse text: symbols of Python source, imports, calls, re-exports, declarations, diffs. Python runs in Arrow batches; joins stay in SQL."""

from __future__ import annotations

import ast
import hashlib
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions import text as T

SNAPSHOT = ["repo", "base_commit"]
_SYMBOLS = "repo string, base_commit string, file_path string, status string, kind string, qualified_name string, start_line int, end_line int, parent string, signature string, symbol_id string"


def _tree(text: str) -> tuple[ast.Module | None, str]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return ast.parse(text.lstrip("﻿")), "ok"
        except (SyntaxError, ValueError):
            return None, "syntax_error"
        except (RecursionError, MemoryError):
            return None, "parser_error"


def python_symbols(text: str) -> tuple[str, list[tuple[str, str, int, int, str, str]]]:
    """(status, [(kind, qualified name, first line with decorators, last line, parent, signature)]) in source order; nested functions are named ``outer.<locals>.inner``."""
    tree, status = _tree(text)
    if tree is None:
        return status, []
    lines = text.split("\n")
    out = []
    todo: list[tuple[ast.AST, str, str, bool]] = [(tree, "", "", False)]
    while todo:
        node, prefix, parent, in_class = todo.pop()
        below = []
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                name = prefix + child.name
                if isinstance(child, ast.ClassDef):
                    kind = "class"
                else:
                    kind = ("async_" if isinstance(child, ast.AsyncFunctionDef) else "") + ("method" if in_class else "function")
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                out.append((kind, name, first, child.end_lineno or child.lineno, parent, lines[child.lineno - 1].strip() if child.lineno <= len(lines) else ""))
                below.append((child, name + ("." if kind == "class" else ".<locals>."), name, kind == "class"))
            else:
                below.append((child, prefix, parent, in_class and not isinstance(child, ast.expr)))
        todo += reversed(below)
    return ("ok" if out else "no_symbols"), sorted(out, key=lambda r: (r[2], -r[3], r[1]))


def _symbol_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for r in f.itertuples(index=False):
            head = (r.repo, r.base_commit, r.file_path)
            if r.content is None:
                rows.append((*head, "missing_file", None, None, None, None, None, None, None))
                continue
            if not r.file_path.endswith((".py", ".pyi")):
                rows.append((*head, "unsupported_language", None, None, None, None, None, None, None))
                continue
            status, symbols = python_symbols(r.content)
            if not symbols:
                rows.append((*head, status, None, None, None, None, None, None, None))
            for kind, name, a, b, parent, signature in symbols:
                key = "\0".join([r.repo or "", r.base_commit or "", r.file_path, "python", kind, name, str(a), str(b)])
                rows.append((*head, status, kind, name, a, b, parent, signature, "sha256:" + hashlib.sha256(key.encode("utf-8", "surrogatepass")).hexdigest()))
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in _SYMBOLS.split(", ")])
        yield frame.astype({"start_line": "Int32", "end_line": "Int32"})


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of every distinct file, and one row with a null kind for files without any; status as in a parse report."""
    return files.filter("file_path IS NOT NULL").select(*SNAPSHOT, "file_path", "content").distinct().mapInPandas(_symbol_rows, _SYMBOLS)


_FACTS = "repo string, base_commit string, file_path string, fact string, owner string, name string, module string, line int"


def python_facts(text: str, module: str) -> list[tuple[str, str, str, str, int]]:
    """(fact, owner, name, module, line) of a source: import (name bound, module it comes from), call (dotted callee), wrapper (function whose short body only delegates), alias (name bound to a dotted name)."""
    tree, _ = _tree(text)
    if tree is None:
        found = []
        for n, line in enumerate(text.split("\n"), 1):
            m = re.match(r"\s*(?:from\s+([\w.]+)\s+import\s+(\w+)|import\s+([\w.]+))", line)
            if m:
                found.append(("import", "", m[2] or m[3], m[1] or m[3], n))
        return found
    out = []
    package = module.rsplit(".", 1)[0] if "." in module else ""

    def dotted(node: ast.AST) -> str:
        parts = []
        while isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ""

    def base(level: int, name: str | None) -> str:
        if not level:
            return name or ""
        up = package.split(".") if package else []
        up = up[: len(up) - (level - 1)] if level > 1 else up
        return ".".join([*up, *([name] if name else [])])

    todo: list[tuple[ast.AST, str]] = [(tree, "")]
    while todo:
        node, owner = todo.pop()
        if isinstance(node, ast.Import):
            out += [("import", owner, a.asname or a.name, a.name, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            home = base(node.level, node.module)
            out += [("import", owner, a.asname or a.name, f"{home}.{a.name}".strip("."), node.lineno) for a in node.names if a.name != "*"]
        elif isinstance(node, ast.Call) and (name := dotted(node.func)):
            out.append(("call", owner, name, "", node.lineno))
        elif isinstance(node, ast.Assign) and not owner and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and (name := dotted(node.value)):
            out.append(("alias", "", node.targets[0].id, name, node.lineno))
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            owner = f"{owner}.{node.name}".strip(".")
            body = [s for s in node.body if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant))]
            if body and len(body) <= 4 and isinstance(body[-1], ast.Return) and isinstance(body[-1].value, ast.Call) and (name := dotted(body[-1].value.func)):
                out.append(("wrapper", owner, name, "", node.lineno))
        elif isinstance(node, ast.ClassDef):
            owner = f"{owner}.{node.name}".strip(".")
        todo += [(c, owner) for c in ast.iter_child_nodes(node)]
    return sorted(out, key=lambda r: (r[4], r[0], r[2]))


def _fact_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [(r.repo, r.base_commit, r.file_path, *x) for r in f.itertuples(index=False) for x in python_facts(r.content, r.module)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _FACTS.split(", ")])


def facts(files: DataFrame) -> DataFrame:
    """Imports, calls, wrappers and aliases of every distinct Python file."""
    rows = files.filter("content IS NOT NULL AND file_path RLIKE '[.]pyi?$'").select(*SNAPSHOT, "file_path", "content", T.module_parts(F.col("file_path")).alias("module")).distinct()
    return rows.mapInPandas(_fact_rows, _FACTS)


def import_edges(found: DataFrame, files: DataFrame) -> DataFrame:
    """(snapshot, src_file, dst_file): imports resolved to the file whose module is their longest known prefix; ambiguous and own modules are left out."""
    modules = files.filter("file_path RLIKE '[.]pyi?$'").select(*SNAPSHOT, "file_path", T.module_parts(F.col("file_path")).alias("m")).distinct()
    tails = F.transform(F.sequence(F.lit(1), F.size(F.split("m", r"\."))), lambda n: F.array_join(F.slice(F.split("m", r"\."), n, F.size(F.split("m", r"\."))), "."))
    keys = modules.select(*SNAPSHOT, "file_path", F.explode(tails).alias("key")).groupBy(*SNAPSHOT, "key").agg(F.count(F.lit(1)).alias("n"), F.min("file_path").alias("dst_file")).filter("n = 1").drop("n")
    parts = F.split("module", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("parts"), F.array_join(F.slice(parts, 1, n), ".").alias("key")))
    asked = found.filter("fact = 'import'").select(*SNAPSHOT, F.col("file_path").alias("src_file"), "module").distinct()
    hits = asked.select(*SNAPSHOT, "src_file", "module", F.explode(prefixes).alias("p")).select(*SNAPSHOT, "src_file", "module", "p.*").join(keys, [*SNAPSHOT, "key"])
    best = hits.groupBy(*SNAPSHOT, "src_file", "module").agg(F.max(F.struct("parts", "dst_file")).alias("x"))
    return best.select(*SNAPSHOT, "src_file", F.col("x.dst_file").alias("dst_file")).filter("src_file <> dst_file").distinct()


def resolved_calls(found: DataFrame, defined: DataFrame) -> DataFrame:
    """(snapshot, caller_file, caller, target_file, target, resolution): calls of a name that the file itself or an import defines, in exactly one place."""
    calls = found.filter("fact = 'call'").select(*SNAPSHOT, F.col("file_path").alias("caller_file"), F.col("owner").alias("caller"), F.col("name").alias("callee")).distinct()
    own = defined.filter("kind IS NOT NULL").select(*SNAPSHOT, "file_path", "qualified_name").distinct()
    local = calls.join(own.withColumnRenamed("file_path", "caller_file"), [*SNAPSHOT, "caller_file"]).filter((F.col("callee") == F.col("qualified_name")) | ((F.substring_index("callee", ".", 1).isin("self", "cls")) & F.col("qualified_name").endswith(F.concat(F.lit("."), F.substring_index("callee", ".", -1)))))
    ways = local.groupBy(*SNAPSHOT, "caller_file", "caller", "callee").agg(F.count(F.lit(1)).alias("n"), F.min("qualified_name").alias("target")).filter("n = 1")
    near = ways.select(*SNAPSHOT, "caller_file", "caller", F.col("caller_file").alias("target_file"), "target", F.lit("local").alias("resolution"))
    bound = found.filter("fact = 'import'").select(*SNAPSHOT, F.col("file_path").alias("caller_file"), F.col("name").alias("head"), F.col("module").alias("origin")).distinct()
    named = calls.withColumn("head", F.substring_index("callee", ".", 1)).join(bound, [*SNAPSHOT, "caller_file", "head"]).withColumn("leaf", F.substring_index(F.concat_ws(".", "origin", F.when(F.col("callee").contains("."), F.substring_index("callee", ".", -1))), ".", -1))
    single = own.withColumn("leaf", F.col("qualified_name")).groupBy(*SNAPSHOT, "leaf").agg(F.count(F.lit(1)).alias("n"), F.min("file_path").alias("target_file")).filter("n = 1").drop("n")
    far = named.join(single, [*SNAPSHOT, "leaf"]).filter("caller_file <> target_file").select(*SNAPSHOT, "caller_file", "caller", "target_file", F.col("leaf").alias("target"), F.lit("imported").alias("resolution"))
    return near.union(far).distinct()


def api_links(found: DataFrame) -> DataFrame:
    """(snapshot, file_path, public, implementation, link): names that only re-export (imports of a package file, aliases) or delegate (wrappers)."""
    again = found.filter("fact = 'import' AND file_path RLIKE '(^|/)__init__[.]py$'").select(*SNAPSHOT, "file_path", F.col("name").alias("public"), F.col("module").alias("implementation"), F.lit("reexport").alias("link"))
    alias = found.filter("fact = 'alias'").select(*SNAPSHOT, "file_path", "name", "module", F.lit("reexport"))
    wrap = found.filter("fact = 'wrapper'").select(*SNAPSHOT, "file_path", "owner", "name", F.lit("wrapper"))
    return again.union(alias).union(wrap).distinct()


#: Declarations of languages without a parser, the first that a line matches counts.
DECLARATIONS = (
    r"\bclass\s+([A-Za-z_][A-Za-z0-9_]*)",
    r"\b(?:function|func|fn)\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(",
    r"\b(?:def|async\s+def)\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(",
    r"\b([A-Za-z_][A-Za-z0-9_]*)\s*[:=]\s*(?:async\s*)?\([^)]*\)\s*=>",
    r"\b(?:public|private|protected|static|final|async|\s)+[A-Za-z0-9_<>,\[\]?]+\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(",
)


def declarations(files: DataFrame) -> DataFrame:
    """(snapshot, file_path, line, kind, name, end_line): declarations by pattern; a block ends where its braces close, else before the next declaration, else 79 lines on."""
    text = F.replace(F.replace("content", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    rows = files.filter("content IS NOT NULL").select(*SNAPSHOT, "file_path", text.alias("t")).distinct().select(*SNAPSHOT, "file_path", F.size(F.split("t", "\n")).alias("n"), F.posexplode(F.split("t", "\n")).alias("at", "line"))
    name = F.coalesce(*[F.nullif(F.regexp_extract(F.trim("line"), p, 1), F.lit("")) for p in DECLARATIONS])
    kind = F.when(F.trim("line").startswith("class ") | F.col("line").contains(" class "), "class").otherwise("function")
    bare = F.regexp_replace(F.regexp_replace("line", "(['\"`]).*?\\1", ""), "//.*$", "")
    step = F.length(F.regexp_replace(bare, r"[^{]", "")) - F.length(F.regexp_replace(bare, r"[^}]", ""))
    w = Window.partitionBy(*SNAPSHOT, "file_path").orderBy("at")
    marked = rows.select(*SNAPSHOT, "file_path", "n", (F.col("at") + 1).alias("line"), name.alias("name"), kind.alias("kind"), step.alias("step"), F.length(F.regexp_replace(bare, r"[^{]", "")).alias("opens"), "at")
    deep = marked.withColumn("depth", F.sum("step").over(w)).withColumn("before", F.col("depth") - F.col("step"))
    heads = deep.filter("name IS NOT NULL").withColumn("next", F.lead("line").over(w))
    # A line that ends less deep than it began closes the levels between; the first closing of a block's level behind its head ends it. Heads and
    # closings of one level are met by a window, not by a join of all lines.
    shut = deep.filter("depth < before").select(*SNAPSHOT, "file_path", F.explode(F.sequence(F.col("depth") + 1, F.col("before"))).alias("level"), "line", F.lit(1).alias("closes"))
    opened = heads.filter("opens > 0 AND depth > before").select(*SNAPSHOT, "file_path", (F.col("before") + 1).alias("level"), "line", F.lit(0).alias("closes"))
    behind = Window.partitionBy(*SNAPSHOT, "file_path", "level").orderBy("line", "closes").rowsBetween(0, Window.unboundedFollowing)
    met = shut.union(opened).withColumn("close", F.first(F.when(F.col("closes") == 1, F.col("line")), ignorenulls=True).over(behind))
    at_once = heads.filter("opens > 0 AND depth <= before").select(*SNAPSHOT, "file_path", "line", F.col("line").alias("close"))
    closing = met.filter("closes = 0 AND close IS NOT NULL").select(*SNAPSHOT, "file_path", "line", "close").union(at_once)
    joined = heads.join(closing, [*SNAPSHOT, "file_path", "line"], "left")
    end = F.coalesce("close", F.greatest(F.col("line"), F.col("next") - 1), F.least(F.col("n"), F.col("line") + 79))
    return joined.select(*SNAPSHOT, "file_path", "line", "kind", "name", end.alias("end_line")).distinct()


_HUNKS = "doc_id bigint, old_file string, new_file string, change string, hunk int, old_start int, old_count int, new_start int, new_count int, deleted array<int>, added array<int>, anchors array<int>, complete boolean"
_HEADER = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def hunks(text: str) -> list[tuple[str, str, str, int, int, int, int, int, list[int], list[int], list[int], bool]]:
    """The hunks of all diffs in a text: files, header numbers, deleted old lines, added new lines, the old line before which each run of additions goes, and whether the body has as many lines as the header says."""
    out = []
    old = new = ""
    count = 0
    lines = text.replace("\r\n", "\n").split("\n")
    k = 0
    while k < len(lines):
        line = lines[k]
        k += 1
        if line.startswith("--- ") and k < len(lines) and lines[k].startswith("+++ "):
            old, new, count = (re.sub(r"^[ab]/", "", x[4:].split("\t")[0].strip()) for x in (line, lines[k])), "", 0
            old, new = tuple(old)
            k += 1
            continue
        m = _HEADER.match(line)
        if not m:
            continue
        a, n, b, o = int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)
        at_old, at_new, deleted, added, anchors, last = a, b, [], [], [], ""
        while k < len(lines) and (at_old - a < n or at_new - b < o):
            body = lines[k]
            if body.startswith("\\"):
                k += 1
                continue
            if not body or body[0] not in " +-":
                break
            if body[0] == "+":
                if last != "+":
                    anchors.append(at_old)
                added.append(at_new)
                at_new += 1
            else:
                if body[0] == "-":
                    deleted.append(at_old)
                else:
                    at_new += 1
                at_old += 1
            last = body[0]
            k += 1
        change = "added" if old == "/dev/null" else "deleted" if new == "/dev/null" else "renamed" if old != new else "modified"
        out.append((old, new, change, count, a, n, b, o, deleted, added, anchors, at_old - a == n and at_new - b == o))
        count += 1
    return out


def diff_hunks(documents: DataFrame) -> DataFrame:
    """One row per hunk of the diffs in each text; null texts have none."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(d, *h) for d, t in zip(f["doc_id"], f["text"], strict=True) for h in hunks(t)], columns=[c.split()[0] for c in _HUNKS.split(", ")])

    return documents.filter("text IS NOT NULL").select("doc_id", "text").mapInPandas(rows, _HUNKS)
