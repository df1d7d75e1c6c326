"""Problem 1: source files that do not parse as the language of their suffix.

1. Workers lex whole files into one-letter token classes and cut them into units: statements of the outer level and of each block (a block inside one is the
   single class G), or logical lines of Python. A file is the hashes of its units; a unit's text is a row once, however many files have it.
2. Windows reduce the units: running depths and running last openers give every token its innermost bracket, so that each bracket's own tokens
   are one text in which inner brackets are single classes, at any depth. An opener without its closer, or a closer of another kind, is a nesting error.
3. The adjacent classes of the reduced texts are anti-joined against the pairs that the language's grammar permits, and each text is held against the
   statement or bracket productions of its place.
4. For Python the productions are narrower than the language: what they do not certify is a candidate, and an exact parse of the candidates follows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm import grammar
from trawl.storage import cut

_AFTER_DOT = re.compile(r"\.\n*[A-Zxc]")
_GO_END = re.compile(r"(?<=[n0s)\]}iBR])\n+")
_JS_END = re.compile(r"(?<=[n0srR)\]}iB])\n+(?=[n0sVcKFRBEIuC@$AW]|i)")
_INNER = re.compile(r"(?<=(.))\{([^{}]*)\}")
_BRACES = re.compile(r"\{[^{}]*\}")
_CHAIN = re.compile(r"([=(,\]])(\{{2,})")  # brackets of an initialiser that begin at once are marked as such
_REPEATED = re.compile(r"((?:[n0s]|b0)[,b])\1+")
#: What can begin a statement after a closed block, by language.
_NEXT = {x: re.compile(p) for x, p in {"javascript": r"(?<=G)(?=[KVcFCRDBInA@L])", "typescript": r"(?<=G)(?=[KVcFCRDBInA@L])", "java": r"(?<=G)(?=[KCIRDBnA@L])", "c": r"(?<=G)(?=[KRDBnA])"}.items()}
#: The place of curly brackets by the class before them (see ``grammar.TAGS``).
_PLACES = {
    "javascript": {"c": "nCx", "e": "=(,[?obRIMLWVcOuieD", "b": ":A{Q0"},
    "typescript": {"c": "nCxo", "e": "=(,[?bRIMLVcOuieD", "b": ":A{W0"},
    "java": {"c": "no", "e": "=(,]QL\x02"},
    "go": {"c": "A", "e": "=(,", "b": "n:{Q0s"},
    "c": {"c": "nA", "e": "=(,\x02"},
}
_PLACE = {x: {c: t for t, cs in d.items() for c in cs} for x, d in _PLACES.items()}


def _tag(language: str, before: str, content: str) -> str:
    tag = _PLACE[language].get(before, "u")
    if language == "c" and before == ")" and content[:1] in (".", "0", "["):
        return "e"  # a compound literal
    return "u" if tag == "b" and ";" in content else tag


def _statements(content: str, language: str) -> list[str]:
    """Cut at semicolons outside of round brackets, and after closed blocks. A header of Go keeps its semicolons."""
    parts = content.split(";")
    out, now, depth = [], "", 0
    for part in parts[:-1]:
        now += part + ";"
        depth += part.count("(") - part.count(")")
        if depth <= 0 and not (language == "go" and now.lstrip("E")[:1] in ("K", "Y") and "G" not in now):
            out.append(now)
            now, depth = "", 0
    now += parts[-1]
    if now:
        out.append(now)
    cut_at = _NEXT.get(language)
    if cut_at is None or "G" not in content:
        return out
    fine = []
    for unit in out:
        held = ""
        for piece in cut_at.split(unit):
            held += piece
            if language == "c" and held[0] == "A" and "(" not in held:
                continue  # a name may follow the type's body
            fine.append(held)
            held = ""
        if held:
            fine.append(held)
    return fine


def _units(classes: str, language: str, memo: dict[tuple[str, str], list[str]]) -> list[str]:
    """Distinct units of a text in curly brackets or semicolons: a tag for the place, then the classes. Brackets that never close stay in the outermost units."""
    classes = _AFTER_DOT.sub(".n", classes)
    if language == "go":
        classes = _GO_END.sub(";", classes + "\n")
    elif language in ("javascript", "typescript"):
        classes = _JS_END.sub(";", classes)
    text = "^" + _REPEATED.sub(r"\1", classes.replace("\n", ""))
    if language in ("c", "java"):
        text = _CHAIN.sub(lambda m: m[1] + "\x02".join(m[2]), text)
    held: set[tuple[str, str]] = set()
    while found := _INNER.findall(text):
        held.update(found)
        text = _BRACES.sub("G", text)
    out: dict[str, None] = {}
    for key in held:
        own = memo.get(key)
        if own is None:
            before, content = key[0], key[1].replace("\x02", "")
            tag = _tag(language, before, content)
            own = [tag + u for u in _statements(content, language)] if tag in "uc" else [tag + content]
            if len(memo) > 100_000:
                memo.clear()
            memo[key] = own
        out.update(dict.fromkeys(own))
    outer = _statements(text[1:].replace("\x02", ""), language)
    if language == "go" and outer:
        out["f" + outer.pop(0)] = None  # the package clause comes first
    out.update(dict.fromkeys("t" + u for u in outer))
    return list(out)


def _lines(classes: str) -> list[str]:
    """Logical lines of Python: last class of the line before (@ for a decorator), > or < for a change of indentation, the opener of the block that ended, N, the line's classes, N."""
    out: list[str] = []
    depth, line, indent = 0, [], 0
    stack: list[tuple[int, str]] = [(0, "")]
    before, opener = "^", ""

    def close() -> None:
        nonlocal before, opener
        if not line:
            return
        mark = ""
        if indent > stack[-1][0]:
            stack.append((indent, opener))
            mark = ">"
        elif indent < stack[-1][0]:
            ended = ""
            while stack[-1][0] > indent:
                mark += "X" if ended == "y" else ""  # an inner try block without a handler
                ended = stack.pop()[1]
            mark += ("<" if stack[-1][0] == indent else "<X") + ended
        text = "".join(line)
        out.append(f"{before}{mark}N{text}N")
        opener = text[0] if text[0] in "kzypE" else ""
        before = "@" if text[0] == "@" else _CLOSED.get(text[-1], text[-1])

    start = 0
    for m in _STOPS.finditer(classes):
        c = m[0]
        if m.start() > start:
            line.append(classes[start : m.start()])
        start = m.end()
        if c >= _BASE:
            if depth <= 0:
                close()
                line, indent, depth = [], ord(c) - grammar.INDENT_BASE, 0
        else:
            line.append(c)
            depth += 1 if c in "([{" else -1
    if start < len(classes):
        line.append(classes[start:])
    close()
    open_try = "y" if any(o == "y" for _, o in stack) else ""
    out.append(f"{before}{open_try}N$")
    return [_AFTER_DOT_PYTHON.sub(".n", u) for u in out]


_CLOSED = {")": "P", "]": "Q", "}": "G"}
_AFTER_DOT_PYTHON = re.compile(r"\.[A-MO-Zkulyp]")
_BASE = chr(grammar.INDENT_BASE)
_STOPS = re.compile(rf"[()\[\]{{}}]|[{_BASE}-{chr(grammar.INDENT_BASE + 2000)}]")


def lex(text: str, language: str, lexer: grammar.Lexer, memo: dict[tuple[str, str], list[str]]) -> list[str]:
    """Distinct units of a whole text, each with its tag."""
    if language in ("javascript", "typescript") and _NESTED.search(text):
        text = _flat(text)
    classes = lexer.classes(text.replace("\x00", "\x01"))
    if language != "python":
        return _units(classes, language, memo)
    lead = re.match(r"[ \t]*", text)[0].expandtabs(8)
    units = list(dict.fromkeys("u" + _REPEATED.sub(r"\1", u) for u in _lines((chr(grammar.INDENT_BASE + len(lead)) if lead else "") + classes)))
    if _TABS.search(text) and _BLANKS.search(text):
        units.append("uX")  # indentation of two kinds: only an exact parse can tell
    return units


_NESTED = re.compile(r"\$\{[^}`]*`")
_HOLE, _WITHIN = re.compile(r"\$\{[^{}`]*\}"), re.compile(r"(\$\{(?:[^{}`]|\{[^{}`]*\})*)`(?:\\[\s\S]|\$(?!\{)|[^`\\$])*`")


def _flat(text: str) -> str:
    """Templates inside templates, from the innermost outwards, as numbers, until none is left."""
    before = ""
    while before != text:
        before, text = text, _WITHIN.sub(r"\g<1>0", _HOLE.sub("0", text))
    return text


_TABS, _BLANKS = re.compile(r"(?m)^ *\t"), re.compile(r"(?m)^ +\S")
_LEXED = "fid bigint, repo string, base_commit string, file_path string, language string, units array<bigint>, fresh array<struct<uid:bigint,unit:string>>"


def _lexed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Files with the hashes of their units; a unit's text stands in the first file of the worker that has it."""
    import xxhash

    lexers: dict[str, grammar.Lexer] = {}
    memos: dict[str, dict[tuple[str, str], list[str]]] = {}
    known: dict[str, dict[str, int]] = {}
    for f in frames:
        units, fresh = [], []
        for text, language in zip(f["content"], f["language"], strict=True):
            if language not in lexers:
                lexers[language], memos[language], known[language] = grammar.Lexer(language), {}, {}
            ids = known[language]
            own, new = [], []
            for u in lex(text, language, lexers[language], memos[language]):
                h = ids.get(u)
                if h is None:
                    h = xxhash.xxh3_64_intdigest(f"{language}:{u}") - (1 << 63)
                    new.append({"uid": h, "unit": u})
                    if len(ids) > 500_000:
                        ids.clear()
                    ids[u] = h
                own.append(h)
            units.append(own)
            fresh.append(new)
        yield f.drop(columns="content").assign(units=units, fresh=fresh)


def language_of(path: Column) -> Column:
    """The language of a path's suffix; NULL for others."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[A-Za-z]+)$", 1))
    out = F.lit(None).cast("string")
    for s, language in grammar.LANGUAGES.items():
        out = F.when(suffix == s, F.lit(language)).otherwise(out)
    return out


def _keyed(files: DataFrame) -> DataFrame:
    key = F.xxhash64(F.coalesce("repo", F.lit("")), F.coalesce("base_commit", F.lit("")), F.col("file_path"), F.col("content"))
    return (
        files.select("repo", "base_commit", "file_path", "content")
        .filter("content IS NOT NULL AND file_path IS NOT NULL")
        .select(key.alias("fid"), "repo", "base_commit", "file_path", language_of(F.col("file_path")).alias("language"), "content")
        .filter("language IS NOT NULL")
    )


def _reduced(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((uid, language, start, before, after, text), uids that do not nest): of each unit the text outside of its brackets and the text of each bracket, inner brackets as P, Q and G."""
    each = units.select("uid", "language", F.substring("unit", 1, 1).alias("tag"), F.posexplode(F.split(F.expr("substring(unit, 2)"), "")).alias("at", "c")).filter("c <> ''")
    opens, closes = F.col("c").isin("(", "[", "{"), F.col("c").isin(")", "]", "}")
    row = Window.partitionBy("uid").orderBy("at")
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    deep = each.withColumn("depth", F.sum(step).over(row.rowsBetween(Window.unboundedPreceding, 0))).withColumns({"before": F.concat(F.coalesce(F.lag("c", 2).over(row), F.when(F.col("tag").isin("c", "t"), "^").otherwise(";")), F.coalesce(F.lag("c").over(row), F.lit(""))), "after": F.coalesce(F.lead("c").over(row), F.lit(""))})
    symbol = F.translate("c", "([{", "PQG")
    entry = lambda level, kind, sym: F.struct(level.alias("level"), F.lit(kind).alias("kind"), sym.alias("sym"))
    none = F.lit(None).cast("string")
    # An opener is a symbol of the text around it and begins the text inside it; a closer ends that.
    placed = deep.select("uid", "language", "tag", "at", "c", "before", "after", F.explode(F.when(opens, F.array(entry(F.col("depth") - 1, 0, symbol), entry(F.col("depth"), 1, none))).when(closes, F.array(entry(F.col("depth") + 1, 2, none))).otherwise(F.array(entry(F.col("depth"), 0, F.col("c"))))).alias("x"))
    placed = placed.select("uid", "language", "tag", "at", "c", "before", "after", "x.*")
    inside = Window.partitionBy("uid", "level").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    owned = placed.withColumn("bracket", F.coalesce(F.max(F.when(F.col("kind") == 1, F.col("at"))).over(inside), F.lit(-1)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == 0, F.struct("at", "sym")))), lambda x: x["sym"]), "")
    groups = owned.groupBy("uid", "language", "tag", "level", "bracket").agg(
        F.max(F.when(F.col("kind") == 1, F.col("c"))).alias("opener"), F.max(F.when(F.col("kind") == 1, F.col("before"))).alias("before"), F.count(F.when(F.col("kind") == 2, 1)).alias("ends"), F.max(F.when(F.col("kind") == 2, F.col("c"))).alias("closer"), F.max(F.when(F.col("kind") == 2, F.col("after"))).alias("after"), text.alias("text")
    )
    groups = cut(groups, "groups", compression="zstd")
    whole = F.when(F.col("opener").isNull(), (F.col("ends") == 0) & (F.col("level") == 0)).otherwise((F.col("ends") == 1) & (F.concat("opener", "closer").isin("()", "[]", "{}")))
    wrong = groups.filter(~F.coalesce(whole, F.lit(False))).select("uid").distinct()
    texts = groups.select("uid", "language", F.coalesce("opener", "tag").alias("start"), *[F.when(F.col("opener") == "(", F.coalesce(c, F.lit(""))).otherwise("").alias(c) for c in ("before", "after")], "text")
    return texts, wrong


def _judged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts that follow none of the productions of their place."""
    for f in frames:
        ok = [grammar.grammar(language).follows(text, grammar.start_of(language, start, before, after)) for language, start, before, after, text in zip(f["language"], f["start"], f["before"], f["after"], f["text"], strict=True)]
        yield f[[not x for x in ok]]


def _bad_units(units: DataFrame) -> DataFrame:
    """(uid, reason) of distinct units that no text of the grammar has; reason is token_pair, production or nesting."""
    spark = units.sparkSession
    texts, wrong = _reduced(units)
    key = ["language", "start", "before", "after", "text"]
    distinct = cut(texts.select(*key).distinct(), "texts", compression="zstd")
    table = [(language, p) for language in sorted(set(grammar.LANGUAGES.values())) for p in sorted(grammar.permitted(language))]
    allowed = spark.createDataFrame(table, "language string, pair string")  # a few thousand rows, whatever the data
    pairs = distinct.filter(F.length("text") > 1).select(*key, F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.substring("text", i, 2))).alias("pair"))
    odd = pairs.join(F.broadcast(allowed), ["language", "pair"], "left_anti").select(*key, F.lit("token_pair").alias("reason"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = distinct.repartition(tasks).mapInPandas(_judged, "language string, start string, before string, after string, text string").withColumn("reason", F.lit("production"))
    bad = odd.union(held).groupBy(*key).agg(F.max("reason").alias("reason"))
    found = texts.join(bad.hint("merge"), key).select("uid", "reason").union(wrong.withColumn("reason", F.lit("nesting")))
    return found.groupBy("uid").agg(F.max("reason").alias("reason"))


def _unparsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import ast
    import warnings

    warnings.simplefilter("ignore")
    for f in frames:
        keep = []
        for text in f["content"]:
            try:
                ast.parse(text.lstrip("﻿"))
                keep.append(False)
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                keep.append(True)
        yield f.loc[keep, ["fid"]]


def unparsable(files: DataFrame) -> DataFrame:
    """(repo, base_commit, file_path, language, reason), one row per file that does not parse as the language of its suffix.

    ``files``: repo, base_commit, file_path, content. Rows with null content or path, and suffixes without a grammar, are not judged; empty
    files and files of comments only are valid. Of repeated rows one is reported; a file with several contents is reported if one of them
    does not parse. reason is token_pair, production or nesting, the first of the three that applies.
    """
    keyed = _keyed(files)
    lexed = cut(keyed.mapInPandas(_lexed, _LEXED), "lexed", compression="zstd")
    units = lexed.select("language", F.explode("fresh").alias("x")).select("language", "x.uid", "x.unit").dropDuplicates(["uid"])
    bad = cut(_bad_units(units), "units")
    found = lexed.select("fid", F.explode("units").alias("uid")).join(bad, "uid").groupBy("fid").agg(F.max("reason").alias("reason"))
    flagged = cut(lexed.select("fid", "repo", "base_commit", "file_path", "language").join(found, "fid").dropDuplicates(["fid"]), "flagged")
    asked = cut(flagged.filter("language = 'python'").select("fid"), "asked")
    exact = keyed.filter("language = 'python'").join(asked, "fid").select("fid", "content").mapInPandas(_unparsed, "fid bigint").distinct()
    judged = flagged.filter("language <> 'python'").union(flagged.join(exact, "fid", "left_semi").select(*flagged.columns))
    return judged.groupBy("repo", "base_commit", "file_path", "language").agg(F.max("reason").alias("reason"))


def rates(files: DataFrame, flagged: DataFrame) -> DataFrame:
    """(repo, language, files, unparsable, rate) over distinct files with non-null content; a null repo is a group of its own."""
    whole = files.select("repo", "base_commit", "file_path", language_of(F.col("file_path")).alias("language")).filter("language IS NOT NULL AND content IS NOT NULL").distinct()
    total = whole.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"))
    bad = flagged.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("unparsable"))
    both = total.join(bad.select(F.col("repo").alias("r"), F.col("language").alias("l"), "unparsable"), F.col("repo").eqNullSafe(F.col("r")) & (F.col("language") == F.col("l")), "left")
    n = F.coalesce("unparsable", F.lit(0))
    return both.select("repo", "language", "files", n.alias("unparsable"), (n / F.col("files")).alias("rate"))
