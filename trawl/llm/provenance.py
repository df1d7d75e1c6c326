"""Problem 2: files that are no hand-written source of the project: generated, minified, third-party, or data.

1. Attribute files are parsed; their globs decide for the files they match, the deepest directory and then the last line winning.
2. Files that no line of their own repository decides are held against equivalent patterns: the lines that public attribute files have for well-known
   folders and names (``PUBLIC_ATTRIBUTES``, parsed and resolved like any attribute file), and patterns mined from this corpus: names of packages that
   stand below declared third-party folders of several repositories, and globs whose files nearly all are declared, noted or confirmed, in several repositories.
   Evidence in the file confirms what a loose pattern says: a note of its maker, its layout, or chunks that a declared third-party file has too.
3. What no pattern reaches but its maker's own note in a comment or the layout of its text shows (minified lines, numbered definitions, tables of values) is
   reported by that. The tables hold no attribute files, and half of the cases have ordinary paths, so this step cannot be left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.storage import cut

# --- attribute files ---------------------------------------------------------------------------------------------------------


def glob_regex(pattern: str) -> str:
    """A regular expression for a path below the attribute file's directory: a pattern without a slash matches names at any depth, ``**`` any directories, ``*`` and ``?`` no slash."""
    anchored = "/" in pattern.rstrip("/")
    p = pattern.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out, i = out + "/.*", i + 3
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 1 :]:
            j = p.index("]", i + 1)
            out, i = out + "[" + p[i + 1 : j].replace("!", "^", 1 if p[i + 1] == "!" else 0).replace("\\", "\\\\") + "]", j + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return f"^{'' if anchored else '(?:.*/)?'}{out.rstrip('/')}{'(?:/.*)?' if pattern.endswith('/') else ''}$"


def parse_attributes(text: str) -> list[tuple[int, str, str, bool]]:
    """(line, glob, generated or vendored, set) of each line that marks paths; comments, macros and other attributes are left out."""
    out = []
    for n, line in enumerate(text.splitlines(), 1):
        parts = line.split()
        if len(parts) < 2 or parts[0].startswith(("#", "[attr]")):
            continue
        for a in parts[1:]:
            m = re.fullmatch(r"([-!]?)(?:linguist|gitlab)-(generated|vendored)(?:=(\w+))?", a)
            if m:
                out.append((n, parts[0].strip('"'), m[2], not m[1] and (m[3] or "true").lower() not in ("false", "0", "no")))
    return out


def _rules(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for r in f.itertuples(index=False):
            folder = r.file_path.rpartition("/")[0]
            for line, glob, mark, on in parse_attributes(r.content):
                rows.append((r.repo, r.base_commit, folder, len(folder.split("/")) if folder else 0, line, rule_key(glob), glob_regex(glob), mark, on))
        yield pd.DataFrame(rows, columns=["repo", "base_commit", "folder", "depth", "line", "key", "pattern", "mark", "on"])


_GLOB = re.compile(r"[*?\[]")


def rule_key(pattern: str) -> str:
    """What the path of every match has: its name, its last suffix, a folder, or nothing in particular."""
    parts = [x for x in pattern.split("/") if x]
    last = parts[-1] if parts and not pattern.endswith("/") else ""
    if last and not _GLOB.search(last):
        return f"name:{last}"
    suffix = re.search(r"\.[A-Za-z0-9]+$", last)
    if suffix and "]" not in suffix[0]:
        return f"suffix:{suffix[0]}"
    folders = [x for x in (parts if pattern.endswith("/") else parts[:-1]) if not _GLOB.search(x)]
    return f"folder:{folders[-1]}" if folders else "any"


def _path_keys(path: Column) -> Column:
    """All keys that a rule which matches the path can have."""
    parts = F.split(path, "/")
    folders = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: F.concat(F.lit("folder:"), x))
    name = F.element_at(parts, -1)
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("name:"), name), F.concat(F.lit("suffix:"), F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1)), F.lit("any")), folders))


def declared(files: DataFrame, attributes: DataFrame) -> DataFrame:
    """(repo, base_commit, file_path, marked): files that an attribute line matches; per mark the deepest folder's last matching line holds, and a file is marked if any mark is on.

    Rules meet files over what their matches must have (name, suffix or folder), so a snapshot's files never meet all its rules.
    """
    rules = attributes.filter("content IS NOT NULL AND file_path RLIKE '(^|/)[.]gitattributes$'").select("repo", "base_commit", "file_path", "content").distinct()
    rules = rules.mapInPandas(_rules, "repo string, base_commit string, folder string, depth int, line int, key string, pattern string, mark string, on boolean")
    inside = F.when(F.col("folder") == "", F.col("file_path")).when(F.col("file_path").startswith(F.concat("folder", F.lit("/"))), F.expr("substring(file_path, length(folder) + 2)"))
    keyed = files.select("repo", "base_commit", "file_path", F.explode(_path_keys(F.col("file_path"))).alias("key"))
    hit = keyed.join(rules, ["repo", "base_commit", "key"]).withColumn("rest", inside).filter(F.expr("rest RLIKE pattern"))
    last = hit.groupBy("repo", "base_commit", "file_path", "mark").agg(F.max(F.struct("depth", "line", "on")).alias("x"))
    return last.groupBy("repo", "base_commit", "file_path").agg(F.max("x.on").alias("marked"))


# --- evidence in chunks --------------------------------------------------------------------------------------------------------
# Notes of tools and of origins, as the first words of a comment line or anywhere in it.
_COMMENT = r"(?m)^[ \t]*(?://+|#+|/?\*+!?|--|;+|<!--|\"\"\")[ \t]*"
_TOOL = re.compile(
    _COMMENT + r"(?:@generated\b|(?i:(?:this (?:file|code) (?:is|was) )?(?:auto(?:matically)?[ -]?generated|code generated by|generated by\b|automatisch erzeugt|automatisch generiert|généré automatiquement|generado automáticamente|autogenerated)|(?:this file (?:is|was) .*)?(?:please )?do not (?:edit|modify)\b(?! the \w+ here)).*)"
)
_ORIGIN = re.compile(
    _COMMENT + r"(?i:imported from upstream|vendored from|this file is a (?:verbatim )?copy of|bundled third[ -]party|third[ -]party code|released under the terms shipped with|send fixes upstream|adapted from upstream|upstream:|.*not part of this project|[a-z][\w.-]*\d* @? ?v?\d+\.\d+\.\d+\b)"
)
_VALUE = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'|\b0x[0-9a-fA-F]+\b|\b\d[\d.]*\b")
_TOKEN = re.compile(r"\w+")
_CALL = re.compile(r"[A-Za-z_]\w*(?=[ \t]*\()")
_CASE = re.compile(r"(?m)^[ \t]*case \d+:")
_CSV = re.compile(r"(?m)^[^,(){};=\n]+(?:,[^,(){};=\n]+){2,}$")
_DEFINES = {"function", "method", "class", "async_function", "async_method"}
#: Chunks shorter than this are too common to tell where they come from.
COPY_CHARS = 120

_EVIDENCE = "repo string, base_commit string, file_path string, chars bigint, blanks bigint, valued bigint, numbers bigint, words bigint, calls bigint, numbered bigint, cases bigint, rows bigint, lines bigint, defs bigint, tool int, origin int, hash bigint"


def _evidence(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xxhash

    for f in frames:
        out = []
        for r in f.itertuples(index=False):
            t = r.code_text
            n = len(t)
            blanks = n - len("".join(t.split()))
            words = _TOKEN.findall(t)
            calls = _CALL.findall(t)
            body = t.strip()
            lines = t.count("\n") + 1
            out.append((
                r.repo, r.base_commit, r.file_path, n, blanks, sum(map(len, _VALUE.findall(t))), sum(w[0].isdigit() for w in words), len(words), len(calls), sum(c.rstrip("_")[-1:].isdigit() for c in calls),
                len(_CASE.findall(t)), len(_CSV.findall(t)), lines, int(r.symbol_kind in _DEFINES), int(bool(_TOOL.search(t))), int(bool(_ORIGIN.search(t))), (xxhash.xxh3_64_intdigest(body.encode("utf-8", "surrogatepass")) - (1 << 63)) if len(body) >= COPY_CHARS else None,
            ))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in _EVIDENCE.split(", ")])
        yield frame.astype({"hash": "Int64"})


# --- path patterns --------------------------------------------------------------------------------------------------------------
#: Lines that public attribute files have for many projects.
PUBLIC_ATTRIBUTES = """
vendor/ linguist-vendored
_vendor/ linguist-vendored
third_party/ linguist-vendored
third-party/ linguist-vendored
thirdparty/ linguist-vendored
3rdparty/ linguist-vendored
node_modules/ linguist-vendored
bower_components/ linguist-vendored
Godeps/ linguist-vendored
Pods/ linguist-vendored
Carthage/ linguist-vendored
jspm_packages/ linguist-vendored
generated/ linguist-generated
generated-sources/ linguist-generated
__generated__/ linguist-generated
autogen/ linguist-generated
*_pb2.py linguist-generated
*_pb2_grpc.py linguist-generated
*.pb.go linguist-generated
*.pb.gw.go linguist-generated
*.pb.cc linguist-generated
*.pb.h linguist-generated
*.pb.c linguist-generated
*.pb.js linguist-generated
*.pb.ts linguist-generated
moc_*.c linguist-generated
moc_*.cpp linguist-generated
ui_*.py linguist-generated
qrc_*.py linguist-generated
*.tab.c linguist-generated
*.tab.h linguist-generated
lex.*.c linguist-generated
*.min.js linguist-generated
*-min.js linguist-generated
*.min.css linguist-generated
*.bundle.js linguist-generated
*.g.* linguist-generated
*.generated.* linguist-generated
*_generated.* linguist-generated
zz_generated* linguist-generated
*_gen.go linguist-generated
"""
#: Folder names of the same kind that projects also use for code of their own; evidence in the file has to confirm them.
LOOSE_ATTRIBUTES = """
extern/ linguist-vendored
external/ linguist-vendored
externals/ linguist-vendored
deps/ linguist-vendored
gen/ linguist-generated
"""
#: A mined glob has files in so many repositories, and at least this share of them is declared, noted or confirmed; a mined package stands below third-party folders of so many repositories.
MINED_REPOS, MINED_SHARE, PACKAGE_REPOS = 3, 0.95, 2


def _any_of(text: str, mark: str = "") -> str:
    """One regular expression for all lines of an attribute text, those with the mark only if one is given."""
    return "|".join(f"(?:{glob_regex(glob)})" for _, glob, m, on in parse_attributes(text) if on and (not mark or m == mark))


#: A package is the folder below a third-party folder (and below a scope or workspace folder there).
_PACKAGE = r"(?:^|/)(?:" + "|".join(re.escape(g.rstrip("/")) for _, g, m, _ in parse_attributes(PUBLIC_ATTRIBUTES + LOOSE_ATTRIBUTES) if m == "vendored") + r")/(?:_workspace/|src/|@[^/]+/)*([^/]+)/"
#: Names of packages that say nothing (fixed values).
_NO_PACKAGES = ("src", "lib", "include", "core", "common", "util", "utils", "test", "tests", "main", "js", "css", "dist")


def _patterns(path: Column) -> Column:
    """The globs that a file could be matched by: each of its folders' names, its double suffix, and the last or first part of its name."""
    name = F.element_at(F.split(path, "/"), -1)
    folders = F.transform(F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1), lambda x: F.concat(F.lit("**/"), x, F.lit("/**")))
    double = F.regexp_extract(name, r"[^.](\.[A-Za-z0-9]+\.[A-Za-z0-9]+)$", 1)
    tail = F.regexp_extract(name, r"[^_](_[a-z0-9]+\.[A-Za-z0-9]+)$", 1)
    lead = F.regexp_extract(name, r"^([a-z]{1,4}_)[^/]*(\.[A-Za-z0-9]+)$", 1)
    suffix = F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1)
    more = F.array(F.when(double != "", F.concat(F.lit("*"), double)), F.when(tail != "", F.concat(F.lit("*"), tail)), F.when(lead != "", F.concat(lead, F.lit("*"), suffix)))
    return F.array_distinct(F.concat(folders, F.filter(more, lambda x: x.isNotNull())))


def _named(path: Column) -> Column:
    """Names that a package could be known by in a path: its folders, and its file name up to each separator."""
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[A-Za-z0-9]+$", "")
    return F.array_distinct(F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(stem, F.regexp_extract(stem, r"^([^_.-]+)[_.-]", 1))))


def provenance(chunks: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
    """(repo, base_commit, file_path, reason): files with at least one chunk that are generated, minified, third-party or mainly data.

    ``chunks``: repo, base_commit, file_path, symbol_kind, code_text; ``attributes``: repo, base_commit, file_path, content of attribute files. Rows with a
    null path are no files; null code counts as empty text; repeated rows change no share that decides. reason is declared (an attribute line), pattern (a public
    attribute line), mined (a package or glob of this corpus), tool or origin (a note in the file), minified, numbered, data, or copy, the first that applies; a file that an attribute
    line declares to be hand-written is none. Empty tables give no rows.
    """
    keys = ["repo", "base_commit", "file_path"]
    rows = chunks.filter("file_path IS NOT NULL").select(*keys, F.lower(F.trim("symbol_kind")).alias("symbol_kind"), F.coalesce("code_text", F.lit("")).alias("code_text"))
    seen = cut(rows.mapInPandas(_evidence, _EVIDENCE), "evidence", compression="zstd")
    sums = [F.sum(c).alias(c) for c in ("chars", "blanks", "valued", "numbers", "words", "calls", "numbered", "cases", "rows", "lines", "defs")]
    file = seen.groupBy(*keys).agg(*sums, F.max("tool").alias("tool"), F.max("origin").alias("origin"))
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    note = F.when(F.col("tool") == 1, "tool").when(F.col("origin") == 1, "origin")
    layout = (
        F.when((F.col("chars") >= 200) & (share("blanks", "chars") < 0.06), "minified")
        .when((F.col("numbered") >= 3) & (share("numbered", "calls") >= 0.5), "numbered")
        .when((F.col("cases") >= 8) & (share("numbers", "words") >= 0.3), "numbered")
        .when((F.col("defs") == 0) & (F.col("chars") >= 200) & (share("valued", "chars") >= 0.42), "data")
        .when((F.col("lines") >= 5) & (share("rows", "lines") >= 0.7), "data")
        .when((F.col("words") >= 60) & (share("numbers", "words") >= 0.6), "data")
    )
    path = F.col("file_path")
    facts = file.select(*keys, note.alias("note"), layout.alias("layout"), path.rlike(_any_of(PUBLIC_ATTRIBUTES)).alias("pattern"), path.rlike(_any_of(PUBLIC_ATTRIBUTES, "vendored")).alias("third"), path.rlike(_any_of(LOOSE_ATTRIBUTES)).alias("loose"), F.nullif(F.regexp_extract(path, _PACKAGE, 1), F.lit("")).alias("package"))
    if attributes is not None:
        facts = facts.join(declared(file.select(*keys), attributes), keys, "left")
    else:
        facts = facts.withColumn("marked", F.lit(None).cast("boolean"))
    judged = cut(facts, "judged", compression="zstd")
    known = F.coalesce("marked", F.col("pattern"))

    # Chunks of declared third-party files, by which copies elsewhere are confirmed.
    third = judged.filter("coalesce(marked, true) AND (third OR note = 'origin')").select(*keys)
    long = seen.filter("hash IS NOT NULL").select(*keys, "hash").distinct()
    there = long.join(third, keys, "left_semi").select("hash").distinct().withColumn("known", F.lit(1))
    copies = (
        long.join(judged.filter("NOT third").select(*keys), keys, "left_semi").join(there, "hash", "left")
        .groupBy(*keys).agg(F.avg(F.coalesce("known", F.lit(0))).alias("s")).filter("s >= 0.5").select(*keys, F.lit(1).alias("copy"))
    )
    facts = cut(judged.join(copies, keys, "left").withColumn("confirmed", F.col("note").isNotNull() | F.col("layout").isNotNull() | F.col("copy").isNotNull()), "facts", compression="zstd")

    # Mined packages: folders below third-party folders of several repositories; files named after one elsewhere are asked for confirmation.
    packages = facts.filter(known & F.col("package").isNotNull() & ~F.col("package").isin(*_NO_PACKAGES)).groupBy(F.col("package").alias("name")).agg(F.count_distinct("repo").alias("repos")).filter(F.col("repos") >= PACKAGE_REPOS).select("name")
    undecided = facts.filter("marked IS NULL AND NOT pattern")
    by_package = undecided.filter("confirmed").select(*keys, F.explode(_named(path)).alias("name")).join(packages, "name", "left_semi").select(*keys)
    # Mined globs: nearly all their files are declared, noted or confirmed, in several repositories.
    case = known | (F.col("marked").isNull() & F.col("confirmed"))
    globs = facts.select(*keys, case.cast("int").alias("e"), (F.col("marked").isNull() & ~F.col("pattern")).alias("open"), F.explode(_patterns(path)).alias("glob"))
    mined = (
        globs.groupBy("glob", "repo").agg(F.sum("e").alias("e"), F.count(F.lit(1)).alias("n"))
        .groupBy("glob").agg(F.sum("e").alias("e"), F.sum("n").alias("n"), F.sum((F.col("e") > 0).cast("int")).alias("repos"))
        .filter((F.col("repos") >= MINED_REPOS) & (F.col("e") >= MINED_SHARE * F.col("n"))).select("glob")
    )
    matched = globs.filter("open").join(mined, "glob", "left_semi").select(*keys).union(by_package).distinct().withColumn("mined", F.lit(True))
    found = F.when(F.col("marked"), "declared").when(
        F.col("marked").isNull(),
        F.when(F.col("pattern") | (F.col("loose") & F.col("confirmed")), F.lit("pattern")).when(F.col("mined"), "mined").otherwise(F.coalesce("note", "layout", F.when(F.col("copy") == 1, "copy"))),
    )
    return facts.join(matched, keys, "left").withColumn("reason", found).filter("reason IS NOT NULL").select(*keys, "reason")
