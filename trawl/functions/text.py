"""Column functions over text: identifier tokens, terms, names, paths, trace references. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about a place in the code.
STOP_WORDS = (
    "about actual after again also and are behavior bug but can cannot crash does error expected fail failed fails failure for from has have into issue log none not null only "
    "should step steps the this ticket typeerror value when with without"
).split()
#: Further words that are no program names.
NO_NAMES = (
    "actual_behavior assert async await bool break bug_report bytes class continue description def dict else error_message except false finally float expected_behavior import int "
    "lambda len list logs print raise screenshots_text steps_to_reproduce summary return self set str true ticket_id title try tuple while yield"
).split()
#: Shapes of code-like names in a report, in order.
IDENTIFIER_SHAPES = (
    r"\b[A-Z][A-Z0-9_]{2,}\b",
    r"\b[A-Z]\d{2,4}\b",
    r"\b[A-Za-z_][A-Za-z0-9_]*__[A-Za-z0-9_]+(?:__[A-Za-z0-9_]+)*\b",
    r"\b[a-z][a-z0-9]+(?:_[a-z0-9]+)+\b",
    r"\b[A-Z][A-Za-z0-9]+(?:[A-Z][A-Za-z0-9]+)+\b",
    r"\b[A-Za-z_][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_]*\b",
)
#: How many terms and identifiers of a report count.
MAX_TERMS, MAX_IDENTIFIERS = 40, 80
#: Fixed value: how many program names of a report are looked up.
MAX_NAMES = 20
_WORD, _PIECE = "[A-Za-z][A-Za-z0-9_]*", "[A-Z]?[a-z]+|[A-Z]+(?=[A-Z_]|$)|[0-9]+"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def tokens(text: Column) -> Column:
    """Each word in lower case, followed by its camel-case and snake-case pieces; one-letter tokens are left out, repetitions stay."""
    words = F.regexp_extract_all(text_or_empty(text), F.lit(_WORD), F.lit(0))
    pieces = lambda w: F.filter(F.regexp_extract_all(w, F.lit(_PIECE), F.lit(0)), lambda p: F.length(p) > 1)
    spread = F.flatten(F.transform(words, lambda w: F.concat(F.array(F.lower(w)), F.transform(pieces(w), F.lower))))
    return F.filter(spread, lambda t: F.length(t) > 1)


def important_terms(text: Column) -> Column:
    """The first distinct tokens of three letters or more that are no stop words, at most MAX_TERMS."""
    kept = F.filter(F.array_distinct(tokens(text)), lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS))
    return F.slice(kept, 1, MAX_TERMS)


def bare(c: Column) -> Column:
    """Without blanks, quotes and brackets around it."""
    return F.trim(F.regexp_replace(F.trim(c), r"^[\"'`.,;:()\[\]{}]+|[\"'`.,;:()\[\]{}]+$", ""))


def identifier(c: Column) -> Column:
    return F.lower(F.replace(bare(c), F.lit("-"), F.lit("_")))


def report_identifiers(text: Column) -> Column:
    """Distinct code-like names of a report in lower case, shape by shape, at most MAX_IDENTIFIERS."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text_or_empty(text), F.lit(p), F.lit(0)) for p in IDENTIFIER_SHAPES]))
    kept = F.filter(F.array_distinct(F.transform(found, identifier)), lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS))
    return F.slice(kept, 1, MAX_IDENTIFIERS)


def program_names(text: Column) -> Column:
    """Distinct lookup keys of the code-like names of a report: names in backticks, called names, then its identifiers, at most MAX_NAMES."""
    name = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*"
    quoted = F.regexp_extract_all(text_or_empty(text), F.lit(r"(?<!`)`([^`\n]+)`(?!`)"), F.lit(1))
    called = F.regexp_extract_all(text_or_empty(text), F.lit(rf"(?<![A-Za-z0-9_.])({name})\s*\("), F.lit(1))
    shaped = F.filter(F.transform(F.concat(quoted, called, report_identifiers(text)), bare), lambda x: x.rlike(rf"\A{name}\z"))
    leaf = lambda k: F.substring_index(k, ".", -1)
    kept = F.filter(F.array_distinct(F.transform(shaped, symbol_key)), lambda k: (F.length(leaf(k)) >= 3) & ~leaf(k).isin(*STOP_WORDS, *NO_NAMES))
    return F.slice(kept, 1, MAX_NAMES)


def identifier_variants(c: Column) -> Column:
    """A name, its singular, and its parts of three letters or more."""
    parts = lambda sep: F.filter(F.split(c, sep), lambda p: F.length(p) >= 3)
    cut = F.when(c.endswith("s") & (F.length(c) > 4), F.array(F.regexp_replace(c, "s$", ""))).otherwise(F.array().cast("array<string>"))
    under = F.when(c.contains("_"), parts("_")).otherwise(F.array().cast("array<string>"))
    dotted = F.when(c.contains("."), parts(r"\.")).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(c), cut, under, dotted))


def symbol_key(c: Column) -> Column:
    """The lookup key of a symbol name: dots for ``::`` and slashes, no dots at the ends, lower case (for case folding beyond ASCII see README)."""
    dotted = F.regexp_replace(F.replace(F.replace(bare(c), F.lit("::"), F.lit(".")), F.lit("/"), F.lit(".")), r"\.+", ".")
    return F.lower(F.regexp_replace(dotted, r"^\.|\.$", ""))


def norm_path(c: Column) -> Column:
    """Slashes forward, and every leading dot and slash removed (so ``.github/x`` gives ``github/x``)."""
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^[./]+", "")


def base_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def same_path(a: Column, b: Column) -> Column:
    """Equal, or one is the other's tail at a slash; empty paths match nothing."""
    return (a != "") & (b != "") & ((a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a)))


def test_like(c: Column) -> Column:
    """Some folder is a test folder, or the name looks like a test."""
    low = F.lower(norm_path(c))
    return low.rlike(r"(^|/)(test|tests|__tests__|spec|specs)(/|$)") | base_name(low).rlike(r"^test_|_test\.py$")


#: References to files in a report, most exact first.
TRACE_SHAPES = (
    r'File "([^"]+)", line (\d+)',
    r"([A-Za-z0-9_./\\-]+\.(?:py|js|jsx|ts|tsx|java|c|cc|cpp|h|hpp|go|rs)):(\d+)",
    r"([A-Za-z0-9_./\\-]+\.(?:py|js|jsx|ts|tsx|java|c|cc|cpp|h|hpp|go|rs))()",
)


def trace_refs(text: Column) -> Column:
    """array<struct<file, line>> of all file references, in the order of TRACE_SHAPES."""
    of = lambda p: F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("file"), F.regexp_extract_all(text, F.lit(p), F.lit(2)).alias("line"))
    rows = F.flatten(F.array(*[of(p) for p in TRACE_SHAPES]))
    return F.transform(rows, lambda r: F.struct(F.replace(r["file"], F.lit("\\"), F.lit("/")).alias("file"), F.when(r["line"] != "", r["line"].cast("bigint")).alias("line")))


def overlap_share(a: Column, b: Column) -> Column:
    """Share of a's distinct terms that b has; 0 if either is empty."""
    n = F.size(F.array_distinct(a))
    return F.when((n > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def keyword_signal(query: Column, terms: Column) -> Column:
    """min(1, matches / max(4, min(query terms, 12))); the query's terms are distinct."""
    n = F.size(F.array_intersect(query, terms))
    return F.when(F.size(query) > 0, F.least(F.lit(1.0), n / F.greatest(F.lit(4), F.least(F.size(query), F.lit(12))))).otherwise(F.lit(0.0))


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def module_parts(path: Column) -> Column:
    """A source path as a dotted module name without its suffix."""
    return F.replace(F.regexp_replace(norm_path(path), r"\.[A-Za-z0-9]+$", ""), F.lit("/"), F.lit("."))
