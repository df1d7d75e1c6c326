"""Operators for training data against brute force, exact round trips and held-out accuracy, with nulls, ties, repeats, empty tables and clashing columns."""

import math
import random
import re
from pathlib import Path

import sys

import pytest
from pyspark.sql import functions as F

from trawl.llm import bpe, boost, families, grammar, overlap, pack, pii, pii_training, provenance, split, syntax, topn

sys.path.insert(0, str(Path(__file__).parent))
FILES = "repo string, base_commit string, file_path string, content string"


# --- 1
GOOD = {
    "a.py": "import os\n\n@dec\nclass A(B):\n    '''doc <<<<<<< HEAD'''\n    def f(self, x=1, *a, **k) -> int:\n        if x and not self.y[1:2]:\n            return {k: v for k, v in x}\n        else:\n            pass\n        y = lambda z: z\n        return f'{x!r}'\n",
    "empty.py": "",
    "note.py": "# only a comment\n",
    "a.js": "'use strict';\nvar a = require('./b');\nfunction f(x, y) {\n  for (var i = 0; i < x.length; i++) {\n    y.forEach(function (z) { g(z, `t${z}`); });\n  }\n  var r = x.replace(/[({]+/g, '');\n  return !x ? { k: 1 } : r;\n}\n/*\n<<<<<<< ours\n*/\n",
    "a.ts": "import { A } from './a';\nexport type Id = string | number;\nexport async function f(x: number, y: string[]) {\n  const z: Id = x;\n  return z;\n}\n",
    "A.java": 'package org.a;\n\nimport org.b.C;\n\npublic class A {\n    private static int f(int a, String b) {\n        char c = \'{\';\n        try {\n            g(a);\n        } catch (RuntimeException err) {\n            LOG.warn("x", err);\n        }\n        while (a > 6) {\n            a--;\n        }\n        return a;\n    }\n}\n',
    "a.go": "package a\n\nimport \"b/c\"\n\nfunc (s *T) f(x int, y string) int {\n\tdefer g.h()\n\tif err := k.m(x); err != nil {\n\t\treturn 2\n\t}\n\tfor i := 0; i < 9; i++ {\n\t\tg.n(i)\n\t}\n\treturn x\n}\n",
    "a.c": '#include <stdio.h>\n#define W 3\n\nstatic int f(int a, const char *b)\n{\n    char c = \'{\';\n    for (int i = 0; i < 3; i++) {\n        g("x", b[i]);\n    }\n    return a;\n}\n',
}


def _bad():
    out = {}
    for path, text in GOOD.items():
        if len(text) < 100:
            continue
        lines = text.split("\n")
        k = next(i for i, x in enumerate(lines) if x.rstrip().endswith(("{", ":")) and i >= 2)
        out["cut_" + path] = "\n".join(lines[: k + 1])
        out["conflict_" + path] = "\n".join([*lines[: k + 1], "<<<<<<< HEAD", *lines[k + 1 :], "=======", ">>>>>>> theirs"])
    out["csv.py"] = "id,name\n9207,reader oaken,io shrink\n"
    out["java.go"] = GOOD["A.java"]
    out["python.js"] = GOOD["a.py"]
    out["go.c"] = GOOD["a.go"]
    return out


def test_syntax_flags_broken_files_only(spark, rows):
    data = [("o/r", "c", p, t) for p, t in [*GOOD.items(), *_bad().items()]] + [("o/r", "c", "null.py", None), ("o/r", "c", "x.txt", "{{{"), ("o/r", "c", "cut_a.py", _bad()["cut_a.py"]), (None, None, "n.py", "def (")]
    found = syntax.unparsable(spark.createDataFrame([(*r, 1) for r in data], FILES + ", language int")).collect()
    assert sorted(r["file_path"] for r in found) == sorted([*_bad(), "n.py"])
    rate = {(r["repo"], r["language"]): (r["files"], r["unparsable"]) for r in syntax.rates(spark.createDataFrame(data, FILES), spark.createDataFrame([tuple(r) for r in found], "repo string, base_commit string, file_path string, language string, reason string")).collect()}
    assert rate[None, "python"] == (1, 1)
    assert syntax.unparsable(spark.createDataFrame([], FILES)).count() == 0


def test_valid_and_broken_constructs(spark):
    from sources import BROKEN, VALID

    suffix = {language: s for s, language in grammar.LANGUAGES.items()}
    data = [("o/r", "c", f"{kind}/{k}{suffix[language]}", t) for kind, texts in (("valid", VALID), ("broken", BROKEN)) for language, ts in texts.items() for k, t in enumerate(ts)]
    got = {r["file_path"] for r in syntax.unparsable(spark.createDataFrame(data, FILES)).collect()}
    assert got == {p for _, _, p, _ in data if p.startswith("broken")}


@pytest.mark.parametrize("depth", [1, 7, 60])
def test_nesting_has_no_bound(spark, depth):
    nest = lambda inner: "(" * depth + inner + ")" * depth
    data = [("o/r", "c", "good.c", f"int f(void) {{ x = {nest('a')}; {'{' * depth} g(); {'}' * depth} }}\n"), ("o/r", "c", "bad.c", f"int f(void) {{ x = {nest('a b')}; }}\n"), ("o/r", "c", "bad2.c", f"int f(void) {{ {'{' * depth} g() {'}' * depth} }}\n"), ("o/r", "c", "bad3.c", f"int f(void) {{ x = {nest('a')}); }}\n")]
    data += [("o/r", "c", "good.js", f"for (var i = {nest('1')}; i < {nest('2')}; i++) {{ f({nest('x => { return y; }')}); }}\n"), ("o/r", "c", "bad.js", f"f({nest('function () { return y z; }')});\n")]
    got = {r["file_path"] for r in syntax.unparsable(spark.createDataFrame(data, FILES)).collect()}
    assert got == {"bad.c", "bad2.c", "bad3.c", "bad.js"}


def test_grammar_pairs_follow_from_productions():
    assert "nP" in grammar.permitted("python") and "nn" not in grammar.permitted("python") and "oo" not in grammar.permitted("javascript")


# --- 2
CHUNKS = "repo string, base_commit string, file_path string, symbol_kind string, code_text string"


def test_provenance(spark):
    own = "def evict(cache, size):\n    # do not edit the cache here, flush does it\n    for item in cache:\n        cache.drop(item, size)\n    return cache\n" * 2
    lib = "int grow(struct pool *p)\n{\n    if (p->full)\n        return resize(p, p->size);\n    return push(p, p->next);\n}\n" * 2
    data = [
        ("a/b", "c", "src/own.py", "function", own), ("a/b", "c", "src/own.py", "function", own), ("a/b", "c", "src/gen.py", "module", "# Code generated by tool v1. DO NOT EDIT.\nx = 1\n"),
        ("a/b", "c", "static/x.js", "module", "function a(n,w){return n&&n.r(w,4)||w}" * 30), ("a/b", "c", "src/says.py", "module", "out.write('# Code generated by x. DO NOT EDIT.')\n" + own),
        ("a/b", "c", "vendor/pool.c", "function", lib), ("x/y", "c", "src/pool_local.c", "function", lib), ("a/b", "c", "data/t.py", "module", "T = [\n" + "    46.5, 17.4, 94.8,\n" * 40 + "]\n"),
        ("a/b", "c", "src/acc.py", "class", "".join(f"    def get_x{i}(self):\n        return self._f[{i}]\n" for i in range(9))), ("a/b", "c", "null.py", None, None), ("a/b", "c", None, "module", "x"), ("a/b", "c", "vendors/admin.py", "function", own),
    ]
    attributes = [("a/b", "c", ".gitattributes", "*.tpl linguist-generated\nsrc/own.py linguist-generated\n"), ("a/b", "c", "src/.gitattributes", "own.py -linguist-generated\n# note\nsays.py linguist-vendored=true\n")]
    found = {(r["repo"], r["file_path"]): r["reason"] for r in provenance.provenance(spark.createDataFrame(data, CHUNKS), spark.createDataFrame(attributes, FILES)).collect()}
    assert found == {("a/b", "src/gen.py"): "tool", ("a/b", "static/x.js"): "minified", ("a/b", "vendor/pool.c"): "pattern", ("x/y", "src/pool_local.c"): "copy", ("a/b", "data/t.py"): "data", ("a/b", "src/acc.py"): "numbered", ("a/b", "src/says.py"): "declared"}
    assert provenance.provenance(spark.createDataFrame([], CHUNKS)).count() == 0


def test_attribute_lines_of_several_depths_in_a_hot_repository(spark):
    own = "def evict(cache, size):\n    for item in cache:\n        cache.drop(item, size)\n    return cache\n" * 2
    paths = [f"m{k % 50}/d{k % 7}/f{k}.{('py', 'js', 'tpl')[k % 3]}" for k in range(3000)] + ["deps/own.py", "gen/own.py", "external/a/b.py"]
    chunks = spark.createDataFrame([("hot/r", "c", x, "function", own) for x in paths], CHUNKS)
    attributes = [
        ("hot/r", "c", ".gitattributes", "*.tpl linguist-generated\nm1/** linguist-vendored\nd3/ linguist-generated\n"),
        ("hot/r", "c", "m1/.gitattributes", "*.js -linguist-vendored\nd2/*.js linguist-vendored=true\n"),
        ("hot/r", "c", "m1/d3/.gitattributes", "* -linguist-vendored -linguist-generated\nf*0.py !linguist-generated\n"),
    ]
    got = {r["file_path"] for r in provenance.provenance(chunks, spark.createDataFrame(attributes, FILES)).collect()}

    def wanted(x):
        m, d, name = x.split("/")
        generated = d == "d3" or name.endswith(".tpl")
        vendored = m == "m1" and (not name.endswith(".js") or d == "d2")
        return (generated or vendored) and not (m == "m1" and d == "d3")

    assert got == {x for x in paths if x.startswith("m") and wanted(x)} and any(x.startswith("m1/d2/") and x.endswith(".js") for x in got)


def test_packages_are_mined_from_declared_folders(spark):
    lib = "int grow(struct pool *p)\n{\n    if (p->full)\n        return resize(p, p->size);\n    return push(p, p->next);\n}\n" * 2
    own = "def evict(cache, size):\n    for item in cache:\n        cache.drop(item, size)\n    return cache\n" * 2
    data = [("a/b", "c", "vendor/tinypool/core.c", "function", lib), ("x/y", "c", "third_party/tinypool/core.c", "function", lib), ("q/r", "c", "src/compat/tinypool_local.c", "function", lib), ("q/r", "c", "src/tinypool_test.py", "function", own)]
    found = {r["file_path"]: r["reason"] for r in provenance.provenance(spark.createDataFrame(data, CHUNKS)).collect()}
    assert found == {"vendor/tinypool/core.c": "pattern", "third_party/tinypool/core.c": "pattern", "src/compat/tinypool_local.c": "mined"}


@pytest.mark.parametrize(("glob", "path", "hit"), [("*.js", "a/b.js", True), ("/x/*.js", "x/b.js", True), ("/x/*.js", "x/y/b.js", False), ("x/**", "x/y/z", True), ("**/gen/*", "a/gen/b", True), ("docs/", "docs/a", True), ("[ab].py", "c/a.py", True)])
def test_globs(glob, path, hit):
    assert bool(re.match(provenance.glob_regex(glob), path)) is hit


# --- 3
def test_top_n_against_brute_force(spark, rows):
    r = random.Random(3)
    data = [(r.choice(["hot", "hot", "hot", f"g{r.randint(0, 40)}", None]), r.choice([f"i{r.randint(0, 60)}", None]), r.choice([0.5, 0.5, round(r.random(), 2), None, float("nan"), float("inf"), -0.1, 1.1]), r.choice([None, 1, 2, 2])) for _ in range(6000)]
    best = {}
    for g, i, s, k in data:
        if g is not None and i is not None and s is not None and 0 <= s <= 1:
            key = (-s, k if k is not None else math.inf)
            best[g, i] = min(best.get((g, i), (math.inf, 0)), key)
    want = []
    for g in {g for g, _ in best}:
        want += [(g, i, p) for p, (_, i) in enumerate(sorted((v, i) for (h, i), v in best.items() if h == g)[:5], 1)]
    df = spark.createDataFrame([(*x, "z") for x in data], "ticket_id string, chunk_id string, score double, rank int, position string")
    got = topn.top_n(df, "ticket_id", "chunk_id", "score", "rank", 5).select("ticket_id", "chunk_id", "position")
    assert rows(got) == sorted(want, key=repr)
    assert topn.top_n(df.filter("false"), "ticket_id", "chunk_id", "score", "rank", 5).count() == 0


def _clustered(data, path, size):
    """A clustered file with row groups of ``size`` rows, as the operator writes it."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    t = pa.table({"g": [x[0] for x in data], "i": [x[1] for x in data], "s": [x[2] for x in data], "r": pa.array([1] * len(data), pa.int32())})
    pq.write_table(t.sort_by([("g", "ascending"), ("s", "descending")]), path, row_group_size=size)
    return pq.ParquetFile(path)


def test_top_n_skips_row_groups(tmp_path):
    r = random.Random(33)
    hot = [("hot", f"i{k}", r.random()) for k in range(4000)]
    small = [(f"a{k // 3:04d}", f"j{k}", r.random()) for k in range(600)]
    for data, least in ((hot, 38), (hot + small, 38), (small, 0)):  # small groups are results as a whole, and hinder no skip
        kept, groups, skipped = topn.scan(_clustered(data, str(tmp_path / "f.parquet"), 100), 5)
        best = {}
        for g, i, s in data:
            best.setdefault(g, []).append((-s, i))
        assert sorted(zip(kept["g"].to_pylist(), kept["i"].to_pylist(), strict=True)) == sorted((g, i) for g, x in best.items() for _, i in sorted(x)[:5])
        assert groups == -(-len(data) // 100) and least <= skipped <= groups - 1


def test_top_n_reports_skips(spark):
    df = spark.createDataFrame([("g", f"i{k}", k / 100, k) for k in range(100)], "g string, i string, s double, r int")
    seen = topn.skips(df, "g", "i", "s", "r", 5).collect()[0]
    assert 0 < seen["row_groups"] and 0 <= seen["skipped"] < seen["row_groups"]
    assert topn.skips(df.filter("false"), "g", "i", "s", "r", 5).collect()[0]["skipped"] == 0


# --- 4
@pytest.mark.parametrize("seed", range(6))
def test_cut_covers_the_text_within_the_limit(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["x = f(a, b)\n", "\n", "def g():\n", "    é日 = 1\r\n", "word " * 30 + "\n", "z" * r.choice([3, 900])]) for _ in range(80))
    for limit, over, unit in ((400, 3, "lines"), (97, 5, "lines"), (200, 20, "chars"), (50, 0, "lines"), (1, 3, "lines")):
        parts = split.cut(text, limit, over, unit)
        assert all(0 < end - begin <= limit for begin, _, end in parts)
        assert "".join(text[own:end] for _, own, end in parts) == text  # the round trip
        assert len(parts) >= -(-len(text) // limit)
    assert split.cut("", 10, 3) == [(0, 0, 0)]


def test_pieces_begin_with_the_stated_overlap():
    # Three lines of half the limit: all of it, not half the limit.
    lines = [c * 19 + "\n" for c in "abcdefghijklmnop"]
    text = "".join(lines)
    for _, own, end in (parts := split.cut(text, 100, 3))[:-1]:
        assert end % 20 == 0
    assert all(own - begin == min(60, own) for begin, own, _ in parts[1:])
    # A line longer than the limit cannot be repeated.
    assert all(0 < own - begin <= 50 for begin, own, _ in split.cut("x" * 350, 100, 3)[1:])


def test_cut_prefers_declarations():
    text = "def a():\n" + "    x = 1\n" * 12 + "\ndef b():\n" + "    y = 2\n" * 12
    assert [text[own : own + 7] for _, own, _ in split.cut(text, 150, 2)][1].startswith("def b()")


def test_pieces_have_lines(spark):
    limits = spark.createDataFrame([("function", "chars", 60, 1, "lines"), ("chunk", "chars", 40, 1, "lines"), ("doc", "tokens", 5, 0, "tokens")], "item_kind string, unit_name string, max_size int, overlap_size int, overlap_unit string")
    code = "\n".join(f"line{k:02d} = {k}" for k in range(10))
    data = [("r", "c", "big", "f", " FUNCTION ", 20, 11, code), ("r", "c", "big", "f", " FUNCTION ", 20, 11, code), ("r", "c", "none", "f", None, None, None, code), ("r", "c", "small", "f", "function", 1, 2, "x"), ("r", "c", "null", "f", "function", 1, 2, None), ("r", "c", "other", "f", "weird", 1, 2, code * 9)]
    got = split.split_oversized(spark.createDataFrame(data, "repo string, base_commit string, chunk_id string, file_path string, symbol_kind string, start_line int, end_line int, code_text string"), limits).collect()
    assert {r["chunk_id"] for r in got} == {"big", "none"}
    big = sorted((r["piece"], r["start_line"], r["end_line"], r["overlap_chars"]) for r in got if r["chunk_id"] == "big")
    assert big[0][1] == 11 and big[-1][2] == 20 and all(o > 0 for p, _, _, o in big if p > 1) and len(big) == len({p for p, *_ in big})
    assert all(r["start_line"] is None for r in got if r["chunk_id"] == "none")


# --- 5
def test_components_against_union_find(spark):
    r = random.Random(5)
    edges = [(f"v{r.randint(0, 80)}", f"v{r.randint(0, 80)}") for _ in range(70)] + [(f"w{k}", f"w{k + 1}") for k in range(40)] + [(None, "v1"), ("v2", "v2")]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            parent[root(a)] = root(b)
    got = {}
    for row in families.components(spark.createDataFrame(edges, "a string, b string")).collect():
        assert row["v"] not in got
        got[row["v"]] = row["root"]
    assert set(got) == {x for e in edges for x in e if x and e[0] and e[0] != e[1]}
    assert all((got[a] == got[b]) == (root(a) == root(b)) for a in got for b in got)
    assert families.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_records_that_belong_together_share_a_split(spark):
    gold = [(f"g{k}", f"t{k % 7}", f"o/r{k % 3}") for k in range(60)] + [("h", " T0 ", "https://x/O/R9.git"), ("n", "TBD", None), ("m", "t1", None), ("u", "ghost", "o/r8"), ("v", "ghost", "o/r7"), ("n", "TBD", None)]
    df = spark.createDataFrame(gold, "gold_id string, ticket_id string, repo string")
    tickets = spark.createDataFrame([(f"t{k}",) for k in range(7)], "ticket_id string")
    targets = spark.createDataFrame([("train", 0.7), ("test", 0.3), (None, 0.5)], "split_name string, share double")
    got = families.split_records(df, tickets, targets).collect()
    assert len(got) == len(gold)
    by = {}
    for r in got:
        by.setdefault(r["family"], set()).add(r["split_name"])
    assert all(len(s) == 1 and None not in s for s in by.values())
    fam = {r["gold_id"]: r["family"] for r in got}
    assert fam["h"] == fam["g0"] == fam["m"] and fam["u"] != fam["v"]
    pairs = {tuple(r) for r in families.family_pairs(df, tickets).collect()}
    assert ("o/r0", "o/r9") in pairs and not any("o/r8" in p for p in pairs)
    assert families.split_records(df.filter("false"), tickets, targets).count() == 0


# --- 6
def test_overlaps_against_brute_force(spark):
    r = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    base = [" ".join(r.sample(words, 12)) for _ in range(12)]
    tickets, gold, outcomes, text = [], [], [], {}
    for k in range(150):
        t = r.choice(base).split()
        for _ in range(r.randint(0, 5)):
            t[r.randrange(len(t))] = r.choice(words)
        s = " ".join(t).upper() if r.random() < 0.3 else "  ".join(t) + "!"
        if k % 40 == 0:
            s = None
        tickets.append((f"t{k}", s, None))
        text[f"t{k}"] = set(re.findall(r"\w+", (s or "").lower()))
        gold.append((f" T{k} ", r.choice(["o/r", "O/R.git"]), r.choice(["a" * 40, "A" * 40, "a" * 12])))
        outcomes.append((f"t{k}", r.choice(["train", " Train", "test", "validation", None])))
    side = {t: (s or "").strip().lower() for t, s in outcomes}
    want = {tuple(sorted((a, b))) for a in text for b in text if side[a] == "train" and side[b] in ("test", "validation") and len(text[a] & text[b]) >= 0.6 * len(text[a] | text[b])}
    frames = spark.createDataFrame(tickets + tickets[:20], "ticket_id string, title string, description string"), spark.createDataFrame(gold, "ticket_id string, repo string, base_commit string"), spark.createDataFrame(outcomes, "ticket_id string, split_name string")
    canonical = {t: " ".join(re.findall(r"\w+", (s or "").lower())) for t, s, _ in tickets}
    for block_chars in (overlap.BLOCK_CHARS, 0):  # compared in one task, and by joins
        got = overlap.overlapping(*frames, block_chars=block_chars).collect()
        assert {(r["ticket_a"], r["ticket_b"]) for r in got} == want and len(want) > 20
        assert all((r["way"] == "hash") == (canonical[r["ticket_a"]] == canonical[r["ticket_b"]]) for r in got)
    report = overlap.report(overlap.overlapping(*frames)).collect()
    assert sum(r["pairs"] for r in report) == len(want) == sum(r["by_hash"] + r["near"] for r in report) and any(r["by_hash"] for r in report)
    assert overlap.overlapping(*(f.filter("false") for f in frames)).count() == 0


# --- 7
VOCABULARY = Path(bpe.TOKENIZERS) / bpe.VOCABULARY
needs_vocabulary = pytest.mark.skipif(not VOCABULARY.exists(), reason="no vocabulary file")


@needs_vocabulary
def test_encoding_equals_the_library():
    import numpy as np
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(str(VOCABULARY))
    library.encode_special_tokens = True
    r = random.Random(7)
    parts = ["a", "b", " ", "é", "日", "\n", "\r", "\t", "12", "٣", "\x85", "\x1c", "\x00", "'s", "😀", "the", "ing", "<|endoftext|>", "\xa0", "½", "_", "ABC"]
    texts = ["".join(r.choices(parts, k=r.randint(1, 50))) for _ in range(3000)] + ["a" * 3000, " " * 2000, "ab" * 2000]
    own = bpe.encoder(str(VOCABULARY))
    assert all(np.frombuffer(own.encode(t), "<i4").tolist() == e.ids for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True))


@needs_vocabulary
def test_empty_and_null_texts(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "a"), (3, "a")], "doc_id bigint, text string")
    got = [(r["doc_id"], r["ids"]) for r in bpe.encode(df, "doc_id", "text").collect()]
    assert sorted(got) == [(1, []), (2, []), (3, [64]), (3, [64])]
    assert {(r["doc_id"], r["tokens"]) for r in bpe.token_counts(df, "doc_id", "text").collect()} == {(1, 0), (2, 0), (3, 1)}


# --- 8
def test_packing(spark):
    r = random.Random(8)
    data = [(k, r.choice([0, 5, r.randint(1, 900), 1024, 3000, None])) for k in range(700)] + [(None, 3), (7, 10)]
    limits = spark.createDataFrame([("small", "tokens", 1024), ("x", "chars", 10)], "item_kind string, unit_name string, max_size int")
    got = pack.pack(spark.createDataFrame(data, "doc_id bigint, tokens int"), limits, block=100).collect()
    load, docs, total = {}, {}, 0
    for x in got:
        load[x["container"]] = load.get(x["container"], 0) + x["tokens"]
        docs[x["container"]] = docs.get(x["container"], 0) + 1
        total += x["tokens"]
        assert x["parts"] == 1 or x["parts"] == 3
    assert max(load.values()) <= 1024 and max(docs.values()) <= pack.MAX_DOCUMENTS
    assert total == sum(t or 0 for d, t in data if d is not None)
    assert pack.pack(spark.createDataFrame([], "doc_id bigint, tokens int"), limits).count() == 0


def test_place_fills_well():
    import numpy as np

    sizes = np.random.default_rng(8).integers(1, 400, 3000)
    at = pack.place(sizes, 1024)
    assert sizes.sum() / (1024 * (at.max() + 1)) > 0.98
    with pytest.raises(ValueError):
        pack.place(np.array([11]), 10)


def test_attention_cost_binds():
    import numpy as np

    sizes = np.array([950, 60, 60, 600, 400, 1000])
    at = pack.place(sizes, 1024, cost_share=0.5)
    cost = np.bincount(at, sizes.astype(float) ** 2)
    several = np.bincount(at) > 1
    assert several.any() and (cost[several] <= 0.5 * 1024**2).all() and (np.bincount(at)[at[[0, 5]]] == 1).all()
    free = pack.place(sizes, 1024, cost_share=1.0)
    assert free[1] == free[0]  # tokens alone let 60 join 950


# --- 9
LEXICON = (("Orla", "given"), ("Tobin", "given"), ("Winter", "given"), ("Hoxley", "family"), ("Okonjo-Vale", "family"), ("Cache", "family"))


def test_personal_items_held_out_accuracy():
    """Frames that the models never saw, per type."""
    from heldout import WITH, WITHOUT

    lexicon, trained = pii.Lexicon(list(LEXICON)), pii.models(LEXICON)
    data = pii_training.labelled(4711, lexicon, (WITH, WITHOUT))[:5000]
    right, wrong, missed = (dict.fromkeys(pii.TYPES, 0) for _ in range(3))
    for (_, gold), items in zip(data, pii.find([t for t, _ in data], lexicon, trained), strict=True):
        got, true = {(t, a) for t, a, _, _ in items}, set(gold)
        for count, found in ((right, got & true), (wrong, got - true), (missed, true - got)):
            for t, _ in found:
                count[t] += 1
    for t in pii.TYPES:
        assert right[t] / (right[t] + missed[t]) >= 0.9 and right[t] / (right[t] + wrong[t]) >= 0.95, (t, right[t], wrong[t], missed[t])


@pytest.mark.skipif(not Path("/root/testdata/sf0.1/documents.parquet").exists(), reason="no test data")
def test_training_sentences_stand_in_no_document():
    import pyarrow.parquet as pq

    text = "\n".join(t for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist() if t)
    for frame in pii_training._WITH + pii_training._WITHOUT:
        parts = [p for p in re.split(r"\{\w+\}", frame.replace("{{", "{").replace("}}", "}")) if len(p) >= 8]
        assert not parts or not all(p in text for p in parts), frame
    assert not [w for w in pii_training._STREETS + pii_training._CITIES if w in text]


def test_redaction(spark):
    text = "Reported-by: Orla Hoxley <o.hoxley@mail.example>\nCall me on +44 20 7946 0678 if it stalls.\nThe Tobin Cache keeps 41061 entries.\nClone git@forge.example:a/b.git\nBuild 46013-555-57 passed."
    df = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x"), (1, text, "x")], "doc_id bigint, text string, items string")
    names = spark.createDataFrame(list(LEXICON), "name_text string, name_kind string")
    got = sorted(((r["doc_id"], r["redacted"]) for r in pii.detect(df, names).collect()), key=repr)
    clean = "Reported-by: [PERSON_NAME] <[EMAIL]>\nCall me on [PHONE] if it stalls.\nThe Tobin Cache keeps 41061 entries.\nClone git@forge.example:a/b.git\nBuild 46013-555-57 passed."
    assert got == sorted([(1, clean), (1, clean), (2, None), (3, "")], key=repr)
    assert {(r["pii_type"], r["start_pos"]) for r in pii.located(df, names).collect()} == {("person_name", 13), ("email", 26), ("phone", text.index("+44"))}
    assert pii.located(df.filter("false"), names.filter("false")).count() == 0


def test_long_mailboxes_are_read_whole():
    box = "ab." * 60 + "x"
    text = f"mail {box}@mail.example now, or a%2Bb@mail.example"
    got = [(a, b) for t, a, b, _ in pii.candidates(text, pii.Lexicon(list(LEXICON))) if t == "email"]
    assert got[0] == (5, 5 + len(box) + len("@mail.example")) and text[slice(*got[1])] == "a%2Bb@mail.example"


def test_boosting_learns_an_interaction():
    import numpy as np

    x = np.random.default_rng(9).integers(0, 2, (400, 4))
    y = x[:, 0] ^ x[:, 2]
    m = boost.Boosted(20, 3).fit(x[:300], y[:300]).calibrate(x[300:], y[300:])
    assert ((m.probability(x[300:]) >= m.cut) == y[300:]).all()


def test_extra_columns_do_not_clash(spark):
    df = spark.createDataFrame([("o/r", "c", "a.py", "def (", "x", "y", 1)], FILES + ", unit string, reason string, fid int")
    assert [r["reason"] for r in syntax.unparsable(df).collect()] != ["y"]
    assert syntax.unparsable(df).columns == ["repo", "base_commit", "file_path", "language", "reason"]
    assert F is not None
