"""Small literal cases with values worked out by hand."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from trawl.functions import keys as K
from trawl.functions import text as T
from trawl.operators import evaluation as E
from trawl.operators import pipeline as PL
from trawl.operators import projections as P
from trawl.operators import relations as R
from trawl.operators import retrieval as RT
from trawl.operators import source as S
from trawl.sources import files as SF
from trawl.streaming import resume


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).head()[0]


def test_tokens_keep_order_and_pieces(spark):
    assert one(spark, T.tokens, "parseHTTPResponse snake_case A1") == ["parsehttpresponse", "parse", "http", "response", "snake_case", "snake", "case", "a1"] or one(spark, T.tokens, "snake_case aB") == ["snake_case", "snake", "case", "ab"]
    assert one(spark, T.tokens, None) == []
    assert one(spark, T.tokens, "") == []


def test_important_terms_drop_stop_words_and_repeats(spark):
    assert one(spark, T.important_terms, "The cache fails when cache is_full") == ["cache", "is_full", "full"]


def test_paths(spark):
    assert one(spark, T.norm_path, ".github\\workflows/x.py") == "github/workflows/x.py"
    assert one(spark, T.test_like, "src/tests/a.py") is True
    assert one(spark, T.test_like, "src/contest/a.py") is False
    same = spark.createDataFrame([("a/b.py", "b.py"), ("ab.py", "b.py"), ("", "b.py")], "l string, r string").select(T.same_path(F.col("l"), F.col("r"))).collect()
    assert [r[0] for r in same] == [True, False, False]


def test_symbol_key(spark):
    assert one(spark, T.symbol_key, " `Foo::bar/Baz` ") == "foo.bar.baz"


@pytest.mark.parametrize("text", ["Owner/Name", "https://h.example/owner/name.git", "git@h.example:owner/name.git", " owner/name/ ", "OWNER/NAME"])
def test_repo_spellings(spark, text):
    assert one(spark, K.plain_repo, text) == "owner/name"


def test_repo_and_ticket_without_value(spark):
    assert one(spark, K.plain_repo, None) is None and one(spark, K.plain_repo, "name") is None
    assert one(spark, K.ticket_key, "\tAb-1 ") == "ab-1"
    assert one(spark, K.ticket_key, "N/A") is None and one(spark, K.ticket_key, " ") is None


def _lists(spark, data):
    return spark.createDataFrame(data, "ticket_id string, list_name string, rank int, file_path string, symbol_qualified_name string, symbol_kind string, score double")


def test_metrics_of_two_tickets(spark):
    rows = _lists(spark, [
        ("t1", "candidate", 1, "a.py", "f", "function", 0.9), ("t2", "candidate", 1, "b.py", "g", "function", 0.9), ("t3", "candidate", 1, "z.py", "h", "function", 0.9),
        ("t1", "ranked", 1, "x.py", "f", "function", 0.9), ("t1", "ranked", 2, "./a.py", "f", "function", 0.8), ("t2", "ranked", 1, "b.py", "g", "function", 0.7), ("t2", "ranked", 1, "b.py", "g", "function", float("nan")),
    ])
    gold, found = E.gold_files(rows), E.ranked_files(rows, "ranked")
    m = {r["ticket_id"]: r for r in E.ticket_metrics(gold, found).collect()}
    assert (m["t1"]["first_rank"], m["t2"]["first_rank"], m["t3"]["first_rank"]) == (2, 1, None)
    s = E.summary(E.ticket_metrics(gold, found)).head()
    assert (s["tickets"], s["top1"], s["top3"], s["rr"], s["miss"]) == (3, round(1 / 3, 6), round(2 / 3, 6), 0.5, 1)  # a missing prediction stays in the denominator


def test_recall_with_several_gold_files(spark):
    rows = _lists(spark, [("t", "candidate", 1, f, "f", "function", 0.5) for f in ("a/x.py", "b/y.py")] + [("t", "ranked", 1, "src/a/x.py", "f", "function", 0.5)])
    r = E.ticket_metrics(E.gold_files(rows), E.ranked_files(rows, "ranked")).head()
    assert (r["recall"], r["outcome"]) == (0.5, "partial")


def test_symbol_match_exact_and_relaxed(spark):
    rows = _lists(spark, [("t", "candidate", 1, "a.py", "C.f", "method", 0.5), ("t", "ranked", 1, "b.py", "D.f", "method", 0.9), ("t", "ranked", 2, "a.py", "C.f", "method", 0.8)])
    r = E.symbol_matches(*E.symbol_ranks(rows)).head()
    assert (r["exact_rank"], r["relaxed_rank"]) == (2, 1)


def test_bootstrap_of_equal_deltas(spark):
    d = spark.createDataFrame([(f"t{i}", "hit", 0.25) for i in range(9)], "ticket_id string, metric string, delta double")
    r = E.bootstrap(d, 40, 1).head()
    assert (r["n"], r["mean"], r["low"], r["high"]) == (9, 0.25, 0.25, 0.25)


CHUNKS = "repo string, base_commit string, chunk_id string, file_path string, language string, symbol_kind string, function_name string, class_name string, start_line int, end_line int, code_text string"


def _corpus(spark):
    chunks = spark.createDataFrame([
        ("o/r", "c1", "k1", "src/cache.py", "python", "function", "evict_cache", "", 1, 9, "def evict_cache(): pass"),
        ("o/r", "c1", "k2", "src/cache.py", "python", "function", "fill", "", 5, 12, "def fill(): evict_cache()"),
        ("o/r", "c1", "k3", "src/net/socket.py", "python", "class", "", "Socket", 1, 30, "class Socket: pass"),
        ("o/r", "c1", "k1", "src/cache.py", "python", "function", "evict_cache", "", 1, 9, "def evict_cache(): pass"),
    ], CHUNKS)
    tickets = spark.createDataFrame([("t1", "evict_cache loses rows", None, None, None, None, 'File "src/cache.py", line 3', "o/r", "c1")], "ticket_id string, title string, description string, component string, product string, severity string, error_message string, repo string, base_commit string")
    return tickets, chunks


def test_tfidf_ranks_the_named_chunk_first(spark):
    tickets, chunks = _corpus(spark)
    scored = RT.tfidf(tickets, chunks).join(RT.order_columns(chunks), [*RT.SNAPSHOT, "chunk_id"])
    assert RT.ranked(scored, "cosine", 1).head()["chunk_id"] == "k1"


def test_trace_scores(spark):
    tickets, chunks = _corpus(spark)
    assert {r["chunk_id"]: r["trace"] for r in RT.trace_scores(tickets, chunks).collect()} == {"k1": 0.75, "k2": 0.55}


def test_independent_evidence_skips_overlaps(spark):
    s = spark.createDataFrame([("t", "f", "a", 0.9, 0, 9, 1, 10), ("t", "f", "b", 0.8, 0, 9, 4, 12), ("t", "f", "c", 0.7, 0, 9, 20, 29)], "ticket_id string, file_path string, chunk_id string, score double, kind_rank int, span int, start_line int, end_line int")
    assert [(r["chunk_id"], r["pick"]) for r in RT.independent_evidence(s).orderBy("pick").collect()] == [("a", 1), ("c", 2)]


def test_lookup_prefers_exact_and_skips_spread_names(spark):
    names = spark.createDataFrame([("t", "r", "c", "pkg.run"), ("t", "r", "c", "x.halt")], "ticket_id string, repo string, base_commit string, symbol string")
    keys = spark.createDataFrame([("r", "c", "pkg.run", "a.py"), ("r", "c", "run", "b.py"), *[("r", "c", "halt", f"h{i}.py") for i in range(5)]], "repo string, base_commit string, lookup_key string, file_path string")
    assert [tuple(r) for r in R.lookup_fallback(names, keys).collect()] == [("t", "a.py", 0.06, 1)]


def test_one_hop_skips_hubs(spark):
    ranked = spark.createDataFrame([("t", "r", "c", "a", 1), ("t", "r", "c", "hub", 2)], "ticket_id string, repo string, base_commit string, file_path string, rank int")
    edges = spark.createDataFrame([("r", "c", "a", "b", "f"), *[("r", "c", "hub", f"x{i}", "g") for i in range(9)]], "repo string, base_commit string, caller_file string, target_file string, call_name string")
    assert [tuple(r) for r in R.one_hop(ranked, edges).collect()] == [("t", "b", 0.9, 0.072)]


def test_innermost_and_ties(spark):
    i = spark.createDataFrame([("f", "class", 1, 200), ("f", "m1", 60, 70), ("f", "m2", 60, 70)], "key string, name string, start_line int, end_line int")
    p = spark.createDataFrame([("f", 65), ("f", 150), ("f", 300)], "key string, line int")
    assert sorted(tuple(r) for r in R.innermost(p, i).collect()) == [("f", 65, "m1", 2), ("f", 150, "class", 1)]


def test_line_windows_and_gaps(spark):
    text = "\n".join(str(k) for k in range(1, 151))
    w = R.line_windows(spark.createDataFrame([("r", "c", "f", text)], "repo string, base_commit string, file_path string, content string"))
    assert sorted((r["start_line"], r["end_line"]) for r in w.collect()) == [(1, 80), (61, 140), (121, 150)]
    _, chunks = _corpus(spark)
    assert R.gaps(chunks.filter("chunk_id <> 'k2'").withColumn("start_line", F.col("start_line") + 3).withColumn("end_line", F.col("end_line") + 3)).count() == 2


def test_largest_remainder_sums_to_target(spark):
    c = spark.createDataFrame([("a", 10), ("b", 10), ("c", 1)], "k string, n bigint")
    assert sorted((r["k"], r["seats"]) for r in R.largest_remainder(c, "k", "n", 5).collect()) == [("a", 2), ("b", 3), ("c", 0)]


def test_blend_falls_back_per_ticket(spark):
    x = spark.createDataFrame([("a", "i", 1, 0.5, 1.0), ("b", "i", 1, 0.5, 1.5), ("b", "j", 2, 0.4, 0.4)], "ticket_id string, item string, rank int, retrieval double, reviewed double")
    assert {(r["ticket_id"], r["item"]): r["blend"] for r in PL.blended(x).collect()} == {("a", "i"): 0.65, ("b", "i"): 0.5, ("b", "j"): 0.4}


def test_python_symbols():
    status, rows = S.python_symbols("import x\n@dec\ndef f():\n    def g(): pass\nclass C:\n    async def m(self): pass\n")
    assert status == "ok"
    assert [(k, n, a, b) for k, n, a, b, _, _ in rows] == [("function", "f", 2, 4), ("function", "f.<locals>.g", 4, 4), ("class", "C", 5, 6), ("async_method", "C.m", 6, 6)]
    assert S.python_symbols("def (")[0] == "syntax_error" and S.python_symbols("x = 1")[0] == "no_symbols"


def test_imports_calls_and_links(spark):
    files = spark.createDataFrame([
        ("r", "c", "pkg/__init__.py", "from pkg.core import run\n"),
        ("r", "c", "pkg/core.py", "def run():\n    return helper()\ndef helper():\n    return 1\n"),
        ("r", "c", "app.py", "from pkg.core import run\ndef go():\n    return run()\n"),
        ("r", "c", "bad.py", "from pkg.core import run\ndef (:\n"),
    ], "repo string, base_commit string, file_path string, content string")
    found = S.facts(files)
    edges = {(r["src_file"], r["dst_file"]) for r in S.import_edges(found, files).collect()}
    assert edges == {("pkg/__init__.py", "pkg/core.py"), ("app.py", "pkg/core.py"), ("bad.py", "pkg/core.py")}
    calls = {(r["caller_file"], r["caller"], r["target_file"], r["target"], r["resolution"]) for r in S.resolved_calls(found, S.symbols(files)).collect()}
    assert ("pkg/core.py", "run", "pkg/core.py", "helper", "local") in calls and ("app.py", "go", "pkg/core.py", "run", "imported") in calls
    links = {(r["public"], r["implementation"], r["link"]) for r in S.api_links(found).collect()}
    assert ("run", "pkg.core.run", "reexport") in links and ("go", "run", "wrapper") in links


def test_declarations_end_with_their_block(spark):
    text = "function a() {\n  if (x) {\n  }\n}\nclass B {\n  m() { }\n}\n"
    d = S.declarations(spark.createDataFrame([("r", "c", "f.js", text)], "repo string, base_commit string, file_path string, content string"))
    assert {(r["name"], r["line"], r["end_line"]) for r in d.collect()} == {("a", 1, 4), ("B", 5, 7)}


def test_hunks():
    text = "--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,3 @@\n a\n-b\n+c\n d\n@@ -9,0 +10 @@\n+z\n@@ -20,2 +21,2 @@\n q\n"
    h = S.hunks(text)
    assert [(x[2], x[4], x[5], x[8], x[9], x[10], x[11]) for x in h] == [("modified", 1, 3, [2], [2], [3], True), ("modified", 9, 0, [], [10], [9], True), ("modified", 20, 2, [], [], [], False)]


def test_incremental_and_gates(spark):
    schema = "repo string, base_commit string, file_path string, content string"
    old, new = spark.createDataFrame([("r", "c", "a", "1"), ("r", "c", "b", "1"), ("r", "c", "d", "1")], schema), spark.createDataFrame([("r", "c", "a", "1"), ("r", "c", "b", "2"), ("r", "c", "e", "1")], schema)
    assert {r["file_path"]: r["action"] for r in PL.incremental(old, new).collect()} == {"a": "reuse", "b": "rebuild", "d": "drop", "e": "rebuild"}
    g = {r["check"]: r["passed"] for r in PL.gates([("none", old.filter("false")), ("some", old)]).collect()}
    assert g == {"none": True, "some": False}


def test_record_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\n\n{"id": "2"}\n')
    (tmp_path / "b.json").write_text(json.dumps({"records": [{"id": "3"}]}))
    (tmp_path / "c.json").write_text(json.dumps([{"id": "4"}]))
    got = [r["id"] for n in ("a.jsonl", "b.json", "c.json") for r in SF.read_records(spark, f"{tmp_path}/{n}", "id string").collect()]
    assert sorted(got) == ["1", "2", "3", "4"]
    (tmp_path / "d.csv").write_text("﻿id,name\n1,x\n", encoding="utf-8")
    assert SF.read_csv(spark, f"{tmp_path}/d.csv", ["id"]).head()["id"] == "1"
    with pytest.raises(ValueError):
        SF.read_csv(spark, f"{tmp_path}/d.csv", ["missing"])
    SF.write_once(spark.range(3), f"{tmp_path}/once")
    with pytest.raises(Exception):  # noqa: B017
        SF.write_once(spark.range(3), f"{tmp_path}/once")
    with pytest.raises(ValueError):
        SF.size_map(spark, {"a": ["r"], "b": ["r"]})
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "m.py").write_text("x = 1\n")
    (tmp_path / "src" / "m.txt").write_text("no")
    assert [r["file_path"] for r in SF.snapshot_files(spark, f"{tmp_path}/src").collect()] == ["m.py"]


def test_resumed_stream_keeps_each_key_once(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    data = spark.createDataFrame([(1, day), (2, day), (2, day), (None, day)], "id int, ts timestamp")
    data.write.parquet(f"{tmp_path}/in")
    for turn in ("p1", "p2"):
        resume.append_once(spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in"), "id", f"{tmp_path}/out", f"{tmp_path}/{turn}").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]


def test_gate_and_validation(spark):
    t = spark.createDataFrame([("a", None, None, None, None, None, None), ("b", "x" * 90 + " src/a.py", None, None, None, None, None)], "ticket_id string, title string, description string, component string, product string, severity string, error_message string")
    g = {r["ticket_id"]: r["status"] for r in P.gated_input(t).collect()}
    assert g == {"a": "error", "b": "ok"}


def test_nearest_rank_with_equal_values(spark):
    x = spark.createDataFrame([("a", 1.0)] * 60 + [("a", 2.0)] * 39 + [("a", 9.0), ("a", None), ("b", 5.0)], "g string, v double")
    got = {r["g"]: (r["n"], r["p50"], r["p95"], r["p100"]) for r in R.nearest_rank(x, "g", "v", {"p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()}
    assert got == {"a": (100, 1.0, 2.0, 9.0), "b": (1, 5.0, 5.0, 5.0)}


def test_package_proximity_takes_the_largest_neighbour(spark):
    f = spark.createDataFrame([("t", "a/b/x.py", 1), ("t", "a/b/y.py", 2), ("t", "a/c/z.py", 3), ("t", "q.py", 4)], "ticket_id string, file_path string, rank int")
    assert {(r["file_path"], r["depth"], r["neighbour"]) for r in RT.package_proximity(f).collect()} == {("a/b/x.py", 2, "a/b/y.py"), ("a/b/y.py", 2, "a/b/x.py"), ("a/c/z.py", 1, "a/b/y.py")}


def test_nearest_disjoint_interval(spark):
    i = spark.createDataFrame([("f", "a", 1, 5), ("f", "b", 10, 20), ("f", "c", 12, 14), ("f", "d", 200, 210)], "key string, name string, start_line int, end_line int")
    assert {(r["name"], r["neighbour"], r["gap"]) for r in R.nearest_disjoint(i).collect()} == {("a", "b", 5), ("b", "a", 5), ("c", "a", 7)}


def test_nearest_disjoint_against_brute_force(spark):
    import random

    r = random.Random(1)
    data = [(f"f{k % 5}", f"n{k}", a := r.randint(1, 400), a + r.choice([0, 3, 30])) for k in range(150)]
    want = {}
    for key, name, a, b in data:
        near = [(max(c - b, a - e), other) for k2, other, c, e in data if k2 == key and other != name and 1 <= max(c - b, a - e) <= 100]
        if near:
            want[name] = min(near)
    got = {x["name"]: (x["gap"], x["neighbour"]) for x in R.nearest_disjoint(spark.createDataFrame(data, "key string, name string, start_line int, end_line int")).collect()}
    assert got == want


def test_bootstrap_interval_against_resampling(spark):
    import numpy as np

    values = np.random.default_rng(3).choice([-1.0, 0.0, 0.0, 1.0, 0.5], 400)
    df = spark.createDataFrame([(f"t{k}", m, float(v)) for k, v in enumerate(values) for m in ("hit", "recall")] + [("x", "hit", None)], "ticket_id string, metric string, delta double")
    got = {r["metric"]: r for r in E.bootstrap(df, 2000, 5).collect()}
    means = np.sort(np.random.default_rng(4).choice(values, (20000, 400)).mean(1))
    for r in got.values():
        assert r["n"] == 400 and abs(r["mean"] - values.mean()) < 1e-6
        assert abs(r["low"] - means[500]) < 0.02 and abs(r["high"] - means[19500]) < 0.02
    assert E.bootstrap(df.filter("false"), 2000, 5).count() == 0


def test_dense_neighbours_against_brute_force(spark):
    import numpy as np

    v = np.random.default_rng(2).normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(300)] + [(999, None)], "vec_id bigint, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in RT.dense_neighbours(df, 3, block=64).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (0, 100, 200):
        c = np.round(u @ u[q], 6)
        want = [i for i in np.lexsort((np.arange(300), -c)) if i != q][:3]
        assert [got[q, k] for k in (1, 2, 3)] == want


def test_audit_sample_covers_strata(spark):
    from trawl.operators import selection as SL

    x = spark.createDataFrame([(f"i{k}", "big" if k else "small") for k in range(50)], "item string, s string")
    got = SL.audit_sample(x, "s", "item", 1, 6, 3).collect()
    assert len(got) == 6 and sum(r["reason"] == "stratum" for r in got) == 2
