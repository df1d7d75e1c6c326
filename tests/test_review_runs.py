"""Reviews of evidence and batch runs on small tables: nulls, repeated rows, ties, empty tables, refused inputs."""

import pytest
from pyspark.sql import functions as F

from trawl.operators import review as V
from trawl.operators import runs as B

SNAP = "repo string, base_commit string"


def test_labels_of_evidence(spark):
    ev = spark.createDataFrame([("a", "f", "x.py", "exact"), ("a", "f", "x.py", "exact"), ("b", "f", "x.py", "exact"), ("b", "f", "./y.py", "leaf"), ("c", "g", "z.py", "leaf"), ("d", "g", "q.py", "exact")], "ticket_id string, symbol string, file_path string, match string")
    gold = V.gold_of(spark.createDataFrame([("a", "./x.py", "mapped"), ("b", "x.py", "mapped"), ("c", "q.py", "mapped"), ("c", "z.py", "excluded"), (None, "x.py", "mapped")], "ticket_id string, file_path string, mapping_status string"))
    ranked = spark.createDataFrame([("a", "x.py", 3), ("b", "y.py", 2)], "ticket_id string, file_path string, rank int")
    got = {r["ticket_id"]: (r["label"], r["files"], r["extra_files"], r["best_rank"]) for r in V.labelled_evidence(ev, gold, ranked).collect()}
    assert got == {"a": ("correct_mapping", 1, 0, 3), "b": ("overly_ambiguous", 2, 1, 2), "c": ("incorrect_mapping", 1, 1, None), "d": ("incorrect_mapping", 1, 1, None)}
    assert V.labelled_evidence(ev.filter("false"), gold, ranked).count() == 0


def test_lookup_takes_leaves_only_of_names_without_exact_hit(spark):
    names = spark.createDataFrame([("t", "r", "c", "a.run"), ("t", "r", "c", "b.stop"), ("t", "r", "c", "many"), ("t", "r", "c", "none")], f"ticket_id string, {SNAP}, symbol string")
    keys = spark.createDataFrame([("r", "c", "a.run", "1.py"), ("r", "c", "run", "2.py"), ("r", "c", "stop", "3.py"), *[("r", "c", "many", f"{k}.py") for k in range(5)]], f"{SNAP}, lookup_key string, file_path string")
    found, rejected = V.lookup_evidence(names, keys)
    assert {(r["symbol"], r["file_path"], r["match"]) for r in found.collect()} == {("a.run", "1.py", "exact"), ("b.stop", "3.py", "leaf")}
    assert [r["symbol"] for r in rejected.collect()] == ["many"]
    assert [tuple(r) for r in V.expansion_diagnostics(names, found, rejected).collect()] == [("t", 4, 2, 1, 1, 2, "a.run=1.py b.stop=3.py")]


def test_the_first_name_of_a_report_decides(spark):
    names = spark.createDataFrame([("t", "r", "c", 1, "evict"), ("t", "r", "c", 0, "cache.evict"), ("t", "r", "c", 2, "other")], f"ticket_id string, {SNAP}, at int, symbol string")
    chunks = spark.createDataFrame([("r", "c", "k", "Cache", "evict"), ("r", "c", "m", "", "evict"), ("r", "c", "n", None, None)], f"{SNAP}, chunk_id string, class_name string, function_name string")
    assert {(r["chunk_id"], r["name"]) for r in V.exact_names(names, chunks).collect()} == {("k", "cache.evict"), ("m", "evict")}


def test_calls_are_evidence_once(spark):
    row = ("t", "a.py", 1, "b.py", "go")
    ev = spark.createDataFrame([row, row, ("t", "a.py", 1, "c.py", "go")], "ticket_id string, reference_file string, reference_rank int, target_file string, call_name string")
    gold = spark.createDataFrame([("t", "b.py")], "ticket_id string, gold_file string")
    got = V.call_evidence(ev, gold).collect()
    assert len(got) == 2 == len({r["evidence_id"] for r in got}) and {(r["target_file"], r["target_is_gold"], r["hint"]) for r in got} == {("b.py", True, "correct_mapping"), ("c.py", False, "unreviewed")}


def test_decisions_replace_labels_or_are_issues(spark):
    cases = spark.createDataFrame([(x, "incorrect_mapping") for x in "abcde"], "ticket_id string, label string")
    said = spark.createDataFrame([("a", "correct_mapping", " seen "), ("b", "correct_mapping", " "), ("c", "nonsense", "x"), ("d", "correct_mapping", "x"), ("d", "overly_ambiguous", "y"), (None, "correct_mapping", "x")], "ticket_id string, label string, reason string")
    final, issues = V.decided(cases, said)
    assert {tuple(r) for r in final.collect()} == {("a", "correct_mapping", True, "seen"), *[(x, "incorrect_mapping", False, "") for x in "bcde"]}
    assert {tuple(r) for r in issues.collect()} == {("b", "reason"), ("c", "label"), ("d", "several")}
    assert ("e", "missing") in {tuple(r) for r in V.decided(cases, said, require_all=True)[1].collect()}


def test_failure_stages_in_their_order(spark):
    g = [("u", "q", "c", "a"), ("u", "r", "c", "a"), ("c", "r", "c", "gone"), ("c", "r", "c", "a"), ("m", "r", "c", "a"), ("m", "r", "c", "b"), ("r", "r", "c", "a"), ("k", "r", "c", "b"), ("ok", "r", "c", "b")]
    gold = spark.createDataFrame(g, f"ticket_id string, {SNAP}, gold_file string")
    final = spark.createDataFrame([("ok", "b", 1), ("k", "b", 21)], "ticket_id string, file_path string, rank int")
    first = spark.createDataFrame([("m", "b", 2), ("k", "b", 50), ("r", "a", 51)], "ticket_id string, file_path string, rank int")
    files = spark.createDataFrame([("r", "c", "a"), ("r", "c", "b")], f"{SNAP}, file_path string")
    got = {r["ticket_id"]: (r["missed"], r["stage"]) for r in V.failure_stages(gold, final, first, files, files).collect()}
    assert got == {"u": (2, "unavailable"), "c": (2, "coverage"), "m": (2, "mixed"), "r": (1, "retrieval"), "k": (1, "rerank")}


def test_unresolved_calls_and_reachability(spark):
    calls = spark.createDataFrame([("r", "c", "a.py", "x.Run"), ("r", "c", "a.py", "run"), ("r", "c", "b.py", "run")], f"{SNAP}, caller_file string, call_name string")
    solved = spark.createDataFrame([("r", "c", "a.py", "run")], f"{SNAP}, caller_file string, call_name string")
    wanted = spark.createDataFrame([("t", "r", "c", "a.py", "run"), ("t", "r", "c", "a.py", "run")], f"ticket_id string, {SNAP}, caller_file string, target_leaf string")
    assert [tuple(r) for r in V.unresolved_calls(calls, solved, wanted).collect()] == [("t", "run", "a.py", "x.Run")]
    edges = spark.createDataFrame([("r", "c", "p.py", "x.py"), ("r", "c", "y.py", "q.py")], f"{SNAP}, caller_file string, target_file string")
    targets = spark.createDataFrame([("t", "r", "c", f, "method") for f in ("x.py", "y.py", "z.py")], f"ticket_id string, {SNAP}, target_file string, kind string")
    ranked = spark.createDataFrame([("t", "p.py", 5), ("t", "q.py", 6)], "ticket_id string, file_path string, rank int")
    assert {(r["target_file"], r["reach"]) for r in V.reachability(targets, edges, ranked).collect()} == {("x.py", "prefix"), ("y.py", "outside"), ("z.py", "none")}


def test_gold_rows_and_features(spark):
    files = spark.createDataFrame([("t", "r", "c", f) for f in ("a", "b", "d")], f"ticket_id string, {SNAP}, file_path string")
    reports = spark.createDataFrame([("r", "c", "a", "ok"), ("r", "c", "b", "syntax_error")], f"{SNAP}, file_path string, status string")
    assert {(r["file_path"], r["mapping_status"], r["kind"], r["reason"]) for r in V.gold_rows(files, reports).collect()} == {("a", "mapped", "module", None), ("b", "excluded", None, "parser_failure"), ("d", "excluded", None, "missing_base_file")}
    hunks = spark.createDataFrame([(1, "a", "a", "modified", 2, 0), (1, "b", "b", "modified", 0, 1), (2, "", "n", "added", 3, 0), (3, "g", "", "deleted", 0, 2)], "doc_id bigint, old_file string, new_file string, change string, added int, deleted int")
    assert {tuple(r) for r in V.features(hunks).collect()} == {(1, "multi_file"), (1, "pure_addition"), (1, "deletion_evidence"), (3, "deletion_evidence"), (3, "deleted_file")}


def test_a_covering_sample(spark):
    rows = spark.createDataFrame([(f"i{k}", f"r{k % 9}", ["rare"] if k < 3 else ["common"] if k % 2 else []) for k in range(90)], "item string, repo string, strata array<string>")
    got = V.covering_sample(rows, {"rare": 2, "common": 4}, 12, 7, 5).collect()
    assert len(got) == 12 == len({r["item"] for r in got}) and len({r["repo"] for r in got}) >= 7
    assert sum(r["item"] in ("i0", "i1", "i2") for r in got) >= 2 and [r["place"] for r in sorted(got, key=lambda r: r["place"])] == list(range(1, 13))
    assert [tuple(r) for r in V.covering_sample(rows.union(rows), {"rare": 2, "common": 4}, 12, 7, 5).collect()] == [tuple(r) for r in got]
    with pytest.raises(ValueError, match="minimums"):
        V.covering_sample(rows, {"rare": 4}, 12, 1, 5)
    with pytest.raises(ValueError, match="repositories"):
        V.covering_sample(rows, {}, 12, 10, 5)


def test_contradictions_are_named(spark):
    df = spark.createDataFrame([("full", 1, 1, 2), ("miss", None, 0, 2), ("miss", 3, 1, 2), ("partial", None, 1, 2)], "outcome string, first_rank int, found int, gold int")
    issues = V.rank_issues(*[F.col(c) for c in df.columns])
    assert [r[0] for r in df.select(issues).collect()] == ["full_without_all", "", "miss_with_found", "found_without_rank"]
    assert df.limit(1).select(V.note(F.col("outcome"), F.col("gold") - F.col("found"), issues)).collect()[0][0] == "full: 1 missed; full_without_all"


def test_selection_in_order(spark):
    t = spark.createDataFrame([(f"t{k}",) for k in range(9)] + [(None,)], "ticket_id string")
    ids = t.filter("ticket_id <> 't3'")
    assert [r[0] for r in B.select_tickets(t, ids, 2, 3).collect()] == ["t2", "t4", "t5"]
    assert B.select_tickets(t).count() == 9 and B.select_tickets(t, offset=20).count() == 0


def test_batch_resumes_and_refuses_another_method(spark, tmp_path):
    t = spark.createDataFrame([(f"t{k}",) for k in range(6)] + [("t0",), (None,)], "ticket_id string")
    tried = []

    def rank(asked):
        tried.append(sorted(r[0] for r in asked.distinct().collect()))
        return asked.filter("ticket_id <> 't4'").distinct().withColumn("score", F.lit(1.0))

    method = B.method_id({"b": 1, "a": 2})
    assert method == B.method_id({"a": 2, "b": 1}) != B.method_id({"a": 2})
    B.run_batch(t.filter("ticket_id < 't3'"), rank, str(tmp_path), method)
    found, failed = B.run_batch(t, rank, str(tmp_path), method)
    assert tried == [["t0", "t1", "t2"], ["t3", "t4", "t5"]]
    assert sorted(r["ticket_id"] for r in found.collect()) == ["t0", "t1", "t2", "t3", "t5"] and [r["ticket_id"] for r in failed.collect()] == ["t4"]
    B.run_batch(t, rank, str(tmp_path), method)
    assert tried[-1] == []
    with pytest.raises(ValueError, match="another method"):
        B.run_batch(t, rank, str(tmp_path), "other")


def test_shards_merge_in_ticket_order(spark):
    rows = spark.createDataFrame([(0, "a", "m", 1), (1, "a", "m", 2), (1, "b", "m", 3)], "shard int, ticket_id string, method_id string, v int")
    order = spark.createDataFrame([("b", 1), ("a", 2), ("x", 3)], "ticket_id string, ordinal int")
    assert sorted((r["place"], r["ticket_id"], r["v"]) for r in B.merge_shards(rows, order).collect()) == [(1, "b", 3), (2, "a", 2)]
    with pytest.raises(ValueError, match="several methods"):
        B.merge_shards(rows.union(spark.createDataFrame([(2, "c", "n", 1)], rows.schema)), order)
    seen, conflicts = B.union_seen([spark.createDataFrame(x, "ticket_id string, repo string") for x in ([("a", "r"), ("b", "r"), (None, "r")], [("a", "s"), ("c", None)])])
    assert {tuple(r) for r in seen.collect()} == {("a", "s", 1), ("b", "r", 0), ("c", None, 1)} and [tuple(r) for r in conflicts.collect()] == [("a", 2)]


def test_memoised_rankings(spark, tmp_path):
    asked = spark.createDataFrame([("a", "r", "c", "t1", "x"), ("b", "r", "c", "t1", "y"), ("e", "r", "c", "t1", "z")], f"ticket_id string, {SNAP}, token string, report string")
    tried = []

    def compute(some):
        tried.append(sorted(r["ticket_id"] for r in some.collect()))
        return some.filter("ticket_id <> 'e'").select("ticket_id", "repo", "base_commit", F.lit("k").alias("chunk_id"))

    path = f"{tmp_path}/memo"
    B.memo_rankings(asked.filter("ticket_id <> 'b'"), compute, path)
    changed = asked.withColumn("report", F.when(F.col("ticket_id") == "a", "new").otherwise(F.col("report")))
    got = {r["ticket_id"]: (r["chunk_id"], r["reused"]) for r in B.memo_rankings(changed, compute, path).collect()}
    assert tried == [["a", "e"], ["a", "b"]] and got == {"a": ("k", False), "b": ("k", False), "e": (None, True)}


def test_states_of_blobs(spark):
    files = spark.createDataFrame([("r", "c", "a", "xy"), ("r", "c", "a", "x"), ("r", "c", "n", None)], f"{SNAP}, file_path string, content string")
    asked = spark.createDataFrame([("r", "c", "a"), ("r", "c", "n"), ("r", "c", "b"), ("r", "d", "a"), ("q", "c", "a")], f"{SNAP}, file_path string")
    assert {(r["repo"], r["base_commit"], r["file_path"]): (r["state"], r["bytes"]) for r in B.blobs(asked, files).collect()} == {("r", "c", "a"): ("found", 2), ("r", "c", "n"): ("missing_content", None), ("r", "c", "b"): ("missing_path", None), ("r", "d", "a"): ("missing_commit", None), ("q", "c", "a"): ("missing_repo", None)}


def test_expansion_in_both_directions(spark):
    edges = spark.createDataFrame([("r", "c", "a", "b"), ("r", "c", "z", "a"), ("r", "c", "a", "a"), ("r", "c", "f", "g")], f"{SNAP}, src_file string, dst_file string")
    ranked = spark.createDataFrame([("t", "r", "c", "a", 1), ("t", "r", "c", "f", 6)], f"ticket_id string, {SNAP}, file_path string, rank int")
    assert {(r["file_path"], r["signal"], r["bonus"]) for r in B.expanded(ranked, edges).collect()} == {("b", 0.8, 0.08), ("z", 0.65, 0.065)}


def test_api_names_lead_to_their_implementation(spark):
    names = spark.createDataFrame([("t", "r", "c", "pkg.Open"), ("t", "r", "c", "wide")], f"ticket_id string, {SNAP}, symbol string")
    links = spark.createDataFrame([("r", "c", "open", "core.do_open", "reexport"), ("r", "c", "open", "core.do_open", "wrapper"), ("r", "c", "wide", "everywhere", "wrapper")], f"{SNAP}, public string, implementation string, link string")
    keys = spark.createDataFrame([("r", "c", "do_open", "core.py"), *[("r", "c", "everywhere", f"{k}.py") for k in range(5)]], f"{SNAP}, lookup_key string, file_path string")
    assert [tuple(r) for r in B.api_expanded(names, links, keys).collect()] == [("t", "core.py", 0.05, 1)]


def test_files_are_cut_into_chunks(spark):
    text = "\n".join(["import a", "", "def f():", "    x", "", "", "def g():", "    y", "z = 1"])
    long = "\n".join(f"v{k} = {k}" for k in range(150)) + "\n"
    files = spark.createDataFrame([("r", "c", "a.py", text), ("r", "c", "b.py", long), ("r", "c", "e.py", ""), ("r", "c", "n.py", None), ("r", "c", "a.py", text)], f"{SNAP}, file_path string, content string")
    symbols = spark.createDataFrame([("r", "c", "a.py", "function", "f", 3, 4, True), ("r", "c", "a.py", "function", "g", 7, 8, True)], f"{SNAP}, file_path string, kind string, name string, start_line int, end_line int, outer boolean")
    got = sorted((r["file_path"], r["start_line"], r["end_line"], r["kind"]) for r in B.file_chunks(files, symbols).collect())
    assert got == [("a.py", 1, 2, "module"), ("a.py", 3, 4, "function"), ("a.py", 7, 8, "function"), ("a.py", 9, 9, "module"), ("b.py", 1, 80, "chunk"), ("b.py", 61, 140, "chunk"), ("b.py", 121, 150, "chunk")]


def test_modes_and_tokens(spark):
    assert B.mode("definition", B.EXPANSIONS)["leaf"] == 0.04
    with pytest.raises(ValueError, match="unknown mode"):
        B.mode("x", B.GRAPHS)
    files = spark.sql("SELECT 'r' AS repo, 'c' AS base_commit, 'a' AS file_path, 'x' AS content, TIMESTAMP_NTZ '2025-01-01 00:00:00' AS loaded_at")
    token = lambda df: df.collect()[0]["token"]
    one = token(B.source_token(files))
    assert one == token(B.source_token(files.union(files))) != token(B.source_token(files.withColumn("content", F.lit("xy"))))
    assert [r[0] for r in spark.createDataFrame([("a/b.py::C#m:3",), ("..x",)], "s string").select(B.plain_name(F.col("s"))).collect()] == ["c.m", "x"]
