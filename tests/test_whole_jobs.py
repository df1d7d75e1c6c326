"""Cases in which a query did less than its whole job."""

import pytest

from trawl.operators import pipeline as PL
from trawl.operators import relations as R
from trawl.operators import retrieval as RT

CHUNKS = "repo string, base_commit string, chunk_id string, file_path string, language string, symbol_kind string, function_name string, class_name string, start_line int, end_line int, code_text string"
TICKETS = "ticket_id string, title string, description string, component string, product string, severity string, error_message string, repo string, base_commit string"


def _tables(spark, tickets):
    chunks = spark.createDataFrame([
        ("o/r", "c1", "k1", "src/cache.py", "python", "function", "evict_cache", "", 1, 9, "def evict_cache(): pass"),
        ("o/r", "c1", "k2", "src/store.py", "python", "function", "fill_store", "", 5, 12, "def fill_store(): evict_cache()"),
    ], CHUNKS)
    return spark.createDataFrame(tickets, TICKETS), chunks


@pytest.mark.parametrize("repo", ["https://h.example/O/R", "O/R", "o/r.git", "o/r/"])
def test_any_spelling_of_a_repository_meets_its_chunks(spark, repo):
    tickets, chunks = _tables(spark, [("t", "`evict_cache` loses rows", None, "store", None, None, 'File "src/cache.py", line 3', repo, "C1")])
    assert "k1" in {r["chunk_id"] for r in RT.tfidf(tickets, chunks).collect()}
    assert {r["chunk_id"] for r in RT.trace_scores(tickets, chunks).collect()} == {"k1"}
    assert RT.path_signals(tickets, chunks).count() > 0
    assert {(r["repo"], r["base_commit"]) for r in R.report_symbols(tickets).collect()} == {("o/r", "c1")}


def test_spellings_count_as_one_repository(spark, tmp_path):
    from trawl.plans import relation_plans as RP

    tickets = [(f"t{i}", "x", None, None, None, None, None, repo, "c1") for i, repo in enumerate(("o/r", "O/R", "https://h.example/o/r.git"))]
    _tables(spark, tickets)[0].write.parquet(f"{tmp_path}/tickets.parquet")
    spark.createDataFrame([("t0", "train"), ("t1", "test"), ("t2", "test")], "ticket_id string, split_name string").write.parquet(f"{tmp_path}/ticket_outcomes.parquet")
    assert {(r["repo"], r["tickets"]) for r in RP.repository_totals(spark, str(tmp_path)).collect()} == {("o/r", 3), ("*", 3)}
    assert [tuple(r) for r in RP.leakage_counts(spark, str(tmp_path)).collect()] == [("o/r", 2, "test,train")]
    assert RP.anti_seen(spark, str(tmp_path)).count() == 0


def test_text_queries_read_the_whole_report(spark, tmp_path):
    from trawl.plans import text_plans as TP

    _tables(spark, [("t", "Boot", "load_cache breaks", "Shelf", None, None, "in FooBar", "o/r", "c1")])[0].write.parquet(f"{tmp_path}/tickets.parquet")
    assert {r["identifier"] for r in TP.report_identifiers(spark, str(tmp_path)).collect()} == {"error_message", "load_cache", "foobar"}
    assert TP.important_terms(spark, str(tmp_path)).head()["terms"] == "title boot description load_cache load cache breaks component shelf error_message message foobar foo bar"
    assert {r["token"] for r in TP.tokenize_terms(spark, str(tmp_path)).collect()} >= {"boot", "load_cache", "shelf", "foobar"}


def test_weighted_adds_the_identifier_signal(spark):
    tickets, chunks = _tables(spark, [("t", "evict_cache loses rows", None, None, None, None, None, "o/r", "c1")])
    rows = {r["chunk_id"]: r for r in RT.weighted(tickets, chunks).collect()}
    r = rows["k1"]
    assert r["identifier"] == 0.5
    assert r["score"] == pytest.approx(0.5 * r["cosine"] + 0.3 * r["trace"] + 0.05 * r["component"] + 0.08 * r["keyword"] + 0.07 * r["symbol"] + 0.12 * r["path"] + 0.07, abs=1e-7)


def test_pipeline_finds_a_file_that_only_the_trace_names(spark):
    tickets, chunks = _tables(spark, [("t", "fill_store", None, None, None, None, 'File "src/misc.py", line 3', "o/r", "c1"), ("blank", None, None, None, None, None, None, "o/r", "c1")])
    chunks = chunks.union(spark.createDataFrame([("o/r", "c1", "k3", "zz/misc.py", "python", "function", "q", "", 1, 9, "def q(): pass"), ("o/r", "c1", "k4", "src/other.py", "python", "function", "w", "", 1, 9, "fill_store store fill src line file")], CHUNKS))
    got = PL.localize(tickets, chunks, files=2, symbols=2).collect()
    assert {r["ticket_id"] for r in got} == {"t"} and {r["file_path"] for r in got} >= {"zz/misc.py"}
    assert {(r["level"], r["policy"]) for r in got} <= {("high", "allow_patch_suggestion"), ("medium", "manual_review_before_patch"), ("low", "block_patch_generation")}


def test_names_in_plain_prose_are_looked_up(spark):
    tickets, _ = _tables(spark, [("t", "evict_cache is slow", "run `fill` and halt (now)", None, None, None, "Socket.close broke " + " ".join(f"name_{i}" for i in range(30)), "o/r", "c1")])
    names = [r["symbol"] for r in R.report_symbols(tickets).collect()]
    assert {"fill", "halt", "evict_cache"} <= set(names) and len(names) == 20


def test_bootstrap_query_draws_ten_thousand_resamples(spark, tmp_path, monkeypatch):
    from trawl.plans import evaluation_plans as EP

    rows = [("t", n, 1, "a.py", "f", "function", 0.5) for n in ("candidate", "ranked", "retrieval")]
    spark.createDataFrame(rows, "ticket_id string, list_name string, rank int, file_path string, symbol_qualified_name string, symbol_kind string, score double").write.parquet(f"{tmp_path}/ranked_symbols.parquet")
    drawn = []
    monkeypatch.setattr(EP.E, "bootstrap", lambda deltas, samples, seed: drawn.append(samples))
    EP.bootstrap_ci(spark, str(tmp_path))
    assert drawn == [10_000]
