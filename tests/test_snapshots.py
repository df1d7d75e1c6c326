"""Scoring a snapshot at a time: same rows as the joins on terms, without their intermediate tables."""

import pytest
from pyspark.sql import functions as F

from trawl.operators import retrieval as RT
from trawl.operators import snapshots as SN

CHUNKS = "repo string, base_commit string, chunk_id string, file_path string, language string, symbol_kind string, function_name string, class_name string, start_line int, end_line int, code_text string"
TICKETS = "ticket_id string, title string, description string, component string, product string, severity string, error_message string, repo string, base_commit string"


@pytest.fixture
def tables(spark):
    chunks = [
        ("o/r", "c1", "k1", "src/cache.py", "python", "function", "evict_cache", "", 1, 9, "def evict_cache(): pass"),
        ("o/r", "c1", "k1", "src/cache.py", "python", "function", "evict_cache", "", 1, 9, "def evict_cache(): pass"),
        ("o/r", "c1", "k2", "src/store.py", "python", "class", "", "FillStore", 5, 12, "x1 = E12; self.FillStore.open() and HTTPServer"),
        ("o/r", "c1", "k3", "lib/deep/misc.py", "python", None, None, None, None, None, None),
        ("o/r", "c2", "k1", "src/cache.py", "python", "method", "evict", "Cache", 40, 30, "caches = evict(cache)"),
    ]
    tickets = [
        ("t1", "evict_cache loses rows", "caches of FillStore.open fail with E12", "store deep", None, None, 'File "src/cache.py", line 3', "https://h.example/O/R", "c1"),
        ("t1", "evict_cache", None, None, None, None, 'File "lib/store.py", line 30', "o/r", "C1"),
        ("t2", "nothing like it", None, "cache", None, None, "src/cache.py:60", "o/r", "c2"),
        ("t3", None, None, None, None, None, None, "o/r", "c9"),
    ]
    return spark.createDataFrame(tickets, TICKETS), spark.createDataFrame(chunks, CHUNKS)


def test_scores_of_files_write_no_table_of_terms(tables, rows, monkeypatch):
    joined = rows(RT.tfidf_joined(*tables).select("ticket_id", "base_commit", "chunk_id", "cosine"))
    monkeypatch.setattr(RT, "cut", lambda df, name, **o: pytest.fail(f"writes {name}"))
    assert rows(RT.tfidf(*tables).select("ticket_id", "base_commit", "chunk_id", "cosine")) == joined != []
    assert RT.file_scores(RT.tfidf_rows(*tables).withColumnRenamed("cosine", "score"), 20).count() > 0


def test_snapshots_too_large_for_a_task_have_the_same_scores(tables, rows, monkeypatch):
    columns = ["ticket_id", "base_commit", "chunk_id", "file_path", "span", "cosine"]
    small = rows(RT.tfidf_rows(*tables).select(columns))
    monkeypatch.setitem(SN.LARGEST, "chunks", 1)
    assert {r["base_commit"] for r in SN.too_large(*tables).collect()} == {"c1"}
    assert rows(RT.tfidf_rows(*tables).select(columns)) == small != []


@pytest.mark.parametrize("limit", [20_000, 1])
def test_all_signals_are_those_of_the_joins(tables, rows, monkeypatch, limit):
    columns = ["ticket_id", "base_commit", "chunk_id", "file_path", "cosine", "trace", "component", "keyword", "symbol", "path", "identifier", "score"]
    joined = rows(RT.weighted_joined(*tables).select(columns))
    monkeypatch.setitem(SN.LARGEST, "chunks", limit)
    assert rows(RT.weighted(*tables).select(columns)) == joined != []


def test_signals_of_reports_write_no_table_of_terms(tables, monkeypatch):
    monkeypatch.setattr(RT, "cut", lambda df, name, **o: pytest.fail(f"writes {name}"))
    files = RT.files_with_chunks(RT.weighted(*tables), "cosine").collect()
    assert files and all(x["a"] <= 0 for r in files for x in r["xs"])


#: Queries that share the scores, each with the tables that it writes on its way: of scores none but the one that is read several times.
WRITTEN = dict.fromkeys(("overlap_evidence", "tfidf_top20", "best_chunk_per_file", "package_proximity", "symbol_rank_b0", "tfidf_cosine"), {"large"}) | {"file_modes": {"large", "light"}}


@pytest.mark.parametrize("query", WRITTEN)
def test_queries_have_the_rows_of_their_sql_and_write_no_table_of_terms(spark, tables, tmp_path, monkeypatch, query):
    import __spark_entry__ as entry
    from trawl import storage

    duckdb = pytest.importorskip("duckdb")
    absent = ("priority", "bug_type", "version", "created_at")
    for name, df in zip(("tickets", "chunks"), tables, strict=True):
        df.withColumns({c: F.lit(None).cast("string") for c in absent if name == "tickets"}).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    written, new_path = set(), storage.new_path
    monkeypatch.setattr(storage, "new_path", lambda spark, name: written.add(name) or new_path(spark, name))
    found = entry.queries()[query](spark, str(tmp_path))
    expected = duckdb.sql(entry.oracle_sql()[query])
    assert found.columns == expected.columns
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected.fetchall(), key=repr) != []
    assert written == WRITTEN[query]


@pytest.mark.parametrize("limit", [20_000, 1])
def test_words_of_reports_and_paths_never_go_through_the_driver(spark, tables, tmp_path, monkeypatch, limit):
    import __spark_entry__ as entry
    from trawl import storage

    duckdb = pytest.importorskip("duckdb")
    tickets, chunks = tables
    paths = ["src\\win\\evict_cache.py", "./lib/store/deep.store.open", "lib/store.py\n", "src/store/", "nothing", "like/it", "", None]
    odd = spark.createDataFrame([("o/r", c, f"p{i}", p, *[None] * 7) for c in ("c1", "c2", None) for i, p in enumerate(paths)], CHUNKS)
    nobody = spark.createDataFrame([(None, "store of nobody", *[None] * 5, "o/r", "c1")], TICKETS)
    tickets = tickets.unionByName(nobody).withColumns({c: F.lit(None).cast("string") for c in ("priority", "bug_type", "version", "created_at")})
    for name, df in (("tickets", tickets), ("chunks", chunks.unionByName(odd))):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    written, new_path = set(), storage.new_path
    monkeypatch.setattr(storage, "new_path", lambda spark, name: written.add(name) or new_path(spark, name))
    monkeypatch.setitem(SN.LARGEST, "chunks", limit)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = entry.queries()["path_signal"](spark, str(tmp_path))
    expected = duckdb.sql(entry.oracle_sql()["path_signal"])
    assert found.columns == expected.columns
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected.fetchall(), key=repr) != []
    assert written == {"large"}
    if limit > 1:
        assert "FlatMapCoGroupsInArrow" in plan(found) and "Generate" not in plan(found) and "Broadcast" not in plan(found)
    # Rows as few as these are broadcast wherever a join leaves the choice to size checks.
    (joined := RT.path_joined(*[spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("tickets", "chunks")])).collect()
    assert "SortMergeJoin" in plan(joined) and "Broadcast" not in plan(joined)
