"""Slot selection: the bounded rows lead to the same choice as all rows."""

import random

import pytest

from trawl.operators import slots as S

ROWS = "ticket_id string, rank int, file_path string, name string, kind string, start_line int, end_line int, file_score double"


def _ticket(r, ticket, n):
    out = []
    for rank in range(1, n + 1):
        kind = r.choice(["module", "class", "method", "method", "function"])
        cls = r.choice(["A", "B", "C"])
        name = "<module>" if kind == "module" else cls if kind == "class" else f"{cls}.{r.choice(['__init__', 'f', 'g', 'h'])}{rank}" if kind == "method" else f"fn{rank}"
        a = r.randint(1, 500)
        out.append((ticket, rank, f"f{r.randint(0, 14)}.py", name, kind, a, a + r.choice([0, 5, 40]), round(r.random(), 2)))
    return out


@pytest.mark.parametrize("mode", S.MODES)
def test_selection_equals_the_choice_among_all_rows(spark, mode):
    r = random.Random(7)
    data = [x for t, n in (("a", 300), ("b", 40), ("c", 6), ("d", 7), ("e", 120)) for x in _ticket(r, t, n)]
    links = [(t, r.randint(1, 30), r.randint(1, n)) for t, n in (("a", 300), ("b", 40), ("e", 120)) for _ in range(60)]
    want = []
    for t in "abcde":
        rows = [x for x in data if x[0] == t]
        score = {}
        for x in rows:
            score[x[2]] = max(x[7], score.get(x[2], 0))
        place = {f: k for k, f in enumerate(sorted(score, key=lambda f: (-score[f], f)), 1)}
        items = [(x[1], x[2], x[3], x[4], x[5], x[6], place[x[2]]) for x in rows]
        want += [(t, n, x[0]) for n, x in enumerate(S.choose(items, 6, mode, {(a, b) for u, a, b in links if u == t}), 1)]
    got = S.select_symbols(spark.createDataFrame(data, ROWS), 6, mode, spark.createDataFrame(links, "ticket_id string, a int, b int"))
    assert sorted((x["ticket_id"], x["place"], x["rank"]) for x in got.collect()) == sorted(want)


def test_slots_of_each_mode():
    rows = [(1, "a", "A.x", "method", 10, 20, 1), (2, "a", "z", "function", 900, 901, 1), (3, "b", "q", "function", 1, 2, 2), (4, "c", "w", "function", 1, 2, 3), (5, "b", "<module>", "module", 1, 9, 2), (6, "a", "A.__init__", "method", 700, 720, 1), (7, "a", "n", "function", 22, 30, 1), (8, "c", "v", "function", 5, 6, 3)]
    ranks = lambda mode, k=4, links=(): [r[0] for r in S.choose(rows, k, mode, set(links))]
    assert ranks("global") == [1, 2, 3, 4]
    assert ranks("module-reserved") == [1, 2, 3, 5]
    assert ranks("family") == [1, 5, 6, 2] and ranks("source") == [1, 5, 7, 2] and ranks("call", links=[(8, 1)]) == [1, 5, 8, 2]
    assert ranks("family", k=8) == [1, 2, 3, 4, 5, 6, 7, 8]


def test_modes_are_checked(spark):
    empty = spark.createDataFrame([], ROWS)
    assert S.select_symbols(empty, 3, "family").count() == 0
    with pytest.raises(ValueError, match="unknown mode"):
        S.select_symbols(empty, 3, "best")
    with pytest.raises(ValueError, match="links"):
        S.select_symbols(empty, 3, "call")
