import random

import pytest
from helpers import lines_of, parsed

from driftwood.operators import view
from driftwood.operators.search import Search, compile_search


def test_folded_events(spark):
    texts = ["2026-06-03T09:15:27Z ERROR one", "  at a", "  at b", "2026-06-03T09:15:28Z INFO two", "2026-06-03T09:15:29Z ERROR three at", "  at c", "words"]
    entries = parsed(spark, texts).entries
    seen = lambda **more: sorted((r["ordinal"], r["lines"]) for r in view.collapsed(entries, **more).collect())
    assert seen() == [(1, 3), (4, 1), (5, 2), (7, 1)]
    # a hit in a further line's message opens its event, one in the first line does not
    assert seen(search=Search("substring", "at b")) == [(1, 3), (2, 1), (3, 1)]
    assert seen(search=compile_search("re:three")) == [(5, 2)]
    assert seen(search=compile_search("re:x*|three")) == [(1, 3), (4, 1), (5, 2), (7, 1)]
    opened = spark.createDataFrame([("s", 5)], "source string, ordinal bigint")
    assert seen(expanded=opened) == [(1, 3), (4, 1), (5, 2), (6, 1), (7, 1)]
    assert seen(facets={"level": ["INFO"]}) == [(4, 1)]
    # lines whose first line is gone are rows by themselves
    gone = view.collapsed(entries.where("ordinal != 1").drop("event", "chained"))
    assert sorted((r["ordinal"], r["lines"]) for r in gone.collect()) == [(2, 1), (3, 1), (4, 1), (5, 2), (7, 1)]


@pytest.mark.parametrize("first, n", [(0, 7), (95, 40), (290, 50), (400, 5), (120, 0)])
def test_rows_by_place(spark, monkeypatch, first, n):
    monkeypatch.setattr(view, "BLOCK", 16)
    rng = random.Random(1)
    rows = [(s, i) for s in ("b", "a", "c") for i in range(1, 300) if rng.random() < 0.37]
    frame = spark.createDataFrame(rows, "source string, ordinal bigint").repartition(5)
    got = view.viewport(frame, first, n).collect()
    assert [(r["source"], r["ordinal"]) for r in got] == sorted(rows)[first : first + n] and [r["position"] for r in got] == list(range(first, first + len(got)))
    assert view.viewport(lines_of(spark, []).select("source", "ordinal"), 0, 5).count() == 0
