import random

import pytest

from driftwood.config import ENTRIES, Config
from driftwood.operators import inventory


def entries_of(spark, rows):
    """Entries of (source, ordinal, fields as text)."""
    found = spark.createDataFrame([(s, o, f) for s, o, f in rows], "source string, ordinal bigint, fields map<string,string>")
    return found.selectExpr("source", "ordinal", "'INFO' AS level", "transform_values(fields, (k, v) -> named_struct('kind', 'string', 'value', v)) AS fields")


def by_hand(rows, cap):
    """Lines in order: values are counted until one too many comes up."""
    seen = {}
    for source, _, fields in sorted(rows, key=lambda r: r[:2]):
        for field, value in fields.items():
            at = seen.setdefault((source, field), {"lines": 0, "values": {}, "high": False})
            at["lines"] += 1
            if not at["high"] and value not in at["values"] and len(at["values"]) == cap:
                at["high"] = True
            if not at["high"]:
                at["values"][value] = at["values"].get(value, 0) + 1
    return sorted((s, f, v, n, at["lines"], at["high"]) for (s, f), at in seen.items() for v, n in at["values"].items())


@pytest.mark.parametrize("cap, held", [(5, 3), (20, 1000), (400, 50)])
def test_values_before_the_cut(spark, monkeypatch, cap, held):
    monkeypatch.setattr(inventory, "HELD", held)
    rng = random.Random(cap)
    rows = []
    for i in range(1, 1500):
        fields = {"level2": rng.choice("abc"), "user": str(int(rng.expovariate(0.1)))}
        if rng.random() < 0.7:
            fields["id"] = f"é{i}"
        if i > 1200:
            fields["late"] = rng.choice(["", str(i // 40)])
        rows.append((rng.choice(["s", "t"]), i, fields))
    shuffled = rows[:]
    rng.shuffle(shuffled)  # tasks see lines in no order
    frame = entries_of(spark, shuffled).repartition(7)
    found = inventory.inventory(frame, Config(value_cap=cap))
    assert sorted(map(tuple, found.collect())) == by_hand(rows, cap)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan  # values are not ranked
    assert inventory.inventory(frame.limit(0)).count() == 0


def test_ids_beyond_the_default_cap(spark):
    """Of a column of ids no task gets more than its share of what summaries hold."""
    rows = spark.range(1, 60_001, 1, 8).selectExpr("'s' AS source", "id AS ordinal", "'INFO' AS level", "map('id', named_struct('kind', 'string', 'value', concat('u', id))) AS fields")
    found = inventory.inventory(rows, Config()).collect()
    assert len(found) == 10_000 and {(r["n"], r["count"], r["high_cardinality"]) for r in found} == {(1, 60_000, True)}
    assert {r["value"] for r in found} == {f"u{i}" for i in range(1, 10_001)}
    model = inventory.facet_model(rows).collect()
    assert [(r["field"], r["value"], r["typed"]) for r in model if r["field"] == "id"] == [("id", None, True)]


def test_entries_have_the_columns_that_inventories_need():
    assert {"source", "ordinal", "fields", "level"} <= {f.name for f in ENTRIES}
