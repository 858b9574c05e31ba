import pytest
from helpers import rows_of, parsed
from pyspark.sql import functions as F

from driftwood.config import Config
from driftwood.operators import inventory, search, stats, timeline
from driftwood.operators.search import QueryError, Search, compile_search, match_ranges, matching, split_facets
from driftwood.plans.spec import QuerySpec, parse_spec, unknown_fields

LOG = [
    '2026-08-08T17:42:01Z ERROR first service=api code=7',
    "  at a.Needle",
    "  at b",
    "2026-08-08T17:42:02Z INFO second service=web code=8",
    "",
    "prose with needle",
    "2026-08-08T17:42:05Z WARN third",
]


@pytest.fixture(scope="module")
def entries(spark):
    return parsed(spark, LOG).entries.cache()


def numbers(df):
    return sorted(r["ordinal"] for r in df.collect())


def test_events_are_shown_or_hidden_whole(entries):
    assert numbers(matching(entries, {}, Search("substring", "needle"))) == [1, 2, 3, 6]
    assert numbers(matching(entries, {"level": ["ERROR"]})) == [1, 2, 3]
    assert numbers(matching(entries, {"service": ["api", "web"], "code": ["8"]})) == [4]
    assert numbers(matching(entries, {"service": []})) == [1, 2, 3, 4, 6, 7]
    assert numbers(matching(entries, {"level": ["INFO"]}, Search("substring", "needle"))) == []
    assert numbers(matching(entries, {}, Search("regex", "N[e]+dle"))) == [1, 2, 3]
    # orphans are tested alone
    orphans = entries.where("ordinal > 1")
    assert numbers(matching(orphans, {}, Search("substring", "needle"))) == [2, 6]


def test_compile():
    assert compile_search("") == Search()
    assert compile_search("re:A+") == Search("regex", "A+")
    assert compile_search("\\re:X") == Search("substring", "re:x")
    with pytest.raises(QueryError):
        compile_search("re:(")
    assert split_facets("level=ERROR foo=1 bar service=a", {"level", "service"}) == ([("level", "ERROR")], "foo=1 bar service=a")
    assert split_facets("service=a ", {"service"}) == ([("service", "a")], "")
    assert search.parse_bound("2026-08-08T17:42:01") == search.parse_bound("2026-08-08T17:42:01Z") == 1786210921000
    assert search.parse_bound("x") is None and search.format_bound(1786210921005) == "2026-08-08T17:42:01.005"


def test_match_ranges(spark):
    df = spark.createDataFrame([("aXbxx",), (None,)], "t string")
    got = [[tuple(x) for x in r[0]] for r in df.select(match_ranges(F.col("t"), Search("substring", "x"))).collect()]
    assert got == [[(1, 2), (3, 4), (4, 5)], []]
    assert [tuple(x) for x in df.limit(1).select(match_ranges(F.col("t"), Search("regex", "x*"))).head()[0]] == [(3, 5)]


def test_counts_and_histogram(entries):
    c = stats.counts(entries, {}, Search("substring", "needle"), 1786210921000, 1786210922000).head()
    assert (c["total"], c["timestamped"], c["timestampless"], c["matching"], c["in_range"], c["shown"]) == (6, 3, 3, 4, 1, 1)
    rows = timeline.histogram(entries, 1786210921000, 1000, 4, {"level": ["ERROR", "INFO"]}).orderBy("bucket").collect()
    assert [(r["total"], r["matching"]) for r in rows] == [(1, 1), (1, 1), (0, 0), (0, 0)]
    assert timeline.full_span(entries).head()["n"] == 3
    assert timeline.layout(1786210921000, 1786210925000) == (1786210921000, 1000, 4)
    assert timeline.layout(1786210921000, 1786210925000, cover_tail=True)[2] == 5
    assert timeline.bucket_width_ms(0) == 1000 and timeline.bucket_width_ms(3_600_000) == 30_000
    assert timeline.bucket_width_ms(31_536_000_000 * 240) == 31_536_000_000 * 2


def test_robust_span(spark):
    stamps = [*range(1000, 201000, 1000), 0]
    df = spark.createDataFrame([(x,) for x in stamps], "ts_ms bigint")
    ordered = sorted(stamps)
    q1, q3 = ordered[len(ordered) // 4], ordered[min(len(ordered) - 1, 3 * len(ordered) // 4)]
    inside = [x for x in ordered if q1 - 1.5 * (q3 - q1) <= x <= q3 + 1.5 * (q3 - q1)]
    assert timeline.robust_span(df) == (inside[0], inside[-1], len(ordered) - len(inside))
    far = spark.createDataFrame([(x,) for x in [0, *[10**12 + i for i in range(200)]]], "ts_ms bigint")
    assert timeline.robust_span(far) == (10**12, 10**12 + 199, 1)
    assert timeline.robust_span(df.limit(0)) is None
    assert timeline.robust_span(spark.createDataFrame([(5,)], "ts_ms bigint")) == (5, 5, 0)


def test_inventory_with_cap(spark):
    lines = [f"k={v} j=1" for v in ["a", "b", "a", "c", "a", "d"]]
    found = parsed(spark, lines, "logfmt").entries
    got = {(r["field"], r["value"]): (r["n"], r["count"], r["high_cardinality"]) for r in inventory.inventory(found, Config(value_cap=2)).collect()}
    assert got == {("k", "a"): (2, 6, True), ("k", "b"): (1, 6, True), ("j", "1"): (6, 6, False)}
    model = {(r["field"], r["value"]): (r["n"], r["typed"]) for r in inventory.facet_model(found, {"level": ["WARN"]}, Config(list_cap=3)).collect()}
    assert model == {("k", None): (None, True), ("j", "1"): (6, False), ("level", "WARN"): (0, False)}


def test_accounting(spark):
    result = parsed(spark, ['{"a":1}', "", "x", "[]", '{"ts":"no"}'], "json")
    r = stats.accounting(result).head()
    assert (r["total_lines"], r["blank_lines"], r["entries"], r["malformed"], r["diagnostics"]) == (5, 1, 2, 2, 3)
    assert r["skip_ratio"] == 0.6 and r["severe"]
    assert [d["ordinal"] for d in stats.diagnostic_examples(result, 2).collect()] == [3, 4]


def test_tail(spark):
    df = spark.createDataFrame([("s", i) for i in range(1, 301) if i % 3], "source string, ordinal bigint")
    assert numbers(stats.tail(df, 50)) == [i for i in range(1, 301) if i % 3][-50:]
    assert len(numbers(stats.tail(df, 0))) == 1


def test_spec_round_trip():
    spec = QuerySpec((1.0, 2.5), {"level": ("ERROR", "WARN"), "a b": ("x=y&z",)}, "re:^a", "json", 60)
    assert parse_spec(spec.to_string()).spec == spec
    bad = parse_spec("#range=1&filter=x&zz=1&filter==v&q=t")
    assert bad.range_error and bad.malformed_filters == 2 and bad.unknown_keys == ("zz",) and bad.spec.query == "t"
    assert parse_spec("range=,5").spec.range_ms == (0.0, 5.0)
    assert unknown_fields(spec, {"b"}) == (QuerySpec((1.0, 2.5), {"level": ("ERROR", "WARN")}, "re:^a", "json", 60), ("a b",))
