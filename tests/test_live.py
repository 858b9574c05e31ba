from driftwood.config import Config
from driftwood.operators import inventory, stats
from driftwood.sources.lines import read_text
from driftwood.streaming.live import LiveTail, gaps, merged, with_epochs


def test_gaps_and_merge(spark):
    seqs = spark.createDataFrame([("s", 0, i, str(i)) for i in (1, 2, 5, 6, 10)], "source string, epoch int, seq bigint, text string")
    assert sorted((r["seq"], r["missing"]) for r in gaps(seqs).collect()) == [(5, 2), (10, 3)]
    both = merged(seqs.where("seq < 6"), seqs.where("seq > 2"))
    assert sorted(r["seq"] for r in both.collect()) == [1, 2, 5, 6, 10]


def test_live_tail_of_files_equals_a_batch(spark, tmp_path):
    inputs = tmp_path / "in"
    inputs.mkdir()
    tail = LiveTail(spark, str(inputs), str(tmp_path / "table"), str(tmp_path / "check"), Config(retention=3))
    assert tail.lines() is None
    text = "2026-08-08T17:42:01Z ERROR x\r\n  at a\n\n2026-08-08T17:42:02Z caf\xe9\nlast"
    for name in ("a.log", "b.log"):
        (inputs / name).write_bytes(text.encode("latin-1"))
        tail.start(availableNow=True).awaitTermination(120)
    columns = ["source", "ordinal", "text", "used_fallback"]
    batch = read_text(spark, str(inputs))
    got, want = (sorted(tuple(r) for r in df.select(*columns).collect()) for df in (tail.lines(), batch))
    assert got == want and len(want) == 10 and ("2026-08-08T17:42:01Z ERROR x" in {r[2] for r in want})
    assert [r[2] for r in want if r[3]] == ["2026-08-08T17:42:02Z café"] * 2
    kept = tail.entries("plain").collect()
    assert sorted(r["ordinal"] for r in kept) == [4, 4, 5, 5]


def test_a_producer_that_begins_anew_counts_again(spark):
    rows = [("s", 1, 0, n) for n in (1, 2, 3, 4)]  # first connection
    rows += [("s", 2, 5, n) for n in (3, 4, 5, 6)]  # back again: 3 and 4 are known
    rows += [("s", 3, 2, n) for n in (1, 2, 3, 7, 8)]  # names 2 after 6: a new run
    rows += [("s", 4, 8, n) for n in (8, 9)] + [("t", 4, 0, 1)]
    lines = spark.createDataFrame(rows, "source string, session int, announced bigint, seq bigint")
    found = with_epochs(lines).select("source", "epoch", "seq")
    once = merged(found.limit(0), found).collect()
    assert sorted(map(tuple, once)) == [*(("s", 0, n) for n in range(1, 7)), *(("s", 1, n) for n in (1, 2, 3, 7, 8, 9)), ("t", 0, 1)]
    assert with_epochs(lines.limit(0)).count() == 0


def test_live_formats_hold_and_diagnostics_stay(spark, tmp_path):
    inputs, tail = tmp_path / "in", None
    inputs.mkdir()
    tail = LiveTail(spark, str(inputs), str(tmp_path / "table"), str(tmp_path / "check"), Config(retention=2))
    texts = {"a": '{"level":"error","user":1}\n{"broken\n{"level":"info","user":2}\n', "b": "user=5 kind=view level=warn\n", "c": "\n\n"}
    texts["a"] += '{"level":"info","user":3}\n' * 8
    for name, text in texts.items():
        (inputs / f"{name}.log").write_text(text)
        tail.start(availableNow=True).awaitTermination(120)
    settled = {r["source"][-5:]: r["format"] for r in tail.formats().collect()}
    assert settled == {"a.log": "json", "b.log": "logfmt"}  # blank lines settle nothing
    # what comes later is read by the format that was settled, whatever it looks like
    one, batch = tail.lines().where("source LIKE '%a.log'").select("source").head()[0], 7
    prose = spark.createDataFrame([(one, n, "some prose") for n in range(12, 40)], "source string, ordinal bigint, text string")
    prose.selectExpr("*", "false AS used_fallback", "current_timestamp() AS arrived").write.parquet(f"{tail.table}/batch={batch}")
    tail._settle(spark.read.parquet(f"{tail.table}/batch={batch}"), batch)
    assert {r["source"][-5:]: r["format"] for r in tail.formats().collect()} == settled
    whole = tail.whole()
    assert {r["reason"]: r["n"] for r in stats.diagnostic_counts(whole).collect()} == {"invalid_json": 29}
    assert {(r["value"], r["n"]) for r in inventory.inventory(whole.entries).where("field = 'user'").collect()} == {("1", 1), ("2", 1), ("3", 8), ("5", 1)}
    # levels are counted over what is retained: of the first source only prose is
    assert [(r["level"], r["n"]) for r in inventory.level_counts(tail.entries()).where("n > 0").collect()] == [("WARN", 1)]


def test_ordinals_do_not_depend_on_splits(spark, tmp_path):
    path = tmp_path / "big.log"
    path.write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(1, 3001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        rows = read_text(spark, str(path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 3000 and all(r["text"].startswith(f"line {r['ordinal']} ") for r in rows)
