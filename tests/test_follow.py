import io
import random

import pytest
from helpers import REFERENCE, lines_of

from driftwood.config import Config
from driftwood.operators.parse import parse
from driftwood.streaming import follow as growing
from driftwood.streaming.events import linked_stream
from driftwood.streaming.live import LiveTail


def test_lines_of_any_shares():
    rng = random.Random(1)
    data = b"".join(bytes(rng.choices(b"ab\n\xff", k=rng.randint(0, 9))) + b"\n" * rng.randint(0, 2) for _ in range(60)) + b"unfinished"
    for _ in range(50):
        cuts = sorted({0, len(data), *(rng.randrange(len(data)) for _ in range(rng.randint(0, 8)))})
        file = io.BytesIO(data)
        found = [line for a, b in zip(cuts, cuts[1:]) for line in growing.lines_in(file, a, b)]
        assert found == data.split(b"\n")[:-1]


def test_a_line_begins_far_back(monkeypatch):
    monkeypatch.setattr(growing, "BACK", 7)
    data = b"one\n" + b"x" * 100 + b"\nlast\n"
    assert list(growing.lines_in(io.BytesIO(data), 60, 107)) == [b"x" * 100]


def test_a_growing_file_is_read_once(spark, tmp_path):
    """Appended lines arrive once, over restarts; an unfinished line waits for its end; a
    file that was cut is read anew."""
    inputs = tmp_path / "in"
    inputs.mkdir()
    one, two = inputs / "a.log", inputs / "b.log"

    def look():
        LiveTail(spark, str(inputs), str(tmp_path / "table"), str(tmp_path / "check"), Config(), growing=True).start(availableNow=True).awaitTermination(120)

    def seen():
        rows = LiveTail(spark, str(inputs), str(tmp_path / "table"), str(tmp_path / "check")).lines().collect()
        return {name: [r["text"] for r in sorted(rows, key=lambda r: r["ordinal"]) if r["source"].endswith(name)] for name in ("a.log", "b.log")}

    one.write_bytes(b"2026-08-08T17:42:01Z ERROR x\r\n  at a\n  at")
    look()
    assert seen()["a.log"] == ["2026-08-08T17:42:01Z ERROR x", "  at a"]
    with one.open("ab") as f:
        f.write(b" b\n\nnext caf\xe9")
    two.write_bytes(b"first\n")
    look()
    assert seen() == {"a.log": ["2026-08-08T17:42:01Z ERROR x", "  at a", "  at b", ""], "b.log": ["first"]}
    with one.open("ab") as f:
        f.write(b"\n")
    look()
    look()
    assert seen()["a.log"][4:] == ["next café"]
    two.write_bytes(b"a\n")  # cut and begun anew
    look()
    with two.open("ab") as f:
        f.write(b"b\n")
    look()
    assert seen()["b.log"] == ["first", "a", "b"]
    rows = LiveTail(spark, str(inputs), str(tmp_path / "table"), str(tmp_path / "check")).lines()
    assert sorted(r["ordinal"] for r in rows.where("source LIKE '%a.log'").collect()) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("seed", [1, 2])
def test_links_of_lines_as_they_arrive(spark, tmp_path, seed):
    """Any split into batches links as a table of all lines does."""
    rng = random.Random(seed)
    t = "06-03 09:15:27.001   511   7 E Unit: {}"
    kinds = ["2026-06-03T09:15:27Z y {", "2026-06-03T09:15:27Z x", "  at f", "  at f", "words", "}", '  File "m.py", line 4', "  body", "", t.format("  at x"), t.format("z {"), t.format("}"), t.format("w")]
    lines = {s: [rng.choice(kinds) for _ in range(120)] + ["2026-06-03T09:15:27Z x", *["  at f"] * 30] for s in ("a", "b")}
    config = Config(chain_cap=9)
    whole = lines_of(spark, lines["a"], "a").unionByName(lines_of(spark, lines["b"], "b"))
    result = parse(whole, "plain", reference=REFERENCE, config=config)
    want = {(r["source"], r["ordinal"]): (r["continuation_of"], r["level"], r["message"]) for r in result.entries.collect()}
    cut = {(r["source"], r["ordinal"]) for r in result.diagnostics.where("reason = 'chain_truncated'").collect()}
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        folder, out = str(tmp_path / "lines"), str(tmp_path / "out")
        at, got, batches = 1, {}, 0
        while at <= 151:
            end = at + rng.choice([1, 3, 20, 60])
            whole.where(f"ordinal >= {at} AND ordinal < {end}").coalesce(1).write.mode("append").parquet(folder)
            stream = linked_stream(spark.readStream.schema(whole.schema).parquet(folder), REFERENCE, config)
            query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(out)
            query.awaitTermination(120)
            at, batches = end, batches + 1
        rows = spark.read.parquet(out).collect()
        got = {(r["source"], r["ordinal"]): (r["continuation_of"], r["level"], r["message"]) for r in rows}
        assert got == want and len(rows) == len(want) and batches > 3
        assert {(r["source"], r["ordinal"]) for r in rows if r["truncated_root"]} == cut and cut
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
