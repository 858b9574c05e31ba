"""Views kept by changes, received messages and what is sent to readers."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftwood.operators import stats
from driftwood.operators.search import with_event
from driftwood.sources.sinks import messages
from driftwood.streaming import view
from driftwood.streaming.sessions import Received, received
from driftwood.streaming.view import live_view, shown

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class Map(dict):
    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]


class Handle:
    def getValueState(self, name, schema):
        return Value()

    def getMapState(self, name, key, value):
        return Map()


def some_lines(rng, n):
    """Lines (ordinal, continuation_of, passes, hit) with events of any length."""
    rows, root, ordinal = [], None, 0
    for _ in range(n):
        ordinal += rng.choice([1, 1, 1, 3])
        root = root if root is not None and rng.random() < 0.7 else None
        rows.append((ordinal, root, rng.random() < 0.7, rng.random() < 0.15))
        root = ordinal if root is None else root
    return rows


def seen(rows, keep):
    """The view by its rules: of the last lines, those of shown events."""
    kept = rows[-keep:]
    there = {r[0] for r in kept}
    event = {r[0]: r[1] if r[1] in there else r[0] for r in kept}
    passes = {r[0]: r[2] for r in kept}
    hits = {event[r[0]] for r in kept if r[3]}
    return {k for k, e in event.items() if passes[e] and e in hits}


@pytest.mark.parametrize("keep, chunk", [(1, 4), (7, 2), (25, 3), (60, 5), (1000, 4096)])
def test_changes_sum_up_to_the_view(monkeypatch, keep, chunk):
    monkeypatch.setattr(view, "CHUNK", chunk)
    for seed in range(25):
        rng = random.Random(seed)
        rows = some_lines(rng, 150)
        task, now, at = view._View(keep), set(), 0
        task.init(Handle())
        while at < len(rows):
            end = at + rng.choice([1, 1, 2, 9, 40])
            batch = pd.DataFrame(rows[at:end], columns=["ordinal", "continuation_of", "passes", "hit"])
            batch["continuation_of"] = batch["continuation_of"].astype("float64")
            for out in task.handleInputRows(("s",), iter([batch.sample(frac=1, random_state=seed)]), None):
                for ordinal, change in zip(out["ordinal"], out["change"]):
                    assert (ordinal in now) == (change < 0)  # each line comes and goes once
                    (now.add if change > 0 else now.remove)(ordinal)
            at = end
            assert now == seen(rows[:at], keep)
            assert sum(len(view._rows(v[0])) for v in task.chunks.values()) + len(view._rows(task.open.held[0])) == min(keep, len(rows[:at]))


def test_a_late_member_shows_its_event_once():
    task = view._View(10)
    task.init(Handle())
    got = []
    for rows in ([(1, None, True, False), (2, 1, False, False)], [(3, 1, False, True)], [(4, 1, False, True), (5, None, True, False)]):
        batch = pd.DataFrame(rows, columns=["ordinal", "continuation_of", "passes", "hit"])
        (out,) = task.handleInputRows(("s",), iter([batch]), None)
        got.append(list(zip(out["ordinal"], out["change"])))
    assert got == [[], [(1, 1), (2, 1), (3, 1)], [(4, 1)]]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    yield
    spark.conf.set(name, before)


def streamed(spark, tmp_path, slices, build):
    """The rows of a stream, run anew for each slice of its input."""
    for part in slices:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = build(spark.readStream.schema(part.schema).parquet(str(tmp_path / "in")))
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True)
        query.start(str(tmp_path / "out")).awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out"))


def test_live_view_of_a_stream(spark, tmp_path, rocks):
    rng = random.Random(3)
    rows = [(s, *r) for s in ("a", "b", None) for r in some_lines(rng, 80)]
    rows += [("c", n, 1 if n > 1 else None, True, n in (1, 4)) for n in range(1, 35)]
    table = spark.createDataFrame(rows, "source string, ordinal bigint, continuation_of bigint, p boolean, h boolean")
    slices = [table.where(f"ordinal > {a} AND ordinal <= {b}") for a, b in ((0, 33), (33, 34), (34, 500))]
    changes = streamed(spark, tmp_path, slices, lambda s: live_view(s, F.col("p"), F.col("h"), 33))
    got = {tuple(r) for r in shown(changes).collect()}
    assert got == {(s, k) for s in ("a", "b", "c", None) for k in seen([r[1:] for r in rows if r[0] == s], 33)} and got
    assert {r["reason"] for r in changes.select("reason").distinct().collect()} == {"shown", "evicted", "orphaned"}
    # as the batch operators cut the same lines
    kept = with_event(stats.tail(table.where("source = 'a'"), 33)).where("h").select("event").distinct().collect()
    roots = {r[1]: r[3] for r in rows if r[0] == "a"}
    assert {r["event"] for r in kept if roots[r["event"]]} <= {k for s, k in got if s == "a"}


def test_what_is_delivered_and_missed_adds_up():
    """A reader that is cut off, lags and meets producers that begin anew."""
    for seed in range(60):
        rng = random.Random(seed)
        reader, got, missed, epoch, first = Received(), {}, {}, 0, {}
        for run in range(3):
            seq = rng.randint(1, 4) if run else rng.randint(1, 30)
            for connection in range(3):
                ring = rng.randint(0, 6)
                sent = [("snapshot", [(n, str(n)) for n in range(max(1, seq - ring + 1), seq + 1)], seq, None, None, None)]
                for _ in range(rng.randint(0, 6)):
                    lost = rng.choice([0, 0, 0, 2])
                    if lost and rng.random() < 0.7:
                        sent.append(("gap", [], None, None, None, lost))
                    seq += lost + 1
                    sent.append(("line", [], None, seq, str(seq), None))
                before = reader.last
                for message in sent:
                    for kind, n, text, missing in reader.take(*message):
                        if kind == "line":
                            assert text == str(n)
                            got.setdefault(reader.epoch, []).append(n)
                        missed[reader.epoch] = missed.get(reader.epoch, 0) + missing
                if before is None or reader.epoch > epoch:
                    epoch = reader.epoch
                    lines = sent[0][1]
                    first[epoch] = lines[0][0] if lines else sent[0][2] + 1
                last = reader.last
                # every number from the first one seen to the last was delivered once or is missed
                lines = got.get(epoch, [])
                assert lines == sorted(set(lines)) and len(lines) + missed.get(epoch, 0) == last - first[epoch] + 1
                seq += rng.choice([0, 0, 1, 5, 20])  # while the reader is away
        assert reader.total == sum(missed.values())


def test_received_messages_of_a_stream(spark, tmp_path, rocks):
    said = lambda kind, **more: json.dumps({"type": kind, **more})
    shot = lambda a, b, last=None: said("snapshot", lines=[{"seq": n, "text": f"t{n}"} for n in range(a, b + 1)], lastSeq=last or b)
    sent = [shot(3, 5), said("line", seq=6, text="t6"), said("gap", count=2), said("line", seq=9, text="t9"), said("line", seq=12, text=None), "{broken", "null", said("line"), said("gap"), said("other")]
    sent += [shot(8, 14), said("snapshot", lines=[], lastSeq=20), shot(1, 2), said("line", seq=3, text="t3"), said("ended")]
    rows = [(s, i, m) for s in ("a", "b") for i, m in enumerate(sent)]
    table = spark.createDataFrame(rows, "source string, at bigint, message string")
    out = streamed(spark, tmp_path, [table.where("at < 3"), table.where("at >= 3 AND at < 11"), table.where("at >= 11")], received).orderBy("source", "at", "seq").collect()
    for s in ("a", "b"):
        own = [r for r in out if r["source"] == s]
        lines = [(r["epoch"], r["seq"]) for r in own if r["kind"] == "line"]
        assert lines == [(0, n) for n in (3, 4, 5, 6, 9, 12, 13, 14)] + [(1, n) for n in (1, 2, 3)]
        assert [(r["at"], r["missing"]) for r in own if r["kind"] == "gap"] == [(2, 2), (4, 2), (11, 6)] and own[-1]["total"] == 10
        assert [r["at"] for r in own if r["kind"] == "ended"] == [14] and [r["text"] for r in own if r["seq"] == 12] == [None]


def test_messages_to_readers(spark):
    lines = spark.createDataFrame([("a", n, f"t{n}") for n in range(1, 31)] + [("b", 1, None)], "source string, seq bigint, text string")
    readers = spark.createDataFrame([("new", "a", None), ("near", "a", 27), ("far", "a", 3), ("done", "a", 30), ("late", "b", None), ("over", "b", 1), ("void", "c", None)], "reader string, source string, position bigint")
    ended = spark.createDataFrame([("b",), ("b",)], "source string")
    found = messages(lines, readers, ended, keep=4, buffer=5).orderBy("reader", "place").collect()
    got = {}
    for r in found:
        got.setdefault(r["reader"], []).append(json.loads(r["envelope"]))
    line = lambda n: {"type": "line", "seq": n, "text": f"t{n}"}
    assert got == {
        "new": [{"type": "snapshot", "lines": [{"seq": n, "text": f"t{n}"} for n in range(27, 31)], "lastSeq": 30}],
        "near": [line(28), line(29), line(30)],
        "far": [{"type": "gap", "count": 22}, *map(line, range(26, 31))],
        "late": [{"type": "snapshot", "lines": [{"seq": 1, "text": ""}], "lastSeq": 1}, {"type": "ended"}],
        "over": [{"type": "ended"}],
        "void": [{"type": "snapshot", "lines": [], "lastSeq": 0}],
    }
    # a reader told of all it is sent has missed nothing that it does not know of
    reader = Received(3)
    told = [x for m in got["far"] for x in reader.take(m["type"], [], None, m.get("seq"), m.get("text"), m.get("count"))]
    assert reader.total == 22 and reader.last == 30 and len([x for x in told if x[0] == "line"]) == 5
    assert messages(lines.limit(0), readers.limit(0), ended.limit(0)).count() == 0
