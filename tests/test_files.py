"""Files written and looked at: the order of entries, and sizes of sources."""

import glob

import pyarrow.parquet as pq
from helpers import parsed

from driftwood.sources.lines import binary_sources
from driftwood.sources.sinks import write_entries


def test_written_entries_are_in_order_of_time(spark, tmp_path):
    """In each file, by time, then source and number; entries without a time are apart."""
    texts = [f"2026-06-{1 + i % 3:02d}T{(i * 7) % 24:02d}:15:27Z INFO {i}" for i in range(200)] + ["no time at all"] * 5
    write_entries(parsed(spark, texts).entries.repartition(7), str(tmp_path / "out"))
    seen, days = 0, set()
    for file in glob.glob(str(tmp_path / "out" / "*" / "*.parquet")):
        rows = pq.ParquetFile(file).read(columns=["ts_ms", "source", "ordinal"]).to_pylist()
        keys = [(r["ts_ms"] or 0, r["source"], r["ordinal"]) for r in rows]
        assert keys == sorted(keys)
        seen, day = seen + len(rows), file.split("date=")[1].split("/")[0]
        days.add(day)
        assert all((r["ts_ms"] is None) == (day == "__HIVE_DEFAULT_PARTITION__") for r in rows)
    assert seen == 205 and len(days) == 4


def test_empty_and_binary_files(spark, tmp_path):
    (tmp_path / "empty.log").write_bytes(b"")
    (tmp_path / "text.log").write_bytes(b"a\n" * 5000 + b"\0")  # beyond the head
    (tmp_path / "bin ary%.log").write_bytes(b"a\0b")
    found = {r["source"].rsplit("/", 1)[1]: (r["bytes"], r["binary"], r["empty"]) for r in binary_sources(spark, str(tmp_path / "*.log")).collect()}
    assert found == {"empty.log": (0, False, True), "text.log": (10_001, False, False), "bin ary%.log": (3, True, False)}
