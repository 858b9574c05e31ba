"""Each stage of the corpus pipeline, and all of them, on a small fixture of awkward rows."""

import random
from collections import Counter

import corpus_pipeline as cp
import public_tokenizers
import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
POOL = {
    "aa": "the river and the old mill stood near a quiet town where people came to trade wool and grain".split(),
    "bb": "der fluss und die alte mühle lagen bei einer stillen stadt in der leute wolle und korn tauschten".split(),
}


def made():
    rng = random.Random(8)
    rows = []
    for i in range(60):
        lang = ("aa", "bb")[i % 2]
        text = " ".join(rng.choices(POOL[lang], k=80)) + f" id{i}"
        rows.append((i, text, lang, ("north", "south", None)[i % 3]))
    base = rows[4][1]
    rows += [
        (100, base, "aa", "north"),  # a copy
        (4, "entirely " + " ".join(rng.choices(POOL["aa"], k=90)), "aa", "south"),  # a known key, another text
        (101, base + " more", "aa", "north"),  # a near copy
        (102, base, "aa", "north"), (102, base, "aa", "north"),  # a repeated row
        (103, None, "aa", "north"), (104, "", None, None), (105, " 12 34 !! ", "bb", "south"),
        (106, " ".join(rng.choices(POOL["bb"], k=9000)), "bb", "south"),
        (107, " ".join(rng.choices(POOL["aa"], k=60)) + " mail me at some.one@mail.example.org or 10.1.2.3", "aa", None),
        (None, " ".join(rng.choices(POOL["bb"], k=70)), "bb", "north"),
    ]
    return [(k, t, lang, s, None if t is None else len(t)) for k, t, lang, s in rows]


ROWS = made()


@pytest.fixture(scope="module")
def docs(spark):
    # columns that clash with those of the operators
    return spark.createDataFrame(ROWS, COLUMNS).selectExpr("*", "'x' AS score", "'y' AS Node", "'z' AS _key", "1 AS times").cache()


def rows_of(df):
    return Counter(tuple(r) for r in df.select(*cp.COLUMNS).collect())


def test_language_stage(spark, docs):
    kept = rows_of(cp.language_stage(spark, docs, ""))
    gone = Counter(ROWS) - kept
    # those without letters go, clean ones stay, repeated rows are alike
    assert {r[0] for r in gone} == {103, 104, 105} and not kept - Counter(ROWS)


def test_dedup_stage(spark, docs):
    kept = rows_of(cp.dedup_stage(spark, docs, ""))
    copies = [r for r in ROWS if r[0] in (100, 101, 102)]
    assert kept == Counter(ROWS) - Counter(copies)


def test_pii_stage(spark, docs):
    got = {(r["doc_id"], r["lang"], r["source"], r["n_chars"]): r["text"] for r in cp.pii_stage(spark, docs, "").collect()}
    (text,) = (t for k, t in got.items() if k[0] == 107)
    assert text.endswith(" mail me at [EMAIL] or [IP]")
    untouched = Counter(r for r in ROWS if r[0] != 107)
    found = rows_of(cp.pii_stage(spark, docs, ""))
    assert not untouched - found and sum(found.values()) == len(ROWS)
    assert all(k[3] == (None if t is None else len(t)) for k, t in got.items())


def test_mixing_stage(spark, docs):
    found = rows_of(cp.mixing_stage(spark, docs, ""))
    size = lambda t: len((t or "").split())
    sizes, taken = Counter(), Counter()
    for r in ROWS:
        sizes[r[3]] += size(r[1])
    for r, n in found.items():
        assert r in ROWS and n <= 2 * ROWS.count(r)
        taken[r[3]] += n * size(r[1])
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), (5, 2, 1)))
    goal, free, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weights[s] for s in free)
        full = {s for s in free if level * weights[s] > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            goal[s] = 2 * sizes[s]
            left -= goal[s]
        free -= full
    goal |= {s: level * weights[s] for s in free}
    longest = {s: max(size(r[1]) for r in ROWS if r[3] == s) for s in sizes}
    assert all(abs(taken[s] - goal[s]) <= longest[s] for s in sizes)


def test_encoding_stage(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    got = Counter((r["doc_id"], r["text"], tuple(r["ids"]), r["n_tokens"]) for r in cp.encoding_stage(spark, docs, "").collect())
    want = Counter()
    for k, t, *_ in ROWS:
        ids = tuple(library.encode(t or "", add_special_tokens=False).ids)
        want[k, t, ids, len(ids)] += 1
    assert got == want


def test_all_stages(spark, docs, tmp_path):
    docs.select(*cp.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    got = cp.run(spark, str(tmp_path)).collect()
    keys = {r["doc_id"] for r in got}
    assert not keys & {100, 101, 102, 103, 104, 105} and keys <= {r[0] for r in ROWS}
    assert all(r["n_chars"] == len(r["text"]) and r["n_tokens"] == len(r["ids"]) for r in got)
    assert not any("@mail.example" in r["text"] for r in got)
    both = {r["text"] for r in got if r["doc_id"] == 4}
    assert both <= {t for k, t, *_ in ROWS if k == 4}


def test_stages_of_an_empty_table(spark, docs):
    rows = docs.limit(0)
    for _, stage in cp.STAGES:
        rows = stage(spark, rows, "")
        assert rows.count() == 0
