"""Resampling, source divergence and near-duplicate vectors against plain computations."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwood.llm import divergence, resampling, vectors
from driftwood.llm.divergence import packed, walked
from driftwood.llm.resampling import resample
from driftwood.llm.vectors import near_vectors

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sampled(docs, target, percent, least, longest=1, key=lambda k: (k is None, k)):
    """(key, n_features, weight, score, rank) of each row, from the definition."""

    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(SMALL))
        return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    source, goal = Counter(), Counter()
    for _, text in docs:
        source.update(map(bucket, features(text)[1]))
    for text in target:
        goal.update(map(bucket, features(text)[1]))
    s_all, t_all, rows = sum(source.values()), sum(goal.values()), []
    for k, text in docs:
        n, found = features(text)
        gained = [math.floor(1000 * math.log((goal[b] + 1) * (s_all + 10000) / ((source[b] + 1) * (t_all + 10000)))) for b in map(bucket, found)]
        weight = sum(gained) // len(gained) if gained else 0
        h = int(hashlib.sha256(f"2024:{'null' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append([k, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], key(r[0])))
    for rank, row in enumerate(able[: len(able) * percent // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def words(rng, n, of="abcdefgh"):
    return " ".join("".join(rng.choice(of) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.mark.parametrize("keys", ["whole", "text"])
def test_resampling(spark, monkeypatch, keys):
    monkeypatch.setattr(resampling, "DIGIT_BITS", 3)  # many passes
    rng = random.Random(1)
    name = (lambda i: i - 2**40) if keys == "whole" else (lambda i: f"k{i % 7}/{'é' * (i % 3)}{i}")
    docs = [(name(i), words(rng, rng.randint(0, 40))) for i in range(300)]
    docs += [(name(900), None), (name(901), ""), (name(902), "?! ..."), (name(903), "Ünder İ 9 " * 3000), (None, words(rng, 30)), (name(2**40 + 2**62 if keys == "whole" else 5000), words(rng, 25))]
    target = [words(rng, 50, "abz") for _ in range(5)] + [None, ""]
    frame = spark.createDataFrame([(k, t, 1, "x") for k, t in docs], f"doc_id {'bigint' if keys == 'whole' else 'string'}, text string, weight int, _key string")
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    order = (lambda k: (k is None, k)) if keys == "whole" else (lambda k: (k is None, (k or "").encode()))
    for longest in (1, 2):
        got = resample(frame, aims, percent=30, longest=longest)
        assert sorted(map(tuple, got.collect()), key=str) == sampled(docs, target, 30, 20, longest, order)


def test_resampling_draws_exactly_as_many_of_rows_that_are_alike(spark):
    rng = random.Random(2)
    docs = [(7, "a b c " * 10)] * 60 + [(i, words(rng, 25)) for i in range(40)]
    got = resample(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([("a b",)], "text string"), percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 51)) and len(got) == 100
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert resample(empty, empty).count() == 0 and {r["rank"] for r in resample(spark.createDataFrame(docs[:5], "doc_id int, text string"), empty).collect()} == {None}


def test_trie_walks_in_order_of_bytes():
    rng = random.Random(3)
    terms = ["".join(rng.choice(["a", "b", "é", "ü", "日", "𝄞"]) for _ in range(rng.randint(0, 5))).encode() for _ in range(3000)]
    leaves = {t: [i, 0, i + 1, 7, 2**40] for i, t in enumerate(terms)}
    assert list(walked(packed(sorted(leaves), [leaves[t] for t in sorted(leaves)]))) == sorted(leaves.items())
    assert list(walked(packed([], []))) == [] and list(walked(packed([b""], [[1]]))) == [(b"", [1])]
    assert [t.decode() for t in sorted(leaves)] == sorted(t.decode() for t in leaves)


def audited(docs, least, top):
    documents, counts = {}, {}
    for text, lang, source in docs:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(SMALL))
        documents.setdefault(lang or "", Counter()).update(set(found))
        counts.setdefault((lang or "", source or ""), Counter()).update(found)
    rows = []
    for lang, df in documents.items():
        kept = [t for t, n in df.items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        own = {s: share(c) for (x, s), c in counts.items() if x == lang}
        whole = share(sum((c for (x, _), c in counts.items() if x == lang), Counter()))
        for s, p in own.items():
            pairs = [(sum(abs(p[t] - q[t]) for t in kept), o) for o, q in own.items() if o != s]
            terms = [(p[t] - whole[t], t) for t in kept if counts[lang, s][t] and p[t] > whole[t]]
            for part, found, n in (("pair", pairs, len(pairs)), ("term", terms, top)):
                rows += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:n], 1)]
    return sorted(rows)


@pytest.mark.parametrize("small", [False, True])
def test_divergence(spark, monkeypatch, small):
    if small:  # tries are handed on all the time, pairs come in many tiles, nothing is broadcast
        for name, value in (("CELLS", 50), ("MERGED", 20), ("TILE", 2), ("BROADCAST_GROUPS", 0)):
            monkeypatch.setattr(divergence, name, value)
    rng = random.Random(4)
    docs = [(words(rng, rng.randint(0, 30), "abcÄé").replace("c", rng.choice("cC")), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "ß", "z9", None])) for _ in range(400)]
    docs += [(None, "en", "only null"), ("", "fr", "a"), ("rare words", "fr", "b"), ("x y", "fr", None), ("long " * 5000, "en", "s1")]
    frame = spark.createDataFrame([(*d, 1, "y") for d in docs], "text string, lang string, source string, item int, value string")
    got = divergence.divergence(frame, least=10, top=4)
    assert sorted(map(tuple, got.collect())) == audited(docs, 10, 4)
    assert {r["value"] for r in got.where("lang = 'fr'").collect()} == {0}
    assert divergence.divergence(frame.limit(0)).count() == 0


def test_shares_stay_exact_beyond_64_bits():
    counts, totals = np.array([0, 3 * 10**12, 7]), np.array([10**13, 10**13, 10**13])
    want = [1 + 10**9 * (int(c) + 5) // (10**13 + 5 * 9) for c in counts]
    assert divergence._share(counts, totals, 9).tolist() == want


def linked(rows, threshold=0.93):
    fine = {i: np.array(v, float) / max(map(abs, v)) for i, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    fine = {i: v / np.linalg.norm(v) for i, v in fine.items()}
    near = {i: {j for j in fine if j != i and rows[i][2] == rows[j][2] and len(fine[i]) == len(fine[j]) and fine[i] @ fine[j] >= threshold} for i in fine}
    out = []
    for i, (key, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = near.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((key, len(near.get(i, ())), least, key == least))
    return sorted(out, key=str)


def crowd(rng, d, n, spread):
    base = rng.standard_normal(d)
    base /= np.linalg.norm(base)
    return [(base + spread * rng.standard_normal(d) / math.sqrt(d)).tolist() for _ in range(n)]


@pytest.mark.parametrize("d, tile", [(64, 4096), (20, 16), (3, 4096)])
def test_near_vectors(spark, monkeypatch, d, tile):
    """Links of loose pairs, of crowds that are balls, of balls that touch each other, and of
    rows on the edge of the threshold are all found, and no other."""
    monkeypatch.setattr(vectors, "CROWD", 20)
    monkeypatch.setattr(vectors, "TILE", tile)
    rng = np.random.default_rng(d)
    found = [v for n, spread in ((80, 0.1), (60, 0.25), (40, 0.45), (30, 0.02)) for v in crowd(rng, d, n, spread)]
    base = np.array(found[0]) / np.linalg.norm(found[0])
    for angle in (0.2, 0.3, 0.36, 0.3764, 0.38, 0.45):  # crowds around one that is there
        other = rng.standard_normal(d)
        other -= (other @ base) * base
        centre = math.cos(angle) * base + math.sin(angle) * other / np.linalg.norm(other)
        found += [(centre + 0.05 * rng.standard_normal(d) / math.sqrt(d)).tolist() for _ in range(25)]
    found += rng.standard_normal((100, d)).tolist() + [found[0]] * 30 + [(7 * np.array(found[3])).tolist()]
    rows = [(i, v, i % 2 if i < 200 else 0) for i, v in enumerate(found)]
    rows += [(900, None, 0), (901, [], 0), (902, [0.0] * d, 0), (903, [float("nan")] * d, 0), (904, [None] * d, 0), (905, [float("inf"), *[1.0] * (d - 1)], 0), (906, found[0], None), (None, found[0], 0), (3, found[0], 0), (907, found[0][:-1], 0), (908, [1e200] * d, 1), (909, [1e200] * d, 1), (910, [-5e-320] * d, 1)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id int, embedding array<double>, label int, node string, unit int")
    got = near_vectors(frame)
    assert sorted(map(tuple, got.collect()), key=str) == linked(rows)
    assert near_vectors(frame.limit(0)).count() == 0


def test_codes_bound_what_they_stand_for():
    """No pair within reach is ruled out, and the estimate has no bias over rotations."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + rng.standard_normal(x.shape) * np.linspace(0.01, 0.3, 200)[:, None] / 8
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    turn = vectors.rotation(64)
    a, b = x @ turn.T, y @ turn.T
    assert np.allclose(turn @ turn.T, np.eye(64))
    step = np.abs(a).max(1, keepdims=True) / 127
    coarse = np.rint(a / step)
    factor = np.arccos(np.minimum(1, np.abs(b).sum(1) / 8))
    open_ = vectors.possible(coarse, step[:, 0], np.linalg.norm(a - coarse * step, axis=1), np.sign(b), factor, np.arccos(np.clip(x @ y.T, -1, 1)) + 1e-9)
    assert open_.all()
    estimates = []
    for seed in range(400):
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((64, 64)))
        turned = (q * np.sign(np.diag(r))) @ y[150]
        estimates.append((q * np.sign(np.diag(r)) @ x[150]) @ np.sign(turned) / np.abs(turned).sum())
    assert abs(np.mean(estimates) - x[150] @ y[150]) < 4 * np.std(estimates) / 20


def test_queries_of_the_module_keep_their_columns(spark):
    from driftwood.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    want = {"op11_resampling": ["doc_id", "n_features", "weight", "score", "rank"], "op12_divergence": ["lang", "source", "part", "item", "value", "rank"], "op13_near_vectors": ["vec_id", "n_links", "component_id", "kept"]}
    for name, columns in want.items():
        assert QUERIES[name](spark, sf).columns == columns
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = QUERIES["op11_resampling"](spark, sf).withColumn("doc_id", F.col("doc_id")).collect()
    assert sorted(map(tuple, got), key=str) == sampled([tuple(d) for d in docs], target, 10, 20)
