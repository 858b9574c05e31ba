"""Each operator against a brute-force version on a small fixture of awkward rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} and" for i in range(9000))
BASE = "the quick brown fox jumps over the lazy dog while many small birds sing in the old tree near the river and nobody hears them"
ROWS = [
    (1, "Hello world, it's <|endoftext|> a  test\n\nwith\ttabs  ", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "b"),
    (4, "Ça va? Straße ΣΑΣ İstanbul 日本 😀 " + "x" * 3000, "fr", "b"),
    (5, LONG, "en", "a"),
    (6, BASE * 3, "en", "a"),
    (7, BASE * 3 + " almost", "en", "c"),
    (8, BASE * 3, "en", "c"),
    (8, BASE * 3, "en", "c"),
    (9, "mail a.b@c.example.com or 10.0.0.300 and 10.0.0.3, +1 (988) 555-2485 card 4041894974608795", None, "d"),
    (10, "   \n\t ", "en", None),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    # columns that clash with outputs are replaced
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("N_tokens", F.lit("x")).withColumn("score", F.lit("y")).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_token_counts(docs, none):
    from driftwood.llm.token_counts import count_tokens

    path, t = public_tokenizers.path("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    got = Counter((r["doc_id"], r["n_tokens"]) for r in count_tokens(docs, path, keep=["doc_id", "n_tokens"]).collect())
    assert got == Counter((k, len(t.encode(x or "", add_special_tokens=False).ids)) for k, x, *_ in ROWS)
    assert count_tokens(none, path).count() == 0


def test_token_counts_on_random_text():
    from driftwood.llm.token_counts import PreTokens

    t, mine = library("byte_bpe_50k.json"), PreTokens(public_tokenizers.path("byte_bpe_50k.json"), {" a": 1})
    rng = random.Random(1)
    letters = [*" \n\t a bé'sll!9½²日́ \x1c\x85😀ࢷ_", "<|endoftext|>", "'re", "\r\n"]
    for _ in range(2000):
        x = "".join(rng.choices(letters, k=rng.randint(0, 25)))
        assert mine.count(x) == len(t.encode(x, add_special_tokens=False).ids)


def test_bpe(docs, none):
    from driftwood.llm.bpe import decode, encode

    path, t = public_tokenizers.path("word_bpe_49k.json"), library("word_bpe_49k.json")
    rows = decode(encode(docs, path, keep=["doc_id"]), path).collect()
    want = Counter()
    for k, x, *_ in ROWS:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[k, tuple(ids), t.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in rows) == want
    assert encode(none, path).count() == 0


def test_bpe_on_random_text():
    from driftwood.llm.bpe import WordBpe

    t, mine = library("word_bpe_49k.json"), WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(2)
    letters = [*" \n\ta bé'sll!9½²日́ \x1c\x85😀ࢷ_ΣİÅ<", "<|endoftext|>", "the", "ing", "</w>"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 25))) for _ in range(2000)] + ["ab" * 3000]
    ids, sizes = mine.encode(texts)
    for x, got in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
        assert got.tolist() == t.encode(x, add_special_tokens=False).ids
    words = ["lowering", "anewword", "zzzzqx", "unbelievable"]
    assert all([mine.ids[r] for r in mine.exact(w)] == t.encode(w, add_special_tokens=False).ids for w in words)


def test_chat(spark):
    from driftwood.llm import chat

    says = "</s>[INST] ok [/INST]"
    rows = [
        (-7, 0, "user", says), (-7, 1, "assistant", says),
        (1, 0, "system", "a\\b<|im_end|>"), (1, 1, "assistant", None), (1, 1, "user", "x"), (1, None, "odd\nrole", "[\\INST]"), (1, 4, "user", "tail"),
        (2, 0, "user", "no reply"), (None, 0, "assistant", "z"), (3, 0, "assistant", "é" * 40000), (3, 0, "assistant", "é" * 40000),
    ]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    examples = chat.prefix_targets(turns)
    got = {r["conv_id"]: r for r in chat.conversation_digests(examples).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(f"{r}\n{x}\n" for *_, r, x in own)
        loss = "".join(x for *_, r, x in own if r == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for e in examples.collect():
        assert e["formatted"].count(chat.START) == e["n_turns"] == e["formatted"].count(chat.END)
    assert chat.conversation_digests(chat.prefix_targets(turns.limit(0))).count() == 0


def test_near_duplicates(docs, none, spark):
    from driftwood.llm.near_dedup import near_duplicates, probability_jaccard, representatives, weighted_shingles

    rng = random.Random(4)
    words = [f"w{i}" for i in range(120)]
    variants = [" ".join(w if rng.random() > p else f"x{rng.random()}" for w in words) for p in (0, 0, 0.01, 0.02, 0.03, 0.04, 0.06, 0.1, 0.3) for _ in range(6)]
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, v) for i, v in enumerate(variants)], "doc_id bigint, text string"))
    texts = dict([(k, x) for k, x, *_ in ROWS] + [(100 + i, v) for i, v in enumerate(variants)])
    sets = {k: weighted_shingles(x) for k, x in texts.items() if x is not None}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in sets:
        for j in sets:
            if i < j and (sets[i][0] == sets[j][0] or probability_jaccard(*sets[i][1:], *sets[j][1:]) >= 0.8):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = near_duplicates(more).collect()
    assert len(got) == len(ROWS) + len(variants)
    assert {r["doc_id"]: r["class_id"] for r in got} == {k: find(k) for k in texts}
    assert sorted(r["doc_id"] for r in representatives(more).collect()) == sorted(k for k in texts if find(k) == k)
    assert near_duplicates(none).count() == 0


def test_representatives_of_repeated_and_null_keys(spark):
    from driftwood.llm.near_dedup import representatives

    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(80)) for x in "abcde")
    rows = [
        (1, b), (5, a), (5, b + " more"),  # a is alone in its class, though its key has a copy of 1's text
        (6, c), (6, d), (6, d),  # different clean texts of one key, and a repeated row
        (None, e), (None, e), (None, e + " more"),  # a class without keys
        (None, c), (7, None), (7, None), (None, None), (None, None),
    ]
    got = Counter(tuple(r) for r in representatives(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    (last,) = (r for r in got if r[0] is None and r[1] is not None)
    assert last[1] in (e, e + " more")
    assert got == Counter([(1, b), (5, a), (6, c), (6, d), last, (7, None), (None, None), (None, None)])


def test_probability_jaccard():
    from driftwood.llm.near_dedup import mixed, prob_min_hash, probability_jaccard

    rng = np.random.default_rng(0)
    a, b = np.arange(0, 60, dtype=np.uint64), np.arange(20, 80, dtype=np.uint64)
    x, y = rng.integers(1, 5, 60), rng.integers(1, 5, 60)
    xs, ys = dict(zip(a.tolist(), x.tolist())), dict(zip(b.tolist(), y.tolist()))
    want = sum(1 / sum(max(xs.get(j, 0) / xs[i], ys.get(j, 0) / ys[i]) for j in {*xs, *ys}) for i in {*xs} & {*ys})
    assert probability_jaccard(a, x, b, y) == pytest.approx(want)
    signs = prob_min_hash([mixed(a + np.uint64(1)), mixed(b + np.uint64(1))], [x, y], 4096)
    assert (signs[0] == signs[1]).mean() == pytest.approx(want, abs=0.04)


def test_fingerprints(docs, none, spark):
    from driftwood.llm import fingerprint as fp

    c = F.col("text")
    pairs = spark.createDataFrame([("a\nb\n\nc", "c\na\nb", "a\nc"), ("a\na", "a", None), ("", None, "x")], "text string, other string, third string")
    r = pairs.select((fp.fingerprint(c) == fp.fingerprint(F.col("other"))).alias("same"), fp.likeness(fp.fingerprint(c), fp.fingerprint(F.col("third"))).alias("near"), (fp.deleted(fp.inserted(fp.fingerprint(c), F.lit("z")), F.lit("z")) == fp.fingerprint(c)).alias("undone")).collect()
    assert [x["same"] for x in r] == [True, False, True] and all(x["undone"] for x in r) and all(0 <= x["near"] <= 1 for x in r)
    ordered = sorted((k, x or "") for k, x, *_ in ROWS)
    for parts in (1, 3, 40):
        got = Counter(tuple(x) for x in fp.with_next(docs, parts=parts).collect())
        assert got == Counter((*ordered[i], ordered[(i + 1) % len(ordered)][1]) for i in range(len(ordered)))
    assert fp.with_next(none).count() == 0


def test_fingerprints_of_one_paragraph_and_string_keys(spark):
    from driftwood.llm import fingerprint as fp

    said = [f"Sentence {i} says {i * i}." for i in range(80)]
    pairs = spark.createDataFrame([(" ".join(said), " ".join(said[:40] + [f"Other {i}!" for i in range(40)])), (" ".join(said), " ".join(f"Else {i}?" for i in range(80)))], "a string, b string")
    half, none_ = (r["near"] for r in pairs.select(fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b"))).alias("near")).collect())
    assert 0.3 < half < 0.75 and none_ < 0.35
    # a text's pieces are those of its paragraphs, whatever stands between these
    rows = spark.createDataFrame([("One. Two!", ["x.", " y?  z. ", "", "é。 w", "no end", ".", "... a"])], "first string, more array<string>")
    r = rows.select(fp.fingerprint(F.concat_ws("\n", "first", "more")).alias("a"), F.aggregate("more", fp.fingerprint(F.col("first")), fp.inserted).alias("b")).head()
    assert r["a"] == r["b"]
    keys = [None, "", "a", "b\u00e9", "doc-1", "doc-10", "doc-2", "doc-\U0001f600", "z"]
    for own in (keys, [f"doc-{i:06d}" for i in range(50)], [None], ["x"]):
        table = spark.createDataFrame([(k, f"text of {k}") for k in own], "doc_id string, text string")
        ordered = sorted(own, key=lambda k: (k is not None, (k or "").encode()))
        want = {(k, f"text of {k}", f"text of {ordered[(i + 1) % len(ordered)]}") for i, k in enumerate(ordered)}
        assert {tuple(r) for r in fp.with_next(table, parts=4).collect()} == want


def test_fingerprints_of_many_paragraphs(spark):
    from driftwood.llm import fingerprint as fp

    def text(first, n):
        return "\n".join(f"line {first + i}" for i in range(n))

    # unrelated ones of 40,000 and more lines, one sharing half its lines, one line repeated
    pairs = [(text(0, 41_000), text(10**6, 42_000)), (text(0, 41_000), text(20_500, 41_000)), ("x\n" * 20_000, text(0, 300)), ("x\n" * 20_000, "x"), ("x\n" * 70_000, "y\n" * 70_000)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    own, other = fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b"))
    prints = df.select("i", own.alias("a"), other.alias("b")).cache()
    got = {r["i"]: r for r in prints.select("i", "a", fp._lanes(F.col("a")).alias("lanes"), fp.likeness(F.col("a"), F.col("b")).alias("near")).collect()}
    near = [got[i]["near"] for i in range(len(pairs))]
    assert near[0] < 0.4 and 0.2 < near[1] < 0.8 and near[2] < 0.4 and near[3] == 0.999 and near[4] < 0.4
    assert {abs(x) for x in got[2]["lanes"]} == {20_000.0} and {abs(x) for x in got[4]["lanes"]} == {70_000.0} and len(got[2]["lanes"]) == 64


def test_language(docs, none, spark):
    from driftwood.llm.language import fit, predict, train

    pool = {"aa": "lorem ipsum dolor sit amet consectetur".split(), "bb": "zwölf boxkämpfer jagen viktor quer über".split()}
    rng = random.Random(1)
    rows = [(" ".join(rng.choices(pool[k], k=60)), k) for k in pool for _ in range(20)]
    field = fit(rows)
    mixed = " ".join(pool["aa"] * 5 + pool["bb"] * 9)
    texts = spark.createDataFrame([(mixed,), ("lorem dolor",), (None,), ("123 !!",), ("",)], "text string")
    got = [tuple(r)[1:] for r in predict(texts, field, runs=True).collect()]
    assert [g[0] for g in got] == ["bb", "aa", "und", "und", "und"] and got[3][1] == 0.0
    assert 0.55 < got[0][1] < 0.75 and [r["lang"] for r in got[0][2]] == ["aa", "bb"]
    small = np.array([1, 5, 32, 33, 100])
    scores = np.random.default_rng(1).normal(size=(small.sum(), 2)).astype(np.float32)
    probs = field.marginals(scores, small)
    for part, p in zip(np.split(scores, np.cumsum(small)[:-1]), np.split(probs, np.cumsum(small)[:-1])):
        a, b = np.zeros_like(part, dtype=float), np.zeros_like(part, dtype=float)
        a[0] = field.start + part[0]
        for i in range(1, len(part)):
            a[i] = part[i] + np.logaddexp.reduce(a[i - 1][:, None] + field.move, axis=0)
        for i in range(len(part) - 2, -1, -1):
            b[i] = np.logaddexp.reduce(field.move + (part[i + 1] + b[i + 1])[None], axis=1)
        want = np.exp(a + b - np.logaddexp.reduce(a + b, axis=1)[:, None])
        assert np.abs(want - p).max() < 1e-5
    trained = train(docs)
    assert predict(docs, trained).count() == len(ROWS) and predict(none, train(none)).count() == 0


def test_language_held_out_accuracy(spark):
    from driftwood.llm.queries import op8_language

    d = "/root/testdata/sf0.01"
    got = op8_language(spark, d).where("held_out").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).head()[0] > 0.97


def test_pii(docs, none, spark):
    from driftwood.llm import pii

    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def brute(t):
        out = [(m.start(), m.end(), 0) for m in email.finditer(t)]
        out += [(m.start(), m.end(), 1) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in card.finditer(t):
            d = re.sub(r"\D", "", m[0])
            if 12 <= len(d) <= 19 and pii.luhn(d):
                out.append((m.start(), m.end(), 2))
        out += [(m.start(), m.end(), 3) for m in phone.finditer(t) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
        return sorted(out)

    rng = random.Random(9)
    for _ in range(3000):
        t = "".join(rng.choices([*"a.b@-+1 2(34)", "@c.d", "10.0.0.", "4041894974608795", "+1 988"], k=rng.randint(0, 25)))
        assert pii.base_spans(t) == brute(t)
    rows = [(i, f"call me under +1 ({i:03d}) 555-01{i:02d} today") for i in range(20)] + [(50, "call me under 555-0199 today"), (51, "we were under 12 today")]
    found = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [tuple(s) for s in found[50]["found"]] == [(14, 22, 3)] and not found[51]["found"] and len(found[3]["base"]) == 1
    clean = {r["doc_id"]: r for r in pii.redact(docs.withColumn("n_chars", F.length("text").cast("bigint"))).collect()}
    assert clean[9]["text"] == 'mail [EMAIL] or 10.0.0.300 and [IP], [PHONE] card [CARD]'
    assert clean[9]["n_chars"] == len(clean[9]["text"]) and clean[2]["text"] is None and clean[6]["text"] == BASE * 3
    odd = {"_k": F.lit("k"), "_found": F.lit(None).cast("string"), "_key0": F.lit(1), "_found0": F.lit(2), "text_hash": F.lit("h")}
    named = {r["doc_id"]: r for r in pii.redact(docs.where("doc_id IN (2, 9)").withColumns(odd)).collect()}
    assert named[9]["text"] == clean[9]["text"] and [named[9][n] for n in odd] == ["k", None, 1, 2, "h"] and named[2]["_key0"] == 1
    assert pii.personal_data(none).count() == 0 and pii.redact(none).count() == 0


def test_quality(docs, none):
    from driftwood.llm import quality

    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(grams)
        covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)

    got = quality.quality_rules(docs, keep=["doc_id"]).collect()
    want = {k: brute(x or "") for k, x, *_ in ROWS}
    assert len(got) == len(ROWS)
    for r in got:
        b = want[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == b
        assert r["base_failed"] == (b[0] < 10 or 100 * b[4] > 20 * b[0]) and not (r["base_failed"] and r["kept"])
    assert quality.quality_rules(none).count() == 0
    assert quality.js_distance(np.array([1, 0]), np.array([0, 3])) == 1.0 and quality.js_distance(np.array([2, 2]), np.array([1, 1])) == 0.0


def test_quality_is_exact_however_the_table_is_cut(spark):
    """Both distances and the verdict against a plain computation, for 1 and 40 partitions."""
    import math

    from driftwood.llm import quality

    rng = random.Random(6)
    rare = [f"zq{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choices(["the", "Of", "and", "Ünd", "ß"], k=60) + rng.choices(rare, k=90)), rng.choice(["x", "y"])) for i in range(120)]
    rows += [(200, "ÀÉ ЖЗ … — " * 60, "x"), (201, " ".join(rng.choices(rare, k=300)), "y"), (202, "the and of " * 50, None), (203, None, "x")]
    words, chars = {}, {}
    for _, t, k in rows:
        if t:
            words.setdefault(k, Counter()).update(t.lower().split())
            chars.setdefault(k, Counter()).update(map(quality.class_of, t))

    def distance(p, q):
        names, a, b = {*p, *q}, sum(p.values()), sum(q.values())
        total = 0.0
        for n in names:
            x, y = p.get(n, 0) / a, q.get(n, 0) / b
            total += sum(z * math.log2(2 * z / (x + y)) for z in (x, y) if z) / 2
        return math.sqrt(max(0.0, total))

    common = {}
    for k, c in words.items():
        total = sum(c.values())
        top = sorted((w for w, n in c.items() if n >= 0.003 * total), key=lambda w: (-c[w], w))[:100]
        common[k] = Counter({w: c[w] for w in top}) + Counter({None: total - sum(c[w] for w in top)})

    def want(t, k):
        if not t:
            return 0.0, 0.0
        pairs = []
        for lang in [k] if k is not None else words:
            own = Counter(w if w in common[lang] else None for w in t.lower().split())
            pairs.append((distance(Counter(map(quality.class_of, t)), chars[lang]), distance(own, common[lang])))
        return min(pairs, key=sum)

    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    for parts in (1, 40):
        got = {r["doc_id"]: r for r in quality.quality_rules(df.repartition(parts), keep=["doc_id"]).collect()}
        for i, t, k in rows:
            far = want(t, k)
            assert (got[i]["char_distance"], got[i]["word_distance"]) == pytest.approx(far, abs=1e-9)
            n = len((t or "").split())
            bad = got[i]["base_failed"] or (got[i]["word_chars"] >= 200 and far[0] > 0.30) or (n >= 100 and far[1] > 0.45)
            assert got[i]["kept"] == (not bad)


def test_mixing(docs, none, spark):
    from driftwood.llm.mixing import mix

    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["s1", "s2", "s3", "S", None, "é"])) for i in range(800)]
    big = spark.createDataFrame(rows, "doc_id bigint, text string, source string").union(docs.select("doc_id", "text", "source").limit(3))
    got = mix(big).collect()
    sizes = Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    free, fixed, budget = set(names), {}, 1.5 * sum(sizes.values())
    while True:
        level = (budget - sum(fixed.values())) / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not full:
            break
        for s in full:
            fixed[s] = 2 * sizes[s]
            free.remove(s)
    goal = fixed | {s: level * weight[s] for s in free}
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(goal[r["source"]]) and r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 35 for s in names)
    assert sorted(map(repr, got)) == sorted(map(repr, mix(big).collect()))
    assert mix(none).count() == 0


def test_warc(spark):
    from driftwood.llm import warc

    html = "<html><head><title>A &amp; B</title><script>var x = '<p>';</script></head><body><p>One <b>two</b></p><!-- no --><div>&lt;3 é</div></body></html>"
    pages = spark.createDataFrame([(1, "http://a/x", html), (2, None, None), (1, "http://a/x", html)], "page_id bigint, url string, html string")
    source = {r["key"]: r for r in warc.responses(pages, "2024-01-01T00:00:00Z").collect()}
    made = warc.derivatives(warc.responses(pages, "2024-01-01T00:00:00Z")).collect()
    assert len(made) == 6
    for r in made:
        headers, block = warc.read_record(r["record"])
        own = source[r["key"]]
        assert headers["WARC-Refers-To"] == own["record_id"] and headers["WARC-Target-URI"] == own["target_uri"] and headers["WARC-Date"] == own["date"]
        assert block == r["block"] and headers["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block.encode()).hexdigest()
        if r["warc_type"] == "metadata":
            assert f"source-payload-digest: {own['payload_digest']}" in block and "source-header: Content-Type: text/html; charset=utf-8" in block
        elif r["key"] == 1:
            assert block == "A & B\nOne two\n<3 é"
        else:
            assert block == ""
    assert warc.derivatives(warc.responses(pages.limit(0), "x")).count() == 0


def test_warc_character_references(spark):
    from driftwood.llm import warc

    html = "<p>&copy; 2024 &middot; caf&eacute; &mdash; it&#8217;s &#x27;x&#X27;</p><p>&amp;copy; &amp;#39; &copy2 &NotEqualTilde; &nosuch; a&b &; AT&T</p><p>a&nbsp;&#160;&#xA0;b&#10;c &#0;&#128;&#x1F600;</p>"
    pages = spark.createDataFrame([(1, "u", html)], "page_id bigint, url string, html string")
    (r,) = (r for r in warc.derivatives(warc.responses(pages, "x")).collect() if r["warc_type"] == "conversion")
    assert r["block"] == "© 2024 · café — it’s 'x'\n&copy; &#39; ©2 ≂̸ &nosuch; a&b &; AT&T\na b\nc \ufffd€😀"
    assert r["content_length"] == len(r["block"].encode()) and warc.read_record(r["record"])[1] == r["block"]
    assert r["block_digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest()
    assert warc.unescaped(f"&#{'0' * 5000}65; &#{'9' * 5000}; &#x{'0' * 50}41;") == "A \ufffd A"


def test_tags_of_pages():
    from driftwood.llm.warc import untagged

    cases = {'<a title="a > b">x</a>': "x", "<a title='>' b=c>x": "x", "a < b and c > d": "a < b and c > d", '<p class="x>y': '\ny', "<!DOCTYPE html><?x y?>z": "z", "<P>a</P >b": "\na\nb", "<b>a</b><br/>c": "a\nc", "it's <i don't>x</i>": "it's x", "</>1 <3": "1 <3", "<" * 50_000: "<" * 50_000, "<a" * 50_000: "<a" * 50_000, "": ""}
    assert {k: untagged(k) for k in cases} == cases
    assert untagged('<a b="c>" ' * 20_000 + ">end") == "end"


def test_warc_files(spark, tmp_path):
    import gzip

    from driftwood.llm import warc

    def record(kind, block, **more):
        fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:x:{kind}>", "WARC-Target-URI": "http://a/\u00e9", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Length": len(block), **more}
        return b"WARC/1.0\r\n" + "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items() if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"

    page = "<p title='x > y'>caf\u00e9</p>"
    http = lambda head, body: f"HTTP/1.1 200 OK\r\n{head}\r\n\r\n".encode() + body
    zipped = gzip.compress(page.encode())
    sent = {
        "plain": (http("Content-Type: text/html;\r\n charset=ISO-8859-1\r\nX-Own: 1", page.encode("latin-1")), {"WARC-Payload-Digest": "sha1:OWN"}),
        "chunks": (http("Transfer-Encoding: chunked", f"{4:x};a=b\r\n".encode() + page.encode()[:4] + f"\r\n{len(page.encode()) - 4:X}\r\n".encode() + page.encode()[4:] + b"\r\n0\r\n\r\n"), {}),
        "gzip": (http("content-encoding: gzip", zipped), {}),
        "short": (http("A: b", page.encode()), {"Content-Length": None}),
        "nothing": (b"", {}),
        "bare": (b"HTTP/1.0 204 No\n\n", {}),
        "odd": (http("Content-Type: text/html; charset=nosuch", page.encode()), {}),
    }
    made = [record("response", block, **{"WARC-Record-ID": f"<urn:x:{name}>", **more}) for name, (block, more) in sent.items()]
    every = [record("warcinfo", b"software: x\r\n"), *made[:3], record("request", b"GET / HTTP/1.1\r\n\r\n"), *made[3:]]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc").write_bytes(b"".join(every))
    (tmp_path / "in" / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, every)))
    (tmp_path / "in" / "empty.warc").write_bytes(b"")
    (tmp_path / "in" / "no.warc").write_bytes(b"no record\n\nat all")
    source = warc.read_responses(spark, str(tmp_path / "in")).collect()
    assert Counter((r["key"].rsplit("/", 1)[1], r["record_id"]) for r in source) == Counter((f, f"<urn:x:{n}>") for f in ("a.warc", "b.warc.gz") for n in sent)
    for r in source:
        name = r["record_id"][7:-1]
        assert r["body"] == ("" if name in ("nothing", "bare") else page) and r["target_uri"] == "http://a/\u00e9" and r["date"] == "2024-01-01T00:00:00Z"
        digest = {"plain": "sha1:OWN", "gzip": "sha256:" + hashlib.sha256(zipped).hexdigest(), "chunks": "sha256:" + hashlib.sha256(page.encode()).hexdigest()}
        assert r["payload_digest"] == digest.get(name, r["payload_digest"])
    meta = {r["refers_to"]: r for r in warc.derivatives(warc.read_responses(spark, str(tmp_path / "in"))).where("warc_type = 'metadata'").collect()}
    own = meta["<urn:x:plain>"]["block"]
    assert "source-payload-digest: sha1:OWN" in own and "source-header: X-Own: 1" in own
    texts = {r["block"] for r in warc.derivatives(warc.read_responses(spark, str(tmp_path / "in"))).where("warc_type = 'conversion'").collect()}
    assert texts == {"caf\u00e9", ""}
    assert [f["content-type"] for f in [warc.fields_of(["Content-Type: a;", " b", "content-type: c", "none"])]] == ["a; b"]
