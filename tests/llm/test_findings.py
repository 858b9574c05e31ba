"""What the reviewer's findings asked for."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer


def test_bpe_keeps_the_words_met_most(monkeypatch):
    from driftwood.llm import bpe

    path = public_tokenizers.path("word_bpe_49k.json")
    t, mine = Tokenizer.from_file(path), bpe.WordBpe(path)
    monkeypatch.setattr(bpe, "CACHE_SIZE", 300)
    learned, learn = [], mine.learn
    monkeypatch.setattr(mine, "learn", lambda words: (learned.extend(words), learn(words))[1])
    rng = random.Random(4)
    often = ["".join(rng.choices("abcdeéß", k=9)) for _ in range(40)]
    for _ in range(30):
        rare = ["".join(rng.choices("fghijñ日", k=9)) for _ in range(100)]
        texts = [" ".join(often * 2 + rare), "Été's <|endoftext|>½😀 " + rare[0], "", "<|endoftext|>"]
        ids, sizes = mine.encode(texts)
        for x, got in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
            assert got.tolist() == t.encode(x, add_special_tokens=False).ids
    # words that were met again and again are found once, however often the table was full
    assert all(learned.count(w) == 1 for w in often)
    assert len(mine.words) <= 300


def test_components_go_on_from_what_is_known(spark, monkeypatch):
    from driftwood.llm import near_dedup
    from driftwood.llm.near_dedup import components

    shuffles, written = [], near_dedup.checkpointed

    def counted(df):
        shuffles.append(df._jdf.queryExecution().sparkPlan().toString().count("Window") + df._jdf.queryExecution().sparkPlan().toString().count("Join"))
        return written(df)

    monkeypatch.setattr(near_dedup, "checkpointed", counted)
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 440)] + [(500, k) for k in range(501, 560)] + [(7, 7)]

    def wanted(links):
        root = {k: k for pair in links for k in pair}
        for _ in root:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return {k: v for k, v in root.items() if k != v}

    def found(df):
        return {r["node"]: r["root"] for r in df.collect()}

    def frame(links):
        return spark.createDataFrame(links, "a bigint, b bigint")

    first, more = links[::2], links[1::2]
    known = components(frame(first))
    assert found(known) == wanted(first)
    assert found(components(frame(more), known)) == wanted(links)
    assert found(components(frame(more[:0]), known)) == wanted(first)
    assert found(components(frame(first[:0]))) == {}
    # a turn has two windows and no join
    assert max(shuffles) == 2


def test_training_gives_its_memory_back(spark, monkeypatch):
    from driftwood.llm import language

    given = []
    monkeypatch.setattr(language, "released", lambda: given.append(1), raising=False)
    docs = spark.createDataFrame([(1, "the old mill", "aa"), (2, "die alte mühle", "bb")], "doc_id bigint, text string, lang string")
    assert language.train(docs).labels == ["aa", "bb"]
    assert given == [1]
