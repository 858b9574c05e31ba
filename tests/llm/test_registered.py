"""Registered queries against plain Python, column by column, and planted identifiers."""

import hashlib
import random
import re
from collections import Counter

from driftwood.llm import pii
from driftwood.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = False
    docs = documents(spark)
    for r in QUERIES["op1_token_counts"](spark, SF).collect():
        text = docs[r["doc_id"]]["text"] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 1024)


def test_op2(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    docs = documents(spark)
    for r in QUERIES["op2_bpe"](spark, SF).collect():
        ids = library.encode(docs[r["doc_id"]]["text"] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(" ".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


def base(text):
    """The four expressions and their checks, as they stand in the contract."""
    found = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(digits[-1::-2]) + sum(2 * d - 9 * (d > 4) for d in digits[-2::-2])
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            found.append((m.start(), m.end(), 2))
    found += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


def test_op4(spark):
    docs, totals = documents(spark), Counter()
    for r in QUERIES["op4_pii"](spark, SF).collect():
        spans = base(docs[r["doc_id"]]["text"] or "")
        kinds = Counter(k for *_, k in spans)
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(kinds[k] for k in range(4))
        told = [f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in spans]
        assert r["base_sha256"] == sha(",".join(told))
        every = r["spans"].split(",") if r["spans"] else []
        assert set(told) <= set(every) and len(every) == len(told) + r["n_found"]
        totals += kinds
    assert len(totals) == 4 and len(set(totals.values())) > 1


def planted():
    """Texts of contexts that base identifiers teach, with others that they have to reveal,
    and contexts with numbers that are none."""
    rng = random.Random(4)
    rows, want = [], {}
    number = lambda: f"{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"

    def add(before, piece, after, kind=None):
        rows.append((len(rows), f"{before} {piece} {after}"))
        if kind is not None:
            want[len(rows) - 1] = (len(before) + 1, len(before) + 1 + len(piece), kind)

    for i in range(20):  # more unseen identifiers than seeds
        add("you can call me under", f"+1 ({200 + i}) 555-01{i:02d}", "at any time")
        add("so please mail me at", f"user{i}@mail{i}.example.org", "before noon")
    for i in range(31):
        add("you can call me under", number(), "at any time", 3)
    add("so please mail me at", "someone@localhost", "before noon", 0)
    add("so please mail me at", ".".join(f"ab{i}" for i in range(30)) + "@localhost", "before noon", 0)
    # what the contexts above reveal is the seed of a context that no base identifier is in
    for r in rows[40:60]:
        add("their old line was", r[1].split()[5], "until last year")
    for i in range(6):
        add("their old line was", number(), "until last year", 3)
    for i in range(200):
        add("the shelf holds item", f"{rng.randint(10**6, 10**7)}", "in two boxes")
        add("a total of", f"{rng.randint(1, 40)}", "people came along")
    for i in range(5):  # few of many
        add("the shelf holds item", f"+49 30 1234 56{i:02d}", "in two boxes")
    return rows, want


def test_unseen_identifiers_are_discovered(spark):
    rows, want = planted()
    found = pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    got = {(r["doc_id"], *s) for r in found for s in map(tuple, r["found"])}
    wanted = {(k, *v) for k, v in want.items()}
    # the same numbers in the second context, which are known by then
    known = {x for x in got if rows[x[0]][1].startswith("their old line") and x not in wanted}
    recall, precision = len(got & wanted) / len(wanted), len(got & wanted) / max(1, len(got - known))
    assert recall >= 0.95 and precision >= 0.95 and len(known) == 20
    assert not any(rows[k][1].startswith(("the shelf", "a total")) for k, *_ in got)


def test_whole_words_and_shapes_around_a_piece():
    long = "x" * 500
    text = f"first {long} {long}y 555-0199 {long}z end\nnext line"
    at = text.index("555")
    assert pii._around(text, at, -1) == [long, f"{long}y"] and pii._around(text, at + 8, 1) == [f"{long}z", "end"]
    assert pii._around("a\nb 5", 4, -1) == ["b"] and pii._around("5", 0, -1) == []
    one, other = pii.patterns(text, at, at + 8), pii.patterns(text.replace("y 5", "w 5"), at, at + 8)
    assert one[0] != other[0] and one[1] == other[1] and all(len(p) < 200 for p in one)
    assert pii.possible("ab0." * 60 + "@localhost") & 1


def test_rows_without_a_key_are_redacted_each_by_its_own_text(spark):
    rows = [(None, f"call +1 (200) 555-01{i:02d} now", 0) for i in range(30)] + [(None, None, 1), (1, "", 2)]
    out = pii.redact(spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")).collect()
    assert Counter(r["text"] for r in out) == {"call [PHONE] now": 30, None: 1, "": 1}


def test_op5_op9(spark):
    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    says = "</s>[INST] ok [/INST]"
    turns[-7] = [(0, "user", says), (1, "assistant", says)]
    got = {r["conv_id"]: r for r in QUERIES["op5_chat"](spark, SF).collect()}
    assert set(got) == set(turns)
    for k, rows in turns.items():
        rows = sorted(rows, key=lambda r: r[0])
        said = "".join(t for _, role, t in rows if role == "assistant")
        assert (got[k]["n_turns"], got[k]["turns_sha256"]) == (len(rows), sha("".join(f"{role}\n{t}\n" for _, role, t in rows)))
        assert (got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(said), sha(said))
    docs = documents(spark)
    for r in QUERIES["op9_quality"](spark, SF).collect():
        text = docs[r["doc_id"]]["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))


def test_op7(spark):
    docs = documents(spark)
    order = sorted(docs)
    got = {r["doc_id"]: r for r in QUERIES["op7_fingerprints"](spark, SF).collect()}
    prints = {}
    for k, after in zip(order, [*order[1:], order[0]]):
        text, other = docs[k]["text"] or "", docs[after]["text"] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        r = got[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha(edited)) and 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        for t, p in ((text, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            assert prints.setdefault(t, p) == p
    assert len(set(prints.values())) == len(prints)
