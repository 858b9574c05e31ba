import random

import pytest
from helpers import parsed, rows_of

from driftwood.config import Config
from driftwood.operators import chains
from driftwood.operators.parse import parse


def links(spark, lines, **more):
    return [r["continuation_of"] for r in rows_of(spark, lines, **more)]


def test_stack_traces(spark):
    java = ["2026-06-03T09:15:27Z ERROR failed", "java.lang.IllegalStateException: bad", "\tat a.B.c(D.java:1)", "Caused by: x.YError", "\t... 14 more", "2026-06-03T09:15:28Z INFO on"]
    assert links(spark, java) == [None, 1, 1, 1, 1, None]
    python = ["2026-06-03T09:15:27Z ERROR failed", "Traceback (most recent call last):", '  File "app.py", line 12, in f', "    call()", "ValueError: no", "prose"]
    assert links(spark, python) == [None, 1, 1, 1, 1, None]
    assert links(spark, ["2026-06-03T09:15:27Z x", "  at a", "", "  at b"]) == [None, 1, None]
    assert links(spark, ["  at a", "  at b", "prose"]) == [None, None, None]


def test_logcat_and_braces(spark):
    t = "06-03 09:15:27.{:03d}   511   640 E Unit: {}"
    trace = [t.format(1, "FATAL EXCEPTION: main"), t.format(1, "java.lang.NullPointerException"), t.format(2, "  at a.b"), t.format(3, "*"), t.format(3, "*")]
    assert links(spark, trace) == [None, 1, 1, None, None]
    body = [t.format(1, "Body {"), t.format(1, '"a": {'), t.format(1, "}"), t.format(1, "}"), t.format(1, "next")]
    assert links(spark, body) == [None, 1, 1, 1, None]


@pytest.mark.parametrize("frames, cut", [(1000, []), (1003, [1002])])
def test_cap(spark, frames, cut):
    result = parsed(spark, ["2026-06-03T09:15:27Z x"] + ["  at a"] * frames)
    assert result.entries.where("continuation_of = 1").count() == 1000
    assert [r["ordinal"] for r in result.diagnostics.where("reason = 'chain_truncated'").collect()] == cut


#: Kinds of lines: what begins an event, its identity, what joins by itself, opened braces.
KINDS = {"root {": (True, None, False, 1), "root": (True, None, False, 0), "  at f": (False, None, True, 0), "words": (False, None, False, 0), "}": (False, None, False, -1), "dump {": (False, None, False, 1), "  File": (False, None, True, 0), "  body": (False, None, False, 0), "log at": (True, "a", True, 0), "log {": (True, "a", False, 1), "log }": (True, "a", False, -1), "log": (True, "a", False, 0), "other": (True, "b", False, 0)}


def extent(lines, root, cap):
    """The line after the last one of the event that a root begins, and whether the cap ends it."""
    open_ = max(0, KINDS[lines[root]][3])
    for at in range(root + 1, len(lines)):
        line = lines[at]
        if line == "":
            return at, False
        prefixed, identity, joins, braces = KINDS[line]
        joins = joins or (line == "  body" and lines[at - 1] == "  File") or open_ > 0
        if not joins or (prefixed and (identity is None or identity != KINDS[lines[root]][1])):
            return at, False
        if at - root > cap:
            return at, True
        if open_ and open_ + braces <= 0:
            return at + 1, False
        open_ = max(0, open_ + braces)
    return len(lines), False


def by_hand(lines, cap):
    """What each line continues, event by event, and the lines that a cap kept out."""
    found, cut, at = [None] * len(lines), {}, 0
    while at < len(lines):
        if lines[at] == "" or not KINDS[lines[at]][0]:
            at += 1
            continue
        end, capped = extent(lines, at, cap)
        found[at + 1 : end] = [at + 1] * (end - at - 1)
        if capped:
            cut[end + 1] = at + 1
        at = end
    return found, cut


TEXTS = {
    "root {": "2026-06-03T09:15:27Z x {", "root": "2026-06-03T09:15:27Z y", "  at f": "  at f", "words": "words", "}": "}", "dump {": "dump {", "  File": '  File "m.py", line 4', "  body": "  body", "": "",
    "log at": "06-03 09:15:27.001   511   7 E Unit:   at x", "log {": "06-03 09:15:27.001   511   7 E Unit: z {", "log }": "06-03 09:15:27.002   511   7 E Unit: }", "log": "06-03 09:15:27.002   511   7 E Unit: w", "other": "06-03 09:15:27.001   511   8 E Unit: q",
}


def check(spark, lines, cap):
    result = parsed(spark, [TEXTS[x] for x in lines], config=Config(chain_cap=cap))
    got = {r["ordinal"]: (r["continuation_of"], r["event"], r["chained"]) for r in result.entries.collect()}
    want, cut = by_hand(lines, cap)
    assert {k: v[0] for k, v in got.items()} == {i: w for i, w in enumerate(want, 1) if lines[i - 1]}
    heads = {w for w in want if w}
    assert all(event == (root or k) and several == (root is not None or k in heads) for k, (root, event, several) in got.items())
    told = result.diagnostics.where("reason = 'chain_truncated'").collect()
    assert {r["ordinal"]: int(r["detail"]) for r in told} == cut
    return want, cut


@pytest.mark.parametrize("block, group, cap", [(64, 2, 40), (8, 3, 6), (8192, 1024, 40)])
def test_links_are_what_the_rules_say(spark, monkeypatch, block, group, cap):
    """Neither blocks nor groups of them change a link, in no kind of run."""
    monkeypatch.setattr(chains, "BLOCK", block)
    monkeypatch.setattr(chains, "GROUP", group)
    rng = random.Random(3)
    lines = [rng.choice([*TEXTS, "  at f", "words"]) for _ in range(900)]
    for kinds in (["log at"], ["log at", "log at", "log"], ["log", "log {", "log }", "words", "log at"], ["log", "log {", "dump {"], ["  at f", "words"], ["log at", "  at f"], ["log {", "log", "log }", "}", "  File", "  body"]):
        lines += ["other", *(rng.choice(kinds) for _ in range(rng.choice([30, 150, 400])))]
    want, cut = check(spark, lines, cap)
    assert sum(w is not None for w in want) > 400 and len(cut) > 5


@pytest.mark.parametrize("block", [64, 8192])
def test_long_runs_of_one_identity(spark, monkeypatch, block):
    monkeypatch.setattr(chains, "BLOCK", block)
    want, cut = check(spark, ["log", *["log at"] * 20_000], 1000)
    assert list(cut) == list(range(1002, 20_002, 1001)) and want[1500] == 1002
    check(spark, ["words", *["log at"] * 9_000, "", "  at f", *["log", "log at", "log at"] * 2_000], 1000)


def test_braces_that_belong_to_no_event(spark):
    assert check(spark, ["log", "dump {", "log", "log", "log"], 1000)[0] == [None] * 5
    # the cap ends an event with an open brace; what begins there has none
    assert check(spark, ["log {", *["log"] * 11], 5)[0] == [None, *[1] * 5, *[None] * 6]
    assert check(spark, ["root {", *["words"] * 11], 5)[0] == [None, *[1] * 5, *[None] * 6]


def test_closing_lines():
    rng = random.Random(8)
    import numpy as np

    for _ in range(200):
        texts = [rng.choice(["{", "}", "{{", "}{", "}}", "", "", "{}"]) for _ in range(rng.randint(1, 25))]
        net = [t.count("{") - t.count("}") for t in texts]
        own = [0 if t == "" else {"{": 1, "}": 0, "{{": 2, "}{": 1, "}}": 0, "{}": 0}[t] for t in texts]
        found = chains._closing(np.array(net), np.array(own))
        for i, depth in enumerate(own):
            at = i
            while depth and at + 1 < len(texts):
                at += 1
                depth = max(depth + net[at], own[at])
            if own[i]:
                assert found[i] == (at if not depth else len(texts))


def test_lines_without_a_prefix_link_to_nothing(spark):
    texts = spark.range(30_000).selectExpr("'s' AS source", "id + 1 AS ordinal", "CASE id % 3 WHEN 0 THEN '  at a' WHEN 1 THEN 'dump {' ELSE '}' END AS text")
    found = parse(texts, "plain").entries
    assert found.where("continuation_of IS NOT NULL OR chained").count() == 0 and found.count() == 30_000


def test_brace_effect(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("{}a") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    from pyspark.sql import functions as F

    a, b = chains.brace_effect(F.col("x"))
    for r in spark.createDataFrame([(x,) for x in texts], "x string").select("x", a.alias("a"), b.alias("b")).collect():
        for start in range(6):
            d = start
            for c in r["x"]:
                d = d + 1 if c == "{" else max(0, d - 1) if c == "}" else d
            assert max(start + r["a"], r["b"]) == d
