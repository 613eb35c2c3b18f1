"""Digests before each statement against a summary of all that lies before, made anew for each."""

import random

import pytest
from pyspark.sql import functions as F

from docaudit.operators import digests

CAPS = {"symbols": 4, "definitions": 3, "assumptions": 3, "obligations": 2}
SIDES = (
    "paper_id string, snippet_id string, order_idx long",
    "paper_id string, snippet_id string, order_idx long, symbol string, domain string, definition string",
    "paper_id string, snippet_id string, order_idx long, description string",
    "paper_id string, order_idx long, obligation_id string, condition string",
)


def expected(paper, order, decl, assumed, obliged):
    rows = sorted((r for r in decl if r[0] == paper and r[2] < order and r[3] is not None), key=lambda r: (r[2], r[1]))
    symbols = {}
    for _, _, at, symbol, domain, definition in rows:
        s = symbols.setdefault(symbol, {})
        if domain not in (None, "unknown"):
            s.setdefault("domain", domain)
        if definition is not None:
            s.setdefault("defined_as", definition)
            s.setdefault("at", at)
    first = sorted((s["at"], name, s["defined_as"]) for name, s in symbols.items() if "at" in s)[:3]
    said = sorted(((r[2], r[3], r[1]) for r in assumed if r[0] == paper and r[2] < order and r[3] is not None), reverse=True)[:3]
    due = sorted(((r[1], r[2], r[3]) for r in obliged if r[0] == paper and r[1] < order and r[3] is not None), reverse=True)[:2]
    lines = [f"- [{s}] {d}" for _, d, s in said] + [f"- {s} = {d}" for _, s, d in first] + [f"- [{o}] {c}" for _, o, c in due]
    for name in sorted(symbols)[:4]:
        told = ", ".join(f"{k}={symbols[name][k]}" for k in ("domain", "defined_as") if k in symbols[name])
        lines.append(f"- {name}" + (f"  ({told})" if told else ""))
    return "\n".join(lines)


def made(rng):
    statements, decl, assumed, obliged = [], [], [], []
    for paper, n in (("hot", 400), ("a", 30), ("b", 3), ("bare", 5)):
        for i in range(n):
            at = rng.randrange(n)  # orders repeat
            statements.append((paper, f"s{i:03}", at))
            if paper == "bare":
                continue
            if rng.random() < 0.5:
                decl.append((paper, f"s{i:03}", at, f"x{rng.randrange(60):02}", rng.choice(["real", "integer", "unknown", None]), rng.choice([None, None, f"d{i}"])))
            if rng.random() < 0.4:
                assumed.append((paper, f"s{i:03}", at, rng.choice([None, f"said {i}"])))
            if rng.random() < 0.3:
                obliged.append((paper, at, f"o{i}", rng.choice([None, "x > 0"])))
    statements += [statements[0], (None, "s", 1), ("a", "s", None)]
    decl += [("a", "s1", 2, None, "real", "d"), (None, "s1", 2, "x", "real", "d")]
    return statements, decl, assumed, obliged


@pytest.fixture
def ranges(spark):
    """Small tables are not put into one range."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def test_digests_before(spark, ranges):
    sides = made(random.Random(3))
    frames = [spark.createDataFrame(r, s).repartition(3) for r, s in zip(sides, SIDES, strict=True)]
    pieces = frames[0].repartitionByRange("paper_id", "order_idx").withColumn("piece", F.spark_partition_id())
    assert pieces.where("paper_id = 'hot'").select("piece").distinct().count() > 3
    got = digests.digests_before(*frames, caps=CAPS).collect()
    want = [(p, s, o, expected(p, o, *sides[1:])) for p, s, o in sides[0] if p is not None and o is not None]
    assert sorted(map(tuple, got)) == sorted(want)
    assert any(w[3] == "" for w in want)


def test_no_rows(spark):
    frames = [spark.createDataFrame([], s) for s in SIDES]
    assert digests.digests_before(*frames).collect() == []


def test_summaries_merge():
    """A walk in one go and summaries of its parts, put together, say the same, wherever it is cut."""
    rng = random.Random(4)
    for _ in range(200):
        events = [(rng.randint(1, 3), i // 2, f"x{rng.randrange(9)}", f"s{i}", rng.choice(["unknown", "real", "c"]), rng.choice([None, f"d{i}"])) for i in range(rng.randint(0, 30))]
        # the operator sorts by kind, snippet, name where orders are equal
        events.sort(key=lambda e: (e[1], e[0], e[3], e[2]))
        cut = 2 * rng.randint(0, 15)
        whole, before, after = (digests.Summary(CAPS) for _ in range(3))
        for e in events:
            whole.add(*e)
            (before if e[1] < cut else after).add(*e)
        before = digests.Summary.load(before.dump(), CAPS)
        before.follow(digests.Summary.load(after.dump(), CAPS))
        assert before.dump() == whole.dump() or before.text() == whole.text()
