"""Operators that work in rounds against what one walk over a document gives."""

import random
from collections import Counter

from docaudit.operators import align, context


def walked(pairs):
    ones, twos, out = set(), set(), []
    for order, a, b in sorted(pairs):
        if a not in ones and b not in twos:
            ones.add(a)
            twos.add(b)
            out.append((order, a, b))
    return out


def test_first_wins(spark):
    rng = random.Random(6)
    rows = []
    for p in range(30):
        n = rng.randint(0, 60)
        rows += [(p, k, rng.randrange(1 + n // 3), rng.randrange(1 + n // 2)) for k in rng.sample(range(200), n)]
    rows += [(99, k, (k + 1) // 2, k // 2) for k in range(20)]  # each pair waits for the one before
    df = spark.createDataFrame(rows, "paper_id int, listed int, a int, b int").repartition(5)
    got = Counter(map(tuple, align.first_wins(df, "paper_id", "a", "b", "listed").collect()))
    want = Counter()
    for p in {r[0] for r in rows}:
        want.update((p, *t) for t in walked([r[1:] for r in rows if r[0] == p]))
    assert got == want
    assert align.first_wins(df.limit(0), "paper_id", "a", "b", "listed").count() == 0


def test_many_pairs_of_one_document(spark):
    n = 100_000
    pairs = spark.range(n).selectExpr("1 AS paper_id", "id AS listed", f"pmod(xxhash64(id), {n // 2}) AS a", f"pmod(xxhash64(id, 1), {n // 2}) AS b")
    want = walked([tuple(r)[1:] for r in pairs.collect()])
    got = align.first_wins(pairs, "paper_id", "a", "b", "listed").collect()
    assert sorted(tuple(r)[1:] for r in got) == want


def test_judge_answers(spark):
    raw = '[{"annotation_index": 0, "prediction_index": 1, "reasoning": "r"}, {"annotation_index": "0", "prediction_index": 0}, {"annotation_index": 5, "prediction_index": 0}, {"annotation_index": 1, "prediction_index": 0}]'
    rows = [("p", raw, 2, 2), ("q", None, 2, 2), ("r", "not json", 1, 1), ("s", "[]", 1, 1)]
    df = spark.createDataFrame(rows, "paper_id string, matches string, n_annotations int, n_predictions int")
    assert {(r.paper_id, r.ann_idx, r.pred_idx, r.reasoning) for r in align.judged_pairs(df).collect()} == {("p", 0, 1, "r"), ("p", 1, 0, "")}


def reached(edges):
    after = {}
    for p, a, b in edges:
        after.setdefault((p, a), set()).add(b)
    out = set()
    for p, a in after:
        todo, seen = [a], set()
        while todo:
            for c in after.get((p, todo.pop()), ()):
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        out |= {(p, a, c) for c in seen if c != a}
    return out


def test_closure(spark):
    rng = random.Random(2)
    edges = [(0, k, k + 1) for k in range(300)] + [(1, k, (k + 1) % 40) for k in range(40)] + [(1, 3, 3)]
    edges += [(2, rng.randrange(60), rng.randrange(60)) for _ in range(90)] * 2
    df = spark.createDataFrame(edges, "paper_id int, from_snippet int, to_snippet int").repartition(4)
    got = context.transitive_dependencies(df).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == reached(edges)
    assert context.transitive_dependencies(df.limit(0)).count() == 0
