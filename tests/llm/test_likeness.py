"""The pipeline's near-duplicate stage against brute force."""

import random

import numpy as np

import corpus_pipeline
from docaudit.llm import likeness, simhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else frozenset([tuple(w)])


def kept_by_force(rows):
    """Ids of the rows that the smallest doc_id of their group has, groups by pairs of similarity 0.8 or more."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 9 * both >= 4 * (len(a) + len(sets[j])):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return set(least.values())


def stage(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]


def test_given_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert set(stage(spark, rows)) == kept_by_force(rows)


def test_planted_copies(spark):
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, " \n"), (2, "One two"), (3, "one  TWO"), (4, "one"), (None, "one two"), (5, "a b c d e"), (6, "a b c d e f")]
    common = [rng.choice(pool) for _ in range(25)]  # a passage in all the rest
    for _ in range(25):
        base = common + [rng.choice(pool) for _ in range(rng.randint(10, 150))]
        for _ in range(rng.randint(1, 6)):  # chains of copies, each changed a little or much
            rows.append((len(rows) + 10, " ".join(base)))
            base = [rng.choice(pool) if rng.random() < rng.choice([0.005, 0.02, 0.05]) else w for w in base]
    got = stage(spark, rows)
    assert None in got
    assert {d for d in got if d is not None} == kept_by_force(rows)
    assert 40 < len(got) < len(rows)


def test_fingerprints_link_first(spark):
    """SimHash puts copies with one changed word in a component; their sets are a pair to be checked."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(5000)}" for _ in range(3000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, "nothing like it at all"), (3, "and again"), (None, None)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    counted = likeness.named_and_counted(texts)
    k = {r.doc_id: r.k for r in counted.filter("doc_id < 3").collect()}
    assert [set(r) for r in likeness.fingerprint_pairs(texts, counted).collect()] == [set(k.values())] and len(k) == 2
    assert sorted(stage(spark, rows), key=str) == [1, 3, 3, None]


def test_fingerprint_links_of_all_members_are_compared(spark, monkeypatch):
    """Without the prefix filter: the first of a SimHash component is like none of the others, and those are alike."""
    rng = random.Random(4)
    passage, tail = ([f"{c}{rng.randrange(9000)}" for _ in range(51)] for c in "pt")
    texts = [" ".join(passage * 100 + t) for t in ([], tail, [*tail[:-1], "other"], [*tail[:-2], "some", "other"])]
    rows = [(1, texts[0]), (2, texts[1]), (3, texts[2]), (None, texts[3]), (5, "something else")]
    components = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).filter("component_id = 1")
    assert components.count() == 4
    monkeypatch.setattr(likeness, "candidates", lambda keyed: spark.createDataFrame([], "u long, v long, p long, n int, at int"))
    seen, saved = [], likeness.stored
    monkeypatch.setattr(likeness, "stored", lambda df, name: (out := saved(df, name), seen.append((name, out)))[0])
    assert sorted(stage(spark, rows), key=str) == [1, 2, 5, None]
    assert sum(df.count() for name, df in seen if name == "near-more") == 3  # the three pairs of the others


def test_pairs_that_share_a_passage_only_are_not_compared(spark, monkeypatch):
    """Texts made of passages that many others have: few pairs go on, and none that is alike is lost."""
    rng = random.Random(3)
    passages = [" ".join(f"w{rng.randrange(3000)}" for _ in range(20)) for _ in range(60)]
    rows = [(i, " ".join(rng.sample(passages, 6))) for i in range(200)]
    for i in range(200, 260):  # near copies of one of them, alike in part
        words = rows[7][1].split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"x{i}"
        rows.append((i, " ".join(words)))
    saved, seen = likeness.stored, []
    monkeypatch.setattr(likeness, "stored", lambda df, name: (out := saved(df, name), seen.append((name, out)))[0])
    assert set(stage(spark, rows)) == kept_by_force(rows)
    assert sum(df.count() for name, df in seen if name in ("near-pairs", "near-more")) < 1000


def test_parity_bits_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for n, m, both in [(1, 1, 0), (60, 70, 60), (64, 65, 64), (100, 130, 90), (500, 520, 450), (1000, 1030, 900)]:
        shared = rng.integers(0, 1 << 63, both, dtype=np.uint64)
        a, b = (np.concatenate([shared, rng.integers(0, 1 << 63, size - both, dtype=np.uint64)]) for size in (n, m))
        x, y = (np.frombuffer(likeness.parity(s, np.array([len(s)]))[0], np.uint64) for s in (a, b))
        apart = likeness.differing(x, [y, x], np.array([len(y), len(x)]))
        assert apart.tolist() == [likeness.differing(y, [x], np.array([len(x)]))[0], 0]
        assert apart[0] <= n + m - 2 * both
