"""Merkle manifest, personal data and whitening against brute force, on odd rows and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docaudit.llm import merkle, personal, whitening

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def written(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree_by_force(nodes):
    """The last digest, and per node the digests left and right of it, from the bottom up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p // 16 * 16 : p // 16 * 16 + 16]
            paths[i].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
        nodes = [sha(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        at = [p // 16 for p in at]
    return nodes[0], paths


def audit_by_force(rows):
    groups = defaultdict(list)
    for d, source, lang, n, text in rows:
        heads = [written(v) for v in (d, source, lang, n)]
        struck = d is not None and zlib.crc32(str(d).encode()) % 5 == 0
        low = text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        groups[source].append(((d is not None, d or 0, sha(*heads, written(text))), d, sha(*heads, written(low if struck else text))))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        groups[s].sort(key=lambda g: g[0])
        trees[s] = tree_by_force([g[0][2] for g in groups[s]])
    root, tops = tree_by_force([trees[s][0] for s in sources])
    out = Counter()
    for s, top in zip(sources, tops, strict=True):
        for (key, d, shown), path in zip(groups[s], trees[s][1], strict=True):
            at = shown
            for left, right in path + top:
                at = sha(left, at, right)
            out[(d, key[2], trees[s][0], root, sha(*(a + b for a, b in path + top)), at, at == root)] += 1
    return out


@pytest.mark.parametrize("sources", [["a"], ["a", None, "ä", "z", ""], [f"s{i}" for i in range(40)]])
def test_manifest(spark, sources):
    rng = random.Random(len(sources))
    rows = [(i, sources[0] if i % 3 else rng.choice(sources), rng.choice(["en", None]), rng.choice([None, 7]), rng.choice(["Ab c", "é\n漢", "", None, "low"])) for i in range(300)]
    rows += [(None, sources[0], None, None, None)] * 40 + [(5, sources[-1], "en", 1, "Same")] * 3 + [(-3, sources[0], "en", 1, "X" * 300_000)]
    rows += [(900, "alone", None, None, "LONE"), (901, "pair", None, None, "One"), (902, "pair", None, None, "Two")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    docs = docs.withColumns({c: F.lit("?") for c in ("n", "at", "path", "digest", "found", "segments", "begun", "leaf", "merkle_source")})
    docs.write.parquet(path := f"{merkle.stored.__globals__['ensure_checkpoint_dir'](spark)}/docs-{len(sources)}.dir/documents.parquet")
    got = merkle.op11_merkle(spark, path.rsplit("/", 1)[0])
    assert Counter(map(tuple, got.collect())) == audit_by_force(rows)


def test_manifest_of_little(spark):
    assert merkle.audit(spark.createDataFrame([], SCHEMA), F.col("text")).count() == 0
    one = [(1, "a", "en", 1, "Text")]
    row = merkle.audit(spark.createDataFrame(one, SCHEMA), F.lit("other")).first()
    assert row.root == row.subroot == row.leaf and not row.verified and row.proof_sha256 == sha("")


def test_requests_for_some_leaves(spark):
    leaves = spark.range(700).select(F.lit("a").alias("source"), F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    tree = merkle.manifest(leaves)
    asked = tree.leaves.filter("doc_id in (0, 17, 699)").unionByName(tree.leaves.filter("doc_id = 17").withColumn("path", F.lit("fff")))
    got = merkle.proofs(tree, asked).withColumn("ok", merkle.folded(F.col("leaf"), F.col("segments")) == tree.root).collect()
    assert sorted((r.doc_id, r.found == r.leaf, r.ok) for r in got) == [(0, True, True), (17, True, True), (699, True, True)]


# The formats as they are written down; here a failing match is dropped, and no other start within it is tried.
PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def fits(kind, s):
    d = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base_by_force(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in p.finditer(text or "") if fits(k, m[0])]


def test_base_spans():
    rng = random.Random(2)
    parts = ["1", "2", "25", "0007", "256", "4111111111111111", "5500 0000-0000 0004", ".", "..", "-", " ", "  ", "@", "a", "b-", "_", "+", "+1", "(743)", "é", "\n", "x.y", "192.168.1.1", "bob@mail.com"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert [(personal.KINDS[k], a, b) for k, a, b in personal.base_spans(text)] == base_by_force(text)


def test_long_runs():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "+1" * 150_000, "a@b" * 100_000, "1 " * 150_000, "." * 300_000 + "@a.b"):
        spans = personal.base_spans(text)
        personal.candidates(text, spans)
    assert personal.base_spans("9" * 5000 + ".1.1.1") == []


def noise(rng):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(3, 12)))


@pytest.fixture(scope="module")
def planted():
    """Numbers called in a telling context, with and without the format; other numbers; addresses."""
    rng = random.Random(8)
    rows = []
    for i in range(40):
        rows.append((i, f"{noise(rng)} please call me on +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} after work {noise(rng)}"))
    for i in range(5):
        rows.append((100 + i, f"{noise(rng)} please call me on ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} after work {noise(rng)}"))
    for i in range(40):
        rows.append((200 + i, f"{noise(rng)} item no {rng.randint(10**6, 10**7)} {noise(rng)}"))
        rows.append((300 + i, f"{noise(rng)} u{i}@mail.example.com {noise(rng)} 4111111111111111 {noise(rng)}"))
    rows += [(400, None), (401, ""), (402, "1"), (403, "😀 é a@b.cd 😀"), (None, rows[0][1]), (None, None), rows[41], (404, rows[41][1]), (405, "word " * 40_000 + "call me on (222) 555-1234 after")]
    return rows


def test_personal(spark, planted):
    docs = spark.createDataFrame(planted, "doc_id long, text string").repartition(4)
    docs = docs.withColumns({c: F.lit(1) for c in ("a", "b", "seen", "kind", "start", "instance", "pattern", "base", "more", "spans")})
    got = personal.find_personal(docs).collect()
    texts = defaultdict(list)
    for d, t in planted:
        texts[d].append(t or "")
    assert len(got) == len(planted)
    for r in got:
        whole = [",".join(f"{k}:{a}:{b}" for k, a, b in base_by_force(t)) for t in texts[r.doc_id]]
        base = next(w for w in whole if sha(w) == r.base_sha256 and (r.spans or "").startswith(w))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [base.count(k + ":") for k in ("email", "ip", "card", "phone")]
        unseen = r.doc_id is not None and (100 <= r.doc_id < 105 or r.doc_id in (404, 405))
        assert (r.n_found == 1) == unseen, r
        if unseen:
            kind, a, b = r.spans.split(",")[-1].split(":")
            text = texts[r.doc_id][0]
            assert kind == "found_phone" and re.fullmatch(r"[0-9]{3}\) 555-[0-9]{4}", text[int(a) : int(b)])
    assert personal.find_personal(docs.limit(0)).count() == 0


def discovered_by_force(edges, rounds, promote):
    kind = defaultdict(lambda: -1)
    for _, i, k in edges:
        kind[i] = max(kind[i], k)
    held = defaultdict(set)
    for p, i, _ in edges:
        held[p].add(i)
    n = Counter(kind.values())
    prior = [personal.PRIOR * n[k] / max(len(kind), 1) for k in range(4)]
    score, before = {}, -1
    for _ in range(rounds):
        found = defaultdict(lambda: [0.0] * 4)
        for p, members in held.items():
            sums, weight = [0.0] * 4, personal.PRIOR
            for i in members:
                if kind[i] >= 0:
                    sums[kind[i]] += 1
                    weight += 1
                else:
                    k, s = score.get(i, (0, 0.0))
                    sums[k] += s
                    weight += max(s, personal.UNKNOWN)
            sure = [(a + b) / weight for a, b in zip(sums, prior, strict=True)]
            best = max(range(4), key=lambda k: (sure[k], -k))
            if sure[best] >= promote:
                for i in members:
                    if kind[i] < 0:
                        found[i][best] -= np.log1p(-min(sure[best], 0.999999))
        score = {i: (k, 1 - np.exp(-v[k])) for i, v in found.items() for k in [max(range(4), key=lambda k: (v[k], -k))]}
        if len(score) == before:
            break
        before = len(score)
    return score


def test_pattern_graph(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        known = rng.choice([-1, -1, 0, 2, 3])
        pool = range(12) if known in (-1, 3) else range(8, 24)
        rows.append((known, i if known >= 0 else 1000 + i % 90, [rng.choice(pool), rng.choice(pool)]))
    seen = spark.createDataFrame(rows, "known int, instance long, patterns array<long>")
    for promote in (0.5, 0.6, 0.8):
        want = discovered_by_force({(p, i, k) for k, i, ps in rows for p in ps}, 4, promote)
        got = {r.instance: (r.kind, r.score) for r in personal.discovered(seen, 4, promote).collect()}
        assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-9 for i in got)
        assert want or promote == 0.8


def eigen_error(a, x):
    """Largest entries of a x - x l and x'x - 1, with l the eigenvalues."""
    a, size = a.astype(whitening.Wide), len(a)
    value = np.einsum("ij,ij->j", x, a @ x)
    return float(max(np.abs(a @ x - x * value).max() / np.abs(a).max(), np.abs(x.T @ x - np.eye(size)).max()))


@pytest.mark.parametrize("values", [
    np.arange(1, 40.0), np.r_[1 + 1e-9 * np.arange(10), 1 + 1e-13 * np.arange(5), 2 + 1e-7 * np.arange(8), np.arange(3, 9.0)],
    np.r_[np.ones(15), np.zeros(15)], 2.0 ** -np.arange(50), 1 + 1e-8 * np.arange(40), np.full(6, 3.0), np.zeros(4), np.array([2.0]),
])
def test_eigenvectors(values):
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(len(values),) * 2))[0]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    if values.any():
        assert eigen_error(a, whitening.eigenvectors(a)) < 2e-17
    value, x = whitening.components(a)
    assert np.allclose(value, np.sort(values)[::-1], atol=1e-13 * max(values.max(), 1)) and np.abs(x.T @ x - np.eye(len(a))).max() < 1e-15


def whitened_by_force(rows, most=32):
    x = [(i, [int(np.floor(64 * c)) + 1_000_000 for c in v]) for i, v in rows]
    n, d = len(x), len(x[0][1])
    s = [sum(v[j] for _, v in x) for j in range(d)]
    o = [[n * c - t for c, t in zip(v, s, strict=True)] for _, v in x]
    z = np.array([[c / n for c in v] for v in o])
    v = z.T @ z / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    return [i for i, _ in x], n, [sum(c * c for c in v) for v in o], z @ q / np.sqrt(e), e / np.trace(v)


def test_whitening(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(200, 40)) * np.linspace(0.2, 3, 40)
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(base)] + [(7, [float(c) for c in base[7]]), (None, [0.5] * 40)]
    odd = [(900, None), (901, []), (902, [1.0] * 39), (903, [float("nan")] + [1.0] * 39), (904, [None] + [1.0] * 39), (905, [float("inf")] * 40), (906, [1e300] * 40)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(5).withColumns({"x": F.lit("x"), "v": F.lit(0), "component": F.lit(1)})
    got = whitening.whitened(table).collect()
    ids, n, deviation, white, explained = whitened_by_force(rows)
    assert len(got) == 32 * len(rows) and Counter(r.vec_id for r in got) == Counter({i: 32 * k for i, k in Counter(ids).items()})
    want = {(i, k + 1): (deviation[j], white[j, k]) for j, i in enumerate(ids) for k in range(32)}
    signs = {}
    for r in got:
        d, w = want[(r.vec_id, r.component)]
        assert (r.n, r.deviation) == (n, d) and abs(r.explained - explained[r.component - 1]) < 1e-12 and r.identity_error < 1e-12
        signs.setdefault(r.component, []).append((w, r.whitened))
    for pairs in signs.values():
        a, b = np.array(pairs).T
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    one = whitening.whitened(spark.createDataFrame([(1, [0.5, 2.0])], schema)).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained) for r in one] == [(1, 0, None, 0.0), (2, 0, None, 0.0)]
    flat = whitening.whitened(spark.createDataFrame([(i, [float(i), 1.0, 2.0 * i]) for i in range(9)], schema)).collect()
    assert {r.component: r.whitened is None for r in flat} == {1: False, 2: True, 3: True} and flat[0].identity_error < 1e-12
    huge = whitening.whitened(spark.createDataFrame([(1, [5e13]), (2, [-5e13])], schema)).collect()
    assert all(r.deviation is None and abs(abs(r.whitened) - 1) < 1e-9 for r in huge)
