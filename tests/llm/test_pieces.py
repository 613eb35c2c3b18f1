"""op10's likeness falls with the share of text that changed, in texts of one line too."""

import random
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from docaudit.llm import sketches
from docaudit.session import ensure_checkpoint_dir


def test_one_line(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(n))) for i, n in enumerate([600, 900, 3000, 700, 2000])]
    rows += [(10, "".join(rng.choice("bcdefgaklmno7") for _ in range(20000))), (11, ""), (12, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in sketches.op10_fingerprints(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i in (0, 1, 2, 3, 4, 10):
        assert 0.4 < got[i].near_edited <= 1 and got[i].near_next < 0.1
    # document 11 is followed by 10: nothing of an empty text is edited
    assert got[11].near_edited == 1 and got[11].fingerprint == got[11].edited_fingerprint


def test_only_ids_are_stored(spark, tmp_path):
    # Each pair with the next document differs in far more pieces than one table gives back.
    rng = random.Random(10)
    rows = [(i, "\n".join(" ".join(f"w{rng.randrange(9000)}" for _ in range(12)) for _ in range(rng.randrange(60, 300)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shared = Path(urlparse(spark.sparkContext.getCheckpointDir() or ensure_checkpoint_dir(spark)).path)
    before = set(shared.glob("*"))
    got = {r.doc_id: r for r in sketches.fingerprints(docs, sketches.piece_digests).collect()}
    new = [f for folder in set(shared.glob("*")) - before for f in folder.rglob("*.parquet")]
    columns = {c for f in new for c in spark.read.parquet(str(f)).columns}
    assert new and not columns & {"keys", "one", "two", "fingerprint"}
    # and the likeness is that of the sets themselves
    sets = {r.doc_id: set(r.k) for r in docs.select("doc_id", sketches.piece_digests(F.col("text")).alias("k")).collect()}
    for i in range(1, 40):
        a, b = sets[i], sets[i - 1]
        assert len(a ^ b) > 60 and got[i].near_next == pytest.approx(1 - len(a ^ b) / (len(a) + len(b)))


def test_larger_sketches_count_exactly(spark):
    rng = random.Random(11)
    rows = []
    for n, m, common in ((0, 0, 0), (1, 0, 3), (700, 650, 50), (30, 5, 4000), (3000, 0, 0), (2, 2, 0)):
        some = [rng.getrandbits(64) - 2**63 for _ in range(n + m + common)]
        rows.append((some[:n] + some[n + m:], some[n:], n + m))
    rows.append(([16 << 56, 17 << 56], [16 << 56, -1], 2))  # digests whose lower bits agree are told apart by the last splits
    df = spark.createDataFrame(rows, "one array<long>, two array<long>, n int")
    failed = F.struct(F.lit(0).alias("n"), F.lit(False).alias("done"))
    assert all(r.n == r.got for r in df.select("n", sketches.differing(F.col("one"), F.col("two"), failed).alias("got")).collect())


def test_units_are_those_of_one_search(spark):
    rng = random.Random(12)
    whole = r"(?<=\s)|(?<=[aeiou0-9]|[^\x00-\x7F])(?=\S{64})"
    lines = ["", " ", "  a", "a ", "\t\r\x0b\x0c", "e" * 64, "e" * 65, "e" * 65 + " ", "é" * 200, "\U0001f600" * 70 + " x "]
    lines += ["".join(rng.choice("ab7éz\U0001f600" + " \t" * rng.randrange(2)) * rng.choice((1, 1, 40)) for _ in range(rng.randrange(90))) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in lines], "line string").select("line", sketches.units(F.col("line")).alias("got"), F.split("line", whole).alias("want"))
    assert all(r.got == r.want and "".join(r.got) == r.line for r in df.collect())
