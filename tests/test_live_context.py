"""The streaming context against the batch operators, on a shuffled and late stream."""

import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docaudit.operators import context
from docaudit.streaming import live

DECLARED = "paper_id string, symbol string, domain string, definition string, snippet_id string, order_idx long, ts timestamp"
USED = "paper_id string, symbol string, snippet_id string, order_idx long, ts timestamp"
OBLIGED = "paper_id string, obligation_id string, condition string, depends_on array<string>, order_idx long, ts timestamp"
CONDITIONS = ["denominator must be non-zero", "argument of log must be positive", "must be real", "nothing known"]
DOMAINS = ["unknown", "real", "positive", "integer", "complex", "matrix"]
SCHEMA = f"{live.EVENT}, ts timestamp"


def stamp(minute):
    return f"2024-01-{1 + minute // 1440:02d}T{minute // 60 % 24:02d}:{minute % 60:02d}:00Z"


@pytest.fixture(scope="module")
def tables(spark):
    """Documents of different lengths, one with most rows; every statement's time is within an hour of its document's start."""
    rng = random.Random(4)
    declared, used, obliged = [], [], []
    for p, n in [("a", 300), ("b", 20), ("c", 1), ("d", 40), ("e", 5)]:
        for k in range(n):
            t = stamp(100 * "abcde".index(p) + min(60, k * 60 // n))
            s = rng.choice("uvwxyz")
            if rng.random() < 0.5:
                declared.append((p, s, rng.choice(DOMAINS), rng.choice([None, f"d{k}"]), f"s{k}", k, t))
            used.append((p, s, f"s{k}", k, t))
            if rng.random() < 0.3:
                obliged.append((p, f"o{k}", rng.choice(CONDITIONS), rng.sample("uvwxyzq", rng.randint(0, 3)), k, t))

    def frame(rows, schema):
        text = schema.replace("ts timestamp", "ts string")
        return spark.createDataFrame(rows, text).withColumn("ts", F.to_timestamp("ts"))

    return frame(declared, DECLARED), frame(used, USED), frame(obliged, OBLIGED)


def dated(path, text):
    """A file whose time tells its place by name: a stream reads files in order of time, and those written at once tie."""
    path.write_text(text)
    os.utime(path, (1_700_000_000 + 60 * int(path.stem),) * 2)


def batches(tables, folder, seed):
    """Files of events: each document's rows shuffled, documents interleaved, then a row that ends them all."""
    rows = [r.asDict() for r in live.context_events(*tables).withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).collect()]
    rng = random.Random(seed)
    rng.shuffle(rows)
    rows.sort(key=lambda r: r["ts"][:13] + str(rng.random() < 0.3))  # out of order, at most by what the delay allows
    folder.mkdir()
    size = len(rows) // 6 + 1
    parts = [rows[i : i + size] for i in range(0, len(rows), size)]
    parts.append([{"paper_id": "end", "kind": "use", "symbol": "x", "snippet_id": "s", "order_idx": 0, "ts": "2025-01-01T00:00:00Z"}])
    for i, part in enumerate(parts):
        dated(folder / f"{i:02d}.json", "\n".join(json.dumps(r) for r in part))
    return len(parts)


def write(df, out, checkpoint, **trigger):
    q = df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(**trigger).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return q


def rows(df):
    return Counter(json.dumps(r.asDict(), sort_keys=True, default=str) for r in df.collect())


def stream(spark, folder, shards, per_trigger=1):
    src = live.read_json_stream(spark, str(folder), SCHEMA, files_per_trigger=per_trigger)
    return live.live_context(src, "ts", delay="120 minutes", gap_minutes=90, shards=shards)


@pytest.mark.parametrize("shards", [1, 3])
def test_equal_to_batch(spark, tables, tmp_path, shards):
    declared, used, obliged = tables
    batches(tables, tmp_path / "in", shards)
    merged = context.merge_declarations(declared)
    released = stream(spark, tmp_path / "in", shards)
    write(released, tmp_path / "rows", tmp_path / "c1", availableNow=True)
    got = spark.read.parquet(str(tmp_path / "rows"))
    assert rows(live.released_symbols(got)) == rows(merged.select(*live.released_symbols(got).columns))
    assert rows(live.released_uses(got)) == rows(context.context_before(used.drop("ts"), merged))
    write(live.released_obligations(released), tmp_path / "obliged", tmp_path / "c2", availableNow=True)
    got = spark.read.parquet(str(tmp_path / "obliged"))
    want = context.resolve_obligations(obliged, merged)
    assert rows(got.select(*want.columns)) == rows(want) and want.where("status = 'resolved'").count() > 5


def test_restart_and_released_state(spark, tables, tmp_path):
    declared, used, _ = tables
    n = batches(tables, tmp_path / "all", 9)
    (tmp_path / "in").mkdir()
    names = sorted(p.name for p in (tmp_path / "all").iterdir())
    merged = context.merge_declarations(declared)
    for part in (names[: n // 2], names[n // 2 : n - 1], names[n - 1 :]):  # the query ends and starts again from its checkpoint
        for name in part:
            dated(tmp_path / "in" / name, (tmp_path / "all" / name).read_text())
        write(stream(spark, tmp_path / "in", 2), tmp_path / "rows", tmp_path / "c", availableNow=True)
    got = spark.read.parquet(str(tmp_path / "rows"))
    assert rows(live.released_uses(got)) == rows(context.context_before(used.drop("ts"), merged))
    assert got.select("paper_id").distinct().count() == 5
    held = spark.read.format("statestore").option("path", str(tmp_path / "c")).option("stateVarName", "last").load()
    assert {r["key"]["paper_id"] for r in held.select("key").collect()} == {"end"}  # finished documents hold no state


def test_session_with_default_store(spark, tables, tmp_path):
    declared, used, _ = tables
    batches(tables, tmp_path / "in", 2)
    plain = spark.newSession()
    plain.conf.set("spark.sql.session.timeZone", "UTC")
    plain.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    write(stream(plain, tmp_path / "in", 1, per_trigger=10), tmp_path / "rows", tmp_path / "c", availableNow=True)
    got = spark.read.parquet(str(tmp_path / "rows"))
    assert rows(live.released_uses(got)) == rows(context.context_before(used.drop("ts"), context.merge_declarations(declared)))


def test_facts_do_not_hang_on_the_order_of_statements():
    rng = random.Random(6)
    told = [(rng.randrange(5), f"s{rng.randrange(3)}", rng.choice(DOMAINS), f"d{rng.randrange(4)}") for _ in range(30)]
    told += [(0, "s0", "unknown", None), (0, "s0", "real", "d0")]
    known = [(o, s, d) for o, s, d, _ in told if d != "unknown"]
    defined = [(o, s, f) for o, s, _, f in told if f is not None]
    want = [*min((o, s, d) for o, s, d, _ in told), *min(known), *min(defined)]
    for _ in range(20):
        rng.shuffle(told)
        held = [None] * 9
        for statement in told:
            live.merge(held, *statement)
        assert held == want
    assert [live.missing(x) for x in (None, float("nan"), "", [], 0, "x")] == [True, True, False, False, False, False]
