"""Roll-up and symbol context over a stream of results or statements.

State is kept per document and session: once no row of a document has arrived for
``gap`` (and the watermark has passed), its result is emitted and its state dropped.
That is the streaming form of releasing a document's context when it is done.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docaudit.operators.context import as_of, first_resolution, needed_predicates, resolution
from docaudit.operators.findings import is_finding
from docaudit.session import keep_state_in_rocksdb


def read_json_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def live_rollup(results: DataFrame, ts: str, delay: str = "10 minutes", gap: str = "30 minutes",
                strictness: str = "strict") -> DataFrame:
    """Counts per document and verifier; redelivered snippets are counted once."""
    fresh = results.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["paper_id", "snippet_id"])
    return fresh.groupBy("paper_id", "verifier_name", F.session_window(ts, gap).alias("session")).agg(
        F.count("*").alias("snippets_verified"),
        F.count_if(is_finding(strictness)).alias("errors_detected"),
        F.max(F.when(is_finding(strictness), F.col("confidence"))).alias("top_confidence"),
    )


def live_symbols(declarations: DataFrame, ts: str, delay: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Merged declarations per document and symbol: the first known domain and the first
    definition win, whatever the arrival order, since each statement carries its index."""
    known, defined = F.col("domain") != "unknown", F.col("definition").isNotNull()
    at = F.struct("order_idx", "snippet_id")
    return (
        declarations.withWatermark(ts, delay)
        .groupBy("paper_id", "symbol", F.session_window(ts, gap).alias("session"))
        .agg(
            F.coalesce(F.min_by("domain", F.when(known, at)), F.lit("unknown")).alias("domain"),
            F.min_by("definition", F.when(defined, at)).alias("definition"),
            F.min_by("snippet_id", at).alias("source_snippet"),
            F.min("order_idx").alias("first_seen"),
        )
    )


# The context of a document as one stream: declarations, uses and obligations arrive in any order and late.

EVENT = (
    "paper_id string, kind string, symbol string, snippet_id string, order_idx long, domain string, definition string,"
    " obligation_id string, need array<string>"
)
FACTS = (
    "domain string, domain_from long, definition string, defined_from long, source_snippet string,"
    " first_seen long, began_unknown boolean"
)
PENDING = "kind string, symbol string, snippet_id string, order_idx long, obligation_id string, need array<string>"
RELEASED = f"paper_id string, {PENDING}, {FACTS}, released timestamp"


def context_events(declarations: DataFrame, uses: DataFrame, obligations: DataFrame, ts: str = "ts") -> DataFrame:
    """One table of what the three tables say, as ``live_context`` reads it; an obligation has a row per symbol."""
    tables = {
        "declaration": declarations,
        "use": uses,
        "obligation": obligations.withColumn("need", needed_predicates(F.col("condition"))).withColumn("symbol", F.explode_outer("depends_on")),
    }
    names = [f.split()[0] for f in EVENT.split(", ")]
    types = dict(f.split() for f in EVENT.split(", "))
    out = None
    for kind, df in tables.items():
        df = df.withColumn("kind", F.lit(kind))
        rows = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(types[c]).alias(c) for c in names], ts)
        out = rows if out is None else out.unionByName(rows)
    return out


def missing(value) -> bool:
    """None or a number that is none; lists are there, empty ones too."""
    return not hasattr(value, "__len__") and (value is None or value is pd.NA or value != value)


def merge(held: list, order: int, snippet: str | None, domain: str | None, definition: str | None) -> None:
    """Takes a statement into a symbol's facts: (order_idx, snippet_id, value) of the first statement, the first known
    domain and the first definition; ties go to the least snippet and value."""
    for i, value, counts in ((0, domain, True), (3, domain, domain != "unknown"), (6, definition, not missing(definition))):
        if counts and (held[i] is None or (order, snippet, value) < tuple(held[i : i + 3])):
            held[i : i + 3] = order, snippet, value


class SymbolState(StatefulProcessor):
    """The facts of a document's symbols, as small as a merged declaration each, and what waits for them.

    Facts are minima over the statements' positions, so the order of arrival is of no account. Uses and obligations wait
    until the document has been quiet for ``gap``: an earlier statement may still come until then. One
    event-time timer stands per document, moved on by its latest row; when it fires, all is emitted and cleared.
    """

    def __init__(self, ts: str, gap_ms: int):
        self.ts, self.gap = ts, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        firsts = "order_idx long, snippet_id string, domain string, dom_order long, dom_snippet string, known string, def_order long, def_snippet string, definition string"
        self.handle = handle
        self.facts = handle.getMapState("facts", "symbol string", firsts)
        self.pending = handle.getListState("pending", PENDING)
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Rows are read as plain values: most documents have few at a time, and a pandas call costs more than all of them."""
        last = self.last.get()
        newest = last[0] if last else None
        held: dict[str, list] = {}
        for batch in rows:
            at = int(batch[self.ts].max().timestamp() * 1000)
            newest = at if newest is None else max(newest, at)
            columns = (batch[c].tolist() for c in ("kind", "symbol", "snippet_id", "order_idx", "obligation_id", "need", "domain", "definition"))
            waits = []
            for kind, symbol, snippet, order, obligation, need, domain, definition in zip(*columns, strict=True):
                if kind == "declaration":
                    if not missing(symbol):
                        if symbol not in held:
                            held[symbol] = list(self.facts.getValue((symbol,)) or (None,) * 9)
                        if not missing(order):
                            merge(held[symbol], int(order), snippet, domain, definition)
                elif kind in ("use", "obligation"):
                    waits.append((kind, *(None if missing(v) else v for v in (symbol, snippet)), None if missing(order) else int(order), None if missing(obligation) else obligation, None if missing(need) else list(need)))
            if waits:
                self.pending.appendList(waits)
        for symbol, facts in held.items():
            self.facts.updateValue((symbol,), tuple(facts))
        if not last or newest > last[0]:
            if last:
                self.handle.deleteTimer(last[0] + self.gap)
            self.handle.registerTimer(newest + self.gap)
            self.last.update((newest,))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        released = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms", tz="UTC")
        facts = {s[0]: tuple(f) for s, f in self.facts.iterator()}

        def known(symbol) -> tuple:
            f = facts.get(symbol)
            return (f[5] or "unknown", f[3], f[8], f[6], f[1], f[0], f[2] == "unknown") if f else (None,) * 7

        rows = [("symbol", s, None, None, None, None, *known(s)) for s in facts]
        rows += [(*p[:5], None if p[5] is None else list(p[5]), *known(p[1])) for p in map(tuple, self.pending.get())]
        for state in (self.facts, self.pending, self.last):
            state.clear()
        names = [f.split()[0] for f in f"{PENDING}, {FACTS}".split(", ")]
        out = pd.DataFrame(rows, columns=names, dtype=object)
        for c in ("order_idx", "domain_from", "defined_from", "first_seen"):
            out[c] = pd.array(out[c], dtype="Int64")
        out["began_unknown"] = pd.array(out["began_unknown"], dtype="boolean")
        out.insert(0, "paper_id", key[0])
        out["released"] = released
        yield out

    def close(self) -> None:
        pass


def live_context(events: DataFrame, ts: str = "ts", delay: str = "10 minutes", gap_minutes: int = 30, shards: int = 1) -> DataFrame:
    """What is known of each symbol, at each use and for each obligation, once a document is finished.

    A document is finished when none of its rows has come for ``gap_minutes`` of event time and the watermark, ``delay``
    behind the newest row, has passed that point; then its rows are emitted and its state is gone. Rows may arrive
    in any order; what comes later than the watermark is dropped, and a row after the end begins the document anew.
    ``shards`` spreads a document's symbols over so many keys, for documents of many rows; each shard
    then also sees the times of all the document's rows, so that all finish together.
    The state has several parts, which Spark keeps in RocksDB only: a session with the default store is set to that.
    Read the result through ``released_symbols``, ``released_uses`` and ``released_obligations``.
    """
    keep_state_in_rocksdb(events.sparkSession)
    own = F.pmod(F.xxhash64(F.coalesce("symbol", F.lit(""))), F.lit(shards)).cast("int")
    rows = events.withWatermark(ts, delay)
    if shards > 1:
        rows = rows.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        keep = F.col("shard") == own
        rows = rows.withColumns({c: F.when(keep, F.col(c)) for c in ("kind", "snippet_id", "order_idx", "domain", "definition", "obligation_id", "need")})
    else:
        rows = rows.withColumn("shard", F.lit(0))
    return rows.groupBy("paper_id", "shard").transformWithStateInPandas(SymbolState(ts, gap_minutes * 60_000), RELEASED, "Append", "EventTime", eventTimeColumnName="released")


def released_symbols(released: DataFrame) -> DataFrame:
    """The rows of ``context.merge_declarations``."""
    return released.where("kind = 'symbol'").select("paper_id", "symbol", *[f.split()[0] for f in FACTS.split(", ")])


def released_uses(released: DataFrame) -> DataFrame:
    """The rows of ``context.context_before``."""
    return as_of(released.where("kind = 'use'"))


def released_obligations(released: DataFrame) -> DataFrame:
    """The rows of ``context.resolve_obligations``: the symbols' shards of a document meet, all having the same release time."""
    rows = resolution(released.where("kind = 'obligation'").withColumnRenamed("need", "_need"))
    return first_resolution(rows, "paper_id", "obligation_id", "released").drop("released")
