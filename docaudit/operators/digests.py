"""The digest of what is known before each statement of a document, for documents of any length.

Events are dealt out in ranges of (document, order) and walked range by range. What comes before a range is a
summary of bounded size: the caps of a digest bound what can still show in a later one, and summaries of
neighbouring ranges merge. So a document that crosses a border carries one row a range, and no task holds a document.
"""

from __future__ import annotations

import json
from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.session import stored

STATEMENT, DECLARATION, ASSUMPTION, OBLIGATION = range(4)
CAPS = {"symbols": 20, "definitions": 10, "assumptions": 10, "obligations": 5}


class Summary:
    """What a digest can still need of the events so far.

    The least symbols by name, the first definitions, the last assumptions and obligations: an entry that falls
    out of its list never comes back, since later events only add entries before it.
    """

    def __init__(self, caps: dict[str, int]) -> None:
        self.caps = caps
        self.symbols: dict[str, list[str | None]] = {}  # domain, definition; None where not known
        self.definitions: list[tuple[int, str, str]] = []
        self.assumptions: list[tuple[int, str, str]] = []
        self.obligations: list[tuple[int, str, str]] = []

    def declare(self, symbol: str, domain: str | None, definition: str | None) -> None:
        known = self.symbols.setdefault(symbol, [None, None])
        for i, value in enumerate((None if domain == "unknown" else domain, definition)):
            known[i] = value if known[i] is None else known[i]
        if len(self.symbols) > self.caps["symbols"]:
            del self.symbols[max(self.symbols)]

    def define(self, order: int, symbol: str, definition: str) -> None:
        if all(symbol != s for _, s, _ in self.definitions):
            insort(self.definitions, (order, symbol, definition))
            del self.definitions[self.caps["definitions"] :]

    def recall(self, section: str, entry: tuple[int, str, str]) -> None:
        last = getattr(self, section)
        insort(last, entry)
        del last[: -self.caps[section]]

    def add(self, kind: int, order: int, name: str | None, snippet: str | None, one: str | None, two: str | None) -> None:
        if kind == DECLARATION and name is not None:
            self.declare(name, one, two)
            if two is not None:
                self.define(order, name, two)
        elif kind == ASSUMPTION and one is not None and snippet is not None:
            self.recall("assumptions", (order, one, snippet))
        elif kind == OBLIGATION and one is not None and name is not None:
            self.recall("obligations", (order, name, one))

    def follow(self, later: Summary) -> None:
        """Take in the summary of what comes right after."""
        for symbol, known in later.symbols.items():
            self.declare(symbol, *known)
        for entry in later.definitions:
            self.define(*entry)
        for section in ("assumptions", "obligations"):
            for entry in getattr(later, section):
                self.recall(section, entry)

    def dump(self) -> str:
        return json.dumps([self.symbols, self.definitions, self.assumptions, self.obligations])

    @classmethod
    def load(cls, text: str, caps: dict[str, int]) -> Summary:
        out, parts = cls(caps), json.loads(text)
        out.symbols = parts[0]
        out.definitions, out.assumptions, out.obligations = ([tuple(e) for e in p] for p in parts[1:])
        return out

    def text(self) -> str:
        lines = [f"- [{snippet}] {said}" for _, said, snippet in reversed(self.assumptions)]
        lines += [f"- {symbol} = {definition}" for _, symbol, definition in self.definitions]
        lines += [f"- [{name}] {condition}" for _, name, condition in reversed(self.obligations)]
        for symbol in sorted(self.symbols):
            told = [f"{label}={v}" for label, v in zip(("domain", "defined_as"), self.symbols[symbol], strict=True) if v is not None]
            lines.append(f"- {symbol}" + (f"  ({', '.join(told)})" if told else ""))
        return "\n".join(lines)


def _events(statements: DataFrame, declarations: DataFrame, assumptions: DataFrame, obligations: DataFrame) -> DataFrame:
    def events(df: DataFrame, kind: int, name: str | None, snippet: str | None, one: str | None = None, two: str | None = None) -> DataFrame:
        def text(c: str | None) -> Column:
            return (F.lit(None) if c is None else F.col(c)).cast("string")

        named = zip((name, snippet, one, two), ("name", "snippet_id", "one", "two"), strict=True)
        return df.select("paper_id", F.col("order_idx").cast("bigint").alias("order_idx"), F.lit(kind).alias("kind"), *[text(c).alias(a) for c, a in named])

    out = events(statements, STATEMENT, None, "snippet_id")
    out = out.unionByName(events(declarations, DECLARATION, "symbol", "snippet_id", "domain", "definition"))
    out = out.unionByName(events(assumptions, ASSUMPTION, None, "snippet_id", "description"))
    return out.unionByName(events(obligations, OBLIGATION, "obligation_id", None, "condition")).where(F.col("paper_id").isNotNull() & F.col("order_idx").isNotNull())


def _in_order(df: DataFrame) -> DataFrame:
    """Rows of each range in order: what is carried in, then the events, statements first where orders are equal."""
    order = [F.col(c).asc_nulls_first() for c in ("order_idx", "kind", "snippet_id", "name")]
    return df.repartition("paper_id", "piece").sortWithinPartitions("paper_id", "piece", *order)


def digests_before(statements: DataFrame, declarations: DataFrame, assumptions: DataFrame, obligations: DataFrame,
                   caps: dict[str, int] | None = None) -> DataFrame:
    """(paper_id, snippet_id, order_idx, digest) per statement: the text of ``context.digest_text`` over all
    that lies strictly before it; an empty text where nothing does.

    Tables as in ``context``; assumptions have paper_id, snippet_id, order_idx, description. Rows without a paper_id or an
    order are passed over, as are entries without their text. Repeated statements each give a row.
    """
    caps = CAPS | (caps or {})
    kind = statements.schema["paper_id"].dataType.simpleString()
    events = _events(statements, declarations, assumptions, obligations)
    events = stored(events.repartitionByRange("paper_id", "order_idx").withColumn("piece", F.spark_partition_id()), "events")
    spread = events.groupBy("paper_id").agg(F.min("piece").alias("a"), F.max("piece").alias("b")).where(F.col("a") < F.col("b")).select("paper_id")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, paper_type = None, None, None
        for b in batches:
            out, paper_type = [], b.schema.field("paper_id").type
            for paper, piece, kind, order, name, snippet, one, two in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (paper, piece) != key:
                    if held is not None:
                        out.append((*key, held.dump()))
                    key, held = (paper, piece), Summary(caps)
                held.add(kind, order, name, snippet, one, two)
            yield _batch(out, ["paper_id", "piece", "one"], [paper_type, pa.int32(), pa.string()])
        if held is not None:
            yield _batch([(*key, held.dump())], ["paper_id", "piece", "one"], [paper_type, pa.int32(), pa.string()])

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = None, Summary(caps)
        for b in batches:
            out = []
            for paper, piece, summary in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if paper != of:
                    of, held = paper, Summary(caps)
                out.append((paper, piece, held.dump()))
                held.follow(Summary.load(summary, caps))
            yield _batch(out, ["paper_id", "piece", "one"], [b.schema.field("paper_id").type, pa.int32(), pa.string()])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, text = None, Summary(caps), None
        for b in batches:
            out = []
            for paper, piece, kind, order, name, snippet, one, two in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (paper, piece) != key:
                    key, held, text = (paper, piece), Summary(caps), None
                if order is None:
                    held, text = Summary.load(one, caps), None
                elif kind == STATEMENT:
                    text = held.text() if text is None else text
                    out.append((paper, snippet, order, text))
                else:
                    held.add(kind, order, name, snippet, one, two)
                    text = None
            yield _batch(out, ["paper_id", "snippet_id", "order_idx", "digest"], [b.schema.field("paper_id").type, pa.string(), pa.int64(), pa.string()])

    columns = ["paper_id", "piece", "kind", "order_idx", "name", "snippet_id", "one", "two"]
    state = f"paper_id {kind}, piece int, one string"
    several = events.join(spread, "paper_id", "left_semi")  # statements too: a range may hold nothing else, and add() passes over them
    sums = _in_order(several).select(*columns).mapInArrow(summed, state)
    carry = sums.repartition("paper_id").sortWithinPartitions("paper_id", "piece").select("paper_id", "piece", "one").mapInArrow(carried, state)
    return _in_order(events.unionByName(carry, allowMissingColumns=True)).select(*columns).mapInArrow(
        told, f"paper_id {kind}, snippet_id string, order_idx bigint, digest string"
    )


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
