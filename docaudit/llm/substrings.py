"""Exact substring de-duplication: winnowed anchors are joined and extended to whole windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docaudit.llm.common import documents, frequent, pair, raw, signed, slices, spanned, stored, word_hashes

WINDOW = 13  # words
GRAM = 5  # words of an anchor; every window holds the least gram of its own WINDOW - GRAM + 1
EDGE = np.uint64(0x5851F42D4C957F2D)  # stands for what lies before and after a text
SHARE = 20_000  # keys with more than this part of all occurrences never go through a shuffle

# An anchor's context is all that any window around it can hold: WINDOW - GRAM words to either side. Documents that share
# a context share every window around the anchor, which settles most repeats with one row for each anchor;
# only where contexts of an anchor differ do its windows matter one by one.


def least_of(x: np.ndarray, width: int, least=np.minimum) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    size, n = 1, len(x) - width + 1
    while size * 2 <= width:
        x = least(x[: len(x) - size], x[size:])
        size *= 2
    return least(x[:n], x[width - size : width - size + n])


class Words:
    """Words of several texts in one row, WINDOW - GRAM edges between them; positions count from the first."""

    def __init__(self, texts: pa.Array):
        words, counts = word_hashes(texts)
        self.counts = counts
        pad = WINDOW - GRAM
        self.begin = np.cumsum(counts + pad) - counts  # place of each text's first word
        self.flow = np.full(int(counts.sum()) + pad * (len(counts) + 1), EDGE)
        row = np.repeat(np.arange(len(counts)), counts)
        self.place = np.arange(len(words)) + pad * (row + 1)
        self.flow[self.place] = words
        self.row = np.full(len(self.flow), -1)
        self.row[self.place] = row
        self.inside = np.zeros(len(self.flow) + 1, np.int64)
        np.cumsum(self.row >= 0, out=self.inside[1:])

    def whole(self, width: int) -> np.ndarray:
        """Whether ``width`` words of one text begin at each place."""
        n = len(self.flow) - width + 1
        return (self.inside[width : width + n] - self.inside[:n]) == width if n > 0 else np.zeros(0, bool)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places where a window begins, and two hashes of each."""
        at = np.flatnonzero(self.whole(WINDOW))
        return at, spanned(self.flow, WINDOW)[at], spanned(self.flow, WINDOW, EDGE)[at]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the anchors, hashes of gram and context, and for each window (as above) the place of its anchor."""
        none = np.zeros(0, np.int64)
        starts = np.flatnonzero(self.whole(WINDOW))
        if not len(starts):
            return none, none.view(np.uint64), none.view(np.uint64), none
        gram = spanned(self.flow, GRAM)
        width = WINDOW - GRAM + 1
        least = least_of(gram, width)[starts]
        own = starts.copy()  # the first place in the window with its least gram
        todo = np.arange(len(starts))
        while len(todo := todo[gram[own[todo]] != least[todo]]):
            own[todo] += 1
        at = np.unique(own)
        context = spanned(self.flow, 2 * WINDOW - GRAM)
        return at, gram[at], context[at - (WINDOW - GRAM)], own


def keys_of(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    return pair(h, c)


def busy_keys(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """(kind, key) of anchors (0), anchors with contexts (1) and windows (2) with a large part of all occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], []]
        for b in batches:
            for lo, hi in slices(b.column("text")):
                words = Words(b.column("text").slice(lo, hi - lo))
                _, h, c, _ = words.anchors()
                for kind, keys in enumerate((h, keys_of(h, c), words.windows()[1])):
                    held[kind].append(keys)
        for kind, parts in enumerate(held):
            keys, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, int))
            total = int(n.sum())
            much = n * share >= max(total, 2 * share)  # at least two of them
            out = pa.array(np.append(signed(keys[much]), 0), pa.int64(), mask=np.append(np.zeros(much.sum(), bool), True))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(much.sum() + 1, kind, np.int32)), out, pa.array(np.append(n[much], 0)), pa.array(np.append(np.zeros(much.sum(), int), total))], names=["kind", "key", "n", "total"])

    return frequent(docs.select("text").mapInArrow(run, "kind int, key long, n long, total long"), share=share)


class Busy:
    """The busy keys of each kind, and the least doc_id of those of kinds 1 and 2."""

    def __init__(self, rows):
        keys = [sorted(r["key"] for r in rows if r["kind"] == k) for k in range(3)]
        self.keys = [np.array(k, np.int64).view(np.uint64) for k in keys]
        for k in range(3):
            self.keys[k].sort()
        self.least = [np.full(len(k), np.iinfo(np.int64).max) for k in self.keys]

    def find(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """The place of each key among the busy ones of its kind, -1 for others."""
        busy = self.keys[kind]
        if not len(busy):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(busy, keys), len(busy) - 1)
        return np.where(busy[at] == keys, at, -1)


def least_ids(docs: DataFrame, busy: Busy) -> None:
    """Fill in the least doc_id of the busy keys; a task passes on one row for each of them at most."""
    shared = docs.sparkSession.sparkContext.broadcast(busy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        busy = shared.value
        least = [x.copy() for x in busy.least]
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, hi in slices(b.column("text")):
                words = Words(b.column("text").slice(lo, hi - lo))
                at, h, c, _ = words.anchors()
                for kind, where, keys in ((1, at, keys_of(h, c)), (2, *words.windows()[:2])):
                    found = busy.find(kind, keys)
                    np.minimum.at(least[kind], found[found >= 0], ids[lo:hi][words.row[where[found >= 0]]])
        for kind in (1, 2):
            at = np.flatnonzero(least[kind] != np.iinfo(np.int64).max)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(least[kind][at])], names=["kind", "at", "doc_id"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "kind int, at long, doc_id long").groupBy("kind", "at").agg(F.min("doc_id").alias("doc_id"))
    for r in rows.collect():  # two for each busy key at most, of which there are 2 * SHARE of a kind
        busy.least[r["kind"]][r["at"]] = r["doc_id"]


def anchor_marks(docs: DataFrame, shared) -> DataFrame:
    """(doc_id, tag, at, settled): anchors whose context an earlier document has (settled), and anchors to be extended.

    The others, which no other document has, do not come out. An anchor is to be extended where it is
    the first of its context, and the anchor occurs in other contexts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        busy = shared.value
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            tags = b.column("tag").to_numpy(zero_copy_only=False)
            for lo, hi in slices(b.column("text")):
                words = Words(b.column("text").slice(lo, hi - lo))
                at, h, c, _ = words.anchors()
                row = words.row[at]
                doc, tag, place = ids[lo:hi][row], tags[lo:hi][row], at - words.begin[row]
                both = keys_of(h, c)
                known = busy.find(1, both)
                much = busy.find(0, h) >= 0
                first = np.where(known >= 0, busy.least[1][known] if len(busy.keys[1]) else 0, np.iinfo(np.int64).min)
                # state: 0 to be compared, 1 settled, 2 to be extended
                state = np.where(known < 0, 0, np.where(doc > first, 1, 2))
                group = np.where(much, both, h)  # a busy anchor is grouped with its context
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(group)), pa.array(signed(c)), pa.array(much), pa.array(doc), pa.array(tag), pa.array(place.astype(np.int32)), pa.array(state.astype(np.int32))],
                    names=["grp", "context", "busy", "doc_id", "tag", "at", "state"],
                )

    rows = docs.mapInArrow(run, "grp long, context long, busy boolean, doc_id long, tag long, at int, state int")
    done = rows.filter("state > 0").select("doc_id", "tag", "at", (F.col("state") == 1).alias("settled"))
    open_ = rows.filter("state = 0").drop("state")
    same, group = W.partitionBy("grp", "context"), W.partitionBy("grp")
    open_ = open_.withColumn("first", F.min("doc_id").over(same))
    open_ = open_.withColumn("several", (F.min("context").over(group) < F.max("context").over(group)) & (F.min("doc_id").over(group) < F.max("doc_id").over(group)))
    settled = F.col("doc_id") > F.col("first")
    open_ = open_.filter(settled | F.col("several") | F.col("busy"))
    return open_.select("doc_id", "tag", "at", settled.alias("settled")).unionByName(done)


def window_marks(docs: DataFrame, marks: DataFrame, shared) -> DataFrame:
    """(doc_id, tag, at): windows around the anchors to be extended that an earlier document has.

    A window belongs to its least anchor. It is extended to both sides at once: equal windows meet in
    one group, so copies cost a row each, not a row for each pair.
    """
    wanted = marks.filter("not settled").groupBy("doc_id", "tag").agg(F.collect_set("at").alias("ats"))
    texts = docs.join(wanted, ["doc_id", "tag"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        busy = shared.value
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            tags = b.column("tag").to_numpy(zero_copy_only=False)
            ats = b.column("ats")
            for lo, hi in slices(b.column("text")):
                words = Words(b.column("text").slice(lo, hi - lo))
                if not words.counts.sum():
                    continue
                part = ats.slice(lo, hi - lo)
                row = pc.list_parent_indices(part).to_numpy()
                wanted = np.zeros(len(words.flow), bool)
                wanted[words.begin[row] + pc.list_flatten(part).to_numpy(zero_copy_only=False)] = True
                own = words.anchors()[3]
                where, one, two = words.windows()
                keep = wanted[own]
                where, one, two = where[keep], one[keep], two[keep]
                row = words.row[where]
                doc, tag, place = ids[lo:hi][row], tags[lo:hi][row], (where - words.begin[row]).astype(np.int32)
                known = busy.find(2, one)
                first = busy.least[2][known] if len(busy.keys[2]) else np.zeros(len(known), np.int64)
                state = np.where(known < 0, 0, np.where(doc > first, 1, 2)).astype(np.int32)
                go = state < 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[go]) for x in (signed(one), signed(two), doc, tag, place, state)], names=["one", "two", "doc_id", "tag", "at", "state"]
                )

    rows = texts.select("doc_id", "tag", "text", "ats").mapInArrow(run, "one long, two long, doc_id long, tag long, at int, state int")
    first = F.min("doc_id").over(W.partitionBy("one", "two"))
    met = rows.filter("state = 0").withColumn("first", first).filter(F.col("doc_id") > F.col("first"))
    return met.select("doc_id", "tag", "at").unionByName(rows.filter("state = 1").select("doc_id", "tag", "at"))


def kept_words(rows: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256; ``rows`` has the anchors and windows that are repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, anchors, windows in zip(b.column("text"), b.column("anchors"), b.column("windows"), strict=True):
                words = (text.as_py() or "").encode().split()
                n = len(words)
                change = np.zeros(n + 1, np.int64)
                for ats, before, after in ((anchors, WINDOW - GRAM, WINDOW), (windows, 0, WINDOW)):
                    if ats.is_valid and len(ats):
                        at = ats.values.to_numpy()
                        np.add.at(change, np.maximum(at - before, 0), 1)
                        np.add.at(change, np.minimum(at + after, n), -1)
                gone = np.cumsum(change[:n]) > 0
                kept = b" ".join(words) if not gone.any() else b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()])
                out.append((n, int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and kept_sha256 of the words that stay, joined by one space.

    A word goes if it lies in WINDOW consecutive words whose sequence also starts in a document with a smaller
    doc_id. Windows are judged on the input. Rows that repeat a doc_id are no earlier documents to each
    other; a row without a doc_id is later than all others, and returned without one. Texts of rows that share a doc_id, or
    have none, are told apart by 64-bit hashes. A null or blank text has no words. Other columns are ignored.
    """
    last = F.lit(int(np.iinfo(np.int64).max))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), last).alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("tag", F.xxhash64("text"))  # parts rows of one doc_id with other texts
    found = busy_keys(rows).collect()  # 2 * SHARE keys of a kind at most
    busy = Busy(found)
    if found:
        least_ids(rows, busy)
    shared = docs.sparkSession.sparkContext.broadcast(busy)
    marks = stored(anchor_marks(rows, shared), "repeat-anchors")
    settled = marks.filter("settled").select("doc_id", "tag", "at", F.lit(True).alias("anchor"))
    windows = window_marks(rows, marks, shared).select("doc_id", "tag", "at", F.lit(False).alias("anchor"))
    gone = settled.unionByName(windows).groupBy("doc_id", "tag").agg(
        F.collect_set(F.when(F.col("anchor"), F.col("at"))).alias("anchors"), F.collect_set(F.when(~F.col("anchor"), F.col("at"))).alias("windows")
    )
    out = kept_words(rows.join(gone, ["doc_id", "tag"], "left").select("doc_id", "text", "anchors", "windows"))
    return out.withColumn("doc_id", F.nullif("doc_id", last))


def op1_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return without_repeats(documents(spark, sf))
