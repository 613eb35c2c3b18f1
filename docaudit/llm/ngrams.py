"""Language-model scores: stupid backoff over word pairs, from count tables that are partitioned by hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.common import documents, pair, signed, slices, word_hashes

BACKOFF = 0.4
BLOCK_BYTES = 12 << 20  # text of the documents that are exploded together
PART_KEYS = 2_000_000  # n-grams, counted once per block, in a partition of the count tables


class Grams:
    """The words and word pairs of a block of documents.

    keys holds each distinct one, in order; words and pairs give the place in it of each word, and of the pair
    that it ends (-1 for a document's first word).
    """

    def __init__(self, texts: pa.Array):
        parts = [word_hashes(texts.slice(lo, hi - lo)) for lo, hi in slices(texts)]
        words = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
        self.lengths = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        del parts
        # A block has few enough words for 32 bits, which halves what its places take.
        self.row = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        self.first = np.ones(len(words), bool)
        self.first[1:] = self.row[1:] != self.row[:-1]
        inner = np.flatnonzero(~self.first)
        both = np.concatenate([words, pair(words[inner - 1], words[inner])])
        n = len(words)
        del words
        self.keys, at, self.counts = np.unique(both, return_inverse=True, return_counts=True)
        del both
        self.at = at.astype(np.int32)
        self.words = self.at[:n]
        self.pairs = np.full(n, -1, np.int32)
        self.pairs[inner] = self.at[n:]
        self.rows = np.concatenate([self.row, self.row[inner]])

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """How often its document has each word, and each pair."""
        _, where, n = np.unique(self.rows.astype(np.int64) * max(len(self.keys), 1) + self.at, return_inverse=True, return_counts=True)
        n = n[where]
        pairs = np.zeros(len(self.words), np.int64)
        pairs[~self.first] = n[len(self.words) :]
        return n[: len(self.words)], pairs

    def parts(self, n: int) -> np.ndarray:
        """Where each of ``n`` hash partitions begins and ends in keys."""
        of = ((self.keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
        return np.searchsorted(of, np.arange(n + 1, dtype=np.uint64))


def sizes(docs: DataFrame) -> tuple[int, int]:
    """Bytes and words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            words = sum(int(word_hashes(texts.slice(lo, hi - lo))[1].sum()) for lo, hi in slices(texts))
            yield pa.RecordBatch.from_arrays([pa.array([words])], names=["words"])

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    return int(size or 0), int(docs.select("text").mapInArrow(run, "words long").agg(F.sum("words")).first()[0] or 0)


def joined(column: pa.ChunkedArray) -> pa.Array:
    out = column.combine_chunks()
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def lm_scores(docs: DataFrame, backoff: float = BACKOFF) -> DataFrame:
    """Per row: doc_id, n_words, log_score (natural), mean_log_score.

    A word w after v scores c(v w) / c(v), if the pair occurs in another document, else ``backoff`` times c(w) / N, if the
    word does, else ``backoff`` squared / (N + 1). Counts are of all documents without the one that is scored;
    a first word has no pair. A null or blank text has no words and scores 0. Repeated rows are documents
    of their own; other columns are ignored.

    Documents are dealt out in blocks. A block sends each of its distinct words and pairs once, with its count, to
    the partition of the count tables that holds it, and gets the total count back in the same order; so a pair that
    fills the corpus costs a row a block. The block then joins totals to its documents' n-grams and sums.
    """
    size, total = sizes(docs.select(F.col("text").cast("string")))
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    n_parts = max(1, -(-2 * total // PART_KEYS))
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.pmod(F.xxhash64(F.col("doc_id").cast("long"), text), F.lit(n_blocks)).cast("int").alias("block"))

    def send(block: pa.Table) -> pa.Table:
        g = Grams(joined(block["text"]))
        cuts = g.parts(n_parts)
        full = np.flatnonzero(np.diff(cuts))
        offsets = pa.array(np.append(cuts[full], cuts[-1:]).astype(np.int32))
        keys = pa.ListArray.from_arrays(offsets, pa.array(signed(g.keys)))
        counts = pa.ListArray.from_arrays(offsets, pa.array(g.counts.astype(np.int32)))
        own = block["block"][0].as_py()
        return pa.table({"part": pa.array(full.astype(np.int32)), "block": pa.array(np.full(len(full), own, np.int32)), "keys": keys, "counts": counts})

    def count(part: pa.Table) -> pa.Table:
        lists = joined(part["keys"])
        keys = lists.flatten().to_numpy(zero_copy_only=False)
        _, at = np.unique(keys, return_inverse=True)
        totals = np.bincount(at, weights=joined(part["counts"]).flatten().to_numpy(zero_copy_only=False)).astype(np.int64)
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        return pa.table({"block": joined(part["block"]), "part": joined(part["part"]), "totals": pa.ListArray.from_arrays(offsets, pa.array(totals[at]))})

    def score(block: pa.Table, totals: pa.Table) -> pa.Table:
        g = Grams(joined(block["text"]))
        order = np.argsort(joined(totals["part"]).to_numpy(zero_copy_only=False)) if len(totals) else np.zeros(0, int)
        lists = joined(totals["totals"]).take(pa.array(order)) if len(totals) else None
        counts = lists.flatten().to_numpy(zero_copy_only=False) if lists is not None else np.zeros(0, np.int64)
        own_word, own_pair = g.own()
        word = counts[g.words] - own_word
        both = np.where(g.first, 0, counts[g.pairs] - own_pair) if len(word) else word
        before = np.concatenate([[0], word[:-1]]) if len(word) else word
        left = total - g.lengths[g.row]
        seen, known = both > 0, word > 0
        logs = np.log(np.where(known, word, 1) / np.where(known, np.maximum(left, 1), left + 1)) + np.log(backoff) * np.where(known, 1, 2)
        logs = np.where(seen, np.log(np.maximum(both, 1) / np.where(seen, before, 1)), logs)
        sums = np.bincount(g.row, weights=logs, minlength=len(g.lengths))
        mean = sums / np.maximum(g.lengths, 1)
        return pa.table({"doc_id": joined(block["doc_id"]), "n_words": pa.array(g.lengths.astype(np.int64)), "log_score": pa.array(sums), "mean_log_score": pa.array(mean)})

    asked = rows.groupBy("block").applyInArrow(send, "part int, block int, keys array<long>, counts array<int>")
    told = asked.groupBy("part").applyInArrow(count, "block int, part int, totals array<long>")
    schema = "doc_id long, n_words long, log_score double, mean_log_score double"
    return rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, schema)


def op4_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    return lm_scores(documents(spark, sf))
