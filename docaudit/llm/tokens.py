"""Token counts of a byte-level vocabulary from counts of its pre-tokens."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docaudit.llm.common import documents

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
HELD = 1_000_000  # pre-tokens whose counts a task holds


class PieceCounts:
    """How many pieces each distinct pre-token has; counted once while it is held."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        special = [regex.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        self.special = regex.compile("|".join(special)) if special else None
        self.pieces: dict[str, int] = {}

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """The text's pre-tokens with their counts, and its special strings, one token each."""
        parts = self.special.split(text) if self.special else [text]
        found = Counter(self.split(parts[0]))
        for p in parts[1:]:
            found.update(self.split(p))
        return found, len(parts) - 1

    def totals(self, texts: list[str]) -> list[int]:
        docs = [self.frequencies(t) for t in texts]
        new = list({p for freq, _ in docs for p in freq} - self.pieces.keys())
        if len(self.pieces) + len(new) > HELD:
            self.pieces, new = {}, list({p for freq, _ in docs for p in freq})
        self.pieces.update(zip(new, map(len, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        of = self.pieces
        return [n + sum(of[p] * k for p, k in freq.items()) for freq, n in docs]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    Each task holds the piece counts of the distinct pre-tokens it has met, counted once, joins
    them to its documents' pre-token frequencies and sums; no ids leave the tokenizer and no row
    is shuffled. A null or empty text has no token. Repeated rows count each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PieceCounts(path)
        for b in batches:
            texts = pc.fill_null(b.column("text"), "")
            n = [x for at in range(0, len(texts), 256) for x in counts.totals(texts[at : at + 256].to_pylist())]
            size = pc.binary_length(texts).cast(pa.int64())
            over = pa.array([x > limit for x in n], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, pa.array(n, pa.int64()), over], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def op2_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts(documents(spark, sf), public_tokenizers.path(VOCABULARY))
