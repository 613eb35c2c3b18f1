"""Toxicity by class-conditional Kneser-Ney models of words, their beginnings and pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docaudit.llm.common import documents, free_name, pair, signed, stored, word_hashes
from docaudit.llm.ngrams import BLOCK_BYTES, joined

ENTRIES = 1 << 20  # entries of each table of the models that are broadcast, the most frequent ones; all others are joined
STEM_BYTES = 5  # bytes of a word's beginning
DISCOUNT = 3.0  # taken off each count, or the whole count if less: rare expressions rest on the shared counts
THRESHOLD = 0.3
TELLING = 3.0  # nats
PULL = 1e-4  # ridge of the weights
UNIT = float(1 << 36)  # sums of the fit are of whole 1 / UNIT, so that they do not hang on the order of the rows

# Letters in lower case make words; digits, signs and blanks part them. Bytes above 127 belong to letters.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PARTING = np.ones(256, bool)
PARTING[97:123] = False
PARTING[128:] = False


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words and of their beginnings, and the number of words of each row."""
    words, counts = word_hashes(texts, PARTING, LOWER)
    return words, word_hashes(texts, PARTING, LOWER, STEM_BYTES)[0], counts


def text_slices(texts: pa.Array, size: int = 256) -> Iterator[pa.Array]:
    for at in range(0, len(texts), size):
        yield texts.slice(at, size)


class Table:
    """Numbers by 64-bit key; the last row serves keys that are not there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys = keys[order]
        self.values = np.vstack([values[order], np.zeros((1, values.shape[1]))])

    def rows(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        found = self.keys[np.minimum(at, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        return np.where(found, at, len(self.keys))

    def of(self, keys: np.ndarray, more: Table | None = None) -> np.ndarray:
        """The numbers of each key, here or in ``more``."""
        out = self.values[self.rows(keys)]
        if more is not None:
            at = more.rows(keys)
            found = at < len(more.keys)
            out[found] = more.values[at[found]]
        return out

    def lacks(self, keys: np.ndarray) -> np.ndarray:
        """The distinct keys that are not there."""
        return np.unique(keys[self.rows(keys) == len(self.keys)])


class Models:
    """Counts of both classes, their shared backoff counts, and the fitted weights of the score.

    All counts are Kneser-Ney's, of different words before what is counted.

    A pair backs off to its word, a word to its beginning, a beginning to the shared counts; how
    a beginning goes on is shared as well. Shared counts are of distinct words before a word. A
    count up to the discount frees all its mass, so the tables hold larger counts only.

    words: own counts, counts and freed counts as a context, of either class; shared count.
    heads: own counts of either class; shared count. pairs: counts of either class.
    totals: per class, counted words, and what words and heads free of them. size: number of all heads.
    The tables hold the most frequent entries; ``more`` has, for some texts, what the others say of their words, heads and pairs.
    """

    def __init__(self, words: Table, heads: Table, pairs: Table, totals: np.ndarray, shared: float, size: int):
        self.words, self.heads, self.pairs = words, heads, pairs
        self.n = np.maximum(totals[:, 0], 1)
        self.left, self.left_of_heads = (np.where(totals[:, 0] > 0, totals[:, i] / self.n, 1.0) for i in (1, 2))
        self.shared = shared + size + 1
        words.values, heads.values = self.of_words(words.values), self.of_heads(heads.values)
        self.weights = np.array([0.0, 1.0, 0.0, 0.0])

    def of_words(self, counts: np.ndarray) -> np.ndarray:
        """Per word: own probability in either class, counts and freed counts as a context, and the shared probability."""
        return np.column_stack([np.maximum(counts[:, 0:2] - DISCOUNT, 0) / self.n, counts[:, 2:6], (counts[:, 6] + 1) / self.shared])

    def of_heads(self, counts: np.ndarray) -> np.ndarray:
        """Per beginning: probability in either class, and the shared one."""
        begins = (counts[:, 2] + 1) / self.shared
        return np.column_stack([np.maximum(counts[:, 0:2] - DISCOUNT, 0) / self.n + self.left_of_heads * begins[:, None], begins])

    def more(self, kinds: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> list[Table]:
        """Tables of further entries, by rows of kind (0 words, 1 heads, 2 pairs), key and counts."""
        out = []
        for kind, (width, of) in enumerate(((7, self.of_words), (3, self.of_heads), (2, np.asarray))):
            own = kinds == kind
            table = Table(keys[own], counts[own, :width])
            table.values = of(table.values)
            out.append(table)
        return out

    def lacking(self, texts: pa.Array) -> list[np.ndarray]:
        """The distinct words, heads and pairs of the texts that the tables do not have."""
        found: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in range(3)]
        for part in text_slices(texts):
            words, heads, counts = words_of(part)
            joint = np.delete(pair(np.concatenate([words[:1], words[:-1]]), words), (np.cumsum(counts) - counts)[counts > 0])
            for out, table, keys in zip(found, (self.words, self.heads, self.pairs), (words, heads, joint), strict=True):
                out.append(table.lacks(keys))
        return [np.unique(np.concatenate(x)) for x in found]

    def gains(self, words: np.ndarray, heads: np.ndarray, first: np.ndarray, more: list[Table] | None = None) -> np.ndarray:
        """Log-probability of each word after the one before it, toxic less ordinary."""
        more = more or [None] * 3
        w, h = self.words.of(words, more[0]), self.heads.of(heads, more[1])
        before = np.concatenate([w[:1], w[:-1]])
        joint = self.pairs.of(pair(np.concatenate([words[:1], words[:-1]]), words), more[2])
        goes_on = np.minimum(w[:, 6] / h[:, 2], 1.0)
        logs = []
        for kind in (0, 1):
            back = w[:, kind] + self.left[kind] * h[:, kind] * goes_on
            n = before[:, 2 + kind]
            some = np.maximum(n, 1)
            p = np.maximum(joint[:, kind] - DISCOUNT, 0) / some + before[:, 4 + kind] / some * back
            logs.append(np.log(np.where(first | (n == 0), back, p)))
        return logs[1] - logs[0]

    def ratios(self, texts: pa.Array, more: list[Table] | None = None) -> np.ndarray:
        """Per row, length-normalised comparisons of toxic and ordinary log-probability; 0 without words.

        They are the mean over the words of toxic less ordinary, its median, which holds what the whole
        text has in common (its language), and the mean of what exceeds it by TELLING nats, the telling words.
        """
        out = []
        for part in text_slices(texts):
            words, heads, counts = words_of(part)
            first = np.zeros(len(words), bool)
            ends = np.cumsum(counts)
            starts = ends - counts
            first[starts[counts > 0]] = True
            gain = self.gains(words, heads, first, more)
            for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
                g = gain[lo:hi]
                mid = np.median(g) if hi > lo else 0.0
                out.append((g.mean(), mid, np.maximum(g - max(mid, 0.0) - TELLING, 0).mean()) if hi > lo else (0.0, 0.0, 0.0))
        return np.array(out).reshape(-1, 3)

    def scores(self, ratios: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + ratios @ self.weights[1:], -60, 60)))

    def fit(self, rows: DataFrame) -> None:
        """Logistic weights of the comparisons of all rows, by Newton's method with a slight pull to zero.

        Each step is a sum over the rows, taken by their tasks.
        """
        w = np.zeros(4)
        for _ in range(100):
            slope, bend = slopes(rows, w)
            step = np.linalg.solve(bend + PULL * np.eye(len(w)), slope + PULL * w)
            w = w - step
            if np.abs(step).max() < 1e-9:
                break
        self.weights = w


def slopes(rows: DataFrame, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the logistic loss at ``w``, summed over the rows of ``ratio_rows``."""
    n = len(w)
    names = [f"g{i}" for i in range(n)] + [f"h{i}{j}" for i in range(n) for j in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, *r = (b.column(c).to_numpy() for c in ("toxic", "mean", "median", "telling"))
            x = np.column_stack([np.ones(len(y)), *r])
            p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
            each = np.hstack([x * (p - y)[:, None], (x[:, :, None] * x[:, None, :] * (p * (1 - p))[:, None, None]).reshape(-1, n * n)])
            total = np.rint(each * UNIT).astype(np.int64).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([t]) for t in total], names=names)

    sums = rows.mapInArrow(run, ", ".join(f"{c} long" for c in names)).agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names]).first()
    values = np.array([float(v or 0) for v in sums]) / UNIT
    return values[:n], values[n:].reshape(n, n)


def chosen_labels(labels: DataFrame) -> DataFrame:
    """doc_id, toxic and role of all labelled rows that training may see.

    By a hash of the id, half of the ids serve the counts, the other half the weights. A document labelled twice counts
    as toxic if either label says so; null ids and labels are left out.
    """
    rows = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).dropna()
    rows = rows.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    return rows.withColumn("role", role(F.col("doc_id")))


def role(doc_id):
    return F.when(F.pmod(F.xxhash64(doc_id), F.lit(2)) == 0, "count").otherwise("fit")


def gram_counts(texts: DataFrame) -> DataFrame:
    """n0 and n1 of each (before, word, head): how many different words stand before the two in ordinary and toxic texts.

    Copies of a text thus count once, and so does a passage that many share. before is null for first words. h0 and h1,
    on one row of each (before, head): whether the beginning stands after the word in either class.

    A task passes on each of its slices' expressions once, in order, which the shuffle packs well; the rows are dealt
    by word before and beginning, and both steps here work on them where they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = b.column("toxic").to_numpy().astype(np.int32)
            at = 0
            for part in text_slices(b.column("text"), 1024):
                words, heads, counts = words_of(part)
                kind = np.repeat(kinds[at : at + len(part)], counts)
                at += len(part)
                first = np.zeros(len(words), bool)
                first[(np.cumsum(counts) - counts)[counts > 0]] = True
                early = first.copy()
                early[1:] |= first[:-1]
                before = np.where(first, 0, np.concatenate([words[:1], words[:-1]]))
                prior = np.where(early, 0, np.concatenate([words[:2], words[:-2]])[: len(words)])
                keys = [kind, early, prior, first, before, words]
                order = np.lexsort(keys)
                new = np.ones(len(order), bool)
                if len(order):
                    new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in keys])
                o = order[new]
                out = [pa.array(kind[o]), pa.array(signed(prior[o]), mask=early[o]), pa.array(signed(before[o]), mask=first[o]), pa.array(signed(words[o])), pa.array(signed(heads[o]))]
                yield pa.RecordBatch.from_arrays(out, names=["kind", "prior", "before", "word", "head"])

    grams = texts.select("toxic", "text").mapInArrow(run, "kind int, prior long, before long, word long, head long").repartition("before", "head").distinct()
    counted = grams.groupBy("before", "word", "head").agg(F.count_if(F.col("kind") == 0).alias("n0"), F.count_if(F.col("kind") == 1).alias("n1"))
    same = Window.partitionBy("before", "head").orderBy("word")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    once = F.row_number().over(same) == 1
    return counted.withColumns({f"h{k}": F.when(once, F.max(F.col(f"n{k}") > 0).over(whole)) for k in (0, 1)})


def count_models(grams: DataFrame) -> tuple[Models, DataFrame | None]:
    """The models from n-gram counts, with the most frequent entries of each table, and all other entries, if any.

    Those are rows of kind, key and counts, as ``Models.more`` reads them.
    """
    both = [F.sum("n0").alias("n0"), F.sum("n1").alias("n1")]
    freed = [F.sum(F.least(n, F.lit(int(DISCOUNT)))).alias(f"f{n[1]}") for n in ("n0", "n1")]
    inner = grams.filter("before is not null")

    def above(rows: DataFrame) -> DataFrame:
        return rows.filter((F.col("n0") > DISCOUNT) | (F.col("n1") > DISCOUNT))

    def by(key: str) -> DataFrame:
        """Of each word or beginning, the different words before it: in either class, and in both together."""
        in0, in1 = (F.col("n0") > 0, F.col("n1") > 0) if key == "word" else (F.col("h0"), F.col("h1"))
        each = grams.filter(in0.isNotNull()).groupBy(key)
        return each.agg(F.count_if(in0).alias("n0"), F.count_if(in1).alias("n1"), F.count("before").alias("shared"))

    contexts = inner.groupBy("before").agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1"), *freed)
    words = above(by("word")).join(contexts, F.col("word") == F.col("before"), "left").drop("before").fillna(0)
    every = [
        (stored(words, "toxicity-words"), ["word"], ["n0", "n1", "c0", "c1", "f0", "f1", "shared"]),
        (stored(above(by("head")), "toxicity-heads"), ["head"], ["n0", "n1", "shared"]),
        (stored(above(inner.select("before", "word", "n0", "n1")), "toxicity-pairs"), ["before", "word"], ["n0", "n1"]),
    ]
    totals = []
    for key in ("word", "head"):
        totals.append(by(key).agg(*both, *freed).fillna(0).first())
    shared = float(inner.count())
    sums = np.array([[totals[0][f"n{k}"], totals[0][f"f{k}"], totals[1][f"f{k}"]] for k in (0, 1)], float)

    def hashed(values: list[np.ndarray]) -> np.ndarray:
        values = [v.astype(np.int64).view(np.uint64) for v in values]
        return pair(*values) if len(values) > 1 else values[0]

    tables, sizes, rest = [], [], None
    for kind, (rows, keys, counts) in enumerate(every):
        place = F.struct(-(F.col("n0") + F.col("n1")), *keys)
        top = rows.orderBy(place).limit(ENTRIES).toPandas()
        tables.append(Table(hashed([top[k].to_numpy() for k in keys]), top[counts].to_numpy(float)))
        sizes.append(rows.count())
        if sizes[-1] > ENTRIES:
            end = top.iloc[-1]
            last = F.struct(*[F.lit(int(x)).cast("long") for x in (-(end["n0"] + end["n1"]), *end[keys])])
            more = entries(rows.filter(place > last), kind, keys, counts, hashed)
            rest = more if rest is None else rest.unionByName(more)
    return Models(*tables, sums, shared, sizes[1]), None if rest is None else stored(rest, "toxicity-rest")


def entries(rows: DataFrame, kind: int, keys: list[str], counts: list[str], hashed: Callable[[list[np.ndarray]], np.ndarray]) -> DataFrame:
    """Rows of a table as kind, key and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.column_stack([b.column(c).to_numpy() for c in counts]).astype(np.int64).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(counts)), pa.array(values))
            key = pa.array(signed(hashed([b.column(k).to_numpy() for k in keys])))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, kind, np.int32)), key, lists], names=["kind", "key", "counts"])

    return rows.select(*keys, *counts).mapInArrow(run, "kind int, key long, counts array<long>")


def with_ratios(rows: DataFrame, models: Models, rest: DataFrame | None, make: Callable, schema) -> DataFrame:
    """What ``make`` makes of all rows (doc_id, text and others): it gets them with the models and their texts' ratios.

    Without a rest, rows stay where they are. Else they are dealt out in blocks; a block asks for each word, head and pair
    that the broadcast tables lack once, by a join with the rest, and gets back what is there.
    """
    shared = rows.sparkSession.sparkContext.broadcast(models)  # of a fixed size
    if rest is None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield make(b, shared.value, shared.value.ratios(b.column("text")))

        return rows.mapInArrow(run, schema)

    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    n_blocks, name = max(1, -(-int(size or 0) // BLOCK_BYTES)), free_name(rows, "block")
    dealt = rows.withColumn(name, F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int"))

    def ask(block: pa.Table) -> pa.Table:
        keys = shared.value.lacking(joined(block["text"]))
        kinds = np.repeat(np.arange(3, dtype=np.int32), [len(k) for k in keys])
        own = np.full(len(kinds), block[name][0].as_py(), np.int32)
        return pa.table({"of": pa.array(own), "kind": pa.array(kinds), "key": pa.array(signed(np.concatenate(keys)))})

    def score(block: pa.Table, told: pa.Table) -> pa.Table:
        counts = np.zeros((len(told), 7))
        lists = joined(told["counts"])
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        counts[np.arange(7) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        more = shared.value.more(told["kind"].to_numpy(), told["key"].to_numpy().astype(np.int64).view(np.uint64), counts)
        out = block.drop_columns([name]).combine_chunks().to_batches()
        done = [make(b, shared.value, shared.value.ratios(b.column("text"), more)) for b in out]
        return pa.Table.from_batches(done)

    asked = dealt.select("text", name).groupBy(name).applyInArrow(ask, "of int, kind int, key long")
    told = asked.join(rest, ["kind", "key"]).select("of", "kind", "key", "counts")
    return dealt.groupBy(name).cogroup(told.groupBy("of")).applyInArrow(score, schema)


def ratio_rows(texts: DataFrame, models: Models, rest: DataFrame | None = None) -> DataFrame:
    def make(b: pa.RecordBatch, _: Models, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("toxic"), *(pa.array(r[:, i]) for i in range(3))], names=["toxic", "mean", "median", "telling"])

    return with_ratios(texts.select("doc_id", "toxic", "text"), models, rest, make, "toxic int, mean double, median double, telling double")


def train(docs: DataFrame, labels: DataFrame) -> tuple[Models, DataFrame | None]:
    """Models from all labelled documents outside the held-out quarter, counted by Spark: what is broadcast, of a fixed size, and the rest."""
    chosen = stored(chosen_labels(labels), "toxicity-labels")  # of known size: Spark broadcasts it while it is small

    def texts(which: str) -> DataFrame:
        own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        own = own.filter(~held_out(F.col("doc_id")) & (role(F.col("doc_id")) == which))
        return own.join(chosen.filter(F.col("role") == which), "doc_id")

    grams = stored(gram_counts(texts("count")), "toxicity-grams")
    models, rest = count_models(grams)
    fit = stored(ratio_rows(texts("fit"), models, rest), "toxicity-ratios")
    if fit.select("toxic").distinct().count() == 2:
        models.fit(fit)
    return models, rest


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on).

    The score is logistic in length-normalised log-ratios of two Kneser-Ney models, toxic against
    ordinary. A text without words has ratios 0 and gets the score of those. Labels are read for training only, and
    only of documents outside the held-out quarter; without both classes the weights stay as they start. A
    null doc_id is not held out. Repeated rows are scored each; other columns are ignored.
    """

    def make(b: pa.RecordBatch, models: Models, ratios: np.ndarray) -> pa.RecordBatch:
        score = models.scores(ratios)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return with_ratios(rows, *train(docs, labels), make, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below ``threshold``, with all their columns."""

    def make(b: pa.RecordBatch, models: Models, ratios: np.ndarray) -> pa.RecordBatch:
        return b.filter(pa.array(models.scores(ratios) < threshold))

    return with_ratios(docs, *train(docs, labels), make, docs.schema)


def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))
