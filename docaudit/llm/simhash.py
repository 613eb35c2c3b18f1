"""Near duplicates by SimHash: BK-trees of fingerprints, one per shard of equal bytes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.common import documents, free_name, stored

SEED = 42


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of a text: a bit is set if it is set in over half of the shingles' XXH64."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    if len(words) < size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    each = xxhash.xxh64_intdigest
    h = np.array([each(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(size)), strict=False)], np.uint64)
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int.from_bytes(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(h), bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), size) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Children are keyed by their distance to the parent; a search follows edges within the radius."""

    def __init__(self) -> None:
        self.root: list | None = None

    def near(self, value: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            gap = (node[0] ^ value).bit_count()
            if gap <= radius:
                found.append(node[0])
            children = node[1]
            todo.extend(children[d] for d in range(max(1, gap - radius), gap + radius + 1) if d in children)
        return found

    def add(self, value: int) -> None:
        node = self.root
        if node is None:
            self.root = [value, {}]
            return
        while gap := (node[0] ^ value).bit_count():
            child = node[1].get(gap)
            if child is None:
                node[1][gap] = [value, {}]
                return
            node = child


class Forest:
    """Union-find over the values that one task has seen; only its tree edges leave the task."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        root = x
        while (above := self.up.get(root, root)) != root:
            root = above
        while x != root:
            self.up[x], x = root, self.up.get(x, x)
        return root

    def link(self, a: int, b: int) -> None:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def shard_masks(radius: int) -> list[int]:
    """Masks of 8 - radius of the 8 bytes: two values within ``radius`` bits agree under one mask.

    A shard, the values that agree under a mask, has at most 256 ** radius of them.
    """
    full = [0xFF << (8 * i) for i in range(8)]
    return [sum(full[i] for i in keep) for keep in combinations(range(8), 8 - radius)]


def fingerprint_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Links (u, v) that connect the distinct values ``fp`` within ``radius`` bits, through trees per shard.

    Every link of the full relation is found; of these a task passes on those that join two of
    its groups, which keeps all components. Broadcasting the trees would mean memory that grows
    with the corpus, so each value travels to the trees of its shards instead.
    """
    masks = [m - (1 << 64) if m >> 63 else m for m in shard_masks(radius)]
    keys = [F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks)]
    sharded = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.mask", "k.part", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, key, members = Forest(), None, []

        def close() -> None:
            if len(members) > 1:
                tree = BKTree()
                for x in members:
                    for y in tree.near(x, radius):
                        forest.link(x, y)
                    tree.add(x)

        for b in batches:
            mask, part, fp = (b.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((np.diff(mask) != 0) | (np.diff(part) != 0)) + 1
            bounds = np.concatenate([[0], cuts, [len(fp)]])
            values = fp.view(np.uint64)
            lone = np.flatnonzero(np.diff(bounds) > 1)  # groups of one need no tree, but for those at the edges
            for g in sorted({0, len(bounds) - 2, *lone.tolist()} if len(fp) else ()):
                lo, hi = int(bounds[g]), int(bounds[g + 1])
                this = (int(mask[lo]), int(part[lo]))
                if this != key:
                    close()
                    key, members = this, []
                members.extend(values[lo:hi].tolist())
        close()
        pairs = [(x, forest.top(x)) for x in forest.up]
        u, v = (np.array([p[i] for p in pairs], np.uint64).view(np.int64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    ordered = sharded.repartition("mask", "part").sortWithinPartitions("mask", "part")
    return ordered.mapInArrow(run, "u long, v long").filter("u <> v").distinct()


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(id, root) for every end of an edge; equal roots mean connected.

    Each round points every id at its neighbour of least hash, itself included, and contracts. Hashed
    order makes long chains shrink by a constant factor. Joins take stored tables on both sides,
    so Spark can split a root that holds most ids.
    """

    def order(c):
        return F.struct(F.xxhash64(c).alias("h"), c.alias("id"))

    edges = stored(edges.select("u", "v"), name)
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = both.groupBy("u").agg(F.min(order(F.col("v"))).alias("m")).select("u", F.least("m", order(F.col("u")))["id"].alias("p"))
        up = stored(up, f"{name}-up")
        if labels is None:
            labels = up.select(F.col("u").alias("id"), F.col("p").alias("root"))
        else:
            step = up.select(F.col("u").alias("root"), "p")
            labels = labels.join(step, "root", "left").select("id", F.coalesce("p", "root").alias("root"))
        labels = stored(labels, f"{name}-roots")
        half = edges.join(up, "u").select(F.col("p").alias("a"), "v")
        other = up.select(F.col("u").alias("v"), F.col("p").alias("b"))
        edges = half.join(other, "v").filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
        edges = stored(edges.distinct(), name)
    if labels is None:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return labels


def near_duplicates(docs: DataFrame, radius: int = 2, size: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Fingerprints within ``radius`` bits are linked; component_id is the smallest doc_id that links
    reach. Null and blank texts have fingerprint zero and are linked like any other. A null doc_id
    keeps its row but is never a component_id, unless its component has no other. Repeated rows
    come out once each; other columns are ignored.
    """
    fps = stored(with_fingerprints(docs, size), "simhash")
    firsts = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-firsts")
    roots = components(fingerprint_links(firsts.select("fp"), radius), "simhash-links")
    placed = firsts.join(roots.select(F.col("id").alias("fp"), "root"), "fp", "left")
    placed = stored(placed.select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-placed")
    least = stored(placed.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-least")
    named = stored(placed.join(least, "root").select("fp", "component_id"), "simhash-components")
    hex16 = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return fps.join(named, "fp").select("doc_id", hex16, "component_id")


def one_of_each(docs: DataFrame, radius: int = 2) -> DataFrame:
    """The documents that are the first of their component; rows without a doc_id stay."""
    name = free_name(docs, "kept_id")
    kept = near_duplicates(docs, radius).filter("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(stored(kept, "simhash-kept"), F.col("doc_id") == F.col(name), "left_semi").unionByName(docs.filter("doc_id is null"))


def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(documents(spark, sf))
