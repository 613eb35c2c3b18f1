"""A Merkle manifest of a dataset: digest-to-children records, and proofs found by descent from the root."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.common import documents, stored
from docaudit.operators.ranking import position

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16  # children of a record; ranks are written in hexadecimal digits, one a level
MOST_LEVELS = 15  # 16 ** 15 rows fill a long
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A value with its length before it, so that no two rows write alike; a null is a dash."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(**changed: Column) -> Column:
    """Digest of a row of ``FIELDS``; a keyword gives another value for its field."""
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def depth_of(n: Column) -> Column:
    """Levels above ``n`` nodes until one is left."""
    return sum(((n > FANOUT**d).cast("int") for d in range(MOST_LEVELS)), F.lit(0))


def digits(rank: Column, depth: Column) -> Column:
    """The rank's digits from the top level down."""
    return F.lpad(F.lower(F.hex(rank)), depth, F.lit("0"))


@dataclass
class Manifest:
    """root: digest, or None of an empty table. root_depth: levels above the subroots.

    leaves: the given rows with ``leaf`` and ``path``, the digits from the root down. upper, lower: by height, the
    records (digest, children) of the levels above the subroots, and of those within sources.
    """

    root: str | None
    root_depth: int
    leaves: DataFrame
    upper: dict[int, DataFrame]
    lower: dict[int, DataFrame]

    def records(self, step: int, lengths: list[int]) -> DataFrame:
        """Each record once that paths of these lengths can open after ``step`` digits."""
        if step < self.root_depth:
            tables = [self.upper[self.root_depth - step]]
        else:
            tables = [self.lower[n - step] for n in lengths if n > step]
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out.dropDuplicates(["digest"])


def climb(nodes: DataFrame, most: int, name: str) -> tuple[dict[int, DataFrame], DataFrame]:
    """The records of each level over ``nodes`` (source, at, n, digest), and the last digest of each source.

    ``n`` counts a source's nodes, ``most`` is the largest n. A run of FANOUT nodes is one group.
    """
    tops, records, height = nodes.filter("n = 1").select("source", "digest"), {}, 0
    while most > 1:
        run = F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"])
        level = nodes.filter("n > 1").groupBy("source", F.floor(F.col("at") / FANOUT).cast("long").alias("at"), "n").agg(run.alias("children"))
        level = level.select("source", "at", F.ceil(F.col("n") / FANOUT).cast("long").alias("n"), F.sha2(F.concat_ws("", "children"), 256).alias("digest"), "children")
        level, height, most = stored(level, f"{name}-{height}"), height + 1, -(-most // FANOUT)
        records[height] = level.select("digest", "children")
        nodes = level.drop("children")
        tops = tops.unionByName(nodes.filter("n = 1").select("source", "digest"))
    return records, tops


def manifest(leaves: DataFrame) -> Manifest:
    """The tree over ``leaves``: source, doc_id, leaf and any columns to carry along.

    Per source, leaves ascend by doc_id, nulls first, then by digest; equal rows follow one another and are told
    apart by their ranks alone. Every FANOUT consecutive digests make a record of the next level until one is left; the
    sources' last digests, null first, then by bytes, are treated likewise. A null source is a
    source of its own. Levels shrink by FANOUT, and no group holds more than FANOUT rows.
    """
    leaves = stored(leaves, "merkle-leaves")
    sizes = position(leaves.groupBy("source").agg(F.count("*").alias("n")), [], [F.col("source")], "source_rank")
    sizes = stored(sizes, "merkle-sources")
    count, most = sizes.agg(F.count("*"), F.max("n")).first()
    root_depth = next(d for d in range(MOST_LEVELS + 1) if FANOUT**d >= count)
    place = F.concat(digits(F.col("source_rank"), F.lit(root_depth)), digits(F.col("rank"), depth_of(F.col("n"))))
    ranked = position(leaves, ["source"], [F.col("doc_id"), F.col("leaf")], "rank")
    of = sizes.select(F.col("source").alias("merkle_source"), "n", "source_rank")
    ranked = stored(ranked.join(of, ranked["source"].eqNullSafe(of["merkle_source"])).withColumn("path", place).drop("merkle_source", "source_rank"), "merkle-ranked")
    lower, subroots = climb(ranked.select("source", F.col("rank").alias("at"), "n", F.col("leaf").alias("digest")), most or 0, "merkle-lower")
    named = subroots.select(F.col("source").alias("merkle_source"), "digest")
    top = sizes.join(named, sizes["source"].eqNullSafe(named["merkle_source"])).select(F.lit(None).cast("string").alias("source"), F.col("source_rank").alias("at"), F.lit(count).cast("long").alias("n"), "digest")
    upper, root = climb(stored(top, "merkle-subroots"), count, "merkle-upper")
    row = root.select("digest").first()
    return Manifest(row and row[0], root_depth, ranked.drop("n", "rank"), upper, lower)


def proofs(tree: Manifest, requests: DataFrame) -> DataFrame:
    """``requests`` (rows with a path) with found, the leaf's digest, subroot, and segments.

    A request goes down from the root by its digits: each step opens the record of a digest, takes the child of the
    next digit and keeps the digests left and right of it. Requests with common first digits go as one row
    until they part, so that a level has at most as many rows as records, and no key more than FANOUT.
    Segments (left, right: joined digests) come reversed, from the leaf up. Paths that the tree
    does not have find nothing and are left out.
    """
    lengths = sorted(r[0] for r in requests.select(F.length("path")).distinct().collect())  # at most 2 * MOST_LEVELS numbers
    last = lengths[-1] if lengths else 0
    wanted: dict[int, DataFrame] = {}
    for k in range(last - 1, -1, -1):  # what begins paths, from long to short
        ends = requests.filter(F.length("path") == k + 1).select(F.substring("path", 1, k).alias("begun"))
        if k + 1 in wanted:
            ends = ends.unionByName(wanted[k + 1].select(F.substring("begun", 1, k).alias("begun")))
        wanted[k] = stored(ends.distinct(), f"merkle-wanted-{k}")
    none = F.array().cast("array<struct<left: string, right: string>>")
    subroot = F.lit(tree.root) if tree.root_depth == 0 else F.lit(None).cast("string")
    found = requests.filter("path = ''").withColumns({"found": F.lit(tree.root), "subroot": F.lit(tree.root), "segments": none})
    front = requests.sparkSession.range(1 if last and tree.root else 0).select(F.lit("").alias("begun"), F.lit(tree.root).cast("string").alias("digest"), subroot.alias("subroot"), none.alias("segments"))
    for k in range(last):
        opened = front.join(tree.records(k, lengths), "digest").select("begun", "subroot", "segments", "children")
        digit = F.conv(F.col("digit"), FANOUT, 10).cast("int")
        left, right = F.slice("children", 1, digit), F.slice("children", digit + 2, FANOUT)
        segment = F.struct(F.concat_ws("", left).alias("left"), F.concat_ws("", right).alias("right"))
        child = F.try_element_at("children", digit + 1)

        def step(rows: DataFrame, whole: str) -> DataFrame:
            rows = rows.withColumns({"merkle_begun": F.substring(whole, 1, k), "digit": F.substring(whole, k + 1, 1)})
            rows = rows.join(opened.withColumnRenamed("begun", "merkle_begun"), "merkle_begun").withColumn("digest", child)
            at = F.col("digest") if k + 1 == tree.root_depth else F.col("subroot")
            return rows.filter("digest is not null").withColumns({"segments": F.concat("segments", F.array(segment)), "subroot": at})

        if k + 1 in lengths:
            ended = step(requests.filter(F.length("path") == k + 1), "path").withColumn("segments", F.reverse("segments"))
            found = found.unionByName(ended.withColumnRenamed("digest", "found").select(*found.columns))
        if k + 1 in wanted:
            front = stored(step(wanted[k + 1], "begun").select("begun", "digest", "subroot", "segments"), f"merkle-front-{k + 1}")
    return found


def proof_digest(segments: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(segments, lambda s: F.concat(s["left"], s["right"]))), 256)


def folded(leaf: Column, segments: Column) -> Column:
    """The root that a leaf and its segments give."""
    return F.aggregate(segments, leaf, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def audit(docs: DataFrame, altered: Column) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The tree is built over the rows as they are. ``altered`` is the text that each row shows when it is audited: its
    own, or a changed one; folded_root is what that row and the kept siblings give, verified whether it is the root.
    Nulls in any column have a digest of their own; equal rows are leaves of their own; an empty table has no rows.
    Columns beyond FIELDS play no part.
    """
    text = F.col("text").cast("string")
    same = altered.eqNullSafe(text)
    leaves = docs.select("doc_id", "source", leaf_digest().alias("leaf"), F.when(~same, leaf_digest(text=altered)).alias("shown"))
    tree = manifest(leaves)
    rows = proofs(tree, tree.leaves)
    rows = rows.withColumn("folded_root", folded(F.coalesce("shown", "found"), F.col("segments")))
    return rows.select(
        F.col("doc_id").cast("long"), F.col("found").alias("leaf"), "subroot", F.lit(tree.root).alias("root"), proof_digest(F.col("segments")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.lit(tree.root)).alias("verified"),
    )


def op11_merkle(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text").cast("string")
    struck = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return audit(documents(spark, sf), F.when(struck, F.translate(text, UPPER, LOWER)).otherwise(text))
