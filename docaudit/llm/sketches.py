"""Document fingerprints: invertible Bloom lookup tables of paragraph digests, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docaudit.llm.common import documents, stored

ROWS = 10  # cells of each of the three parts of a table
ROUNDS = 12  # of peeling
PIECE = 16  # words of a piece of a line, on average
WORDS = r"(?<=\s)"  # ends of words
PARTS = r"(?<=[aeiou0-9]|[^\x00-\x7F])(?=\S{64})"  # ends of parts of a run that is very long
SPLIT = 4  # a table that cannot be peeled is tried again as so many tables
CELLS, LEAST, MOST = 2.4, 4, 16  # cells for each digest of a further table; the fewest and most cells of its parts
SPLITS = 32  # of a set: each takes two bits of the digests, so the last leaves one digest in a part


def digests(text: Column) -> Column:
    """The distinct digests of a text's lines."""
    return F.array_distinct(F.transform(F.split(text, "\n"), lambda p: F.xxhash64(p)))


def units(line: Column) -> Column:
    """The words of a line with the blank after each; runs of over 64 characters are cut into parts.

    Only such runs are searched for ends of parts, as that looks ahead at each character.
    """
    long = lambda w: F.length(w) > 64
    cut = lambda w: F.when(long(w), F.split(w, PARTS)).otherwise(F.array(w))
    return bound(F.split(line, WORDS), lambda ws: F.when(F.exists(ws, long), F.flatten(F.transform(ws, cut))).otherwise(ws))


def piece_digests(text: Column) -> Column:
    """The distinct digests of the pieces of a text's lines.

    A line is cut after each word that, hashed with the one before it, is 0 modulo PIECE, so a change
    reaches the pieces around it only, wherever it stands.
    """

    def cuts(w: Column) -> Column:
        return F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: (i == F.size(w)) | (F.pmod(F.xxhash64(F.get(w, i - 1), F.get(w, i - 2)), F.lit(PIECE)) == 0))

    def cut(w: Column, ends: Column) -> Column:
        begin = lambda j: F.coalesce(F.get(ends, j - 1), F.lit(0))
        return F.transform(ends, lambda e, j: F.xxhash64(F.slice(w, begin(j) + 1, e - begin(j))))

    def pieces(line: Column) -> Column:
        return bound(units(line), lambda w: bound(cuts(w), lambda ends: cut(w, ends)))

    return F.array_distinct(F.flatten(F.transform(F.split(text, "\n"), pieces)))


def check(k: Column) -> Column:
    return F.xxhash64(k, F.lit(9)).bitwiseAND(F.lit(0xFFFFFFFF))


def placed(keys: Column, of: Callable[[Column], tuple[Column, Column]], rows: Column) -> Column:
    """Each key with its count, both as ``of`` has them, its check and the three cells that hold it, one in each part."""

    def one(x: Column) -> Column:
        k, c = of(x)
        at = [(F.pmod(F.xxhash64(k, F.lit(j)), rows) + rows * j).cast("int").alias(f"p{j}") for j in range(3)]
        return F.struct(c.alias("c"), k.alias("k"), check(k).alias("h"), *at)

    return F.transform(keys, one)


def bound(value: Column, of) -> Column:
    """of(value), with the value computed once: inside a lambda an expression is computed at each call."""
    return F.transform(F.array(value), of)[0]


def by_part(of, rows: Column) -> Column:
    """of(part, i) for each cell i of each part, the cells in order."""

    def part(j: int) -> Column:
        return F.transform(F.sequence(rows * j, rows * (j + 1) - 1), lambda i: of(f"p{j}", i))

    return F.concat(*map(part, range(3)))


def cell(c: Column, k: Column, h: Column) -> Column:
    return F.struct(c.cast("int").alias("c"), k.alias("k"), h.alias("h"))


def filled(entries: Column, rows: Column) -> Column:
    """The cells of placed digests: in each, the sum of their counts, and the exclusive-or of the digests and of their checks."""
    zero = F.lit(0).cast("long")

    def fill(entries: Column, part: str, i: Column) -> Column:
        mine = F.filter(entries, lambda e: e[part] == i)
        return F.aggregate(mine, cell(F.lit(0), zero, zero), lambda a, e: cell(a["c"] + e["c"], a["k"].bitwiseXOR(e["k"]), a["h"].bitwiseXOR(e["h"])))

    return bound(entries, lambda es: by_part(lambda part, i: fill(es, part, i), rows))


def table(keys: Column) -> Column:
    """The cells of a set of digests."""
    return filled(placed(keys, lambda k: (k, F.lit(1)), F.lit(ROWS)), F.lit(ROWS))


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: cell(x["c"] - y["c"], x["k"].bitwiseXOR(y["k"]), x["h"].bitwiseXOR(y["h"])))


def difference(one: Column, two: Column, rows: Column) -> Column:
    """The table of one set less that of the other, both with ``rows`` cells a part, filled in one go."""
    signs = [placed(keys, lambda k, sign=sign: (k, F.lit(sign)), rows) for keys, sign in ((one, 1), (two, -1))]
    return filled(F.concat(*signs), rows)


def peeled(cells: Column, rows: Column | None = None) -> Column:
    """Struct of n, the digests recovered from a difference, and done, whether these are all.

    A cell with one digest gives it away; taking it out of its other cells lays open more. Each round
    takes all digests that lie open. ``rows`` are the cells of a part, ROWS if not given.
    """
    rows = F.lit(ROWS) if rows is None else rows

    def round_(state: Column, _: Column) -> Column:
        pure = F.filter(state["cells"], lambda x: (F.abs(x["c"]) == 1) & (x["h"] == check(x["k"])))
        signs = lambda found: F.array_distinct(F.transform(found, lambda x: F.struct(x["k"].alias("k"), x["c"].alias("c"))))
        stuck = F.struct(state["cells"].alias("cells"), state["n"].alias("n"), F.lit(False).alias("more"))
        next_ = bound(pure, lambda found: F.when(F.size(found) == 0, stuck).otherwise(bound(signs(found), lambda s: taken(state, s))))
        return F.when(state["more"], next_).otherwise(state)

    def taken(state: Column, signs: Column) -> Column:
        entries = placed(signs, lambda s: (s["k"], s["c"]), rows)

        def less(x: Column, part: str, i: Column, es: Column) -> Column:
            return F.aggregate(F.filter(es, lambda e: e[part] == i), x, lambda a, e: cell(a["c"] - e["c"], a["k"].bitwiseXOR(e["k"]), a["h"].bitwiseXOR(e["h"])))

        left = bound(entries, lambda es: by_part(lambda part, i: less(state["cells"][i], part, i, es), rows))
        return F.struct(left.alias("cells"), (state["n"] + F.size(signs)).alias("n"), F.lit(True).alias("more"))

    start = F.struct(cells.alias("cells"), F.lit(0).alias("n"), F.lit(True).alias("more"))
    clear = lambda s: F.struct(s["n"].alias("n"), (~F.exists(s["cells"], lambda x: (x["c"] != 0) | (x["k"] != 0))).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_, clear)


def as_text(keys: Column, cells: Column) -> Column:
    """A table as text: how many digests, then all cells in base 64."""

    def hexed(c: Column, digits: int) -> Column:
        return F.lpad(F.hex(c), digits, "0")

    packed = F.array_join(F.transform(cells, lambda x: F.concat(hexed(x["c"].cast("long"), 8), hexed(x["k"], 16), hexed(x["h"], 8))), "")
    return F.concat(F.size(keys).cast("string"), F.lit(":"), F.base64(F.unhex(packed)))


def followers(docs: DataFrame) -> DataFrame:
    """Each document (a, b: two hashes of its id and text) with the one before and after it, by descending doc_id.

    The order is cyclic: the last is followed by the first. Ids are dealt out in ranges and saved with
    the number of their range, so each range is ordered by itself; what crosses ranges is one row of each.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(*row_key(), "doc_id", F.length("text").cast("long").alias("n_chars"))
    # Null ids come last; rows that repeat an id and a text are one document.
    ranged = ids.distinct().repartitionByRange(F.desc_nulls_last("doc_id"), "a", "b").withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "sketch-order")
    order = (F.desc_nulls_last("doc_id"), F.col("a"), F.col("b"))
    this = F.struct("a", "b", (F.col("n_chars") / 3).cast("long").alias("need"))
    rank = F.struct(F.col("doc_id").isNull(), F.bitwise_not("doc_id"), "a", "b")  # the same order, ascending
    ends = ranged.groupBy("part").agg(F.min_by(this, rank).alias("head"), F.max_by(this, rank).alias("tail"))
    around = W.orderBy("part")  # one row for each range
    every = around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = ends.select(
        "part",
        F.coalesce(F.lead("head").over(around), F.first("head").over(every)).alias("next_head"),
        F.coalesce(F.lag("tail").over(around), F.last("tail").over(every)).alias("last_tail"),
    )
    within = W.partitionBy("part").orderBy(*order)
    rows = ranged.select("a", "b", "doc_id", "n_chars", "part", F.lead(this).over(within).alias("next"), F.lag(this).over(within).alias("last"))
    rows = rows.join(F.broadcast(ends), "part")
    return rows.select("a", "b", "doc_id", "n_chars", (F.col("n_chars") / 3).cast("long").alias("need"), F.coalesce("last", "last_tail").alias("last"))


def row_key() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(7), F.col("doc_id").isNull(), "doc_id", "text").alias("b")]


def differing(one: Column, two: Column, got: Column) -> Column:
    """How many digests only one of two sets has; ``got`` is what peeling the difference of their tables gave.

    A pair whose difference cannot be peeled is tried again with a larger sketch: SPLIT tables, each for the digests
    with the same two bits, of a size that suits them. Only the parts that fail again are split further, so the cost
    is in proportion to the digests. All of it happens within the row: no digests are stored or sent.
    """

    def parts(pair: Column, turn: Column) -> Column:
        def share(keys: Column, part: Column) -> Column:
            return F.filter(keys, lambda k: F.call_function("shiftright", k, turn * 2).bitwiseAND(F.lit(SPLIT - 1)) == part)

        return F.transform(F.sequence(F.lit(0), F.lit(SPLIT - 1)), lambda part: F.struct(share(pair["one"], part).alias("one"), share(pair["two"], part).alias("two")))

    def tried(pair: Column) -> Column:
        rows = F.least(F.greatest(((F.size(pair["one"]) + F.size(pair["two"])) * CELLS / 3).cast("int"), F.lit(LEAST)), F.lit(MOST))
        got = bound(rows, lambda n: peeled(difference(pair["one"], pair["two"], n), n))
        return F.struct(pair["one"].alias("one"), pair["two"].alias("two"), got.alias("got"))

    def summed(state: Column, pairs: Column) -> Column:
        n = F.aggregate(pairs, state["n"], lambda a, p: a + F.when(p["got"]["done"], p["got"]["n"]).otherwise(0))
        left = F.filter(pairs, lambda p: ~p["got"]["done"])
        return F.struct(n.alias("n"), F.transform(left, lambda p: F.struct(p["one"].alias("one"), p["two"].alias("two"))).alias("open"))

    def round_(state: Column, turn: Column) -> Column:
        pairs = F.transform(F.flatten(F.transform(state["open"], lambda p: parts(p, turn))), tried)
        return F.when(F.size(state["open"]) == 0, state).otherwise(bound(pairs, lambda ps: summed(state, ps)))

    open_ = F.filter(F.array(F.struct(one.alias("one"), two.alias("two"))), lambda _: ~got["done"])
    start = F.struct(F.when(got["done"], got["n"]).otherwise(0).alias("n"), open_.alias("open"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(SPLITS - 1)), start, round_, lambda s: s["n"])


def fingerprints(docs: DataFrame, digests: Callable[[Column], Column] = digests) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A fingerprint is a table of the distinct digests that ``digests`` takes of the text, of lines or of pieces
    of lines. Likeness is one less the share
    of differing digests, which subtracting and peeling the tables recovers, among those of both
    texts. In the edited text the last third gives way to the beginning of the next document in
    descending order of doc_id, null ids last. A null text counts as empty, an empty text as one empty
    line. Rows that repeat an id and a text are one document, returned once; of rows that repeat an id
    only, the hash decides the order. Other columns are ignored.
    """
    order = stored(followers(docs), "sketch-followers")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(*row_key(), "text", digests(F.col("text")).alias("keys")).dropDuplicates(["a", "b"])
    own = texts.join(order, ["a", "b"])
    sent = own.select(F.col("last.a").alias("a"), F.col("last.b").alias("b"), F.expr("substring(text, 1, cast(last.need as int))").alias("head"), F.col("keys").alias("next_keys"))
    both = own.select("a", "b", "doc_id", "n_chars", "need", "text", "keys").join(sent, ["a", "b"])
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - need as int))"), F.col("head"))
    rows = both.select("a", "b", "doc_id", "n_chars", "keys", "next_keys", edited.alias("edited"))
    rows = rows.select("a", "b", "doc_id", "n_chars", "keys", "next_keys", digests(F.col("edited")).alias("edited_keys"), F.sha2("edited", 256).alias("edited_sha256"))
    rows = rows.select("*", table(F.col("keys")).alias("cells"), table(F.col("edited_keys")).alias("edited_cells"), table(F.col("next_keys")).alias("next_cells"))
    rows = rows.select(
        "doc_id", "n_chars", "edited_sha256", "keys", "edited_keys", "next_keys",
        as_text(F.col("keys"), F.col("cells")).alias("fingerprint"), as_text(F.col("edited_keys"), F.col("edited_cells")).alias("edited_fingerprint"),
        peeled(subtracted(F.col("cells"), F.col("edited_cells"))).alias("to_edited"), peeled(subtracted(F.col("cells"), F.col("next_cells"))).alias("to_next"),
    )

    def near(which: str) -> Column:
        n = differing(F.col("keys"), F.col(f"{which}_keys"), F.col(f"to_{which}"))
        return (1 - n / (F.size("keys") + F.size(f"{which}_keys"))).cast("double").alias(f"near_{which}")

    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited"), near("next"))


def op10_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints(documents(spark, sf), piece_digests)
