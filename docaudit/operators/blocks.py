"""Structure of documents of any size: the texts are cut into blocks, and what crosses a border is carried over.

The tables are those of ``extract.sections``, ``equations``, ``tables`` and ``theorems``, but no task sees more of a
document than a block, and no row holds its matches. A border lies at a line end where no header, table or theorem head
can cross it: the line ends in text and the next one begins with a letter or a backslash. So those are found block
by block. What may lie far apart is resolved over the order of the blocks, a row a block:

- the next header, statement end, proof and so on: the first one of the later blocks is carried back;
- display equations: the delimiters of a block map the kind of equation open before it to the kind open after it;
  these maps are composed by a prefix scan, and each block then knows what it begins in.

Text that a border divides is put together from pages of a fixed size, joined by number.
One row per document is expected; a null text has the structure of an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.constants import HEADER_LINE, INLINE_EQUATION, MARKDOWN_TABLE, STATEMENT_END, THEOREM_HEAD
from docaudit.functions.text import spans, strip
from docaudit.operators import extract
from docaudit.operators.ranking import position
from docaudit.session import stored

BLOCK_CHARS = 1 << 16
PAGE_CHARS = 1 << 12

BORDER = r"[^\s#\d.]\.?\n(?=[\p{L}\\])"
DELIMITER = r"\\[\[\]]|\$\$|\\(?:begin|end)\{(?:equation|align|eqnarray)\*?\}"
ENVIRONMENTS = ("equation", "align", "eqnarray")  # kinds 3 to 5; 1 is brackets, 2 dollars, 0 stands for none open
KINDS = 6
PROOF_HEAD = r"\*\*Proof\.?\*\*\s*"
PROOF_STOP = r"\n\*\*(?:Theorem|Lemma|Proposition|Corollary)|\n#{1,4}\s"

SPAN = "struct<start: bigint, stop: bigint, block: int, hit: string>"


@dataclass
class Blocks:
    """rows: paper_id, block, n_blocks, offset, size (characters), doc_size, text. pages: paper_id, page, text."""

    rows: DataFrame
    pages: DataFrame
    page_chars: int


def cut(texts: DataFrame, block_chars: int = BLOCK_CHARS, page_chars: int = PAGE_CHARS) -> Blocks:
    """Blocks of up to ``block_chars`` characters, or up to the first border if there is none before; texts has paper_id, full_text."""
    text = F.coalesce("full_text", F.lit(""))
    pattern = rf"(?s).{{0,{block_chars}}}{BORDER}|.*?{BORDER}|.+"
    pieces = texts.select("paper_id", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("p"))
    pieces = pieces.withColumn("p", F.when(F.size("p") == 0, F.array(F.lit(""))).otherwise(F.col("p")))
    ends = F.aggregate("p", F.array(F.lit(0).cast("bigint")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x))))
    rows = pieces.withColumn("ends", ends).select(
        "paper_id", F.size("p").alias("n_blocks"), F.element_at("ends", -1).alias("doc_size"), "ends", F.posexplode_outer("p").alias("block", "text")
    )
    rows = rows.withColumn("offset", F.get("ends", F.col("block"))).withColumn("size", F.length("text").cast("bigint")).drop("ends")
    pages = texts.select("paper_id", F.posexplode(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{page_chars}}}"), F.lit(0))).alias("page", "text"))
    return Blocks(stored(rows, "blocks"), stored(pages, "pages"), page_chars)


def met(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the corpus, by shuffles: their files are small for the rows in them, so that
    Spark, which goes by the files, would send all of one through the driver."""
    return rows.join(other.hint("merge"), keys, how)


def found(pattern: str) -> Column:
    """The matches of a block as global spans. The letter put after a block stands for the next one's, so that ends of lines stay what they are."""
    text = F.when(F.col("block") + 1 < F.col("n_blocks"), F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return F.transform(
        spans(text, pattern),
        lambda s: F.struct((F.col("offset") + s["start_pos"]).alias("start"), (F.col("offset") + s["end_pos"]).alias("stop"), F.col("block").alias("block"), s["hit"].alias("hit")),
    )


def with_next(rows: DataFrame, lists: list[str]) -> DataFrame:
    """For each list of spans, next_<list>: the first span that any later block of the document has."""
    later = Window.partitionBy("paper_id").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumns({f"next_{c}": F.first(F.get(c, F.lit(0)), ignorenulls=True).over(later) for c in lists})


def first_from(spans_: str, at: Column) -> Column:
    """The first span of the block's list, or of later blocks, that starts at ``at`` or after."""
    return F.coalesce(F.get(F.filter(spans_, lambda s: s["start"] >= at), F.lit(0)), F.col(f"next_{spans_}"))


def local(start: Column, stop: Column) -> Column:
    """Characters from ``start`` to ``stop``, clipped to the document; null if they are not all in this block."""
    a, b = F.greatest(start, F.lit(0)), F.least(stop, F.col("doc_size"))
    inside = (a >= F.col("offset")) & (b <= F.col("offset") + F.col("size"))
    return F.when(a >= b, "").when(inside, F.substring("text", (a - F.col("offset") + 1).cast("int"), (b - a).cast("int")))


def filled(rows: DataFrame, blocks: Blocks, key: str, ranges: dict[str, tuple[str, str]]) -> DataFrame:
    """Null texts filled in from their ranges (columns of global starts and stops). ``key`` tells a document's rows apart.

    A range is cut at page borders, so that a page is read where it lies and only its part travels.
    """
    size = blocks.page_chars
    need = F.array(*[F.when(F.col(c).isNull() & F.col(a).isNotNull(), F.struct(F.lit(c).alias("part"), F.greatest(F.col(a), F.lit(0)).alias("a"), F.col(b).alias("b"))) for c, (a, b) in ranges.items()])
    wanted = rows.select("paper_id", key, F.explode(F.filter(need, lambda n: n.isNotNull())).alias("n")).where("n.a < n.b")
    wanted = wanted.select("paper_id", key, "n.*", F.explode(F.sequence(F.floor(F.col("n.a") / size).cast("int"), F.floor((F.col("n.b") - 1) / size).cast("int"))).alias("page"))
    here = F.greatest(F.col("a") - F.col("page").cast("bigint") * size, F.lit(0))
    piece = F.substring("text", (here + 1).cast("int"), (F.col("b") - F.col("page").cast("bigint") * size - here).cast("int"))
    parts = met(wanted, blocks.pages, ["paper_id", "page"]).groupBy("paper_id", key, "part").agg(F.array_sort(F.collect_list(F.struct("page", piece.alias("s")))).alias("l"))
    parts = parts.withColumn("s", F.array_join(F.col("l.s"), "")).groupBy("paper_id", key).agg(F.map_from_entries(F.collect_list(F.struct("part", "s"))).alias("_filled"))
    out = met(rows, parts, ["paper_id", key], "left")
    return out.withColumns({c: F.coalesce(c, F.when(F.col(a).isNotNull(), F.coalesce(F.element_at("_filled", F.lit(c)), F.lit("")))) for c, (a, _) in ranges.items()}).drop("_filled")


def _surroundings() -> list[Column]:
    """The names under which ``extract`` reads the text around an element."""
    return [F.col("pre").alias("_before"), F.col("post").alias("_after")]


def _numbered(rows: DataFrame, order: str = "start") -> DataFrame:
    return position(rows, ["paper_id"], [F.col(order)], "idx")


def _element(family: str, hit: Column, start: str = "start", stop: str = "stop", next_pos: Column | None = None, flag: Column | None = None) -> Column:
    return extract._element(family, F.col("idx"), hit, F.col(start), F.col(stop), next_pos, flag).alias("e")


def sections(blocks: Blocks) -> DataFrame:
    """As ``extract.sections``; a section's text, which may be long, is one row of the result."""
    rows = blocks.rows.withColumn("heads", found(HEADER_LINE))
    lead = F.coalesce(F.get("heads", F.lit(0))["start"] - F.col("offset"), F.col("size"))
    rows = rows.withColumn("led", strip(F.substring("text", F.lit(1), lead.cast("int"))) != "").drop("text")
    rows = with_next(stored(rows, "section-heads"), ["heads"])
    earlier = Window.partitionBy("paper_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("led", F.max("led").over(earlier))
    seen = F.sum(F.size("heads")).over(Window.partitionBy("paper_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", F.coalesce(seen, F.lit(0)))
    first = (F.col("before") == 0) & (F.size("heads") > 0)
    opening = F.when(first & F.col("led"), F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("stop"), F.col("block"), F.lit("").alias("hit"))))
    none = (F.col("before") == 0) & (F.size("heads") == 0) & (F.col("block") + 1 == F.col("n_blocks"))
    whole = F.when(none, F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("stop"), F.col("block"), F.lit(None).cast("string").alias("hit"))))
    empty = F.expr(f"cast(array() as array<{SPAN}>)")
    each = rows.withColumn("heads", F.concat(F.coalesce(whole, empty), F.coalesce(opening, empty), "heads"))
    each = each.select("paper_id", "doc_size", F.col("next_heads.start").alias("later"), F.posexplode("heads").alias("i", "h"), "heads")
    each = each.select("paper_id", "h.start", "h.stop", "h.hit", F.coalesce(F.get("heads", F.col("i") + 1)["start"], F.col("later"), F.col("doc_size")).alias("next_pos"))
    each = each.withColumn("place", F.when(F.coalesce(F.col("hit"), F.lit("")) == "", F.lit(-1).cast("bigint")).otherwise(F.col("start")))
    each = _numbered(each, "place").withColumn("content", F.lit(None).cast("string"))  # numbered before the texts are there
    each = filled(each, blocks, "place", {"content": ("stop", "next_pos")})
    full = F.col("hit").isNull()
    each = each.withColumn("full_text", F.col("content")).select("paper_id", "full_text", "content", _element("section", F.coalesce("hit", F.lit("")), next_pos=F.col("next_pos"), flag=full))
    columns = extract.section_columns() | {"content": F.when(F.col("e.flag"), F.col("content")).otherwise(strip(F.col("content")))}
    return each.select("paper_id", *[c.alias(n) for n, c in columns.items()])


def _delimiters() -> Column:
    """A block's delimiters in order: kind, whether one can open or close, start, stop."""

    def kind(hit: Column) -> Column:
        out = F.when(hit.isin("\\[", "\\]"), 1).when(hit == "$$", 2)
        for k, name in enumerate(ENVIRONMENTS):
            out = out.when(F.contains(hit, F.lit(name)), 3 + k)
        return out

    return F.transform(
        found(DELIMITER),
        lambda s: F.struct(
            kind(s["hit"]).alias("kind"), (F.startswith(s["hit"], F.lit("\\b")) | s["hit"].isin("\\[", "$$")).alias("opens"),
            (F.startswith(s["hit"], F.lit("\\e")) | s["hit"].isin("\\]", "$$")).alias("closes"), s["start"].alias("start"), s["stop"].alias("stop"),
        ),
    )


def _turn(state: Column, d: Column) -> Column:
    """The kind open after a delimiter: an opening one counts if the document has a closing one of its kind after it."""
    lasting = d["stop"] <= F.get("last_close", d["kind"])
    return F.when(state == 0, F.when(d["opens"] & lasting, d["kind"]).otherwise(F.lit(0))).otherwise(F.when(d["closes"] & (d["kind"] == state), F.lit(0)).otherwise(state))


def _entered(rows: DataFrame) -> DataFrame:
    """paper_id, block, open: the kind of equation that a block begins in, by a prefix scan over the blocks' maps.

    In each round a block's map takes in that of the block 1, 2, 4, ... before, so rounds grow with the logarithm of
    the longest document. A document takes part in as many as its own blocks need.
    """
    maps = stored(rows.where("n_blocks > 1").select("paper_id", "block", "n_blocks", "map"), "equation-maps")
    most, step = maps.agg(F.max("n_blocks")).first()[0] or 1, 1
    done = maps.where("n_blocks <= 1")
    while step < most:
        before = maps.select("paper_id", (F.col("block") + step).alias("block"), F.col("map").alias("earlier"))
        joined = met(maps, before, ["paper_id", "block"], "left")
        maps = joined.withColumn("map", F.when(F.col("earlier").isNull(), F.col("map")).otherwise(F.transform("earlier", lambda s: F.get("map", s)))).drop("earlier")
        maps, step = stored(maps, "equation-maps"), step * 2
        done, maps = done.unionByName(maps.where(F.col("n_blocks") <= step)), maps.where(F.col("n_blocks") > step)
    return done.select("paper_id", (F.col("block") + 1).alias("block"), F.get("map", F.lit(0)).alias("open"))


def _display(blocks: Blocks) -> DataFrame:
    """paper_id, start, stop, a, b (the inner range), block and n_blocks of each display equation."""
    rows = blocks.rows.withColumn("d", _delimiters())

    def last(kind: int) -> Column:
        closing = F.filter("d", lambda d: d["closes"] & (d["kind"] == kind))
        return F.coalesce(F.array_max(F.transform(closing, lambda d: d["start"])), F.lit(-1))

    rows = stored(rows.withColumn("last_close", F.array(*map(last, range(KINDS)))).drop("text"), "equation-delimiters")
    document = Window.partitionBy("paper_id")
    rows = rows.withColumn("last_close", F.array(*[F.max(F.get("last_close", F.lit(k))).over(document) for k in range(KINDS)]))
    through = F.aggregate("d", F.array(*[F.lit(k) for k in range(KINDS)]), lambda acc, d: F.transform(acc, lambda s: _turn(s, d)))
    rows = stored(rows.withColumn("map", through), "equation-blocks")
    rows = met(rows, _entered(rows), ["paper_id", "block"], "left")
    start = F.struct(F.coalesce("open", F.lit(0)).alias("state"), F.expr("cast(array() as array<struct<start: bigint, stop: bigint, opened: boolean>>)").alias("out"))

    def note(acc: Column, d: Column) -> Column:
        now = _turn(acc["state"], d)
        event = F.array(F.struct(d["start"].alias("start"), d["stop"].alias("stop"), (now != 0).alias("opened")))
        return F.struct(now.alias("state"), F.when(now != acc["state"], F.concat(acc["out"], event)).otherwise(acc["out"]).alias("out"))

    rows = rows.withColumn("events", F.aggregate("d", start, note, lambda acc: acc["out"]))
    final = F.get(F.filter("events", lambda e: e["opened"]), F.size(F.filter("events", lambda e: e["opened"])) - 1)
    before = Window.partitionBy("paper_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("carried", F.last(final, ignorenulls=True).over(before))
    each = rows.select("paper_id", "block", "carried", "events", F.posexplode("events").alias("i", "shut")).where("not shut.opened")
    opening = F.when(F.col("i") > 0, F.get("events", F.col("i") - 1)).otherwise(F.col("carried"))
    each = each.withColumn("o", opening)
    return each.select("paper_id", "block", F.col("o.start").alias("start"), F.col("shut.stop").alias("stop"), F.col("o.stop").alias("a"), F.col("shut.start").alias("b"))


def equations(blocks: Blocks) -> DataFrame:
    """As ``extract.equations``."""
    names = ["paper_id", "start", "stop", "a", "b"]
    display = _display(blocks).withColumn("display", F.lit(True))
    inline = blocks.rows.select("paper_id", "block", F.explode(found(INLINE_EQUATION)).alias("s")).select(
        "paper_id", "block", F.col("s.start").alias("start"), F.col("s.stop").alias("stop"), (F.col("s.start") + 2).alias("a"), (F.col("s.stop") - 2).alias("b"), F.lit(False).alias("display")
    )
    rows = met(display.unionByName(inline), blocks.rows, ["paper_id", "block"])
    reach = F.when(F.col("display"), 200).otherwise(100)
    rows = rows.withColumns({"x": F.col("start") - reach, "y": F.least(F.col("stop") + reach, "doc_size"), "place": F.col("start") * 2 + (~F.col("display")).cast("int")})
    rows = rows.withColumns({"inner": local(F.col("a"), F.col("b")), "pre": local(F.col("x"), F.col("start")), "post": local(F.col("stop"), F.col("y"))})
    rows = filled(stored(rows.select(*names, "display", "x", "y", "place", "inner", "pre", "post"), "equation-rows"), blocks, "place", {"inner": ("a", "b"), "pre": ("x", "start"), "post": ("stop", "y")})
    rows = rows.withColumns({c: strip(F.col(c)) for c in ("inner", "pre", "post")}).where((F.length("inner") >= 2) | (F.col("display") & (F.length("inner") == 1)))
    rows = position(rows.withColumn("inline", ~F.col("display")), ["paper_id"], [F.col("inline"), F.col("start")], "idx")
    rows = rows.select("paper_id", *_surroundings(), _element("equation", F.col("inner"), flag=F.col("display")))
    return rows.select("paper_id", *[c.alias(n) for n, c in extract.equation_columns().items()])


def tables(blocks: Blocks) -> DataFrame:
    """As ``extract.tables``."""
    rows = blocks.rows.withColumn("s", F.explode(found(MARKDOWN_TABLE))).select("*", "s.start", "s.stop", strip(F.col("s.hit")).alias("raw"))
    rows = rows.where(F.size(extract.table_rows(F.col("raw"))) >= 2).withColumns({"x": F.col("start") - 300, "y": F.least(F.col("stop") + 200, "doc_size")})
    rows = rows.withColumns({"pre": local(F.col("x"), F.col("start")), "post": local(F.col("stop"), F.col("y"))})
    rows = stored(rows.select("paper_id", "start", "stop", "raw", "x", "y", "pre", "post"), "table-rows")
    rows = _numbered(filled(rows, blocks, "start", {"pre": ("x", "start"), "post": ("stop", "y")}))
    return rows.select("paper_id", *_surroundings(), _element("table", F.col("raw"))).select("paper_id", *[c.alias(n) for n, c in extract.table_columns().items()])


def theorems(blocks: Blocks) -> DataFrame:
    """As ``extract.theorems``: a statement reaches to the next head, proof or header, and a proof to the next of some of these."""
    lists = {"heads": THEOREM_HEAD, "ends": STATEMENT_END, "proofs": PROOF_HEAD, "stops": PROOF_STOP}
    rows = stored(blocks.rows.withColumns({c: found(p) for c, p in lists.items()}).drop("text"), "theorem-marks")
    rows = stored(with_next(rows, list(lists)), "theorem-blocks")
    each = rows.withColumn("h", F.explode("heads")).withColumn("end", first_from("ends", F.col("h.stop")))
    each = each.select("paper_id", "doc_size", "h.start", "h.stop", "h.hit", "h.block", F.col("end.block").alias("end_block"), F.coalesce("end.start", "doc_size").alias("end_at"))
    there = rows.select("paper_id", F.col("block").alias("end_block"), "heads", "next_heads", "proofs", "next_proofs")
    each = met(each, there, ["paper_id", "end_block"], "left").withColumns({"own": F.coalesce(first_from("heads", F.col("end_at"))["start"], "doc_size"), "proof": first_from("proofs", F.col("end_at"))})
    each = each.withColumn("proof", F.when(F.col("proof.start") < F.col("own"), F.col("proof"))).drop("heads", "next_heads", "proofs", "next_proofs")
    there = rows.select("paper_id", F.col("block").alias("proof_block"), "stops", "next_stops")
    each = met(each.withColumn("proof_block", F.col("proof.block")), there, ["paper_id", "proof_block"], "left")
    # white space after the proof's head counts as its text if there is nothing else
    bare = (F.col("proof.stop") >= F.col("own")) & F.col("proof.hit").rlike(r"\s\z")
    begins = F.when(bare | (F.col("proof.stop") < F.col("own")), F.col("proof.stop"))
    each = each.withColumns({"begins": begins, "shut": F.least(F.coalesce(first_from("stops", F.col("proof.stop") + 1)["start"], F.col("own")), F.col("own"))})
    each = met(each.select("paper_id", "block", "start", "stop", "hit", "end_at", "begins", "shut"), blocks.rows, ["paper_id", "block"])
    each = each.withColumns({"x": F.col("start") - 300, "y": F.least(F.col("end_at") + 300, "doc_size")})
    each = each.withColumns({"_stmt": local(F.col("stop"), F.col("end_at")), "pre": local(F.col("x"), F.col("start")), "post": local(F.col("end_at"), F.col("y")), "proof": local(F.col("begins"), F.col("shut"))})
    names = ["paper_id", "start", "stop", "hit", "end_at", "begins", "shut", "x", "y", "_stmt", "pre", "post", "proof"]
    each = stored(each.withColumn("proof", F.when(F.col("begins").isNotNull(), F.col("proof"))).select(*names), "theorem-rows")
    each = _numbered(filled(each, blocks, "start", {"_stmt": ("stop", "end_at"), "pre": ("x", "start"), "post": ("end_at", "y"), "proof": ("begins", "shut")}))
    each = each.select("paper_id", *_surroundings(), "_stmt", "proof", _element("theorem", F.col("hit")))
    columns = extract.theorem_columns() | {"proof": strip(F.col("proof"))}
    return each.select("paper_id", *[c.alias(n) for n, c in columns.items()])
