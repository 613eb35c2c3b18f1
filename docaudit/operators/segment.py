"""Snippets: the units that are routed and scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.constants import (
    CHUNK_CHARS, CHUNK_OVERLAP, OVERLAP_CHARS, REVIEW_CHARS, REVIEW_FLOOR_CHARS, SECTION_CHARS, SNIPPET_CHARS,
)
from docaudit.functions.text import cut_every, head, once, strip, tail
from docaudit.operators import extract

# order of the families inside a document
FAMILIES = ["section", "equation", "figure", "table", "theorem"]

COLUMNS = {
    "paper_id": None, "snippet_id": "string", "snippet_type": "string", "location": "string",
    "content": "string", "order_key": "bigint", "section_title": "string", "section_level": "int",
    "part": "int", "total_parts": "int", "latex": "string", "display_mode": "boolean",
    "caption": "string", "row_count": "int", "theorem_type": "string", "has_proof": "boolean",
}


def order_key(family: str, index: Column) -> Column:
    """Sortable position in the document, known without a window; pieces add their number."""
    return F.lit(FAMILIES.index(family)).cast("bigint") * (1 << 52) + index.cast("bigint") * (1 << 20)


def _shape(df: DataFrame) -> DataFrame:
    """The common snippet columns, missing ones as typed nulls, with size columns."""
    have = set(df.columns)
    cols = [
        F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in COLUMNS.items()
    ]
    return with_sizes(df.select(*cols))


def with_sizes(snippets: DataFrame, text: str = "content") -> DataFrame:
    n = F.length(text)
    return snippets.withColumn("content_length", n.cast("bigint")).withColumn(
        "estimated_tokens", F.greatest(F.lit(1), F.floor(n / 4)).cast("bigint")
    )


def _sid(tag: str, index: str) -> Column:
    return F.concat(F.col("paper_id").cast("string"), F.lit(f"_{tag}_"), F.col(index).cast("string"))


def _block(*parts: Column) -> Column:
    return F.concat_ws("\n\n", *parts)


def _named(label: str, text: Column) -> Column:
    """"label" plus text; null (and so left out of a block) where the text is empty."""
    return F.when(text != "", F.concat(F.lit(label), text))


def section_parts(section_chars: int = SECTION_CHARS, size: int = SNIPPET_CHARS, overlap: int = OVERLAP_CHARS) -> dict[str, Column]:
    """Long sections become overlapping pieces."""
    long = F.length("content") > section_chars
    return {
        "base_id": _sid("sec", "section_idx"),
        "snippet_type": F.when(F.col("section_level") >= 3, "SUBSECTION").otherwise("SECTION"),
        "location": F.concat(F.lit("Section "), "section_title"),
        "pieces": F.when(long, windows(F.col("content"), size, overlap)).otherwise(F.array("content")),
        "is_split": long,
        "base_key": order_key("section", F.col("section_idx")),
        "section_title": F.col("section_title"),
        "section_level": F.col("section_level").cast("int"),
    }


def equation_parts() -> dict[str, Column]:
    content = _block(
        _named("Context before:\n", tail(F.col("context_before"), 500)),
        F.concat(F.lit("Equation:\n"), "latex"),
        _named("Context after:\n", head(F.col("context_after"), 500)),
    )
    return {
        "base_id": _sid("eq", "eq_idx"),
        "snippet_type": F.lit("EQUATION"),
        "location": F.col("equation_label"),
        "pieces": F.array(content),
        "base_key": order_key("equation", F.col("eq_idx")),
        "latex": F.col("latex"),
        "display_mode": F.col("display_mode"),
    }


def figure_parts() -> dict[str, Column]:
    content = _block(
        _named("Caption: ", F.col("caption")),
        _named("Context before:\n", tail(F.col("context_before"), 300)),
        _named("Context after:\n", head(F.col("context_after"), 300)),
    )
    return {
        "base_id": _sid("img", "image_idx"),
        "snippet_type": F.lit("FIGURE"),
        "location": F.col("caption"),
        "pieces": F.array(content),
        "base_key": order_key("figure", F.col("image_idx")),
        "caption": F.col("caption"),
    }


def table_parts() -> dict[str, Column]:
    content = _block(_named("Caption: ", F.col("caption")), F.concat(F.lit("Table content:\n"), "raw_content"))
    return {
        "base_id": _sid("tbl", "table_idx"),
        "snippet_type": F.lit("TABLE"),
        "location": F.col("caption"),
        "pieces": F.array(content),
        "base_key": order_key("table", F.col("table_idx")),
        "caption": F.col("caption"),
        "row_count": F.size("rows"),
    }


def theorem_parts() -> dict[str, Column]:
    content = _block(
        F.concat(F.lit("**"), "label", F.lit("**")),
        F.concat(F.lit("Statement: "), "statement"),
        _named("Proof: ", F.col("proof")),
        _named("Context before:\n", tail(F.col("context_before"), 300)),
        _named("Context after:\n", head(F.col("context_after"), 300)),
    )
    return {
        "base_id": _sid("thm", "theorem_idx"),
        "snippet_type": F.when(F.col("theorem_type") == "claim", "THEOREM").otherwise(F.upper("theorem_type")),
        "location": F.col("label"),
        "pieces": F.array(content),
        "base_key": order_key("theorem", F.col("theorem_idx")),
        "theorem_type": F.col("theorem_type"),
        "has_proof": F.col("proof").isNotNull(),
    }


def _unfold(rows: DataFrame) -> DataFrame:
    """One row per piece; the pieces of a split section carry their number.

    The outer explode matters: an inner one adds a filter on the array's size, which is
    pushed down and builds every piece a second time. No array here is empty.
    """
    split = F.coalesce("is_split", F.lit(False)) if "is_split" in rows.columns else F.lit(False)
    rest = [c for c in rows.columns if c not in ("pieces", "is_split")]
    out = rows.select(*rest, split.alias("_split"), F.size("pieces").alias("_n"), F.posexplode_outer("pieces").alias("_j", "content"))
    part = F.when(F.col("_split"), F.col("_j"))
    number = F.col("_j").cast("string")
    return out.withColumns(
        {
            "part": part,
            "total_parts": F.when(F.col("_split"), F.col("_n")),
            "snippet_id": F.when(F.col("_split"), F.concat("base_id", F.lit("_part_"), number)).otherwise(F.col("base_id")),
            "location": F.when(part > 0, F.concat("location", F.lit(" (part "), (part + 1).cast("string"), F.lit(")"))).otherwise(
                F.col("location")
            ),
            "order_key": F.col("base_key") + F.coalesce(part, F.lit(0)),
        }
    )


def _snippets(df: DataFrame, parts: dict[str, Column]) -> DataFrame:
    return _shape(_unfold(df.select("paper_id", *[c.alias(n) for n, c in parts.items()])))


def section_snippets(sections: DataFrame, section_chars: int = SECTION_CHARS, size: int = SNIPPET_CHARS,
                     overlap: int = OVERLAP_CHARS) -> DataFrame:
    return _snippets(sections, section_parts(section_chars, size, overlap))


def equation_snippets(equations: DataFrame) -> DataFrame:
    return _snippets(equations, equation_parts())


def figure_snippets(images: DataFrame) -> DataFrame:
    return _snippets(images, figure_parts())


def table_snippets(tables: DataFrame) -> DataFrame:
    return _snippets(tables, table_parts())


def theorem_snippets(theorems: DataFrame) -> DataFrame:
    return _snippets(theorems, theorem_parts())


def segment(corpus: DataFrame) -> DataFrame:
    """All snippets of all documents from one scan of the corpus, without a shuffle.

    The families' elements come out of one explode. Each later step is one projection
    in which a column picks the expression of the row's family.
    """
    family = F.col("e.family")

    def pick(by_family: dict[str, dict[str, Column]]) -> list[Column]:
        names = list(dict.fromkeys(n for cols in by_family.values() for n in cols))
        out = []
        for name in names:
            case = None
            for fam, cols in by_family.items():
                if name in cols:
                    hit = family == fam
                    case = F.when(hit, cols[name]) if case is None else case.when(hit, cols[name])
            out.append(case.alias(name))
        return out

    images_ = {k: v for k, v in extract.image_columns().items() if k != "base64_data"}  # an element's row holds no payload
    light = corpus.select("paper_id", extract.without_payloads(F.col("paper_content")).alias("paper_content"))
    rows = extract.with_surroundings(extract.elements(light), FAMILIES).select(
        "paper_id",
        "e",
        *pick(
            {
                "section": extract.section_columns(), "equation": extract.equation_columns(), "figure": images_,
                "table": extract.table_columns(), "theorem": extract.theorem_columns(),
            }
        ),
    )
    builders = {
        "section": section_parts(), "equation": equation_parts(), "figure": figure_parts(),
        "table": table_parts(), "theorem": theorem_parts(),
    }
    return _shape(_unfold(rows.select("paper_id", *pick(builders))))


def line_snippets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Non-blank lines of plain text as paragraph snippets."""
    rows = docs.select("*", F.posexplode_outer(F.split(text, "\n")).alias("line_idx", "content"))
    rows = rows.where(strip(F.col("content")) != "")
    return with_sizes(
        rows.withColumn(
            "snippet_id", F.concat(F.col(key).cast("string"), F.lit("_line_"), F.col("line_idx").cast("string"))
        ).withColumn("order_key", F.col("line_idx").cast("bigint"))
    )


def windows(text: Column, size: int = SNIPPET_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    """Overlapping pieces of ``size`` characters; a piece ends at its last blank line
    if that lies beyond its middle. Without blank lines the cut points are a sequence.

    A character's place in a text is found by going there from its beginning, so the text is
    cut into pages first; a piece lies on two of them, and time grows with the text, not its square.
    """
    if overlap < 0 or 2 * overlap >= size:
        raise ValueError("overlap must be less than half of the size")
    step, least = size - overlap, size // 2 + 1 - overlap

    def piece(doc: Column, start: Column) -> Column:
        page = F.floor(start / size).cast("int")
        near = F.concat(F.coalesce(F.get(doc["pages"], page), F.lit("")), F.coalesce(F.get(doc["pages"], page + 1), F.lit("")))
        return F.substring(near, start - page * size + 1, F.lit(size))

    def even(doc: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(doc["length"] - overlap - 1, F.lit(0)), F.lit(step))
        return F.transform(starts, lambda s: piece(doc, s))

    def ragged(doc: Column) -> Column:
        def advance(acc: Column, _: Column) -> Column:
            start = acc["at"]
            last = start + size >= doc["length"]

            def moved(whole: Column) -> Column:
                back = F.locate("\n\n", F.reverse(whole))
                cut = F.length(whole) - back - 1
                keep = F.when(~last & (back > 0) & (cut > size // 2), cut).otherwise(F.lit(size))
                return F.struct(
                    F.when(last, doc["length"] + 1).otherwise(start + keep - overlap).cast("int").alias("at"),
                    F.concat(acc["out"], F.array(F.substring(whole, F.lit(1), keep))).alias("out"),
                )

            return F.when(start > doc["length"], acc).otherwise(once(piece(doc, start), moved))

        turns = F.sequence(F.lit(1), F.floor(doc["length"] / least).cast("int") + 2)
        return F.aggregate(turns, F.expr("named_struct('at', 0, 'out', cast(array() as array<string>))"), advance, lambda acc: acc["out"])

    doc = F.struct(cut_every(text, size).alias("pages"), F.length(text).alias("length"))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(
        once(doc, lambda d: F.when(F.contains(text, F.lit("\n\n")), ragged(d)).otherwise(even(d)))
    )


def chunks(text: Column, max_chars: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Paragraphs, then sentences, then fixed slices, packed into chunks of up to
    ``max_chars``; each chunk after the first starts with the end of the one before."""
    body = strip(F.coalesce(text, F.lit("")))

    def pieces(values: Column, finer) -> Column:
        clean = F.filter(F.transform(values, strip), lambda v: v != "")
        return F.flatten(
            F.transform(clean, lambda v: F.when(F.length(v) <= max_chars, F.array(v)).otherwise(finer(v)))
        )

    units = pieces(
        F.split(body, r"\n\s*\n"),
        lambda para: pieces(F.split(para, r"(?<=[.!?])\s+"), lambda s: cut_every(s, max_chars)),
    )

    def pack(acc: Column, n: Column) -> Column:
        fits = (acc["n"] == 0) | (acc["len"] + 1 + n <= max_chars)
        grown = F.struct(
            F.when(acc["n"] == 0, n).otherwise(acc["len"] + 1 + n).alias("len"),
            acc["at"].alias("at"),
            (acc["n"] + 1).alias("n"),
            acc["out"].alias("out"),
        )
        fresh = F.struct(
            n.alias("len"),
            (acc["at"] + acc["n"]).alias("at"),
            F.lit(1).alias("n"),
            F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), acc["n"].alias("n")))).alias("out"),
        )
        return F.when(fits, grown).otherwise(fresh)

    def bounds(lengths: Column) -> Column:
        start = F.expr("named_struct('len', 0, 'at', 1, 'n', 0, 'out', cast(array() as array<struct<at: int, n: int>>))")
        return F.aggregate(lengths, start, pack, lambda acc: F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), acc["n"].alias("n")))))

    def joined(all_: Column) -> Column:
        return F.transform(bounds(F.transform(all_, F.length)), lambda b: F.array_join(F.slice(all_, b["at"], b["n"]), "\n"))

    packed = once(units, joined)
    if overlap > 0:
        # the previous chunk is read from the same array, by position
        packed = once(
            packed,
            lambda all_: F.transform(
                all_,
                lambda c, i: F.when(i == 0, c).otherwise(
                    F.concat(tail(F.get(all_, i - 1), overlap), F.lit("\n"), c)
                ),
            ),
        )
    return F.when(F.length(body) <= max_chars, F.array(body)).otherwise(packed)


def chunk_rows(df: DataFrame, text: str, max_chars: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """One row per chunk, with its index and the number of chunks of its text."""
    rest = [c for c in df.columns if c != text]
    return df.withColumn("_chunks", chunks(F.col(text), max_chars, overlap)).select(
        *rest, F.size("_chunks").alias("n_chunks"), F.posexplode_outer("_chunks").alias("chunk_idx", "chunk")
    )


def step_snippets(cases: DataFrame) -> DataFrame:
    """Each step with the problem and all steps before it as context."""
    rows = cases.select("id", "problem", "steps", F.posexplode("steps").alias("step_index", "step"))
    prior = F.transform(
        F.slice("steps", F.lit(1), F.col("step_index")),
        lambda s, j: F.concat(F.lit("Step "), j.cast("string"), F.lit(": "), s),
    )
    content = F.array_join(
        F.concat(
            F.array(F.concat(F.lit("Problem: "), "problem")),
            prior,
            F.array(F.concat(F.lit("Current step "), F.col("step_index").cast("string"), F.lit(": "), "step")),
        ),
        "\n\n",
    )
    return rows.select(
        F.concat(F.col("id").cast("string"), F.lit("_step_"), F.col("step_index").cast("string")).alias("snippet_id"),
        F.lit("PARAGRAPH").alias("snippet_type"),
        F.col("id").alias("paper_id"),
        F.concat(F.lit("Step "), F.col("step_index").cast("string")).alias("location"),
        content.alias("content"),
        extract.step_math(F.col("step")).alias("latex"),
        "step_index",
    )


def review_budgets(length: Column, limit: int = REVIEW_CHARS, floor: int = REVIEW_FLOOR_CHARS) -> Column:
    """Input sizes to try in turn: the whole text up to ``limit``, halved while at least ``floor``."""
    top = F.least(length, F.lit(limit))
    halvings = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: F.floor(top / F.pow(F.lit(2.0), i)).cast("int"))
    return F.filter(halvings, lambda b, i: (i == 0) | (b >= floor))


def truncations(texts: DataFrame, text: str = "full_text", limit: int = REVIEW_CHARS, floor: int = REVIEW_FLOOR_CHARS) -> DataFrame:
    """The attempts of a single-call review: budget, cut text and whether it was cut."""
    rows = texts.select("*", F.posexplode_outer(review_budgets(F.length(text), limit, floor)).alias("attempt", "budget"))
    return rows.select(
        "paper_id",
        "attempt",
        "budget",
        (F.length(text) > F.col("budget")).alias("truncated"),
        F.substring(F.col(text), F.lit(1), F.col("budget")).alias("cut_text"),
    )
