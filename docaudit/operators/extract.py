"""Structure of a document: sections, equations, images, tables, theorem blocks.

Every operator is a projection plus an explode: a document is one row, so nothing
shuffles, and the text is scanned by the JVM's regex engine, never by Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.constants import (
    BRACKET_CITATION, CONTENT_TYPES, DISPLAY_EQUATION, DOMAIN_PATTERNS, EQUATION_LABEL,
    FIGURE_CAPTION, HEADER_LINE, INLINE_EQUATION, MARKDOWN_TABLE, NAME_CITATION, PROOF_BLOCK,
    REFERENCE_TAGS, SEPARATOR_ROW, STATEMENT_END, STEP_MATH, TABLE_CAPTION, THEOREM_HEAD,
)
from docaudit.functions.text import between, blank_to_null, head, spans, strip, tail


def items(corpus: DataFrame) -> DataFrame:
    """One row per content item, with its position; unknown types are named so."""
    kind = F.col("item.type")
    return corpus.select("paper_id", F.posexplode_outer("paper_content").alias("pos", "item")).select(
        "paper_id",
        "pos",
        F.when(kind.isin(CONTENT_TYPES), kind).otherwise(F.lit("unknown")).alias("type"),
        F.col("item.text").alias("text"),
        F.col("item.image_url.url").alias("url"),
    )


def joined_text(content: Column) -> Column:
    texts = F.filter(content["text"], lambda t: t.isNotNull() & (t != ""))  # the field alone is read, no image
    return F.array_join(texts, "\n")


def without_payloads(content: Column) -> Column:
    """Types and texts of the items. Read field by field, so that no image is read or made."""
    return F.zip_with(content["type"], content["text"], lambda kind, text: F.struct(kind.alias("type"), text.alias("text")))


def full_text(corpus: DataFrame) -> DataFrame:
    """(paper_id, full_text): non-empty item texts, one per line."""
    return corpus.select("paper_id", joined_text(F.col("paper_content")).alias("full_text"))


# An element is a located piece of structure, of any family:
# hit = matched text (of an equation its LaTeX), next_pos = start of the next header,
# flag = display mode of an equation, or "no header at all" of a section.
ELEMENT = (
    "struct<family: string, idx: int, hit: string, start_pos: int, end_pos: int, next_pos: int, flag: boolean>"
)


def _element(family: str, idx: Column, hit: Column, start: Column, end: Column,
             next_pos: Column | None = None, flag: Column | None = None) -> Column:
    return F.struct(
        F.lit(family).alias("family"),
        idx.cast("int").alias("idx"),
        hit.alias("hit"),
        start.cast("int").alias("start_pos"),
        end.cast("int").alias("end_pos"),
        (F.lit(None) if next_pos is None else next_pos).cast("int").alias("next_pos"),
        (F.lit(None) if flag is None else flag).cast("boolean").alias("flag"),
    )


def section_elements(text: Column) -> Column:
    """Headers, each with the start of the next one; one element for a text without headers.

    What stands before the first header, if not blank, is a section of its own, with the length of
    its text as the start of the next header and no text of its own as its header.
    """

    def each(found: Column) -> Column:
        opening = F.get(found, F.lit(0))["start_pos"]
        none = F.struct(F.lit("").alias("hit"), F.lit(0).alias("start_pos"), F.lit(0).alias("end_pos"))
        before = F.when(strip(F.substring(text, F.lit(1), opening)) != "", F.array(none))
        plain = F.transform(found, lambda s: F.struct(s["hit"].alias("hit"), s["start_pos"].cast("int").alias("start_pos"), s["end_pos"].cast("int").alias("end_pos")))
        headed = F.concat(F.coalesce(before, F.slice(F.array(none), 1, 0)), plain)
        return F.transform(
            F.array(headed),
            lambda all_: F.transform(
                all_,
                lambda s, i: _element(
                    "section", i, s["hit"], s["start_pos"], s["end_pos"],
                    F.coalesce(F.get(all_, i + 1)["start_pos"], F.length(text)), F.lit(False),
                ),
            ),
        )[0]

    whole = F.array(_element("section", F.lit(0), F.lit(""), F.lit(0), F.lit(0), F.length(text), F.lit(True)))
    return F.transform(
        F.array(spans(text, HEADER_LINE)), lambda found: F.when(F.size(found) > 0, each(found)).otherwise(whole)
    )[0]


def equation_elements(text: Column) -> Column:
    """Display equations first, then inline ones; the index runs on across both."""

    def latex_of(hit: Column) -> Column:
        return strip(
            F.coalesce(*[blank_to_null(F.regexp_extract(hit, DISPLAY_EQUATION, i)) for i in range(1, 6)], F.lit(""))
        )

    def keep(pattern: str, latex, display: bool, least: int) -> Column:
        rows = F.transform(
            spans(text, pattern),
            lambda s: F.struct(
                latex(s["hit"]).alias("latex"), s["start_pos"], s["end_pos"], F.lit(display).alias("display_mode")
            ),
        )
        return F.filter(rows, lambda r: F.length(r["latex"]) >= least)

    both = F.concat(
        keep(DISPLAY_EQUATION, latex_of, True, 1),
        keep(INLINE_EQUATION, lambda h: strip(F.regexp_extract(h, INLINE_EQUATION, 1)), False, 2),
    )
    return F.transform(
        both,
        lambda e, i: _element("equation", i, e["latex"], e["start_pos"], e["end_pos"], flag=e["display_mode"]),
    )


def image_elements(content: Column) -> Column:
    """Image items; start_pos is the item's position."""
    at = F.filter(
        F.transform(content, lambda x, i: F.struct(x["type"].alias("type"), i.alias("pos"))),
        lambda x: x["type"] == "image_url",
    )
    return F.transform(at, lambda x, i: _element("figure", i, F.lit(""), x["pos"], x["pos"]))


def table_rows(raw: Column) -> Column:
    """Cells of a markdown table, without the separator row."""
    lines = F.filter(F.split(raw, "\n"), lambda line: ~line.rlike(SEPARATOR_ROW))
    cells = F.transform(
        lines,
        lambda line: F.transform(
            F.slice(F.split(line, r"\|"), 2, F.greatest(F.size(F.split(line, r"\|")) - 2, F.lit(0))), strip
        ),
    )
    return F.filter(cells, lambda c: F.size(c) > 0)


def table_elements(text: Column) -> Column:
    """Markdown tables with at least one data row, of any number of columns."""
    found = F.filter(
        F.transform(
            spans(text, MARKDOWN_TABLE),
            lambda s: F.struct(strip(s["hit"]).alias("raw"), s["start_pos"], s["end_pos"]),
        ),
        lambda t: F.size(table_rows(t["raw"])) >= 2,
    )
    return F.transform(found, lambda t, i: _element("table", i, t["raw"], t["start_pos"], t["end_pos"]))


def theorem_elements(text: Column) -> Column:
    return F.transform(
        spans(text, THEOREM_HEAD), lambda t, i: _element("theorem", i, t["hit"], t["start_pos"], t["end_pos"])
    )


# Columns of an element, read from (full_text, paper_content, e) rows.


def _at(field: str) -> Column:
    return F.col(f"e.{field}")


def _numbered(word: str) -> Column:
    return F.concat(F.lit(word + " "), (_at("idx") + 1).cast("string"))


def section_columns() -> dict[str, Column]:
    text, whole = F.col("full_text"), _at("flag")
    number = F.regexp_extract(_at("hit"), HEADER_LINE, 2)
    title = strip(F.regexp_extract(_at("hit"), HEADER_LINE, 3))
    return {
        "section_idx": _at("idx"),
        "section_title": F.when(whole, F.lit("Full Paper"))
        .when(_at("hit") == "", F.lit("Preamble"))
        .when(number != "", F.concat(number, F.lit(". "), title))
        .otherwise(title),
        "section_level": F.when(whole | (_at("hit") == ""), F.lit(1)).otherwise(F.length(F.regexp_extract(_at("hit"), HEADER_LINE, 1))),
        "content": F.when(whole, text).otherwise(
            strip(between(text, _at("end_pos"), _at("next_pos")))
        ),
        "start_index": _at("end_pos"),
        "end_index": _at("next_pos"),
    }


def equation_columns() -> dict[str, Column]:
    display = _at("flag")
    label = F.regexp_extract(_at("hit"), EQUATION_LABEL, 1)
    return {
        "eq_idx": _at("idx"),
        "equation_label": F.when(~display, _numbered("Inline")).when(label != "", label).otherwise(_numbered("Equation")),
        "latex": _at("hit"),
        "display_mode": display,
        "context_before": F.col("_before"),
        "context_after": F.col("_after"),
    }


def image_columns() -> dict[str, Column]:
    url = F.get("paper_content", _at("start_pos"))["image_url"]["url"]
    first, second = (strip(F.regexp_extract(c, FIGURE_CAPTION, 1)) for c in ("_before", "_after"))
    cut = F.locate("base64,", url)
    return {
        "image_idx": _at("idx"),
        "caption": F.when(first != "", first).when(second != "", second).otherwise(_numbered("Figure")),
        "base64_data": F.when(cut > 0, F.substring(url, cut + 7, F.length(url))).when(url != "", url),
        "context_before": F.col("_before"),
        "context_after": F.col("_after"),
    }


def table_columns() -> dict[str, Column]:
    caption = strip(F.regexp_extract("_before", TABLE_CAPTION, 0))
    return {
        "table_idx": _at("idx"),
        "caption": F.when(caption != "", caption).otherwise(_numbered("Table")),
        "raw_content": _at("hit"),
        "rows": table_rows(_at("hit")),
        "context_before": tail(blank_to_null(F.col("_before")), 200),
        "context_after": F.col("_after"),
    }


def theorem_columns() -> dict[str, Column]:
    own = F.split("_after", THEOREM_HEAD, 2)[0]
    return {
        "theorem_idx": _at("idx"),
        "theorem_type": F.lower(F.regexp_extract(_at("hit"), THEOREM_HEAD, 1)),
        "label": F.rtrim(F.replace(strip(_at("hit")), F.lit("**"), F.lit("")), F.lit(".")),
        "statement": strip(F.col("_stmt")),
        "proof": strip(blank_to_null(F.regexp_extract(own, PROOF_BLOCK, 1))),
        "context_before": F.col("_before"),
        "context_after": head(F.col("_after"), 300),
    }


def with_surroundings(rows: DataFrame, families: list[str]) -> DataFrame:
    """Add the text around each element: _before and _after, and a theorem's _stmt.

    They are a projection of their own because several columns read each of them.
    What follows a theorem starts after its statement.
    """
    text, start, end = F.col("full_text"), _at("start_pos"), _at("end_pos")
    family = _at("family")
    reach = F.when(_at("flag"), F.lit(200)).otherwise(F.lit(100))

    def neighbour(step: int) -> Column:
        return blank_to_null(F.get("paper_content", start + step)["text"])

    def pick(arms: dict[str, Column]) -> Column:
        case = F.lit(None).cast("string")
        for name, value in arms.items():
            if name in families:
                case = F.when(family == name, value).otherwise(case)
        return case

    if "theorem" in families:
        rows = rows.withColumn("_rest", F.when(family == "theorem", between(text, end, F.length(text))))
        rows = rows.withColumn("_stmt", F.split("_rest", STATEMENT_END, 2)[0])
    before, after = {}, {}
    if "figure" in families:
        before["figure"], after["figure"] = tail(neighbour(-1), 500), head(neighbour(1), 500)
    if "equation" in families:
        before["equation"] = strip(between(text, start - reach, start))
        after["equation"] = strip(between(text, end, end + reach))
    if "table" in families:
        before["table"], after["table"] = between(text, start - 300, start), between(text, end, end + 200)
    if "theorem" in families:
        before["theorem"] = between(text, start - 300, start)
        after["theorem"] = F.substring(F.col("_rest"), F.length("_stmt") + 1, F.length("_rest"))
    return rows.withColumns({"_before": pick(before), "_after": pick(after)})


def _table_of(df: DataFrame, family: str, elements: Column, columns: dict[str, Column]) -> DataFrame:
    keep = [c for c in ("paper_id", "full_text", "paper_content") if c in df.columns]
    # An inner explode makes Catalyst test the array in a filter, and so build it twice.
    rows = df.select(*keep, F.explode_outer(elements).alias("e")).where(F.col("e").isNotNull())
    if "full_text" not in keep:
        rows = rows.withColumn("full_text", F.lit(""))
    rows = with_surroundings(rows, [family])
    return rows.select("paper_id", *[c.alias(n) for n, c in columns.items()])


def sections(texts: DataFrame) -> DataFrame:
    """Header to header; a document without headers is one section, cut to its first 10,000 characters."""
    return _table_of(texts, "section", section_elements(F.col("full_text")), section_columns())


def equations(texts: DataFrame) -> DataFrame:
    return _table_of(texts, "equation", equation_elements(F.col("full_text")), equation_columns())


def images(corpus: DataFrame) -> DataFrame:
    """Image items with payload, neighbouring text and the caption found there."""
    return _table_of(corpus.select("paper_id", "paper_content"), "figure", image_elements(F.col("paper_content")), image_columns())


def tables(texts: DataFrame) -> DataFrame:
    return _table_of(texts, "table", table_elements(F.col("full_text")), table_columns())


def theorems(texts: DataFrame) -> DataFrame:
    """Theorem-like blocks; a proof belongs to the block it follows, up to the next block."""
    return _table_of(texts, "theorem", theorem_elements(F.col("full_text")), theorem_columns())


def elements(corpus: DataFrame) -> DataFrame:
    """All elements of all families in one scan of the corpus: (paper_id, full_text, paper_content, e)."""
    base = corpus.select("paper_id", "paper_content", joined_text(F.col("paper_content")).alias("full_text"))
    text = F.col("full_text")
    every = F.concat(
        section_elements(text), equation_elements(text), image_elements(F.col("paper_content")),
        table_elements(text), theorem_elements(text),
    )
    return base.select("paper_id", "full_text", "paper_content", F.explode_outer(every).alias("e"))


def tagged_text(corpus: DataFrame) -> DataFrame:
    """Full text with figure, table and equation references, and images, as tags."""

    def tag(text: Column) -> Column:
        for pattern, label in REFERENCE_TAGS:
            text = F.regexp_replace(text, pattern, label)
        return text

    def part(x: Column, i: Column) -> Column:
        rank = F.size(F.filter(F.slice("paper_content", F.lit(1), i + 1), lambda y: y["type"] == "image_url"))
        return (
            F.when((x["type"] == "text") & (x["text"] != ""), tag(x["text"]))
            .when(x["type"] == "image_url", F.concat(F.lit("\n[IMAGE:FIGURE_"), rank.cast("string"), F.lit("]\n")))
        )

    parts = F.filter(F.transform("paper_content", part), lambda p: p.isNotNull())
    return corpus.select("paper_id", F.array_join(parts, "\n").alias("tagged_full_text"))


def structure_counts(corpus: DataFrame) -> DataFrame:
    """Elements per document and family: array sizes of one scan, without explode or shuffle."""
    content = F.col("paper_content")
    base = corpus.select("paper_id", "paper_content", joined_text(content).alias("full_text"))
    text = F.col("full_text")
    return base.select(
        "paper_id",
        F.size(section_elements(text)).alias("n_sections"),
        F.size(equation_elements(text)).alias("n_equations"),
        F.size(image_elements(content)).alias("n_images"),
        F.size(table_elements(text)).alias("n_tables"),
        F.size(theorem_elements(text)).alias("n_theorems"),
    )


def step_math(step: Column) -> Column:
    """LaTeX fragments of a solution step, joined."""
    return F.array_join(F.concat(*[F.regexp_extract_all(step, F.lit(p), F.lit(1)) for p in STEP_MATH]), " ; ")


def symbol_domain(latex: Column) -> Column:
    """Domain a LaTeX declaration implies; null if it implies none."""
    (first, domain), *rest = DOMAIN_PATTERNS
    case = F.when(latex.rlike(first), F.lit(domain))
    for pattern, domain in rest:
        case = case.when(latex.rlike(pattern), F.lit(domain))
    return case


def citation_heavy(text: Column) -> Column:
    """At least three citation marks per 500 characters."""
    marks = F.size(F.regexp_extract_all(text, F.lit(BRACKET_CITATION), F.lit(0))) + F.size(
        F.regexp_extract_all(text, F.lit(NAME_CITATION), F.lit(0))
    )
    dense = marks / (F.greatest(F.length(text), F.lit(1)) / F.lit(500.0)) >= 3
    return F.coalesce(dense & (text != ""), F.lit(False))


def duplicate_images(images: DataFrame) -> DataFrame:
    """Images whose decoded bytes occur more than once, within one document or across several."""
    hashed = images.where(F.col("base64_data").isNotNull()).select(
        "paper_id",
        "image_idx",
        F.sha2(F.coalesce(F.expr("try_to_binary(base64_data, 'base64')"), F.to_binary("base64_data", F.lit("utf-8"))), 256).alias("image_hash"),
    )
    # count per (hash, document) first: a picture that is everywhere reduces map-side
    per_paper = hashed.groupBy("image_hash", "paper_id").agg(
        F.count("*").alias("n"), F.min("image_idx").alias("first_idx")
    )
    return (
        per_paper.groupBy("image_hash")
        .agg(
            F.sum("n").alias("n_images"),
            F.count("*").alias("n_papers"),
            F.max("n").alias("max_in_paper"),
            F.min("paper_id").alias("first_paper"),
        )
        .where(F.col("n_images") > 1)
    )
