"""JSON that a model wrote into free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docaudit.functions.text import strip


def repair_json(response: Column) -> Column:
    """The JSON object text inside a response: fences dropped, first "{" to last "}"."""
    text = strip(response)
    body = F.regexp_replace(text, r"^```[^\n]*\n?", "")
    body = F.regexp_replace(body, r"\n[ \t]*```[ \t]*$", "")
    text = F.when(F.startswith(text, F.lit("```")), body).otherwise(text)
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(inner != "", inner).otherwise(text)


def parse_object(response: Column, schema: str) -> Column:
    """The repaired object as a struct; null where it is not valid JSON."""
    text = repair_json(response)
    return F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema))


def report_candidates(output: Column) -> Column:
    """JSON texts that may hold a report: fenced blocks first, then bare objects."""
    fenced = F.filter(
        F.regexp_extract_all(output, F.lit(r"(?s)```json\s*\n(.*?)\n```"), F.lit(1)),
        lambda b: F.try_variant_get(F.try_parse_json(b), "$.paper_id", "variant").isNotNull()
        | F.try_variant_get(F.try_parse_json(b), "$.predicted_errors", "variant").isNotNull(),
    )
    bare = F.filter(
        F.regexp_extract_all(output, F.lit(r'\{[^{}]*"paper_id"[^{}]*\}'), F.lit(0)),
        lambda b: F.try_parse_json(b).isNotNull(),
    )
    return F.concat(fenced, bare)


def verdict_lines(output: Column, marker: str = "VERDICT:") -> Column:
    """Valid JSON payloads of the lines that start with ``marker``, in order."""
    lines = F.transform(F.split(output, r"\r\n|\n|\r"), strip)
    marked = F.filter(lines, lambda line: F.startswith(line, F.lit(marker)))
    payloads = F.transform(marked, lambda line: F.substring(line, len(marker) + 1, 1 << 30))
    return F.filter(payloads, lambda p: F.try_parse_json(p).isNotNull())
