"""Location strings ("Eq. (12)", "Lemma 3,4") as typed references, and their match score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.constants import LOCATION_PATTERNS
from docaudit.functions.text import chars_of, compact, contains_any, similarity, strip


def split_ids(ids: Column) -> Column:
    """Identifiers of a list such as "3,4" or "1.2 & 1.3"."""
    parts = F.split(ids, r"\s*[,&]\s*|\s+and\s+")
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def normalize(kind: Column, ids: Column) -> Column:
    return F.concat(kind, F.lit(" "), F.replace(ids, F.lit(" "), F.lit("")))


# Substrings of which one must occur for a pattern to hit: byte searches that spare
# most rows all but one regular expression.
_GATES = {"section": ["sec", "§"], "equation": ["eq"], "figure": ["fig"]}


def _numbered(raw: str, low: str) -> Column:
    """(kind, ids) of the first numbered pattern that hits, else null."""
    folded = f"translate({low}, 'ſı', 'si')"
    arms = []
    for kind, pattern in LOCATION_PATTERNS:
        regex = f"r'(?iu){pattern}'"
        gate = " OR ".join(f"contains({folded}, '{word}')" for word in _GATES.get(kind, [kind]))
        ids = f"regexp_extract({raw}, {regex}, 1)"
        if "))+" in pattern:  # a repeated group: its last value is the second identifier
            ids = f"concat({ids}, ',', regexp_extract({raw}, {regex}, 2))"
        arms.append(f"WHEN ({gate}) AND {raw} RLIKE {regex} THEN named_struct('kind', '{kind}', 'ids', {ids})")
    return F.expr(f"CASE {' '.join(arms)} END")


def with_location(df: DataFrame, source: str, target: str = "location_ref") -> DataFrame:
    """Add ``target``: (raw, location_type, identifier, identifiers, is_range, normalized).

    The pattern search is a projection of its own, so it runs once per row
    although several branches below read its result.
    """
    raw, low, hit = F.col("_raw"), F.col("_low"), F.col("_hit")
    df = (
        df.withColumn("_raw", strip(F.col(source)))
        .withColumn("_low", F.lower(raw))
        .withColumn("_hit", _numbered("_raw", "_low"))
    )

    def ref(kind, identifier, identifiers, normalized):
        return F.struct(
            raw.alias("raw"),
            kind.alias("location_type"),
            identifier.alias("identifier"),
            identifiers.alias("identifiers"),
            (F.size(identifiers) > 1).alias("is_range"),
            normalized.alias("normalized"),
        )

    snake = F.replace(low, F.lit(" "), F.lit("_"))
    vague = contains_any(low, ["overall", "overview", "unknown"])
    parsed = (
        F.when(
            hit.isNotNull(),
            ref(hit["kind"], hit["ids"], split_ids(hit["ids"]), normalize(hit["kind"], hit["ids"])),
        )
        .when(
            vague,
            ref(
                F.when(F.contains(low, F.lit("over")), F.lit("overall")).otherwise(F.lit("unknown")),
                raw, F.array(raw), snake,
            ),
        )
        .when(
            F.contains(low, F.lit("introduction")),
            ref(F.lit("section"), F.lit("introduction"), F.array(F.lit("introduction")), F.lit("section introduction")),
        )
        .when(F.contains(low, F.lit("appendix")), ref(F.lit("appendix"), raw, F.array(raw), low))
        .when(
            raw.rlike(r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*$"),
            ref(F.lit("section"), snake, F.array(raw), F.concat(F.lit("section "), snake)),
        )
        .otherwise(ref(F.lit("unknown"), raw, F.array(raw), low))
    )
    return df.withColumn(target, parsed).drop("_raw", "_low", "_hit")


def match_key(ref: Column) -> Column:
    """What :func:`location_score` reads of a reference, with character sets built once."""
    norm = compact(ref["normalized"])
    raw = compact(ref["raw"])
    return F.struct(
        ref["location_type"].alias("kind"),
        F.array_distinct(ref["identifiers"]).alias("ids"),
        norm.alias("norm"),
        chars_of(norm).alias("norm_chars"),
        raw.alias("raw"),
        chars_of(raw).alias("raw_chars"),
    )


def location_score(a: Column, b: Column) -> Column:
    """Match score in [0, 1] of two :func:`match_key` structs."""
    by_norm = similarity(a["norm"], b["norm"], a["norm_chars"], b["norm_chars"])
    by_raw = similarity(a["raw"], b["raw"], a["raw_chars"], b["raw_chars"])
    n_a, n_b = F.size(a["ids"]), F.size(b["ids"])

    def by_ids(shared: Column) -> Column:
        either = n_a + n_b - shared
        return (
            F.when((n_a == 0) | (n_b == 0), F.lit(0.0))
            .when(shared == either, F.lit(1.0))
            .when(shared > 0, F.lit(0.5) + F.lit(0.5) * (shared / either))
            .otherwise(by_norm)
        )

    same_kind = F.transform(F.array(F.size(F.array_intersect(a["ids"], b["ids"]))), by_ids)[0]
    unknown = (a["kind"] == "unknown") | (b["kind"] == "unknown")
    return (
        F.when(a["kind"] == b["kind"], same_kind)
        .when(unknown, by_norm * 0.5)
        .otherwise(F.greatest(by_raw, by_norm) * 0.8)
    )
