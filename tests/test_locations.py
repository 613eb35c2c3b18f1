"""Location strings and their match scores."""

import pytest
from pyspark.sql import functions as F

from docaudit.functions.locations import location_score, match_key, with_location

# Each type of location with its ways of writing, filled with own numbers.
FORMS = {
    "section": ["Section {}", "Sec {}", "§{}", "sec. {}"],
    "equation": ["Equation {}", "Eq. {}", "Eq. ({})", "eq {}"],
    "figure": ["Figure {}", "Fig. {}", "fig {}"],
    "table": ["Table {}", "Table. {}"],
    "theorem": ["Theorem {}"],
    "lemma": ["Lemma {}"],
    "proposition": ["Proposition {}"],
    "page": ["Page {}"],
    "claim": ["Claim {}"],
}
NUMBERS = {"section": ["8", "9.6", "2.10.5"], "equation": ["31", "17b"], "figure": ["12", "6c"], "table": ["14", "3a"]}
CASES = [(form.format(n), kind, f"{kind} {n}") for kind, forms in FORMS.items() for form in forms for n in NUMBERS.get(kind, ["5", "28"])]
CASES += [
    ("Lemma 6, 9", "lemma", "lemma 6,9"), ("Theorems 3.2, 3.5", "theorem", "theorem 3.2,3.5"), ("4.12. Corollary", "corollary", "corollary 4.12"),
    ("Fig8, Fig9", "figure", "figure 8,9"), ("Appendix D", "appendix", "appendix D"), ("Overall", "overall", "overall"),
    ("Section 6.1 (proof of Lemma 2)", "section", "section 6.1"), ("nowhere?", "unknown", "nowhere?"),
]

# Pairs by how they relate, with the range that the score's formula gives for it.
PAIRS = [
    (a.format(n), b.format(n), 1.0, 1.0) for kind, n in (("section", "9.6"), ("figure", "12"), ("equation", "31")) for a in FORMS[kind][:2] for b in FORMS[kind][:2]
] + [
    ("Lemma 6,9", "Lemma 6", 0.75, 0.75),  # one of two shared: a half, and half of a half
    ("Lemma 6,9", "Lemma 6,9", 1.0, 1.0), ("Theorem 8", "Figure 8", 0.0, 0.4999), ("Equation 31", "Equation 32", 0.5, 0.99),
    ("Proposition 4.4", "Proposition 5.4", 0.5, 0.99),
]


def test_formats(spark):
    df = with_location(spark.createDataFrame([(r,) for r, _, _ in CASES], "raw string"), "raw")
    got = {r.raw: (r.location_ref.location_type, r.location_ref.normalized) for r in df.collect()}
    assert got == {raw: (kind, norm) for raw, kind, norm in CASES}


def test_several_identifiers(spark):
    r = with_location(spark.createDataFrame([("Lemma 11,15",)], "raw string"), "raw").first().location_ref
    assert r.identifiers == ["11", "15"] and r.is_range


@pytest.fixture(scope="module")
def scores(spark):
    d = spark.createDataFrame([(a, b) for a, b, _, _ in PAIRS], "a string, b string")
    d = with_location(with_location(d, "a", "ra"), "b", "rb")
    d = d.withColumns({"ka": match_key(F.col("ra")), "kb": match_key(F.col("rb"))})
    return {(r.a, r.b): r.s for r in d.select("a", "b", location_score(F.col("ka"), F.col("kb")).alias("s")).collect()}


@pytest.mark.parametrize("a,b,low,high", PAIRS)
def test_score_bounds(scores, a, b, low, high):
    assert low <= scores[(a, b)] <= high
