"""Structure found block by block equals what one look at the whole text finds."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docaudit.operators import blocks, extract

PARTS = [
    "# 1. Intro\n", "## Results\n", "#\n", "# 2.\n", "### \n\nTitle\n", "1.\n", "\n", "\n\n", " ", "plain words of a text\n", "A sentence ends.\nAnother begins, ", "ü umlaut\n", "x\n",
    "$$a^2$$", "$$", "$$$", "\\[", "\\]", "\\[ y \\label{eq:a} \\]", "\\\\[2pt]", "\\begin{equation}", "\\end{equation*}", "\\begin{align*} p \\end{align}", "\\end{eqnarray}", "\\(ab\\)", "\\(a", "\\)$",
    "**Theorem 2.1.** Let n be.\n", "**Lemma 3**\n\n", "**Claim** foo", "\n**Proof.** As shown ", "**Proof**\n", "\n**Theorem A** odd\n", "\n**Lemma\n4** split\n", "Table 4: nice table\n",
    "| a | b |\n|---|---|\n| 1 | 2 |\n", "| a |\n|-\n-|\n| 1 |\n\n| 2 |\n", "|---|\n", "| 9 |\n", "Text after\n", "\\alpha begins a line\n", "😀 emoji\n",
]
OLD_NEW = [(extract.sections, blocks.sections), (extract.equations, blocks.equations), (extract.tables, blocks.tables), (extract.theorems, blocks.theorems)]


def rows(df):
    return Counter(json.dumps(r.asDict(True), sort_keys=True) for r in df.collect())


def same(texts, block_chars, page_chars):
    b = blocks.cut(texts, block_chars, page_chars)
    for old, new in OLD_NEW:
        want, got = rows(old(texts)), rows(new(b))
        assert got == want, (old.__name__, list((want - got).items())[:2], list((got - want).items())[:2])
    return b


@pytest.mark.parametrize("seed,block_chars,page_chars", [(1, 20, 7), (3, 400, 4096)])
def test_random_structure(spark, seed, block_chars, page_chars):
    rng = random.Random(seed)
    made = [(str(i), "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 90)))) for i in range(150)] + [("none", None), ("empty", ""), ("blank", " \n ")]
    texts = spark.createDataFrame(made, "paper_id string, full_text string").repartition(4)
    b = same(texts.withColumn("full_text", F.coalesce("full_text", F.lit(""))), block_chars, page_chars)
    assert b.rows.where("n_blocks > 3").count() > 50
    assert rows(b.rows.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "").alias("full_text"))) == rows(texts.fillna(""))


def test_equation_across_many_blocks(spark):
    body = "words and words\nMore words here\n" * 400
    text = f"Begin\n\\begin{{align}}{body}\\end{{align}} and \\[ open\n" + body + "$$z$$"
    texts = spark.createDataFrame([("p", text)], "paper_id string, full_text string")
    want, got = rows(extract.equations(texts)), rows(blocks.equations(blocks.cut(texts, 100, 64)))
    assert got == want and len(got) == 2


def test_no_growing_table_passes_the_driver(spark, monkeypatch):
    """The files of a table say little of its size: no join may send one through the driver because they are small."""
    texts = spark.createDataFrame([(str(i), "words \\[ y \\] end\nMore words\n" * n) for i, n in enumerate([1, 3, 20, 21])], "paper_id string, full_text string")
    b, saved = blocks.cut(texts, 40, 16), blocks.stored
    assert b.rows.agg(F.max("n_blocks")).first()[0] > 8
    seen = []
    monkeypatch.setattr(blocks, "stored", lambda df, name: (seen.append(df), saved(df, name))[1])
    assert rows(blocks.equations(b)) == rows(extract.equations(texts))
    seen += [blocks._display(b), *[new(b) for _, new in OLD_NEW[2:]]]
    plans = [df._jdf.queryExecution().sparkPlan().toString() for df in seen]
    assert sum("SortMergeJoin" in p for p in plans) > 5
    for p in plans:  # a position's own table has a row a range
        assert not [line for line in p.splitlines() if "BroadcastHashJoin" in line and "_first" not in line]
