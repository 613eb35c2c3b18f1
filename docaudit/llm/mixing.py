"""Mixing to target weights with soft domains, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.common import documents, free_name, stored, text_key

BLANKS = r"[\x20\x09-\x0D]+"
DOMAINS = ("toxic", "poor", "plain")
TARGETS = {"toxic": 0.02, "poor": 0.18, "plain": 0.8}  # shares of the expected tokens
BUDGET = 0.5  # tokens of the mixture, as a share of the corpus
FIT_ROWS = 20_000  # labelled documents that the classifier is counted on
TELLING = 64  # telling words of each domain
MAX_STEPS = 100
SAVED = 10  # steps after which the rates are written
TOLERANCE = 1e-3  # of the budget, largest gap between a domain's total and its target


def words_of(text: Column) -> Column:
    """Words as they stand, in lower case from A to Z; none for null."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, BLANKS), "")


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 1, "plain").when(quality == 0, "poor")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, domain and text of the labelled documents that the classifier may see, by hash of the id.

    Null ids and labels without a domain are left out; of several labels of a document the first in the order of
    DOMAINS counts.
    """
    place = F.array_position(F.array(*map(F.lit, DOMAINS)), domain_of(F.col("quality"), F.col("toxic")))
    rows = labels.select(F.col("doc_id").cast("long"), place.alias("place")).dropna().groupBy("doc_id").agg(F.min("place").alias("place"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    rows = rows.select("doc_id", F.element_at(F.array(*map(F.lit, DOMAINS)), F.col("place").cast("int")).alias("domain"))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(rows), "doc_id")  # FIT_ROWS ids at most


def telling_words(texts: DataFrame) -> dict[str, list[str]]:
    """Per domain, the TELLING words whose share of its documents most exceeds that of the others', by twice at least."""
    words = F.array_distinct(F.filter(words_of(F.col("text")), lambda w: F.length(w) <= 40))
    each = texts.select("domain", F.explode(words).alias("word"))
    total = {r["domain"]: r["n"] for r in texts.groupBy("domain").agg(F.count("*").alias("n")).collect()}  # three rows
    counts = each.groupBy("word").agg(*[F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS], F.count("*").alias("n"))
    counts = stored(counts.filter("n >= 5"), "mixing-words")
    out = {}
    for d in DOMAINS:
        n, rest = total.get(d, 0), sum(total.values()) - total.get(d, 0)
        inside = F.col(d) / F.lit(max(n, 1))
        outside = (F.col("n") - F.col(d)) / F.lit(max(rest, 1))
        gain = inside * F.ln((inside + 1 / max(n, 1)) / (outside + 1 / max(rest, 1)))
        out[d] = [r["word"] for r in counts.filter(inside > 2 * outside).orderBy(gain.desc(), "word").limit(TELLING).select("word").collect()]
    return out


def features(telling: dict[str, list[str]]) -> list[Column]:
    """A text's traits as small integers, from its words and its text.

    How long it is, its share of signs, of digits and of distinct words, how long its words are, and for each domain
    how many of its telling words occur.
    """
    n = F.size("words")
    size = F.greatest(F.length("text"), F.lit(1))
    left = lambda pattern: F.length(F.translate("text", pattern, ""))

    def share(part: Column, whole: Column, steps: int) -> Column:
        return F.least(F.floor(part * steps / whole), F.lit(steps)).cast("int")

    signs = F.length("text") - left("#%&$*|<>{}[]=\\/@~^_+")
    digits = F.length("text") - left("0123456789")
    out = [
        F.least(F.floor(F.log2(n + 1)), F.lit(16)).cast("int"),
        share(signs, size, 50), share(digits, size, 50),
        share(F.size(F.array_distinct("words")), F.greatest(n, F.lit(1)), 10),
        F.least(F.floor(F.length("text") / F.greatest(n, F.lit(1))), F.lit(20)).cast("int"),
    ]
    for d in DOMAINS:
        hits = F.size(F.array_intersect("words", F.array(*map(F.lit, telling[d])) if telling[d] else F.array().cast("array<string>")))
        out.append(F.least(hits, F.lit(TELLING)))
    return out


def traits(docs: DataFrame, telling: dict[str, list[str]], *keep: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*keep, text.alias("text")).withColumn("words", words_of(F.col("text")))
    return rows.select(*keep, F.size("words").cast("long").alias("n_tokens"), *[f.alias(f"f{i}") for i, f in enumerate(features(telling))])


def classifier(texts: DataFrame) -> tuple[dict[str, list[str]], dict[str, list[float]], dict[str, list[list[float]]]]:
    """Naive Bayes over the traits: telling words, and per domain the log-prior and the log-shares of each trait's values.

    Neighbouring values lend each other counts, so rare ones are not taken at their word.
    """
    telling = telling_words(texts)
    width = max(TELLING, 50) + 1
    rows = stored(traits(texts, telling, "domain"), "mixing-traits")
    n = 5 + len(DOMAINS)
    values = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"f{i}").alias("v")) for i in range(n)])
    counts = rows.select("domain", F.explode(values).alias("t")).groupBy("domain", "t.i", "t.v").agg(F.count("*").alias("n")).collect()  # 3 * 8 * 65 rows at most
    seen = {d: [[0.0] * width for _ in range(n)] for d in DOMAINS}
    for r in counts:
        seen[r["domain"]][r["i"]][r["v"]] += r["n"]
    total = {d: sum(seen[d][0]) for d in DOMAINS}
    prior = {d: math.log((total[d] + 1) / (sum(total.values()) + len(DOMAINS))) for d in DOMAINS}
    logs = {}
    for d in DOMAINS:
        logs[d] = []
        for row in seen[d]:
            lent = [row[v] + 0.25 * ((row[v - 1] if v else 0) + (row[v + 1] if v + 1 < width else 0)) + 0.5 for v in range(width)]
            logs[d].append([math.log(x / sum(lent)) for x in lent])
    return telling, prior, logs


def posteriors(docs: DataFrame, labels: DataFrame, *keep: str) -> DataFrame:
    """``keep``, n_tokens and p_<domain>: the chances of each domain, given the text's traits."""
    telling, prior, logs = classifier(stored(labelled(docs, labels), "mixing-labelled"))
    rows = traits(docs, telling, *keep)
    for d in DOMAINS:
        parts = [F.element_at(F.array(*map(F.lit, logs[d][i])), F.col(f"f{i}") + 1) for i in range(len(logs[d]))]
        rows = rows.withColumn(f"l_{d}", sum(parts, F.lit(prior[d])))
    top = F.greatest(*[F.col(f"l_{d}") for d in DOMAINS])
    rows = rows.select(*keep, "n_tokens", *[F.exp(F.col(f"l_{d}") - top).alias(f"e_{d}") for d in DOMAINS])
    whole = sum((F.col(f"e_{d}") for d in DOMAINS), F.lit(0.0))
    return rows.select(*keep, "n_tokens", *[(F.col(f"e_{d}") / whole).alias(f"p_{d}") for d in DOMAINS])


def after(steps: list[list[float]], r: Column) -> Column:
    """The rate r after projected steps: each adds its moves, weighted by the document's posteriors, and cuts at zero."""
    if not steps:
        return r

    def step(now: Column, s: Column) -> Column:
        return F.greatest(sum((s[i] * F.col(f"p_{d}") for i, d in enumerate(DOMAINS)), now), F.lit(0.0))

    return F.aggregate(F.array(*[F.array(*map(F.lit, s)) for s in steps]), r, step)


def solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """The solution of a few linear equations, by elimination."""
    rows = [[*row, x] for row, x in zip(matrix, right, strict=True)]
    for i in range(len(rows)):
        rows[i:] = sorted(rows[i:], key=lambda row: -abs(row[i]))
        for j in range(len(rows)):
            if j != i:
                share = rows[j][i] / rows[i][i]
                rows[j] = [x - share * y for x, y in zip(rows[j], rows[i], strict=True)]
    return [row[-1] / row[i] for i, row in enumerate(rows)]


def fit_rates(rows: DataFrame, targets: dict[str, float], budget: float) -> list[list[float]]:
    """Steps of projected gradient descent on the squared gaps between expected domain totals and targets.

    ``rows`` has n_tokens and p_<domain>. A step needs the totals at the present rates, and how the domains of the
    documents with positive rates overlap, one aggregate of a few numbers. A document's rate follows from its
    posteriors and the steps, so documents with equal posteriors are fitted as one, and the list of steps is the
    result; rates are written every SAVED steps. The gradient is scaled by the inverse of the overlaps. Where such a
    step makes things worse, a plain one, of the length that the overlaps' sum allows, takes its place; so targets
    that cannot be met are approached in the sense of least squares.
    """
    k = len(DOMAINS)
    rows = rows.groupBy(*[f"p_{d}" for d in DOMAINS]).agg(F.sum("n_tokens").alias("n_tokens")).withColumn("r", F.lit(budget))
    rows = stored(rows, "mixing-rates")
    total = float(rows.agg(F.sum("n_tokens")).first()[0] or 0)
    if total == 0:
        return []
    want = [targets[d] / sum(targets.values()) * budget for d in DOMAINS]
    steps: list[list[float]] = []
    saved, error, plain, scaled = 0, math.inf, [0.0] * k, False
    weight = {d: F.col("n_tokens") * F.col(f"p_{d}") for d in DOMAINS}
    for _ in range(MAX_STEPS):
        moved = rows.withColumn("s", after(steps[saved:], F.col("r")))
        if len(steps) - saved == SAVED:
            saved = len(steps)
            rows = stored(moved.drop("r").withColumnRenamed("s", "r"), "mixing-rates")
            moved = rows.withColumn("s", F.col("r"))
        overlaps = [F.sum(F.when(F.col("s") > 0, weight[a] * F.col(f"p_{b}"))) for a in DOMAINS for b in DOMAINS]
        now = [float(x or 0) / total for x in moved.agg(*[F.sum(F.col("s") * weight[d]) for d in DOMAINS], *overlaps).first()]
        gaps = [x - w for x, w in zip(now[:k], want, strict=True)]
        last, error = error, sum(g * g for g in gaps)
        if max(map(abs, gaps)) <= TOLERANCE * budget:
            break
        if scaled and error > last and len(steps) > saved:
            steps[-1], scaled, error = plain, False, last
            continue
        if not scaled and last - error <= 1e-9 * error < math.inf and len(steps) > 1:
            break
        matrix = [[now[k + i * k + j] + (1e-6 if i == j else 0.0) for j in range(k)] for i in range(k)]
        plain = [-g for g in gaps]  # all overlaps sum to one at most, and so does the largest eigenvalue
        steps.append(solved(matrix, plain))
        scaled = True
    return steps


def mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float = BUDGET) -> DataFrame:
    """Per row: doc_id, n_tokens, p_<domain> for each domain, rate, expected_tokens.

    Rates are not negative; expected_tokens is rate times n_tokens, and its sum over the posteriors of a domain matches
    the domain's share of ``budget`` times all tokens. A null or blank text has no tokens and keeps the rate
    that its posteriors give. Repeated rows get equal rates each; null ids keep theirs. Other columns are ignored.
    """
    rows = stored(posteriors(docs.select(F.col("doc_id").cast("long"), "text"), labels, "doc_id"), "mixing-posteriors")
    out = rows.withColumn("rate", after(fit_rates(rows, targets or TARGETS, budget), F.lit(budget)))
    return out.withColumn("expected_tokens", F.col("rate") * F.col("n_tokens"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float = BUDGET) -> DataFrame:
    """The documents of a positive rate, with all their columns, rate and expected_tokens, which replace columns of these names.

    Rows of one text have one rate; a null text counts as empty. An empty table gives no rows.
    """
    keyed = docs.select("doc_id", "text", text_key(F.col("text")).alias("key"))
    rows = stored(posteriors(keyed, labels, "key"), "mixing-posteriors")
    steps = fit_rates(rows, targets or TARGETS, budget)
    rates = rows.dropDuplicates(["key"]).withColumn("rate", after(steps, F.lit(budget)))
    name = free_name(docs, "rate_key")
    rates = stored(rates.select(F.col("key").alias(name), "rate", (F.col("rate") * F.col("n_tokens")).alias("expected_tokens")), "mixing-rates")
    rates = rates.filter("rate > 0")
    return docs.drop("rate", "expected_tokens").join(rates, text_key(F.col("text")) == F.col(name)).drop(name)


def op5_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixture(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))
