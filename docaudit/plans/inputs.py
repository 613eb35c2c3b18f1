"""Views of the supplied tables in the shapes the operators read.

Each view keeps every row of its table. Beside the DataFrame form stands the same view
as a SQL common table expression, for the comparison queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.constants import SNIPPET_TYPES, WHITESPACE
from docaudit.functions.text import lookup
from docaudit.operators import segment
from docaudit.operators.ranking import position

WS = "'" + WHITESPACE + "'"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _cat(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _one_line(encoded: Column) -> Column:
    return F.replace(encoded, F.lit("\r\n"), F.lit(""))


# --- documents as papers with structure ---------------------------------------------------


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as papers: their text under a header, then a model, an image and a table."""
    d = table(spark, sf, "documents")
    i, n = F.col("doc_id"), F.col("n_chars")
    t0 = _cat("# 1. Overview ", F.col("source"), "\n", F.col("text"), "\n")
    t1 = _cat(
        "## 1.1 Model of ", F.col("lang"), "\nWe use $$q_{", i, "} = n / 2 \\label{eq", i, "}$$ and \\(a_", i % 7,
        " + b\\) as in Eq. (", i % 9 + 1, ") and Table ", i % 4 + 1, ".\n**Theorem ", i % 5 + 1,
        ".1.** Let n = ", n, " be fixed.\n**Proof.** See Figure ", i % 3 + 1, ".\n### 1.1.1 Remark\nDone.\n",
    )
    t3 = _cat(
        "Figure ", i % 3 + 1, ": panel of ", F.col("source"), "\nTable ", i % 4 + 1,
        ": counts\n| lang | chars |\n|------|-------|\n| ", F.col("lang"), " | ", n, " |\n| total | ", n + 1, " |\n",
    )
    url = F.concat(F.lit("data:image/png;base64,"), _one_line(F.base64(F.encode("text", "utf-8"))))

    def item(kind: str, text: Column, url: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), text.alias("text"), url.alias("image_url"))

    nothing, no_text = F.lit(None).cast("struct<url: string>"), F.lit(None).cast("string")
    return d.select(
        i.cast("string").alias("paper_id"),
        F.substring("text", 1, 60).alias("title"),
        F.col("lang").alias("paper_category"),
        "source",
        F.array(
            item("text", t0, nothing), item("text", t1, nothing),
            item("image_url", no_text, F.struct(url.alias("url"))), item("text", t3, nothing),
        ).alias("paper_content"),
        F.when(i % 3 == 0, F.array(item("text", F.col("source"), nothing))).alias("error_local_content"),
    )


CORPUS_SQL = """corpus AS (
  SELECT doc_id::VARCHAR AS paper_id, doc_id, text, lang, source, n_chars,
    '# 1. Overview ' || source || chr(10) || text || chr(10) AS t0,
    '## 1.1 Model of ' || lang || chr(10) || 'We use $$q_{' || doc_id || '} = n / 2 \\label{eq' || doc_id || '}$$ and \\(a_'
      || (doc_id % 7) || ' + b\\) as in Eq. (' || (doc_id % 9 + 1) || ') and Table ' || (doc_id % 4 + 1) || '.' || chr(10)
      || '**Theorem ' || (doc_id % 5 + 1) || '.1.** Let n = ' || n_chars || ' be fixed.' || chr(10)
      || '**Proof.** See Figure ' || (doc_id % 3 + 1) || '.' || chr(10) || '### 1.1.1 Remark' || chr(10) || 'Done.' || chr(10) AS t1,
    'Figure ' || (doc_id % 3 + 1) || ': panel of ' || source || chr(10) || 'Table ' || (doc_id % 4 + 1) || ': counts' || chr(10)
      || '| lang | chars |' || chr(10) || '|------|-------|' || chr(10) || '| ' || lang || ' | ' || n_chars || ' |' || chr(10)
      || '| total | ' || (n_chars + 1) || ' |' || chr(10) AS t3
  FROM documents),
papers AS (SELECT *, t0 || chr(10) || t1 || chr(10) || t3 AS full_text FROM corpus)"""


# --- document lines as snippets --------------------------------------------------------------


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Non-blank document lines as snippets of all types."""
    rows = segment.line_snippets(table(spark, sf, "documents"))
    kinds = F.array(*[F.lit(t) for t in SNIPPET_TYPES])
    kind = F.get(kinds, ((F.col("doc_id") * 7 + F.col("line_idx")) % 12).cast("int"))
    return rows.select(
        F.col("doc_id").alias("paper_id"), "source", "lang", "line_idx", "order_key", "snippet_id",
        kind.alias("snippet_type"),
        F.concat(F.lit("Section "), (F.col("line_idx") + 1).cast("string")).alias("location"),
        "content",
        F.when(kind == "EQUATION", F.col("content")).alias("latex"),
        "content_length", "estimated_tokens",
    )


LINES_SQL = f"""raw_lines AS (
  SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS content,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_idx FROM documents),
lines AS (
  SELECT doc_id AS paper_id, source, lang, line_idx::BIGINT AS line_idx, doc_id || '_line_' || line_idx AS snippet_id, content,
    {SNIPPET_TYPES!r}[((doc_id * 7 + line_idx) % 12 + 1)::INT] AS snippet_type
  FROM raw_lines WHERE trim(content, {WS}) <> ''),
scored AS (
  SELECT *, CASE WHEN snippet_type = 'EQUATION' THEN content END AS latex,
    CASE WHEN snippet_type = 'EQUATION' THEN 0.72::DOUBLE
      WHEN regexp_matches(lower(content), 'incorrect|error|contradict|wrong') THEN 0.65::DOUBLE
      WHEN snippet_type IN ('FIGURE', 'TABLE') THEN 0.4::DOUBLE ELSE 0.08::DOUBLE END AS uncertainty,
    CASE WHEN snippet_type = 'EQUATION' THEN 'math'
      WHEN regexp_matches(lower(content), 'incorrect|error|contradict|wrong') THEN 'text'
      WHEN snippet_type IN ('FIGURE', 'TABLE') THEN 'vision' ELSE 'none' END AS suggested_route
  FROM lines)"""


# --- events as verifier results ------------------------------------------------------------

EVENT_VERIFIER = {
    "click": "text", "view": "vision", "signup": "math_equation", "error": "statistical", "purchase": "unlisted",
}


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Events as results of one verifier each; the user is the document."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("user_id").alias("paper_id"),
        F.concat(F.col("user_id").cast("string"), F.lit("_ev_"), F.col("event_id").cast("string")).alias("snippet_id"),
        F.col("event_id").alias("order_key"),
        lookup(EVENT_VERIFIER, F.col("event_type")).alias("verifier_name"),
        (k >= 30).alias("error_detected"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"),
        F.when(k % 5 != 0, F.col("event_type")).alias("predicted_error_category"),
        F.concat(F.lit("Lemma "), (k % 9 + 1).cast("string")).alias("location"),
        k.alias("k"),
    )


RESULTS_SQL = """res AS (
  SELECT user_id AS paper_id, user_id || '_ev_' || event_id AS snippet_id, event_id AS order_key,
    CASE event_type WHEN 'click' THEN 'text' WHEN 'view' THEN 'vision' WHEN 'signup' THEN 'math_equation'
      WHEN 'error' THEN 'statistical' ELSE 'unlisted' END AS verifier_name,
    k >= 30 AS error_detected, least(1.0::DOUBLE, value / 100) AS confidence,
    CASE WHEN k % 5 <> 0 THEN event_type END AS predicted_error_category,
    'Lemma ' || (k % 9 + 1) AS location, k, event_type, value
  FROM (SELECT *, regexp_extract(props, '[0-9]+')::INT AS k FROM events)),
flagged AS (
  SELECT *, error_detected AND confidence >= CASE verifier_name WHEN 'math_equation' THEN 0.7::DOUBLE WHEN 'vision' THEN 0.75::DOUBLE ELSE 0.8::DOUBLE END
    AS is_finding FROM res)"""


# --- order lines as predictions and annotations ---------------------------------------------


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as predicted errors, in order of falling discount."""
    order = [-F.col("l_discount"), *[F.col(c) for c in _LINE_ORDER]]
    used = ["l_orderkey", "l_returnflag", "l_linenumber", "l_partkey"]
    return _placed_lines(spark, sf, order, used, "pred_idx").select(
        F.col("l_orderkey").alias("paper_id"),
        F.col("l_returnflag").alias("error_category"),
        F.concat(F.lit("Lemma "), F.col("l_linenumber").cast("string")).alias("error_location"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("supporting_evidence"),
        "pred_idx",
    )


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as annotated errors, in line order."""
    used = ["l_orderkey", "l_linestatus", "l_partkey", "l_quantity", "l_suppkey"]
    return _placed_lines(spark, sf, [F.col(c) for c in _LINE_ORDER], used, "ann_idx").select(
        F.col("l_orderkey").alias("paper_id"),
        F.when(F.col("l_linestatus") == "F", "A").otherwise("N").alias("error_category"),
        F.concat(
            F.when(F.col("l_partkey") % 3 == 0, "Theorem ").otherwise("Lemma "), (F.col("l_partkey") % 5 + 1).cast("string")
        ).alias("error_location"),
        F.when(F.col("l_quantity") > 25, "retract").otherwise("errata").alias("error_severity"),
        F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("error_annotation"),
        F.when(F.col("l_quantity") > 40, "Physics").otherwise("Math").alias("paper_category"),
        "ann_idx",
    )


def _placed_lines(spark: SparkSession, sf: str, order: list[Column], used: list[str], name: str) -> DataFrame:
    """The columns ``used`` of the order lines with each line's place in its order; texts are made from what is saved."""
    li = table(spark, sf, "lineitem").select("l_orderkey", *_LINE_ORDER)
    return position(li, ["l_orderkey"], order, name, drop=[c for c in li.columns if c not in used])


_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_tax", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate"]
_LINE_ORDER_COLS = _LINE_ORDER

_ORD = ", ".join(_LINE_ORDER)
ALIGN_SQL = f"""preds AS (
  SELECT l_orderkey AS paper_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, {_ORD}) - 1 AS pred_idx,
    l_returnflag AS error_category, 'Lemma ' || l_linenumber AS error_location, 'part ' || l_partkey AS supporting_evidence FROM lineitem),
anns AS (
  SELECT l_orderkey AS paper_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORD}) - 1 AS ann_idx,
    CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'N' END AS error_category,
    CASE WHEN l_partkey % 3 = 0 THEN 'Theorem ' ELSE 'Lemma ' END || (l_partkey % 5 + 1) AS error_location,
    CASE WHEN l_quantity > 25 THEN 'retract' ELSE 'errata' END AS error_severity, 'supplier ' || l_suppkey AS error_annotation,
    CASE WHEN l_quantity > 40 THEN 'Physics' ELSE 'Math' END AS paper_category FROM lineitem)"""


# --- conversations as step cases ----------------------------------------------------------------


def steps(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as checked steps."""
    c = table(spark, sf, "conversations")
    n = F.length("text")
    return c.select(
        F.col("conv_id").alias("paper_id"),
        F.col("turn").alias("step_index"),
        (F.col("role") != "system").alias("checkable"),
        (n % 4 == 0).alias("is_error"),
        ((n % 5 == 0) & (F.col("role") == "user")).alias("truly_wrong"),
    )


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """Step cases with the true label: the first truly wrong turn, or -1."""
    wrong = F.min(F.when(F.col("truly_wrong"), F.col("step_index")))
    return steps(spark, sf).groupBy(F.col("paper_id").alias("id")).agg(F.coalesce(wrong, F.lit(-1)).alias("label"))


STEPS_SQL = """st AS (
  SELECT conv_id, turn, role <> 'system' AS checkable, length(text) % 4 = 0 AS is_error,
    length(text) % 5 = 0 AND role = 'user' AS truly_wrong FROM conversations),
cs AS (
  SELECT conv_id AS paper_id, coalesce(min(CASE WHEN truly_wrong THEN turn END), -1)::BIGINT AS true_label,
    coalesce(min(CASE WHEN checkable AND is_error THEN turn END), -1)::BIGINT AS predicted_label, count(*) AS n_steps
  FROM st GROUP BY 1)"""


# --- events as statements about symbols ------------------------------------------------------------

DOMAINS = ["unknown", "integer", "real", "positive_real", "nonzero", "natural", "complex", "matrix"]
CONDITIONS = ["x != 0", "x > 0", "x is real", "x is integer"]


def statements(spark: SparkSession, sf: str) -> DataFrame:
    """Events in order: each names a symbol; its number picks domain and condition."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("user_id").alias("paper_id"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("snippet_id"),
        F.col("event_id").alias("order_idx"),
        "event_type",
        k.alias("k"),
        F.concat(F.lit("s"), (k % 7).cast("string")).alias("symbol"),
        F.concat(F.lit("s"), ((k + 3) % 7).cast("string")).alias("symbol2"),
    )


def declarations(st: DataFrame) -> DataFrame:
    domains = F.array(*[F.lit(d) for d in DOMAINS])
    return st.select(
        "paper_id", "snippet_id", "order_idx", "symbol",
        F.get(domains, F.col("k") % len(DOMAINS)).alias("domain"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("q"), F.col("k").cast("string"))).alias("definition"),
    )


def obligations(st: DataFrame) -> DataFrame:
    conditions = F.array(*[F.lit(c) for c in CONDITIONS])
    return st.select(
        "paper_id", "order_idx",
        F.concat("snippet_id", F.lit("_cond")).alias("obligation_id"),
        F.get(conditions, F.col("k") % len(CONDITIONS)).alias("condition"),
        F.array("symbol", "symbol2").alias("depends_on"),
    )


SYMBOLS_SQL = f"""st AS (
  SELECT user_id AS paper_id, 'e' || event_id AS snippet_id, event_id AS order_idx, event_type, k, 's' || (k % 7) AS symbol,
    's' || ((k + 3) % 7) AS symbol2 FROM (SELECT *, regexp_extract(props, '[0-9]+')::INT AS k FROM events)),
decl AS (
  SELECT *, {DOMAINS!r}[k % 8 + 1] AS domain, CASE WHEN event_type = 'click' THEN 'q' || k END AS definition
  FROM st),
ranked AS (
  SELECT *, first_value(domain) OVER w AS first_domain,
    row_number() OVER (PARTITION BY paper_id, symbol ORDER BY order_idx) AS r,
    row_number() OVER (PARTITION BY paper_id, symbol, domain = 'unknown' ORDER BY order_idx) AS rk,
    row_number() OVER (PARTITION BY paper_id, symbol, definition IS NULL ORDER BY order_idx) AS rd
  FROM decl WINDOW w AS (PARTITION BY paper_id, symbol ORDER BY order_idx)),
merged AS (
  SELECT paper_id, symbol, coalesce(max(CASE WHEN domain <> 'unknown' AND rk = 1 THEN domain END), 'unknown') AS domain,
    max(CASE WHEN domain <> 'unknown' AND rk = 1 THEN order_idx END) AS domain_from,
    max(CASE WHEN definition IS NOT NULL AND rd = 1 THEN definition END) AS definition,
    max(CASE WHEN definition IS NOT NULL AND rd = 1 THEN order_idx END) AS defined_from,
    max(CASE WHEN r = 1 THEN snippet_id END) AS source_snippet, min(order_idx) AS first_seen,
    bool_or(first_domain = 'unknown') AS began_unknown
  FROM ranked GROUP BY 1, 2),
implied(domain, predicate) AS (VALUES
  ('integer','integer'),('integer','rational'),('integer','real'),('integer','complex'),
  ('natural','integer'),('natural','rational'),('natural','real'),('natural','complex'),('natural','nonnegative'),
  ('rational','rational'),('rational','real'),('rational','complex'),('real','real'),('real','complex'),('complex','complex'),
  ('positive_real','real'),('positive_real','complex'),('positive_real','positive'),
  ('nonnegative_real','real'),('nonnegative_real','complex'),('nonnegative_real','nonnegative'),
  ('nonzero','nonzero'),('nonzero','complex'),('unknown','complex'))"""


# --- location strings of every kind ---------------------------------------------------------------


def locations(spark: SparkSession, sf: str) -> DataFrame:
    """Two location strings per order line, in all the formats the parser knows."""
    li = table(spark, sf, "lineitem")
    return li.select(
        *_LINE_ORDER_COLS, "l_orderkey",
        location_text(F.col("l_partkey") % 20).alias("loc_a"),
        location_text(F.col("l_suppkey") % 20).alias("loc_b"),
    )


def location_text(kind: Column) -> Column:
    n, m = (F.col("l_suppkey") % 12 + 1).cast("string"), F.col("l_linenumber").cast("string")
    formats = [
        _cat("Equation ", n), _cat("Eq. (", n, ")"), _cat("Fig ", n), _cat("Figure ", n, "a"),
        _cat("Fig", n, ", Fig", m), _cat("Lemma ", n, ",", m), _cat("Theorems ", n, ".1, ", m, ".2"),
        _cat(n, ".", m, ". Corollary"), _cat("Section ", n, ".", m), _cat("§", n, ".", m), _cat("Table. ", n),
        _cat("Page ", n), _cat("Claim ", n), F.lit("Appendix B"), F.lit("Overall"), F.lit("Introduction"),
        F.lit("Kahler Twists"), _cat("nowhere ", n), _cat("Proposition ", n, " & ", m), _cat("  ALGORITHM ", n),
    ]
    return F.element_at(F.array(*formats), (kind + 1).cast("int"))


def location_sql(kind: str) -> str:
    """Expected parse of each format: (type, identifier, identifiers, normalized, raw)."""
    rows = [
        ("'equation'", "n", "[n]", "'equation ' || n", "'Equation ' || n"),
        ("'equation'", "n", "[n]", "'equation ' || n", "'Eq. (' || n || ')'"),
        ("'figure'", "n", "[n]", "'figure ' || n", "'Fig ' || n"),
        ("'figure'", "n || 'a'", "[n || 'a']", "'figure ' || n || 'a'", "'Figure ' || n || 'a'"),
        ("'figure'", "n || ',' || m", "[n, m]", "'figure ' || n || ',' || m", "'Fig' || n || ', Fig' || m"),
        ("'lemma'", "n || ',' || m", "[n, m]", "'lemma ' || n || ',' || m", "'Lemma ' || n || ',' || m"),
        ("'theorem'", "n || '.1, ' || m || '.2'", "[n || '.1', m || '.2']", "'theorem ' || n || '.1,' || m || '.2'", "'Theorems ' || n || '.1, ' || m || '.2'"),
        ("'corollary'", "n || '.' || m", "[n || '.' || m]", "'corollary ' || n || '.' || m", "n || '.' || m || '. Corollary'"),
        ("'section'", "n || '.' || m", "[n || '.' || m]", "'section ' || n || '.' || m", "'Section ' || n || '.' || m"),
        ("'section'", "n || '.' || m", "[n || '.' || m]", "'section ' || n || '.' || m", "'§' || n || '.' || m"),
        ("'table'", "n", "[n]", "'table ' || n", "'Table. ' || n"),
        ("'page'", "n", "[n]", "'page ' || n", "'Page ' || n"),
        ("'claim'", "n", "[n]", "'claim ' || n", "'Claim ' || n"),
        ("'appendix'", "'B'", "['B']", "'appendix B'", "'Appendix B'"),
        ("'overall'", "'Overall'", "['Overall']", "'overall'", "'Overall'"),
        ("'section'", "'introduction'", "['introduction']", "'section introduction'", "'Introduction'"),
        ("'section'", "'kahler_twists'", "['Kahler Twists']", "'section kahler_twists'", "'Kahler Twists'"),
        ("'unknown'", "'nowhere ' || n", "['nowhere ' || n]", "'nowhere ' || n", "'nowhere ' || n"),
        ("'proposition'", "n || ' & ' || m", "[n, m]", "'proposition ' || n || '&' || m", "'Proposition ' || n || ' & ' || m"),
        ("'algorithm'", "n", "[n]", "'algorithm ' || n", "'ALGORITHM ' || n"),
    ]
    arms = [
        f"WHEN {i} THEN {{'kind': {t}, 'id': {a}, 'ids': {b}, 'norm': {c}, 'raw': {r}}}" for i, (t, a, b, c, r) in enumerate(rows)
    ]
    return f"CASE {kind} {' '.join(arms)} END"


LOCATIONS_SQL = f"""li AS (SELECT *, (l_suppkey % 12 + 1)::VARCHAR AS n, l_linenumber::VARCHAR AS m FROM lineitem),
loc AS (SELECT *, {location_sql('l_partkey % 20')} AS a, {location_sql('l_suppkey % 20')} AS b FROM li)"""


def similarity_sql(a: str, b: str) -> str:
    """Text similarity of two compact texts."""
    union = f"len(list_distinct(list_concat(string_split({a}, ''), string_split({b}, ''))))"
    shared = f"len(list_intersect(list_distinct(string_split({a}, '')), list_distinct(string_split({b}, ''))))"
    return (
        f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.85::DOUBLE"
        f" ELSE {shared}::DOUBLE / {union} END"
    )


def compact_sql(x: str) -> str:
    return f"translate(lower({x}), ' .()', '')"
