"""Catalog: profiling, structure extraction, segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from docaudit.functions import modeljson
from docaudit.functions.locations import with_location
from docaudit.operators import extract, profile, segment
from docaudit.plans import inputs
from docaudit.plans.inputs import CORPUS_SQL, LINES_SQL, LOCATIONS_SQL, WS
from docaudit.plans.registry import query

NL = "chr(10)"


# --- profiling -------------------------------------------------------------------------


@query("profile_documents", """
SELECT (column_index)::BIGINT AS position, column_name, column_type, (SELECT count(*) FROM documents)::BIGINT AS n_rows FROM (VALUES
 (0,'doc_id','bigint'),(1,'text','string'),(2,'lang','string'),(3,'source','string'),(4,'n_chars','bigint')) v(column_index,column_name,column_type)""")
def _(spark, sf):
    return profile.column_inventory(inputs.table(spark, sf, "documents"))


@query("content_census", """
SELECT 'text' AS type, (3 * count(*))::BIGINT AS n_items FROM documents UNION ALL SELECT 'image_url', count(*)::BIGINT FROM documents""")
def _(spark, sf):
    return profile.content_census(inputs.corpus(spark, sf))


@query("content_keys", """
SELECT unnest(['type','text','image_url']) AS key, unnest([4*count(*), 3*count(*), count(*)])::BIGINT AS n_filled FROM documents""")
def _(spark, sf):
    return profile.content_keys(inputs.corpus(spark, sf))


@query("row_flags", """
SELECT count(*)::BIGINT AS n_rows, count(*)::BIGINT AS rows_with_images, count(*) FILTER (doc_id % 3 = 0)::BIGINT AS rows_with_local_content FROM documents""")
def _(spark, sf):
    return profile.row_flags(inputs.corpus(spark, sf))


@query("value_counts", """
SELECT 'lang' AS dimension, lang AS value, count(*)::BIGINT AS n FROM documents WHERE lang IS NOT NULL GROUP BY 2
UNION ALL SELECT 'source', source, count(*)::BIGINT FROM documents WHERE source IS NOT NULL GROUP BY 2""")
def _(spark, sf):
    return profile.value_counts(inputs.table(spark, sf, "documents"), ["lang", "source"])


@query("distinct_values", "SELECT DISTINCT source FROM documents")
def _(spark, sf):
    return profile.distinct_values(inputs.table(spark, sf, "documents"), "source")


@query("item_sample", f"""
WITH {CORPUS_SQL}, it AS (
 SELECT paper_id, unnest([0,1,2,3])::BIGINT AS pos, unnest(['text','text','image_url','text']) AS type, unnest([t0,t1,NULL,t3]) AS x FROM corpus)
SELECT paper_id, pos, type, x IS NOT NULL AS has_text, type = 'image_url' AS has_image_url, left(x, 200) AS text_preview
FROM it WHERE paper_id IN (SELECT paper_id FROM corpus ORDER BY paper_id LIMIT 5)""")
def _(spark, sf):
    return profile.sample_items(inputs.corpus(spark, sf), "paper_id")


@query("paper_lookup", "SELECT doc_id, CASE WHEN length(text) > 3000 THEN left(text, 3000) || '... [truncated]' ELSE text END AS text, lang, source, n_chars FROM documents WHERE doc_id = 17")
def _(spark, sf):
    docs = inputs.table(spark, sf, "documents")
    text = F.col("text")
    return profile.get_paper(docs, "17", key="doc_id").withColumn(
        "text", F.when(F.length(text) > 3000, F.concat(F.substring(text, 1, 3000), F.lit("... [truncated]"))).otherwise(text)
    )


@query("page_listing", "SELECT doc_id, left(text, 200) AS text, lang, source, (SELECT count(*) FROM documents)::BIGINT AS total FROM documents ORDER BY doc_id LIMIT 50 OFFSET 20")
def _(spark, sf):
    return profile.list_papers(inputs.table(spark, sf, "documents"), "doc_id", "text", ["lang", "source"], 50, 20)


@query("restrict_ids", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    docs = inputs.table(spark, sf, "documents").select("doc_id", "n_chars")
    return profile.restrict(docs, inputs.table(spark, sf, "labels"), "doc_id")


@query("collapse_annotations", f"""
WITH {inputs.ALIGN_SQL}
SELECT paper_id, 0::BIGINT AS page, arg_min(paper_category, ann_idx) AS paper_category, string_agg(error_location, '|' ORDER BY ann_idx) AS error_location,
 string_agg(error_annotation, '|' ORDER BY ann_idx) AS error_annotation FROM anns GROUP BY 1""")
def _(spark, sf):
    return profile.collapse_annotations(
        inputs.annotations(spark, sf), "paper_id", "ann_idx", ["error_location", "error_annotation"], ["paper_category"]
    )


HEADER_SQL = r"'(?m)^(#{1,4})\s*(\d+(?:\.\d+)*)?\.?\s*(.+?)\s*$'"

SECTION_CTE = f"""hits AS (
 SELECT paper_id, full_text, regexp_extract_all(full_text, {HEADER_SQL}, 0) AS h, regexp_split_to_array(full_text, {HEADER_SQL}) AS g FROM papers),
sec AS (
 SELECT paper_id, unnest(range(len(h))) AS i, unnest(h) AS hit, unnest(g[2:]) AS body, unnest(g[1:-2]) AS gap FROM hits),
sections AS (
 SELECT paper_id, i::BIGINT AS section_idx, length(regexp_extract(hit, {HEADER_SQL}, 1))::BIGINT AS section_level,
  CASE WHEN regexp_extract(hit, {HEADER_SQL}, 2) <> '' THEN regexp_extract(hit, {HEADER_SQL}, 2) || '. ' ELSE '' END
    || trim(regexp_extract(hit, {HEADER_SQL}, 3), {WS}) AS section_title,
  trim(body, {WS}) AS content,
  sum(length(gap) + length(hit)) OVER (PARTITION BY paper_id ORDER BY i)::BIGINT AS start_index,
  (sum(length(gap) + length(hit)) OVER (PARTITION BY paper_id ORDER BY i) + length(body))::BIGINT AS end_index FROM sec)"""


@query("structure_counts", f"""
WITH {CORPUS_SQL}, {SECTION_CTE}, sc AS (SELECT paper_id, count(*) AS n FROM sections GROUP BY 1)
SELECT p.paper_id, sc.n::BIGINT AS n_sections,
 (len(list_filter(regexp_extract_all(full_text, '(?s)\\$\\$(.*?)\\$\\$', 1), lambda x: trim(x, {WS}) <> '')) + len(regexp_extract_all(full_text, '\\\\\\(.+?\\\\\\)')))::BIGINT AS n_equations,
 1::BIGINT AS n_images, 1::BIGINT AS n_tables, 1::BIGINT AS n_theorems
FROM papers p JOIN sc USING (paper_id)""")
def _(spark, sf):
    return extract.structure_counts(inputs.corpus(spark, sf))


@query("corpus_profile", """
WITH d AS (SELECT count(*) AS n, count(*) FILTER (doc_id % 3 = 0) AS m FROM documents)
SELECT unnest(['rows','rows','rows','content_type','content_type','item_key','item_key','item_key']) AS dimension,
 unnest(['n_rows','rows_with_images','rows_with_local_content','text','image_url','type','text','image_url']) AS value,
 unnest([n, n, m, 3*n, n, 4*n, 3*n, n])::BIGINT AS n FROM d
UNION ALL SELECT 'paper_category', lang, count(*)::BIGINT FROM documents GROUP BY 2""")
def _(spark, sf):
    return profile.corpus_profile(inputs.corpus(spark, sf), ["paper_category"])


# --- structure ---------------------------------------------------------------------------


@query("normalized_items", f"""
WITH {CORPUS_SQL}
SELECT paper_id, unnest([0,1,2,3])::BIGINT AS pos, unnest(['text','text','image_url','text']) AS type, unnest([t0,t1,NULL,t3]) AS text,
 unnest([NULL,NULL,'data:image/png;base64,' || base64(encode(text)),NULL]) AS url FROM corpus""")
def _(spark, sf):
    return extract.items(inputs.corpus(spark, sf))


@query("full_text", f"WITH {CORPUS_SQL} SELECT paper_id, full_text FROM papers")
def _(spark, sf):
    return extract.full_text(inputs.corpus(spark, sf))


@query("sections", f"WITH {CORPUS_SQL}, {SECTION_CTE} SELECT paper_id, section_idx, section_title, section_level, content, start_index, end_index FROM sections")
def _(spark, sf):
    return extract.sections(extract.full_text(inputs.corpus(spark, sf)))


# display equations are found between $$ pairs (the corpus has no other delimiter)
EQUATION_CTE = f"""eqs AS (
 SELECT paper_id, full_text, 1 AS fam, unnest(range(len(regexp_extract_all(full_text, '(?s)\\$\\$(.*?)\\$\\$', 0)))) AS i,
  unnest(regexp_extract_all(full_text, '(?s)\\$\\$(.*?)\\$\\$', 0)) AS hit, unnest(regexp_extract_all(full_text, '(?s)\\$\\$(.*?)\\$\\$', 1)) AS body,
  unnest(regexp_split_to_array(full_text, '(?s)\\$\\$(.*?)\\$\\$')[1:-2]) AS gap FROM papers
 UNION ALL
 SELECT paper_id, full_text, 2, unnest(range(len(regexp_extract_all(full_text, '\\\\\\((.+?)\\\\\\)', 0)))),
  unnest(regexp_extract_all(full_text, '\\\\\\((.+?)\\\\\\)', 0)), unnest(regexp_extract_all(full_text, '\\\\\\((.+?)\\\\\\)', 1)),
  unnest(regexp_split_to_array(full_text, '\\\\\\((.+?)\\\\\\)')[1:-2]) FROM papers),
placed AS (
 SELECT *, trim(body, {WS}) AS latex, sum(length(gap) + length(hit)) OVER (PARTITION BY paper_id, fam ORDER BY i) AS e FROM eqs),
equations AS (
 SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY fam, i) - 1 AS eq_idx, latex, fam = 1 AS display_mode,
  trim(substring(full_text, greatest(e - length(hit) - r, 0) + 1, least(r, e - length(hit))), {WS}) AS context_before,
  trim(substring(full_text, e + 1, r), {WS}) AS context_after
 FROM (SELECT *, (CASE WHEN fam = 1 THEN 200 ELSE 100 END)::BIGINT AS r, e::BIGINT AS e2 FROM placed)
 WHERE length(latex) >= fam),
labelled AS (
 SELECT paper_id, eq_idx::BIGINT AS eq_idx, latex, display_mode, context_before, context_after,
  CASE WHEN NOT display_mode THEN 'Inline ' || (eq_idx + 1)
   WHEN regexp_matches(latex, '\\\\label\\{{[^}}]+\\}}') THEN regexp_extract(latex, '\\\\label\\{{([^}}]+)\\}}', 1)
   ELSE 'Equation ' || (eq_idx + 1) END AS equation_label FROM equations)""".replace("e - length(hit)", "(e::BIGINT - length(hit))").replace("full_text, e + 1", "full_text, e::BIGINT + 1")


@query("equations", f"WITH {CORPUS_SQL}, {EQUATION_CTE} SELECT paper_id, eq_idx, equation_label, latex, display_mode, context_before, context_after FROM labelled")
def _(spark, sf):
    return extract.equations(extract.full_text(inputs.corpus(spark, sf)))


IMAGE_CTE = """images AS (
 SELECT paper_id, doc_id, 0::BIGINT AS image_idx, 'See' AS x, base64(encode(text)) AS base64_data, right(t1, 500) AS context_before, left(t3, 500) AS context_after,
  coalesce(
   nullif(trim(regexp_extract(right(t1, 500), '(?i)(?:Figure|Fig\\.?)\\s*\\d+[a-zA-Z]?(?:[\\.:]?\\s*(.+?))?(?:\\n|\\z)', 1)), ''),
   nullif(trim(regexp_extract(left(t3, 500), '(?i)(?:Figure|Fig\\.?)\\s*\\d+[a-zA-Z]?(?:[\\.:]?\\s*(.+?))?(?:\\n|\\z)', 1)), ''), 'Figure 1') AS caption
 FROM corpus)"""


@query("images", f"WITH {CORPUS_SQL}, {IMAGE_CTE} SELECT paper_id, image_idx, caption, base64_data, context_before, context_after FROM images")
def _(spark, sf):
    return extract.images(inputs.corpus(spark, sf))


# the table starts after "Figure n: panel of <source>\nTable n: counts\n" of the last item
TABLE_CTE = """tables AS (
 SELECT paper_id, 0::BIGINT AS table_idx, trim(regexp_extract(right(before, 300), '(?i)Table\\s*\\d+[a-zA-Z]?(?:[\\.:]?\\s*(.+?))?(?:\\n|\\z)', 0), chr(10)) AS caption,
  raw_content, right(before, 200) AS context_before, '' AS context_after, 3::BIGINT AS row_count, cells
 FROM (SELECT paper_id, substring(full_text, 1, length(full_text) - length(raw) ) AS before, rtrim(raw, chr(10)) AS raw_content, cells
  FROM (SELECT *, '| lang | chars |' || chr(10) || '|------|-------|' || chr(10) || '| ' || lang || ' | ' || n_chars || ' |' || chr(10) || '| total | ' || (n_chars + 1) || ' |' || chr(10) AS raw,
   'lang,chars;' || lang || ',' || n_chars || ';total,' || (n_chars + 1) AS cells FROM papers)))"""


@query("tables", f"WITH {CORPUS_SQL}, {TABLE_CTE} SELECT paper_id, table_idx, caption, raw_content, context_before, context_after, cells FROM tables")
def _(spark, sf):
    t = extract.tables(extract.full_text(inputs.corpus(spark, sf)))
    return t.withColumn("cells", F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";")).drop("rows")


# the block stands in the second item: "**Theorem k.1.** Let n = c be fixed.\n**Proof.** See Figure j.\n### 1.1.1 ..."
THEOREM_CTE = """theorems AS (
 SELECT paper_id, 0::BIGINT AS theorem_idx, 'theorem' AS theorem_type, 'Theorem ' || (doc_id % 5 + 1) || '.1' AS label,
  'Let n = ' || n_chars || ' be fixed.' AS statement, 'See Figure ' || (doc_id % 3 + 1) || '.' AS proof,
  right(split_part(full_text, '**Theorem ' || (doc_id % 5 + 1) || '.1.**', 1), 300) AS context_before,
  left(substring(full_text, strpos(full_text, chr(10) || '**Proof.** See Figure ')), 300) AS context_after FROM papers)"""


@query("theorems", f"WITH {CORPUS_SQL}, {THEOREM_CTE} SELECT paper_id, theorem_idx, theorem_type, label, statement, proof, context_before, context_after FROM theorems")
def _(spark, sf):
    return extract.theorems(extract.full_text(inputs.corpus(spark, sf)))


@query("tagged_text", f"""
WITH {CORPUS_SQL}, tagged AS (
 SELECT paper_id, unnest([0,1,2,3]) AS pos, unnest([t0,t1,NULL,t3]) AS x FROM corpus),
r AS (SELECT paper_id, pos, CASE WHEN x IS NULL THEN chr(10) || '[IMAGE:FIGURE_1]' || chr(10) ELSE
  regexp_replace(regexp_replace(regexp_replace(x, '(?:Figure|Fig\\.?|FIGURE)\\s+(\\d+[a-zA-Z]?)', '[IMAGE:FIGURE_\\1]', 'gi'),
   'Table\\s+(\\d+[a-zA-Z]?)', '[TABLE:TABLE_\\1]', 'gi'), '(?:Equation|Eq\\.?)\\s*\\(?\\s*(\\d+[a-zA-Z]?)\\s*\\)?', '[EQUATION:EQ_\\1]', 'gi') END AS y FROM tagged)
SELECT paper_id, string_agg(y, chr(10) ORDER BY pos) AS tagged_full_text FROM r GROUP BY 1""")
def _(spark, sf):
    return extract.tagged_text(inputs.corpus(spark, sf))


@query("step_math", """
SELECT conv_id, turn, array_to_string(list_concat(regexp_extract_all(x, '\\\\\\((.*?)\\\\\\)', 1), regexp_extract_all(x, '\\$(.*?)\\$', 1)), ' ; ') AS latex
FROM (SELECT conv_id, turn, text || ' \\(' || turn || ' + 1\\) and $' || role || '$ or \\(z\\)' AS x FROM conversations)""")
def _(spark, sf):
    c = inputs.table(spark, sf, "conversations")
    x = F.concat(F.col("text"), F.lit(" \\("), F.col("turn").cast("string"), F.lit(" + 1\\) and $"), F.col("role"), F.lit("$ or \\(z\\)"))
    return c.select("conv_id", "turn", extract.step_math(x).alias("latex"))


@query("parse_locations", f"""
WITH {LOCATIONS_SQL}
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, a.raw AS raw, a.kind AS location_type, a.id AS identifier,
 array_to_string(a.ids, '|') AS identifiers, len(a.ids) > 1 AS is_range, a.norm AS normalized FROM loc""")
def _(spark, sf):
    parsed = with_location(inputs.locations(spark, sf).select("l_orderkey", "l_linenumber", "loc_a"), "loc_a")
    return parsed.select("l_orderkey", "l_linenumber", "location_ref.*")


@query("symbol_domains", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'natural' WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 'real' ELSE 'matrix' END
 WHEN 'signup' THEN 'positive_real' WHEN 'purchase' THEN 'nonzero' END AS domain
FROM (SELECT *, regexp_extract(props, '[0-9]+')::INT AS k FROM events)""")
def _(spark, sf):
    e = inputs.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    latex = (
        F.when(F.col("event_type") == "click", "n \\in \\mathbb{N}")
        .when(F.col("event_type") == "view", F.when(k % 2 == 0, "x \\in \\mathbb{R}").otherwise("x \\in \\mathbb{R}^3"))
        .when(F.col("event_type") == "signup", F.concat(F.lit("x_"), k.cast("string"), F.lit(" > 0")))
        .when(F.col("event_type") == "purchase", "y \\neq 0")
        .otherwise("x = y")
    )
    return e.select("event_id", extract.symbol_domain(latex).alias("domain"))


@query("citation_density", """
SELECT doc_id, (CASE WHEN c > 0 THEN c ELSE 0 END / (length(x) / 500.0)) >= 3 AS is_heavy FROM (
 SELECT doc_id, x, len(regexp_extract_all(x, '\\[\\d+(?:,\\s*\\d+)*\\]')) + len(regexp_extract_all(x, '\\([A-Z][a-z]+\\s*(?:et al\\.?)?\\s*,\\s*\\d{4}[a-z]?\\)')) AS c
 FROM (SELECT doc_id, text || repeat(' see [1, 2] and (Smith et al., 2020)', (doc_id % 9)::INT) AS x FROM documents))""")
def _(spark, sf):
    d = inputs.table(spark, sf, "documents")
    x = F.concat("text", F.repeat(F.lit(" see [1, 2] and (Smith et al., 2020)"), (F.col("doc_id") % 9).cast("int")))
    return d.select("doc_id", extract.citation_heavy(x).alias("is_heavy"))


@query("json_repair", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN regexp_extract(props, '[0-9]+')::BIGINT END AS k, event_type <> 'error' AS is_valid FROM events""")
def _(spark, sf):
    e = inputs.table(spark, sf, "events")
    answer = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(F.col("event_type") == "view", F.concat(F.lit("Sure: "), "props", F.lit(" - done.")))
        .when(F.col("event_type") == "error", F.concat(F.lit("{"), "props"))
        .otherwise(F.col("props"))
    )
    parsed = modeljson.parse_object(answer, "struct<k: bigint>")
    return e.select("event_id", parsed["k"].alias("k"), parsed.isNotNull().alias("is_valid"))


@query("report_extract", """
SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'signup') THEN user_id::VARCHAR END AS paper_id,
 CASE event_type WHEN 'click' THEN 'fenced' WHEN 'view' THEN 'bare' WHEN 'signup' THEN 'fenced' ELSE 'UNKNOWN' END AS verdict FROM events""")
def _(spark, sf):
    e = inputs.table(spark, sf, "events")

    def body(verdict):
        return F.concat(F.lit('{"paper_id": "'), F.col("user_id").cast("string"), F.lit(f'", "verdict": "{verdict}"}}'))

    kind = F.col("event_type")
    output = (
        F.when(kind == "click", F.concat(F.lit("text\n```json\n"), body("fenced"), F.lit("\n```\nend "), body("bare")))
        .when(kind == "view", F.concat(F.lit("```json\n{broken\n```\nthen "), body("bare")))
        .when(kind == "signup", F.concat(F.lit('```json\n{"other": 1}\n```\n```json\n'), body("fenced"), F.lit("\n```")))
        .otherwise(F.lit("no report here"))
    )
    first = F.from_json(F.get(modeljson.report_candidates(output), F.lit(0)), "struct<paper_id: string, verdict: string>")
    return e.select(
        "event_id", first["paper_id"].alias("paper_id"), F.coalesce(first["verdict"], F.lit("UNKNOWN")).alias("verdict")
    )


@query("verdict_lines", """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE 'A' || k END AS first_verdict,
 CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'click' THEN 'A' || k ELSE 'B' || k END AS last_verdict
FROM (SELECT *, regexp_extract(props, '[0-9]+')::INT AS k FROM events)""")
def _(spark, sf):
    e = inputs.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")

    def line(tag):
        return F.concat(F.lit(f'VERDICT:{{"verdict": "{tag}'), k, F.lit('"}\n'))

    output = (
        F.when(F.col("event_type") == "error", F.lit("VERDICT:{oops\nnothing"))
        .when(F.col("event_type") == "click", F.concat(F.lit("log\n  "), line("A"), F.lit("VERDICT:{bad\n")))
        .otherwise(F.concat(line("A"), F.lit("noise\n"), line("B")))
    )
    lines = modeljson.verdict_lines(output)

    def name(i):
        return F.get_json_object(F.try_element_at(lines, F.lit(i)), "$.verdict")

    return e.select("event_id", name(1).alias("first_verdict"), name(-1).alias("last_verdict"))


@query("image_duplicates", """
SELECT sha256(text) AS image_hash, count(*)::BIGINT AS n_images, count(*)::BIGINT AS n_papers, 1::BIGINT AS max_in_paper, min(doc_id::VARCHAR) AS first_paper
FROM documents GROUP BY 1 HAVING count(*) > 1""")
def _(spark, sf):
    return extract.duplicate_images(extract.images(inputs.corpus(spark, sf)))


# --- segmentation ----------------------------------------------------------------------------


@query("segment_lines", f"WITH {LINES_SQL} SELECT paper_id, snippet_id, line_idx, content, length(content)::BIGINT AS content_length, greatest(1, length(content) // 4)::BIGINT AS estimated_tokens FROM lines")
def _(spark, sf):
    return inputs.lines(spark, sf).select("paper_id", "snippet_id", "line_idx", "content", "content_length", "estimated_tokens")


# long sections hold no blank line, so their parts start every 3800 characters
@query("segment_corpus", f"""
WITH {CORPUS_SQL}, {SECTION_CTE}, {EQUATION_CTE}, {IMAGE_CTE}, {TABLE_CTE}, {THEOREM_CTE},
parts AS (
 SELECT *, CASE WHEN length(content) > 8000 THEN unnest(range(0, (length(content) - 200)::BIGINT, 3800)) ELSE 0 END AS s FROM sections WHERE length(content) > 8000
 UNION ALL SELECT *, 0 FROM sections WHERE length(content) <= 8000),
snip AS (
 SELECT paper_id, CASE WHEN length(content) > 8000 THEN paper_id || '_sec_' || section_idx || '_part_' || (s // 3800) ELSE paper_id || '_sec_' || section_idx END AS snippet_id,
  CASE WHEN section_level >= 3 THEN 'SUBSECTION' ELSE 'SECTION' END AS snippet_type,
  'Section ' || section_title || CASE WHEN s > 0 THEN ' (part ' || (s // 3800 + 1) || ')' ELSE '' END AS location,
  CASE WHEN length(content) > 8000 THEN substring(content, s + 1, 4000) ELSE content END AS content FROM parts
 UNION ALL SELECT paper_id, paper_id || '_eq_' || eq_idx, 'EQUATION', equation_label,
  CASE WHEN context_before <> '' THEN 'Context before:' || chr(10) || context_before || chr(10) || chr(10) ELSE '' END || 'Equation:' || chr(10) || latex
  || CASE WHEN context_after <> '' THEN chr(10) || chr(10) || 'Context after:' || chr(10) || context_after ELSE '' END FROM labelled
 UNION ALL SELECT paper_id, paper_id || '_img_0', 'FIGURE', caption, 'Caption: ' || caption || chr(10) || chr(10) || 'Context before:' || chr(10) || right(context_before, 300)
  || chr(10) || chr(10) || 'Context after:' || chr(10) || left(context_after, 300) FROM images
 UNION ALL SELECT paper_id, paper_id || '_tbl_0', 'TABLE', caption, 'Caption: ' || caption || chr(10) || chr(10) || 'Table content:' || chr(10) || raw_content FROM tables
 UNION ALL SELECT paper_id, paper_id || '_thm_0', 'THEOREM', label, '**' || label || '**' || chr(10) || chr(10) || 'Statement: ' || statement || chr(10) || chr(10) || 'Proof: ' || proof
  || chr(10) || chr(10) || 'Context before:' || chr(10) || context_before || chr(10) || chr(10) || 'Context after:' || chr(10) || context_after FROM theorems)
SELECT *, length(content)::BIGINT AS content_length, greatest(1, length(content) // 4)::BIGINT AS estimated_tokens FROM snip""")
def _(spark, sf):
    s = segment.segment(inputs.corpus(spark, sf))
    return s.select("paper_id", "snippet_id", "snippet_type", "location", "content", "content_length", "estimated_tokens")


@query("window_chunks", """
WITH w AS (
 SELECT doc_id, text, unnest(range(0, (length(text) - 200)::BIGINT, 3800)) AS s FROM documents WHERE length(text) > 4000
 UNION ALL SELECT doc_id, text, 0 FROM documents WHERE length(text) <= 4000)
SELECT doc_id, (s // 3800)::BIGINT AS part, substring(text, s + 1, 4000) AS piece FROM w""")
def _(spark, sf):
    d = inputs.table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode_outer(segment.windows(F.col("text"))).alias("part", "piece"))


# sentences (or 2000-character slices of longer ones) packed by a walk over their lengths
@query("packed_chunks", f"""
WITH RECURSIVE body AS (SELECT doc_id, trim(text, {WS}) AS t FROM documents),
long AS (SELECT doc_id, t FROM body WHERE length(t) > 2000),
sent AS (SELECT doc_id, unnest(range(1, 1 + len(s))) AS i, trim(unnest(s), {WS}) AS u FROM
  (SELECT doc_id, list_filter(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {WS}) <> '') AS s FROM long)),
sliced AS (
 SELECT doc_id, i, 0 AS j, u FROM sent WHERE length(u) <= 2000
 UNION ALL SELECT doc_id, i, j, substring(u, j + 1, 2000) FROM (SELECT *, unnest(range(0, length(u)::BIGINT, 2000)) AS j FROM sent WHERE length(u) > 2000)),
units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS n, u, length(u) AS len FROM sliced),
walk AS (
 SELECT doc_id, n, len AS cur, 0::BIGINT AS c FROM units WHERE n = 1
 UNION ALL
 SELECT u.doc_id, u.n, CASE WHEN w.cur + 1 + u.len <= 2000 THEN w.cur + 1 + u.len ELSE u.len END,
  CASE WHEN w.cur + 1 + u.len <= 2000 THEN w.c ELSE w.c + 1 END
 FROM walk w JOIN units u ON u.doc_id = w.doc_id AND u.n = w.n + 1),
packed AS (SELECT doc_id, c, string_agg(u, chr(10) ORDER BY n) AS chunk FROM walk JOIN units USING (doc_id, n) GROUP BY 1, 2),
lapped AS (
 SELECT doc_id, c AS chunk_idx, CASE WHEN c = 0 THEN chunk ELSE right(lag(chunk) OVER (PARTITION BY doc_id ORDER BY c), 200) || chr(10) || chunk END AS chunk FROM packed
 UNION ALL SELECT doc_id, 0, t FROM body WHERE length(t) <= 2000)
SELECT doc_id, (count(*) OVER (PARTITION BY doc_id))::BIGINT AS n_chunks, chunk_idx::BIGINT AS chunk_idx, chunk FROM lapped""")
def _(spark, sf):
    d = inputs.table(spark, sf, "documents").select("doc_id", "text")
    return segment.chunk_rows(d, "text")


@query("step_context", f"""
WITH p AS (SELECT doc_id, source, string_split(text, chr(10)) AS s FROM documents),
x AS (SELECT doc_id, source, s, unnest(range(len(s))) AS i FROM p)
SELECT doc_id || '_step_' || i AS snippet_id, 'Step ' || i AS location, md5(c) AS content_md5, length(c)::BIGINT AS content_length, i::BIGINT AS step_index FROM (
 SELECT *, 'Problem: ' || source || chr(10) || chr(10)
  || array_to_string(list_transform(s[1:i], lambda v, j: 'Step ' || (j - 1) || ': ' || v), chr(10) || chr(10)) || CASE WHEN i > 0 THEN chr(10) || chr(10) ELSE '' END
  || 'Current step ' || i || ': ' || s[i + 1] AS c FROM x)""")
def _(spark, sf):
    d = inputs.table(spark, sf, "documents")
    cases = d.select(F.col("doc_id").alias("id"), F.col("source").alias("problem"), F.split("text", "\n").alias("steps"))
    s = segment.step_snippets(cases)
    return s.select(
        "snippet_id", "location", F.md5("content").alias("content_md5"), F.length("content").alias("content_length"), "step_index"
    )


@query("truncation_budgets", """
WITH t AS (SELECT doc_id, text, least(length(text), 60000)::BIGINT AS top FROM documents),
b AS (SELECT doc_id, text, top, unnest(range(0, 6)) AS a FROM t)
SELECT doc_id::VARCHAR AS paper_id, a::BIGINT AS attempt, (top >> a)::BIGINT AS budget, length(text) > (top >> a) AS truncated, md5(left(text, top >> a)) AS text_md5
FROM b WHERE a = 0 OR (top >> a) >= 12000""")
def _(spark, sf):
    d = inputs.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), "text")
    t = segment.truncations(d, "text")
    return t.select("paper_id", "attempt", "budget", "truncated", F.md5("cut_text").alias("text_md5"))
