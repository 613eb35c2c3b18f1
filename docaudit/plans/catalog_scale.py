"""Catalog: documents cut into blocks, and streams, against the same SQL as the operators on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docaudit.operators import align, blocks, digests, extract
from docaudit.plans import inputs
from docaudit.plans.registry import ORACLES, query
from docaudit.session import shared_path
from docaudit.sources import sinks
from docaudit.streaming import live

BLOCK_CHARS = 1000  # far below the operator's own, so that the given documents have borders


def cut_corpus(spark, sf):
    return blocks.cut(extract.full_text(inputs.corpus(spark, sf)), BLOCK_CHARS)


@query("block_sections", ORACLES["sections"])
def _(spark, sf):
    return blocks.sections(cut_corpus(spark, sf))


@query("block_equations", ORACLES["equations"])
def _(spark, sf):
    return blocks.equations(cut_corpus(spark, sf))


@query("block_tables", ORACLES["tables"])
def _(spark, sf):
    t = blocks.tables(cut_corpus(spark, sf))
    return t.withColumn("cells", F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";")).drop("rows")


@query("block_theorems", ORACLES["theorems"])
def _(spark, sf):
    return blocks.theorems(cut_corpus(spark, sf))


def released(spark, sf, result=lambda df: df):
    """The statements as a stream of a dozen micro-batches in random order, then a row past the end of all documents."""
    st = inputs.statements(spark, sf).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("order_idx"), F.lit(3600))))
    st = st.withColumn("paper_id", F.col("paper_id").cast("string"))
    tables = [inputs.declarations(st), st.select("paper_id", "symbol", "snippet_id", "order_idx"), inputs.obligations(st)]
    times = st.select("paper_id", "order_idx", "ts").distinct()
    events = live.context_events(*[t.join(times, ["paper_id", "order_idx"]) for t in tables])
    source, rows, state = (shared_path(spark, name) for name in ("events", "released", "stream"))
    events.repartition(12, F.xxhash64("order_idx", "kind")).write.parquet(source)
    end = spark.range(1).select(F.lit("end").alias("paper_id"), F.lit("use").alias("kind"), *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns[2:-1]], F.timestamp_seconds(F.lit(1_800_000_000)).alias("ts"))
    end.write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(source)
    out = result(live.live_context(stream, "ts", delay="2 hours", gap_minutes=120, shards=2))
    q = out.writeStream.format("parquet").option("path", rows).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(out.schema).parquet(rows)


@query("live_context", ORACLES["asof_context"])
def _(spark, sf):
    uses = live.released_uses(released(spark, sf))
    return uses.withColumn("paper_id", F.col("paper_id").cast("bigint"))


@query("live_obligations", ORACLES["resolve_obligations"])
def _(spark, sf):
    return released(spark, sf, live.released_obligations).withColumn("paper_id", F.col("paper_id").cast("bigint"))


@query("step_result_sink", f"""
WITH {inputs.STEPS_SQL} SELECT paper_id, true_label, predicted_label, CASE paper_id % 2 WHEN 0 THEN 'math' ELSE 'gsm8k' END AS split FROM cs""")
def _(spark, sf):
    s = inputs.steps(spark, sf)
    wrong, guess = F.min(F.when(F.col("truly_wrong"), F.col("step_index"))), F.min(F.when(F.col("checkable") & F.col("is_error"), F.col("step_index")))
    cases = s.groupBy("paper_id").agg(F.coalesce(wrong, F.lit(-1)).cast("bigint").alias("true_label"), F.coalesce(guess, F.lit(-1)).cast("bigint").alias("predicted_label"))
    path = shared_path(spark, "steps")
    for i, split in enumerate(("math", "gsm8k")):
        own = cases.where(F.pmod("paper_id", F.lit(2)) == i)
        sinks.write_step_results(own, own.agg(F.count("*").alias("total_cases")), path, split)
    back = spark.read.schema(cases.schema)
    parts = [back.json(f"{path}/split={split}/results").withColumn("split", F.lit(split)) for split in ("math", "gsm8k")]
    return parts[0].unionByName(parts[1])


@query("align_in_rounds", ORACLES["greedy_align"])
def _(spark, sf):
    preds, anns = inputs.predictions(spark, sf), inputs.annotations(spark, sf)
    matched = align.greedy_matches(preds, anns, at_once=0)  # every document as a large one
    out = align.outcomes(preds, anns, matched)
    return out.withColumn("match_quality", F.round("match_quality", 6))


@query("digest_before", f"""
WITH {inputs.SYMBOLS_SQL},
sy AS (SELECT st.paper_id, st.snippet_id, m.symbol, m.defined_from, CASE WHEN m.domain_from < st.order_idx THEN 'domain=' || m.domain END AS d, CASE WHEN m.defined_from < st.order_idx THEN m.definition END AS f
  FROM st JOIN merged m ON m.paper_id = st.paper_id AND m.first_seen < st.order_idx),
sl AS (SELECT paper_id, snippet_id, string_agg('- ' || symbol || CASE WHEN d IS NULL AND f IS NULL THEN '' ELSE '  (' || concat_ws(', ', d, 'defined_as=' || f) || ')' END, chr(10) ORDER BY symbol) AS symbols,
  string_agg('- ' || symbol || ' = ' || f, chr(10) ORDER BY defined_from, symbol) AS definitions FROM sy GROUP BY 1, 2),
ev AS (SELECT paper_id, snippet_id, order_idx, list('- [' || snippet_id || '] ' || event_type) OVER (PARTITION BY paper_id ORDER BY order_idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS a,
  list('- [' || snippet_id || '_cond] ' || {inputs.CONDITIONS!r}[k % 4 + 1]) OVER (PARTITION BY paper_id ORDER BY order_idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS o FROM st)
SELECT paper_id, snippet_id, order_idx, concat_ws(chr(10), array_to_string(list_reverse(a), chr(10)), definitions, array_to_string(list_reverse(o), chr(10)), symbols) AS digest
FROM ev LEFT JOIN sl USING (paper_id, snippet_id)""")
def _(spark, sf):
    st = inputs.statements(spark, sf)
    assumptions = st.select("paper_id", "snippet_id", "order_idx", F.col("event_type").alias("description"))
    return digests.digests_before(st, inputs.declarations(st), assumptions, inputs.obligations(st))
