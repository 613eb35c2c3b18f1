"""The queries of this subpackage and their comparison SQL."""

from __future__ import annotations

from docaudit.llm.decontaminate import op6_decontamination
from docaudit.llm.licenses import op8_licenses
from docaudit.llm.merkle import op11_merkle
from docaudit.llm.mixing import op5_mixing
from docaudit.llm.ngrams import op4_lm_scores
from docaudit.llm.personal import op12_personal
from docaudit.llm.secrets import op9_secrets
from docaudit.llm.simhash import op3_simhash
from docaudit.llm.sketches import op10_fingerprints
from docaudit.llm.substrings import op1_substring_dedup
from docaudit.llm.tokens import op2_token_counts
from docaudit.llm.toxicity import op7_toxicity
from docaudit.llm.whitening import op13_whitening

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_simhash": op3_simhash,
    "op4_lm_scores": op4_lm_scores,
    "op5_mixing": op5_mixing,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_licenses": op8_licenses,
    "op9_secrets": op9_secrets,
    "op10_fingerprints": op10_fingerprints,
    "op11_merkle": op11_merkle,
    "op12_personal": op12_personal,
    "op13_whitening": op13_whitening,
}

WORDS_6 = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLES: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') AS s FROM (SELECT *, unnest(range(0, len(w) - 12)) AS i FROM d)),
first AS (SELECT s, min(doc_id) AS f FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN first USING (s) WHERE doc_id > f)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op6_decontamination": f"""
WITH d AS (SELECT doc_id, {WORDS_6} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {WORDS_6} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS win FROM (SELECT *, unnest(range(0, len(w) - n + 1)) AS i FROM b)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win FROM (SELECT *, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
hits AS (SELECT DISTINCT doc_id, i, n, win FROM dw JOIN (SELECT DISTINCT n, win FROM bw) USING (n, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS s
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits JOIN bw USING (n, win)) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_merkle": r"""
WITH RECURSIVE bits(i, c, k) AS (SELECT range, range, 0 FROM range(0, 256) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]),
    lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295) % 5 = 0 AS struck FROM documents, tab),
f AS (SELECT doc_id, source, coalesce(struck, false) AS struck, [CASE WHEN v IS NULL THEN '-' ELSE strlen(v) || ':' || v END FOR v IN [doc_id::VARCHAR, source, lang, n_chars::VARCHAR]] AS heads, text,
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM d),
leaves AS (SELECT doc_id, source, sha256(array_to_string(heads, '') || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
  sha256(array_to_string(heads, '') || CASE WHEN text IS NULL THEN '-' WHEN struck THEN strlen(low) || ':' || low ELSE strlen(text) || ':' || text END) AS shown FROM f),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM leaves),
low(source, h, p, n, digest) AS (SELECT source, 0, r, n, leaf FROM ranked
  UNION ALL SELECT source, h + 1, p // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY p)) FROM low WHERE n > 1 GROUP BY source, h, p // 16, n),
subs AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM low WHERE n = 1),
top(h, p, n, digest) AS (SELECT 0, r, n, subroot FROM subs UNION ALL SELECT h + 1, p // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY p)) FROM top WHERE n > 1 GROUP BY h, p // 16, n),
lp AS (SELECT source, h, p, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
  coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM low WHERE n > 1 WINDOW w AS (PARTITION BY source, h, p // 16 ORDER BY p)),
tp AS (SELECT h, p, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
  coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM top WHERE n > 1 WINDOW w AS (PARTITION BY h, p // 16 ORDER BY p)),
path AS (SELECT k.r, k.source, lp.h, a, b FROM ranked k JOIN lp ON lp.source IS NOT DISTINCT FROM k.source AND lp.p = k.r // (16 ** lp.h)::BIGINT
  UNION ALL SELECT k.r, k.source, 100 + tp.h, a, b FROM ranked k JOIN subs s ON s.source IS NOT DISTINCT FROM k.source JOIN tp ON tp.p = s.r // (16 ** tp.h)::BIGINT),
segs AS (SELECT source, r, list({'a': a, 'b': b} ORDER BY h) AS s FROM path GROUP BY source, r)
SELECT k.doc_id, k.leaf, subs.subroot, root.digest AS root, sha256(array_to_string([x.a || x.b FOR x IN coalesce(s, [])], '')) AS proof_sha256,
  list_reduce(list_prepend({'a': shown, 'b': ''}, coalesce(s, [])), lambda x, y: {'a': sha256(y.a || x.a || y.b), 'b': ''}).a AS folded_root,
  list_reduce(list_prepend({'a': shown, 'b': ''}, coalesce(s, [])), lambda x, y: {'a': sha256(y.a || x.a || y.b), 'b': ''}).a = root.digest AS verified
FROM ranked k JOIN subs ON subs.source IS NOT DISTINCT FROM k.source CROSS JOIN (SELECT digest FROM top WHERE n = 1) root LEFT JOIN segs ON segs.source IS NOT DISTINCT FROM k.source AND segs.r = k.r""",
}
