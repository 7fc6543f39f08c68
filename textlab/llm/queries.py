"""The registered queries of this subpackage: name -> (run(spark, sf_dir),
DuckDB SQL or None). Each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from textlab.llm.bestfit import pack_best_fit
from textlab.llm.collocations import collocations
from textlab.llm.exact import exact_duplicates
from textlab.llm.licences import licence_labels
from textlab.llm.lines import drop_lines
from textlab.llm.lm import lm_scores
from textlab.llm.mixing import mix_report
from textlab.llm.neardup import near_duplicates
from textlab.llm.packing import pack
from textlab.llm.quality import quality_rules
from textlab.llm.repair import repair_conversations
from textlab.llm.secrets import secret_spans
from textlab.llm.warc import archive_folder, read_archives, write_archives


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_quality_rules(spark, sf_dir):
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_line_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_lines(docs, counts=True)


def op3_warc_dictionary(spark, sf_dir):
    folder = archive_folder(spark)
    manifest = write_archives(_table(spark, sf_dir, "pages"), folder)
    return read_archives(manifest, folder, with_payload=False).drop("payload")


def op4_minhash_bbit(spark, sf_dir):
    return near_duplicates(_table(spark, sf_dir, "documents"), words=3, share=(85, 100))


def op5_secret_guess_cost(spark, sf_dir):
    return secret_spans(_table(spark, sf_dir, "documents"))


def op6_license_rare_index(spark, sf_dir):
    return licence_labels(_table(spark, sf_dir, "documents"))


def op7_lm_backoff(spark, sf_dir):
    return lm_scores(_table(spark, sf_dir, "documents"))


def op8_exact_refine(spark, sf_dir):
    return exact_duplicates(_table(spark, sf_dir, "documents"), carry={"text_sha256": F.sha2("text", 256)})


def op9_mix_curriculum(spark, sf_dir):
    return mix_report(_table(spark, sf_dir, "documents"))


def op10_pack_binary(spark, sf_dir):
    return pack(_table(spark, sf_dir, "documents"), with_ids=False)


def op11_audit_repair(spark, sf_dir):
    return repair_conversations(_table(spark, sf_dir, "conversations"))


def op12_best_fit(spark, sf_dir):
    return pack_best_fit(_table(spark, sf_dir, "documents"), with_ids=False)


def op13_marginal_collocations(spark, sf_dir):
    return collocations(_table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, url, strlen(html)::BIGINT AS payload_bytes,
 list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))) & 31) + 1, 1)
  for i in range(0, 32)], 'string_agg', '') AS payload_digest,
 CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> best THEN best END AS refers_to
FROM w
"""

OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct([array_to_string(ws[i:i + 2], ' ') for i in range(1, len(ws) - 1)])
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.doc_id)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, min(reach.c) AS component_id, s.doc_id = min(reach.c) AS kept
FROM s JOIN reach ON reach.doc_id = s.doc_id GROUP BY s.doc_id, len(s.sh)
"""

OP8_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
 doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

OP13_SQL = r"""
WITH pieces AS (
 SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(text,
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws
 FROM documents WHERE text IS NOT NULL),
grams AS (
 SELECT lang, ws[i:i + m - 1] AS p FROM (
  SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS m)
  WHERE len(ws) >= m)),
f AS (SELECT lang, p, len(p) AS m, count(*) AS c FROM grams GROUP BY lang, p),
n AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT * FROM f WHERE c >= 100 AND m > 1),
inner_ AS (SELECT lang, p[i:i + k - 1] AS p, max(c) AS longer FROM (
  SELECT lang, p, c, m, k, unnest(range(1, m - k + 2)) AS i FROM (
   SELECT lang, p, c, m, unnest(range(2, m)) AS k FROM cand)) GROUP BY 1, 2),
kept AS (SELECT cand.* FROM cand LEFT JOIN inner_ USING (lang, p) WHERE longer IS NULL OR 100 * longer < 100 * c),
cuts AS (
 SELECT q.lang, q.p, q.k, q.c AS a, x.c AS l, y.c AS r, n.n,
  (1000::HUGEINT * q.c * n.n) // (x.c::HUGEINT * y.c) AS score
 FROM (SELECT *, unnest(range(1, m)) AS k FROM kept) q
 JOIN f x ON x.lang = q.lang AND x.p = q.p[:q.k] JOIN f y ON y.lang = q.lang AND y.p = q.p[q.k + 1:]
 JOIN n ON n.lang = q.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1)
SELECT lang, row_number() OVER w AS rank, array_to_string(p, ' ') AS phrase, a, l, r, n, score::BIGINT AS score
FROM best WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' '))
QUALIFY row_number() OVER w <= 2000
"""

QUERIES = {
    "op1_quality_rules": (op1_quality_rules, None),
    "op2_line_dedup": (op2_line_dedup, None),
    "op3_warc_dictionary": (op3_warc_dictionary, OP3_SQL),
    "op4_minhash_bbit": (op4_minhash_bbit, OP4_SQL),
    "op5_secret_guess_cost": (op5_secret_guess_cost, None),
    "op6_license_rare_index": (op6_license_rare_index, None),
    "op7_lm_backoff": (op7_lm_backoff, None),
    "op8_exact_refine": (op8_exact_refine, OP8_SQL),
    "op9_mix_curriculum": (op9_mix_curriculum, None),
    "op10_pack_binary": (op10_pack_binary, None),
    "op11_audit_repair": (op11_audit_repair, None),
    "op12_best_fit": (op12_best_fit, None),
    "op13_marginal_collocations": (op13_marginal_collocations, OP13_SQL),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
