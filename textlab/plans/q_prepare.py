"""Registered queries: text preparation (F2, F3, F7, F8, X1-X4, A23, J4, J5,
A19, A20)."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import prompts as PR
from ..operators import replies as RS
from ..operators import sample as S
from ..operators import subword as SB
from ..operators import vocab as V
from ..session import scratch_path, stage_table
from .fixtures import view
from .q_compare import WS_DUCK
from .registry import register

WORD_DUCK = r"[\p{L}\p{N}_]+|[^\s\x0B\x1C-\x1F\x{85}\p{Z}\p{L}\p{N}_]"
TOKS_DUCK = f"list_filter(regexp_split_to_array(text, '{WS_DUCK}'), lambda x: x <> '')"
DIM = 64  # dimension of the given embeddings


def u_duck(seed_expr: str, *cols: str) -> str:
    key = " || ':' || ".join([f"'{seed_expr}'"] + [f"CAST({c} AS VARCHAR)" for c in cols])
    return f"(CAST(concat('0x', substr(md5({key}), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE))"


def labelled(spark, sf):
    return view(spark, sf, "tw").where(F.col("target").isNotNull())


def train_part(spark, sf):
    """Training rows: labelled tw rows outside the validation split."""
    return S.train_val_split(labelled(spark, sf), 0.2, 42).where(~F.col("is_val")).drop("is_val")


LAB = "lab AS (SELECT id, keyword, location, text, target FROM tw WHERE target IS NOT NULL)"
TRN = f"trn AS (SELECT id, text, target FROM lab WHERE NOT ({u_duck('42', 'id')} < 0.2))"
VOC = f"""voc AS (SELECT '<PAD>' AS tok, 0 AS idx UNION ALL SELECT '<UNK>' AS tok, 1 AS idx UNION ALL
 SELECT tok, CAST(row_number() OVER (ORDER BY n DESC, tok) + 1 AS INT) AS idx FROM (
  SELECT tok, count(*) AS n FROM (SELECT unnest({TOKS_DUCK}) AS tok FROM trn) x
  WHERE tok NOT IN ('<PAD>', '<UNK>') GROUP BY tok ORDER BY n DESC, tok LIMIT 4998) c)"""


@register("tokenize_ws", "id:i pos:i tok:s",
          f"SELECT id, unnest(generate_series(0, len(arr) - 1)) AS pos, unnest(arr) AS tok "
          f"FROM (SELECT id, {TOKS_DUCK} AS arr FROM tw) x", ["tw"])
def q_tokenize_ws(spark, sf):
    return view(spark, sf, "tw").select("id", F.posexplode(T.tokenize_ws("text")).alias("pos", "tok"))


@register("tokenize_words", "id:i pos:i tok:s",
          f"SELECT id, unnest(generate_series(0, len(arr) - 1)) AS pos, unnest(arr) AS tok "
          f"FROM (SELECT id, regexp_extract_all(text, '{WORD_DUCK}') AS arr FROM tw) x", ["tw"])
def q_tokenize_words(spark, sf):
    return view(spark, sf, "tw").select("id", F.posexplode(T.tokenize_words("text")).alias("pos", "tok"))


@register("response_parse", "id:i label:i parse_ok:i",
          "SELECT id, CASE WHEN contains(reply, '0') THEN 0 WHEN contains(reply, '1') THEN 1 END AS label, "
          "(contains(reply, '0') OR contains(reply, '1')) AS parse_ok FROM replies", ["replies"])
def q_response_parse(spark, sf):
    return PR.response_parse(view(spark, sf, "replies"))


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


REPLY_FORMS = ("1", "Answer: 0", "10", " 1.", "not sure")


def _reply_of(prompts: list[str]) -> list[str]:
    """The plug-in model of the fixture: a reply by the prompt's md5."""
    return [REPLY_FORMS[int(hashlib.md5(p.encode()).hexdigest()[:8], 16) % len(REPLY_FORMS)] for p in prompts]


@register("reply_store", "id:i reply:s label:i",
          f"""WITH p AS (SELECT id, replace({_sql_lit(PR.ZERO_SHOT_TEMPLATE)}, '[test_tweet]', text) AS prompt FROM tw WHERE target IS NULL),
 r AS (SELECT id, [{', '.join(_sql_lit(r) for r in REPLY_FORMS)}][CAST(concat('0x', substr(md5(prompt), 1, 8)) AS BIGINT) % {len(REPLY_FORMS)} + 1] AS reply FROM p)
SELECT id, reply, CASE WHEN contains(reply, '0') THEN 0 WHEN contains(reply, '1') THEN 1 END AS label FROM r""", ["tw"])
def q_reply_store(spark, sf):
    """Half of the prompts are asked and stored first, then the rest; labels come from the store."""
    tw = view(spark, sf, "tw")
    prompts = PR.prompt_build(tw.where(F.col("target").isNull()).select("id", "text"), 0, None).select("id", "prompt")
    store = scratch_path(spark, "replies")
    RS.ask_missing(prompts.where("id % 2 = 0"), store, _reply_of)
    RS.ask_missing(prompts, store, _reply_of)
    return RS.attach_replies(prompts, store).select("id", "reply", T.response_parse("reply").alias("label"))


SHOTS_CTE = ("head AS (SELECT id, text, target, row_number() OVER (ORDER BY id) - 1 AS pos FROM "
             "(SELECT id, text, target FROM lab ORDER BY id LIMIT 25) h), "
             "shots AS (SELECT v.slot, head.id, head.text, head.target FROM head JOIN (VALUES "
             + ", ".join(f"({i}, {p})" for i, p in enumerate(PR.SHOT_POSITIONS)) + ") AS v(slot, pos) ON head.pos = v.pos)")


@register("few_shot_select", "slot:i id:i text:s target:i",
          f"WITH {LAB}, {SHOTS_CTE} SELECT slot, id, text, target FROM shots", ["tw"])
def q_few_shot(spark, sf):
    return PR.few_shot_select(labelled(spark, sf), 10)


def _prompt_sql(shots: int) -> str:
    if shots == 0:
        expr = _sql_lit(PR.ZERO_SHOT_TEMPLATE)
    elif shots == 1:
        expr = _sql_lit(PR.ONE_SHOT_TEMPLATE)
        expr = f"replace({expr}, '[example_tweet]', (SELECT text FROM shots WHERE slot = 0))"
        expr = f"replace({expr}, '[desaster]', (SELECT CAST(target AS VARCHAR) FROM shots WHERE slot = 0))"
    else:
        expr = _sql_lit(PR.TEN_SHOT_TEMPLATE)
        for i in range(shots):
            expr = f"replace({expr}, '[example_tweet{i}]', (SELECT text FROM shots WHERE slot = {i}))"
            expr = f"replace({expr}, '[desaster{i}]', (SELECT CAST(target AS VARCHAR) FROM shots WHERE slot = {i}))"
    return (f"WITH {LAB}, {SHOTS_CTE} SELECT t.id, replace({expr}, '[test_tweet]', t.text) AS prompt "
            "FROM tw t WHERE t.target IS NULL")


def _prompt_query(shots):
    def q(spark, sf):
        tw = view(spark, sf, "tw")
        ex = PR.few_shot_select(labelled(spark, sf), shots) if shots else None
        return PR.prompt_build(tw.where(F.col("target").isNull()).select("id", "text"), shots, ex).select("id", "prompt")
    return q


for _s, _name in ((10, "prompt_build"), (1, "prompt_build_one_shot"), (0, "prompt_build_zero_shot")):
    register(_name, "id:i prompt:s", _prompt_sql(_s), ["tw"])(_prompt_query(_s))


@register("class_weights", "target:i n:i weight:d",
          f"WITH {LAB} SELECT target, count(*) AS n, CAST((SELECT count(*) FROM lab) AS DOUBLE) / "
          "((SELECT count(DISTINCT target) FROM lab) * count(*)) AS weight FROM lab GROUP BY target", ["tw"])
def q_class_weights(spark, sf):
    return S.class_weights(labelled(spark, sf))


@register("train_val_split", "id:i is_val:i",
          f"WITH {LAB} SELECT id, {u_duck('42', 'id')} < 0.2 AS is_val FROM lab", ["tw"])
def q_train_val_split(spark, sf):
    return S.train_val_split(labelled(spark, sf), 0.2, 42).select("id", "is_val")


@register("train_val_split_exact", "id:i is_val:i",
          f"""WITH {LAB}, u AS (SELECT id, CAST(concat('0x', substr(md5('42:' || CAST(id AS VARCHAR)), 1, 8)) AS BIGINT) AS u FROM lab),
 r AS (SELECT id, row_number() OVER (ORDER BY u, id) AS rn FROM u)
SELECT id, rn <= (SELECT ceil(0.2 * count(*)) FROM lab) AS is_val FROM r""", ["tw"])
def q_train_val_split_exact(spark, sf):
    return S.train_val_split_exact(labelled(spark, sf), 0.2, 42).select("id", "is_val")


@register("balanced_bootstrap", "id:i target:i copy:i",
          f"""WITH {LAB}, cw AS (SELECT target, count(*) AS n FROM lab GROUP BY target),
 w AS (SELECT target, CAST((SELECT count(*) FROM lab) AS DOUBLE) / ((SELECT count(*) FROM cw) * n) AS lam FROM cw),
 j AS (SELECT target, lam, unnest(range(0, CAST(ceil(lam + 10 * sqrt(lam) + 10) AS BIGINT) + 1)) AS j FROM w),
 p AS (SELECT target, j, sum(exp(-lam + j * ln(lam) - lgamma(j + 1))) OVER (PARTITION BY target ORDER BY j
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cdf FROM j),
 uu AS (SELECT id, target, {u_duck('0:boot', 'id')} AS u FROM lab),
 k AS (SELECT uu.id, uu.target, count(*) FILTER (WHERE p.cdf <= uu.u) AS k FROM uu JOIN p ON uu.target = p.target
       GROUP BY uu.id, uu.target)
SELECT id, target, unnest(range(1, k + 1)) AS copy FROM k WHERE k > 0""", ["tw"])
def q_balanced_bootstrap(spark, sf):
    return S.balanced_bootstrap(labelled(spark, sf).select("id", "target"), "target", 0)


@register("balanced_draw_exact", "id:i target:i copy:i",
          f"""WITH {LAB}, cw AS (SELECT target, count(*) AS n FROM lab GROUP BY target),
 w AS (SELECT lab.id, lab.target, CAST(floor(CAST((SELECT count(*) FROM lab) AS DOUBLE) / ((SELECT count(*) FROM cw) * cw.n)
        * CAST(1e12 AS DOUBLE)) AS HUGEINT) AS w, CAST(concat('0x', substr(md5('0:draw:' || CAST(lab.id AS VARCHAR)), 1, 8)) AS BIGINT) AS u
       FROM lab JOIN cw ON lab.target = cw.target),
 p AS (SELECT id, target, coalesce(sum(w) OVER (ORDER BY u, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM w),
 d AS (SELECT ((CAST(concat('0x', substr(md5('0:position:' || CAST(j AS VARCHAR)), 1, 13)) AS BIGINT) >> 2)::HUGEINT
        * (SELECT sum(w) FROM w)::HUGEINT) // (1::HUGEINT << 50) AS spot FROM (SELECT unnest(range(0, (SELECT count(*) FROM lab))) AS j) x),
 k AS (SELECT p.id, p.target, count(*) AS k FROM d ASOF JOIN p ON d.spot >= p.pos GROUP BY p.id, p.target)
SELECT id, target, unnest(range(1, k + 1)) AS copy FROM k""", ["tw"])
def q_balanced_draw(spark, sf):
    return S.balanced_draw(labelled(spark, sf).select("id", "target"), "target", None, 0)


@register("build_vocab", "tok:s idx:i", f"WITH {LAB}, {TRN}, {VOC} SELECT tok, idx FROM voc", ["tw"])
def q_build_vocab(spark, sf):
    return V.build_vocab(train_part(spark, sf), "text", 5000)


@register("vocab_encode", "id:i pos:i idx:i",
          f"""WITH {LAB}, {TRN}, {VOC},
 tk AS (SELECT id, unnest(generate_series(0, len(arr) - 1)) AS pos, unnest(arr) AS tok FROM (SELECT id, {TOKS_DUCK} AS arr FROM tw) x),
 g AS (SELECT id, unnest(range(0, 128)) AS pos FROM tw)
SELECT g.id, g.pos, CASE WHEN tk.tok IS NULL THEN 0 ELSE coalesce(voc.idx, 1) END AS idx
FROM g LEFT JOIN tk ON g.id = tk.id AND g.pos = tk.pos LEFT JOIN voc ON tk.tok = voc.tok""", ["tw"])
def q_vocab_encode(spark, sf):
    voc = V.build_vocab(train_part(spark, sf), "text", 5000)
    enc = V.vocab_encode(view(spark, sf, "tw"), voc, "id", "text", 128, vocab_rows=5000)
    return enc.select("id", F.posexplode("input_ids").alias("pos", "idx"))


@register("subword_encode", "id:i pos:i idx:i mask:i")
def q_subword_encode(spark, sf):
    """Sub-words learnt on the training texts (100 merges), all texts encoded to 128 ids."""
    vocabulary, _ = SB.learn_vocabulary(train_part(spark, sf), 100)
    rows = SB.encode(view(spark, sf, "tw"), vocabulary)
    return rows.select("id", F.posexplode(F.arrays_zip("input_ids", "attention_mask")).alias("pos", "t")).select(
        "id", "pos", F.col("t.input_ids").alias("idx"), F.col("t.attention_mask").alias("mask"))


@register("vocab_vectors", "idx:i dim:i value:d",
          f"""WITH {LAB}, {TRN}, {VOC},
 vv AS (SELECT v.idx, w.vec FROM voc v LEFT JOIN word_vectors w ON v.tok = w.tok)
SELECT idx, d AS dim, CASE WHEN vec IS NULL THEN -0.25 + 0.5 * {u_duck('0', 'idx', 'd')}
 ELSE CAST(vec[d + 1] AS DOUBLE) END AS value FROM vv, (SELECT unnest(range(0, {DIM})) AS d) dd""",
          ["tw", "word_vectors"])
def q_vocab_vectors(spark, sf):
    voc = V.build_vocab(train_part(spark, sf), "text", 5000)
    vv = V.vocab_vectors(voc, view(spark, sf, "word_vectors"), DIM, seed=0, vocab_rows=5000)
    return vv.select("idx", F.posexplode("vec").alias("dim", "value"))


@register("bow_mean_vector", "id:i dim:i value:d",
          f"""WITH toks AS (SELECT id, unnest({TOKS_DUCK}) AS tok FROM tw),
 kv AS (SELECT t.id, w.vec FROM toks t JOIN word_vectors w ON t.tok = w.tok),
 ex AS (SELECT id, unnest(generate_series(0, len(vec) - 1)) AS dim, unnest(vec) AS value FROM kv),
 mv AS (SELECT id, dim, avg(CAST(value AS DOUBLE)) AS value FROM ex GROUP BY id, dim)
SELECT t.id, d.dim, coalesce(mv.value, 0.0) AS value FROM (SELECT id FROM tw) t
 CROSS JOIN (SELECT unnest(range(0, {DIM})) AS dim) d LEFT JOIN mv ON mv.id = t.id AND mv.dim = d.dim""",
          ["tw", "word_vectors"])
def q_bow_mean_vector(spark, sf):
    # the fixture computes its vectors by joins; written, they are made once for the count and the look-up
    out = V.bow_mean_vector(view(spark, sf, "tw"), stage_table(view(spark, sf, "word_vectors"), "vectors"), DIM)
    return out.select("id", F.posexplode("vec").alias("dim", "value"))


@register("masked_mean_pool", "id:i dim:i value:d",
          """WITH ex AS (SELECT id, unnest(generate_series(0, len(vec) - 1)) AS dim, unnest(vec) AS value FROM hidden WHERE mask = 1)
SELECT id, dim, avg(CAST(value AS DOUBLE)) AS value FROM ex GROUP BY id, dim
UNION ALL SELECT id, NULL AS dim, NULL AS value FROM hidden GROUP BY id HAVING max(mask) = 0""", ["hidden"])
def q_masked_mean_pool(spark, sf):
    out = V.masked_mean_pool(view(spark, sf, "hidden"), "id", "mask", "vec")
    return out.select("id", F.posexplode_outer("vec").alias("dim", "value"))
