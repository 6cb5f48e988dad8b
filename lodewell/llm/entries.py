"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fim, langid, lexical, licenses, lines, nearjoin, packing, pii, quality, suffix, tokencounts, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors by integer inner product of every vector whose id is divisible by 20."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with one line of each group of near copies left, and how many went."""
    return lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in sequences of at most 2048 tokens."""
    pieces = packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_group")


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its 400-byte repeats, as a digest."""
    found = suffix.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's rule counts, and its verdict with its host's."""
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_failed")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: base kinds counted and digested, all spans listed."""
    found = pii.detect(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long").alias("n_found"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from three quarters of them."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text", F.coalesce(held, F.lit(False)).alias("held_out"))
    prototypes = langid.learn(docs.where("NOT held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), prototypes, ["doc_id", "held_out"])


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids and the bytes they decode to, as digests."""
    import public_tokenizers

    found = bpe.encode_decode(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under four edits: its head replaced, a cut at a third, a note put in at two thirds, its last word doubled."""
    import public_tokenizers

    n = "CAST(length(text) AS BIGINT)"
    edits = f"""array(
        named_struct('start', 0L, 'stop', 5L, 'put', 'The'),
        named_struct('start', {n} div 3, 'stop', {n} div 3 + 7, 'put', ''),
        named_struct('start', 2 * {n} div 3, 'stop', 2 * {n} div 3, 'put', concat(' (see note ', CAST({n} % 97 AS STRING), ": it's new)\n")),
        named_struct('start', 1000000000000L, 'stop', 1000000000000L, 'put', concat(' ', substring_index(text, ' ', -1))))"""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(edits).alias("edits"))
    found = tokencounts.count_edited(docs, _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_reencoded", F.sha2(F.col("text_after").cast("binary"), 256).alias("after_sha256"))


def op10_nearjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near copies (three-word shingles, Jaccard 0.85)."""
    return nearjoin.near_components(_table(spark, sf_dir, "documents"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license phrases, and the licenses whose notices a block of it holds."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of all for every benchmark item."""
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written for filling in its middle, and rebuilt from that, as digests."""
    made = fim.fill_in_middle(_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_topk, op2_lines, op3_packing, op4_suffix, op5_quality, op6_pii, op7_langid, op8_bpe, op9_tokencounts, op10_nearjoin, op11_licenses, op12_lexical, op13_fim)}


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": OP1, "op5_quality": OP5, "op10_nearjoin": OP10, "op11_licenses": _op11(), "op12_lexical": OP12, "op13_fim": OP13}


OP1 = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INTEGER) AS rank, CAST(vec_id AS BIGINT) AS vec_id, CAST(score AS BIGINT) AS score
FROM r WHERE rank <= 20
"""

OP10 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh
  FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i WHERE 100 * c >= 85 * (na + nb - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT CAST(s.doc_id AS BIGINT) AS doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, CAST(m.component_id AS BIGINT) AS component_id, s.doc_id = m.component_id AS kept
FROM s JOIN m ON m.a = s.doc_id
"""

OP5 = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
i AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS k FROM i),
twice AS (SELECT doc_id, unnest(list(i)) AS i FROM win GROUP BY doc_id, k HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM twice, (SELECT unnest(range(8)) AS j) GROUP BY 1),
st AS (
  SELECT w.doc_id, w.source, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n_dup_lines, 0) AS n_dup_lines, coalesce(cov.n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN cov ON cov.doc_id = w.doc_id),
f AS (SELECT *, n_words < 20 AS r0, 100 * n_repeat_words > 30 * n_words AS r1, 10 * n_symbols > n_words AS r2, 20 * n_dup_lines > n_words AS r3,
  2 * word_chars < 5 * n_words OR word_chars > 12 * n_words AS r4 FROM st),
b AS (SELECT *, r0 OR r1 AS base_failed FROM f),
long AS (
  SELECT doc_id, source, rule, CAST(hit AS INT) AS hit
  FROM (SELECT doc_id, source, unnest(['few', 'repetition', 'symbols', 'lines', 'lengths', 'base']) AS rule, unnest([r0, r1, r2, r3, r4, base_failed]) AS hit FROM b)
  WHERE source IS NOT NULL),
h AS (SELECT source, rule, count(*) AS n, sum(hit) AS f FROM long GROUP BY 1, 2),
m AS (SELECT rule, sum(f) / sum(n) AS m, coalesce(var_samp(f / n), 0) AS v, avg(1 / n) AS inv FROM h GROUP BY 1),
p AS (SELECT rule, m, least(1000, greatest(1, m * (1 - m) / greatest(1e-9, v - m * (1 - m) * inv) - 1)) AS s FROM m),
rate AS (SELECT h.source, h.rule, (f + s * m) / (n + s) AS rate FROM h JOIN p ON p.rule = h.rule),
bad AS (SELECT source FROM rate WHERE rule = 'base' AND rate > 0.9),
habit AS (SELECT source, rule FROM rate WHERE rule <> 'base' AND rate > 0.02),
caught AS (SELECT DISTINCT long.doc_id FROM long JOIN habit ON habit.source = long.source AND habit.rule = long.rule WHERE hit = 1)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  base_failed, NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AND doc_id NOT IN (SELECT doc_id FROM caught) AS kept,
  source IS NOT NULL AND source IN (SELECT source FROM bad) AS host_failed
FROM b
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _op11() -> str:
    def words(text: str) -> str:
        return "[" + ", ".join(f"'{w.decode()}'" for w in licenses.words_of(text.encode())) + "]"

    longest = max(len(licenses.words_of(t.encode())) for t in licenses.TEMPLATES.values())
    templates = ", ".join(f"('{label}', list_distinct({words(t)}))" for label, t in licenses.TEMPLATES.items())
    phrases = ", ".join(f"('{label}', {words(p)})" for p, label in licenses.PHRASES.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, {LOWER} AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM d),
p(label, phrase) AS (VALUES {phrases}),
t(label, words) AS (VALUES {templates}),
b AS (
  SELECT id, p.label, unnest(list_filter(range(0, len(ws) - len(phrase) + 1), lambda i: ws[i + 1 : i + len(phrase)] = phrase)) AS place
  FROM w JOIN p ON contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || array_to_string(phrase, ' ') || ' ')),
base AS (SELECT id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM b GROUP BY 1),
par AS (SELECT id, unnest(regexp_split_to_array(text, '\n[ \t\r\f\v]*\n')) AS text FROM d),
pw AS (SELECT id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM par),
lo AS (SELECT id, ws, unnest(range(0, greatest(1, len(ws) - {longest}), {longest})) AS lo FROM pw),
blocks AS (SELECT id, list_distinct(ws[lo + 1 : lo + {2 * longest}]) AS words FROM lo),
met AS (SELECT id, label, len(list_intersect(t.words, blocks.words)) AS c, len(t.words) AS n FROM blocks JOIN t ON len(blocks.words) >= 1),
found AS (SELECT id, list(DISTINCT label) AS labels, max(c / n) AS share FROM met WHERE 100 * c >= 80 * n GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN base ON base.id = w.id LEFT JOIN found ON found.id = w.id
"""


OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
q AS (SELECT row_number() OVER () AS qid, item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM benchmark),
st AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM d WHERE len(ws) > 0),
post AS (SELECT id, doc_id, CAST(n AS BIGINT) AS n, term, count(*) AS tf FROM (SELECT id, doc_id, len(ws) AS n, unnest(ws) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, st),
ask AS (SELECT qid, item_id, term, count(*) AS times FROM (SELECT qid, item_id, unnest(ws) AS term FROM q) GROUP BY ALL),
sc AS (
  SELECT qid, item_id, id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM ask JOIN w USING (term) JOIN post USING (term), st GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""

OP13 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
n AS (
  SELECT doc_id, text, length(text) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS x, greatest(h1 % (n + 1), h2 % (n + 1)) AS y,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM n),
c AS (SELECT *, substring(text, 1, x) AS p, substring(text, x + 1, y - x) AS m, substring(text, y + 1, n - y) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""
