"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teleskein.llm import bpe, conversation, jaccard, langid, line_dedup, lm, mixing, pii, quality, search, spelling, suffix, warc
from teleskein.llm.common import source


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.cleaned(source(spark, sf_dir, "documents"))
    return done.select(
        F.col("row")["doc_id"].alias("doc_id"),
        F.col("n_lines").cast("long").alias("n_lines"),
        F.col("n_removed").cast("long").alias("n_removed"),
        F.md5(F.col("row")["text"].cast("binary")).alias("kept_md5"),
    )


OP1_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, pos, string_split(text, chr(10))[pos + 1] AS line
  FROM documents, LATERAL (SELECT unnest(range(len(string_split(text, chr(10))))) AS pos)
), keyed AS (
  SELECT *, regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS key FROM lines
), common AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key
  HAVING count(DISTINCT coalesce('s' || source, '')) >= {line_dedup.MIN_SITES}
), placed AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS LAST, pos) AS place
  FROM keyed JOIN common USING (key)
)
SELECT k.doc_id, count(*) AS n_lines, count(p.pos) AS n_removed,
  md5(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE p.pos IS NULL), '')) AS kept_md5
FROM keyed k LEFT JOIN (SELECT * FROM placed WHERE place > 1) p ON k.doc_id = p.doc_id AND k.pos = p.pos
GROUP BY k.doc_id
"""


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(source(spark, sf_dir, "documents")).drop("source")


OP2_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    ([{", ".join(f"{w}::DOUBLE" for w in mixing.WEIGHTS)}])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1)::INT] AS weight
  FROM sized GROUP BY source
), bounds AS (
  SELECT *, {mixing.MAX_EPOCHS}::DOUBLE * source_size AS bound FROM sources
), steps AS (
  SELECT coalesce(sum(bound) OVER w, 0) AS taken, (SELECT sum(weight) FROM bounds) - coalesce(sum(weight) OVER w, 0) AS free,
    bound / weight AS ratio
  FROM bounds WINDOW w AS (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT max(({mixing.SHARE} * (SELECT sum(source_size) FROM sources) - taken) / free) AS level
  FROM steps WHERE ({mixing.SHARE} * (SELECT sum(source_size) FROM sources) - taken) / free < ratio
), targets AS (
  SELECT source, source_size, least(bound, coalesce(level * weight, bound)) AS target FROM bounds, level
), placed AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized
), joined AS (
  SELECT p.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, round(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM joined
"""


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(source(spark, sf_dir, "documents"))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(source(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, source(spark, sf_dir, "pages"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(source(spark, sf_dir, "documents"))


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.with_pseudonyms(source(spark, sf_dir, "documents"))
    return done.select(F.col("row")["doc_id"].alias("doc_id"), F.col("row")["text"].alias("text"), "n_values")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(source(spark, sf_dir, "documents"), bpe.default_path())


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_substrings(source(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(source(spark, sf_dir, "documents"), source(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(source(spark, sf_dir, "documents"))


# crc32 of a text: its table by eight shifts of each byte, then one step a byte.
_CRC_TABLE = """
bits(i, k, v) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM bits WHERE k < 8
), crc_table AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8)"""


def _crc(key: str) -> str:
    """SQL for the crc32 of ``key`` in a query that also reads crc_table."""
    digits = f"hex(encode({key}))"
    bytes_ = f"list_transform(range(length({digits}) // 2), lambda i: ('0x' || substr({digits}, 2 * i::INT + 1, 2))::UBIGINT)"
    step = "lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::INT + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {bytes_}), {step}), 4294967295::UBIGINT)"


OP11_SQL = f"""
WITH RECURSIVE {_CRC_TABLE}, cut AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(text, '{spelling.RUN}')) AS run FROM documents
), runs AS (
  SELECT doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times FROM cut GROUP BY ALL
), hashed AS (
  SELECT run, times, {_crc("doc || ':' || run")} AS h FROM runs, crc_table
), typed AS (
  SELECT CASE WHEN h % {spelling.MISTYPED} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM hashed
), words AS (
  SELECT word, sum(times)::BIGINT AS n FROM typed WHERE length(word) >= {spelling.MIN_LENGTH} GROUP BY word HAVING sum(times) >= {spelling.MIN_COUNT}
), cuts AS (
  SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM words, LATERAL (SELECT unnest(range(length(word))) AS i)
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION
  SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM pairs GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN other_n >= {spelling.RATIO} * n THEN other END AS form, CASE WHEN other_n >= {spelling.RATIO} * n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), chains(word, tip) AS (
  SELECT word, word FROM forms
  UNION ALL
  SELECT c.word, f.form FROM chains c JOIN forms f ON c.tip = f.word WHERE f.form IS NOT NULL
), roots AS (
  SELECT c.word, c.tip AS root FROM chains c JOIN forms f ON c.tip = f.word WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(source(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.repaired(source(spark, sf_dir, "conversations"))


OP13_SQL = f"""
WITH RECURSIVE {_CRC_TABLE}, plain AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), hits AS (
  SELECT conv_id, turn, role, text, {_crc("key")} % 20 AS hit FROM plain, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hits WHERE hit <> 0
), ranked AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), copy) AS k,
    regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z', 1) AS last
  FROM damaged
), judged AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
      WHEN last IN ('.', '!', '?') THEN '' ELSE 'truncated' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS adjacent
  FROM ranked
), steps(role, i, j) AS (
  VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)
), inserts(i, j, n) AS (
  VALUES (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)
), edits AS (
  SELECT conv_id, k, i, i AS j, 4 AS cost, 'D' AS edit FROM judged, range(4) t(i)
  UNION ALL
  SELECT conv_id, k, i, j, 3 + CASE fault WHEN '' THEN 0 ELSE 3 END, 'R' FROM judged, steps WHERE fault IN ('', 'truncated') AND steps.role <> 's'
  UNION ALL
  SELECT conv_id, k, i, j, CASE fault WHEN '' THEN 0 ELSE 3 END, 'K' FROM judged JOIN steps ON initial = steps.role WHERE fault IN ('', 'truncated')
), reached(conv_id, k, state, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0::BIGINT, {{'cost': 0::BIGINT, 'audit': ''}} FROM conversations
  UNION ALL
  SELECT r.conv_id, r.k + 1, e.j::BIGINT, min({{'cost': r.best.cost + 3 * n + e.cost, 'audit': r.best.audit || repeat('I', n) || e.edit}})
  FROM reached r JOIN inserts p ON p.i = r.state JOIN edits e ON e.conv_id IS NOT DISTINCT FROM r.conv_id AND e.k = r.k + 1 AND e.i = p.j
  GROUP BY r.conv_id, r.k, e.j
), talks AS (
  SELECT c.conv_id, count(j.k) AS n, coalesce(max(j.turn) - min(j.turn) + 1 - count(DISTINCT j.turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE adjacent NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN judged j ON c.conv_id IS NOT DISTINCT FROM j.conv_id GROUP BY c.conv_id
), ends AS (
  SELECT t.conv_id, min({{'cost': r.best.cost + 3 * p.n, 'audit': r.best.audit || repeat('I', p.n)}}) AS best
  FROM talks t JOIN reached r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.k = t.n JOIN inserts p ON p.i = r.state AND p.j IN (0, 3)
  GROUP BY t.conv_id
), letters AS (
  SELECT conv_id, p, substr(best.audit, p::INT, 1) AS edit FROM ends, LATERAL (SELECT unnest(range(1, length(best.audit) + 1)) AS p)
), placed AS (
  SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS k FROM letters
), outputs AS (
  SELECT l.conv_id, p, edit, j.role, CASE WHEN edit = 'I' THEN '' ELSE text END AS text, row_number() OVER (PARTITION BY l.conv_id ORDER BY p) AS m,
    first_value(edit = 'K' AND initial = 's') OVER (PARTITION BY l.conv_id ORDER BY p) AS led
  FROM placed l LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM l.conv_id AND j.k = l.k WHERE edit <> 'D'
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (m - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS text
  FROM outputs GROUP BY conv_id
)
SELECT t.conv_id, t.gaps::BIGINT AS gaps, t.blank, t.duplicate, t.truncated, t.illegal, e.best.cost::BIGINT AS cost, e.best.audit AS audit, sha256(coalesce(x.text, '')) AS repaired_sha256
FROM talks t JOIN ends e ON e.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN texts x ON x.conv_id IS NOT DISTINCT FROM t.conv_id
"""


QUERIES = {
    "op1_line_dedup": (op1_line_dedup, OP1_SQL),
    "op2_source_mixing": (op2_source_mixing, OP2_SQL),
    "op3_lm_scoring": (op3_lm_scoring, None),
    "op4_topk_search": (op4_topk_search, None),
    "op5_warc": (op5_warc, None),
    "op6_ngram_jaccard": (op6_ngram_jaccard, None),
    "op7_pii_pseudonyms": (op7_pii_pseudonyms, None),
    "op8_bpe": (op8_bpe, None),
    "op9_suffix_array_dedup": (op9_suffix_array_dedup, None),
    "op10_quality_rules": (op10_quality_rules, None),
    "op11_spelling_variants": (op11_spelling_variants, OP11_SQL),
    "op12_language_id": (op12_language_id, None),
    "op13_conversation_repair": (op13_conversation_repair, OP13_SQL),
}
