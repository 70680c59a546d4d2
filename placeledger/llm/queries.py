"""The registered queries: each applies its operator, with the settings of production, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeledger.llm.texts import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _hex(column):
    return F.sha2(F.coalesce(column, F.lit("")), 256)


@query
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placeledger.llm.chat import format_conversations, read_back

    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return read_back(format_conversations(turns))


CHECKS["op1_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), walked AS (
  SELECT conv_id, row_number() OVER w - 1 AS at_turn, count(*) OVER (PARTITION BY conv_id) AS n, role,
    coalesce(lag(role) OVER w, 'start') || '>' || role IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AS good
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), judged AS (
  SELECT conv_id, coalesce(min(at_turn) FILTER (WHERE NOT good), max(n) FILTER (WHERE at_turn = n - 1 AND role <> 'assistant')) AS first_error
  FROM walked GROUP BY conv_id
), sized AS (
  SELECT *, length(text) + (length(text) - length(replace(text, chr(92), '')))
      + (length(text) - length(replace(text, '<s>', ''))) // 3 + (length(text) - length(replace(text, '</s>', ''))) // 4
      + (length(text) - length(replace(text, '[INST]', ''))) // 6 + (length(text) - length(replace(text, '[/INST]', ''))) // 7
      + (length(text) - length(replace(text, '<<SYS>>', ''))) // 7 + (length(text) - length(replace(text, '<</SYS>>', ''))) // 8 AS escaped
  FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(3 + length(role) + 1 + escaped + 5)::BIGINT AS formatted_chars,
  any_value(first_error) AS first_error
FROM sized JOIN judged USING (conv_id) GROUP BY conv_id
"""


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placeledger.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


CHECKS["op2_decontamination"] = r"""
WITH split AS (
  SELECT 'd' AS kind, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL
  SELECT 'b', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), worded AS (
  SELECT kind, id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM split
), shingled AS (
  SELECT DISTINCT kind, id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT kind, id, w, unnest(generate_series(1, greatest(len(w) - 4, least(len(w), 1)))) AS i FROM worded)
  UNION
  SELECT kind, id, array_to_string(w[i : i + short - 1], ' ')
  FROM (
    SELECT kind, id, w, short, unnest(generate_series(1, len(w) - short + 1)) AS i
    FROM worded, (SELECT DISTINCT len(w) AS short FROM worded WHERE kind = 'b' AND len(w) BETWEEN 1 AND 4)
    WHERE kind = 'd' AND len(w) >= short
  )
), items AS (
  SELECT id AS item_id, s, count(*) OVER (PARTITION BY id) AS n_shingles FROM shingled WHERE kind = 'b'
)
SELECT d.id AS doc_id, i.item_id, count(*) AS n_shared, any_value(i.n_shingles) AS n_shingles
FROM items i JOIN shingled d ON d.kind = 'd' AND d.s = i.s
GROUP BY d.id, i.item_id HAVING 100 * count(*) >= 75 * any_value(i.n_shingles)
"""


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placeledger.llm.line_dedup import line_report

    out = line_report(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", _hex(F.col("text")).alias("kept_sha256"))


CHECKS["op9_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
    translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT k.doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key GROUP BY k.doc_id
"""


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    from placeledger.llm.token_files import read_token_files, write_token_files
    from placeledger.session import checkpoint_dir

    path = f"{checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4()}"
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def token_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Encode and decode every text, and give the digests of both."""
    import public_tokenizers

    from placeledger.llm.bpe import decode, encode

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = decode(encode(docs, path, public_tokenizers.PATTERN), path)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark, table(spark, sf_dir, "documents"))


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@query
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placeledger.llm.ngrams import score

    docs = table(spark, sf_dir, "documents")
    return score(docs, train=_remainder(5) != 1)


def language_model(docs: DataFrame):
    """The production model, learned from the rows whose remainder modulo 4 is not 2."""
    import public_tokenizers

    from placeledger.llm.language_id import train

    return train(docs.filter(_remainder(4) != 2), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placeledger.llm.language_id import identify

    docs = table(spark, sf_dir, "documents")
    return identify(docs, language_model(docs), F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"))


@query
def op10_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placeledger.llm.outliers import judge

    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 6).alias("distance")
    )


@query
def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placeledger.llm.near_dedup import near_groups

    return near_groups(table(spark, sf_dir, "documents"))


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placeledger.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=50).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placeledger.llm.repair import damage, repair, with_all

    turns = table(spark, sf_dir, "conversations")
    return with_all(*repair(damage(turns)), turns)


CHECKS["op11_conversation_repair"] = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), cased AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::UBIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))
  ), 4294967295::UBIGINT) % 20 AS c FROM given
), damaged AS (
  SELECT conv_id, turn, CASE c WHEN 4 THEN 'user' ELSE role END AS role,
    CASE c WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE c WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM cased WHERE c <> 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last_char, left(role, 1) AS letter
  FROM damaged
), faulty AS (
  SELECT *, CASE WHEN last_char = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
    WHEN last_char NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    coalesce(lag(letter) OVER (PARTITION BY conv_id ORDER BY i) || letter NOT IN ('su', 'ua', 'au'), false) AS odd_pair
  FROM ordered
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
    count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE odd_pair) AS illegal, any_value(n) AS n
  FROM faulty GROUP BY conv_id
), steps AS ( -- states: 0 nothing, 1 system, 2 user, 3 assistant
  SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) AS t(f, letter, t)
), inserts AS (
  SELECT f, 0 AS cost, '' AS done, f AS t FROM (VALUES (0), (1), (2), (3)) AS v(f)
  UNION ALL SELECT f, 2, 'I', t FROM steps WHERE letter <> 's'
  UNION ALL SELECT a.f, 4, 'II', b.t FROM steps a JOIN steps b ON a.t = b.f WHERE a.letter <> 's' AND b.letter <> 's'
), ways AS (
  SELECT conv_id, 0 AS i, 0 AS q, {'cost': 0, 'audit': ''} AS best, n FROM counted
  UNION ALL
  SELECT w.conv_id, w.i + 1, m.t, min({'cost': w.best.cost + m.cost, 'audit': w.best.audit || m.done}), any_value(w.n)
  FROM ways w
  LEFT JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
  JOIN (
    SELECT x.f, x.cost + 3 AS cost, x.done || 'D' AS done, x.t, NULL AS letter, 1 AS kind FROM inserts x
    UNION ALL SELECT x.f, x.cost, x.done || 'K', y.t, y.letter, 2 FROM inserts x JOIN steps y ON x.t = y.f
    UNION ALL SELECT x.f, x.cost + 2, x.done || 'R', y.t, NULL, 3 FROM inserts x JOIN steps y ON x.t = y.f AND y.letter <> 's'
    UNION ALL SELECT x.f, x.cost + 1, x.done || 'K', y.t, y.letter, 4 FROM inserts x JOIN steps y ON x.t = y.f
    UNION ALL SELECT x.f, x.cost + 3, x.done || 'R', y.t, NULL, 5 FROM inserts x JOIN steps y ON x.t = y.f AND y.letter <> 's'
    UNION ALL SELECT x.f, x.cost, x.done, x.t, NULL, 6 FROM inserts x
  ) m ON m.f = w.q AND CASE WHEN w.i = w.n THEN m.kind = 6 AND m.t IN (0, 3) WHEN m.kind = 1 THEN true WHEN r.fault IN (1, 2) THEN false
    WHEN r.fault = 0 THEN m.kind = 3 OR (m.kind = 2 AND m.letter = r.letter) ELSE m.kind = 5 OR (m.kind = 4 AND m.letter = r.letter) END
  WHERE w.i <= w.n
  GROUP BY w.conv_id, w.i, m.t
), solved AS (
  SELECT conv_id, min(best) AS best FROM ways WHERE i = n + 1 GROUP BY conv_id
), spelled AS (
  SELECT conv_id, k, substr(best.audit, k, 1) AS edit, k - length(replace(left(best.audit, k), 'I', '')) AS skipped,
    length(replace(left(best.audit, k), 'D', '')) - 1 - length(replace(best.audit, 'D', '')) % 2 AS place
  FROM (SELECT *, unnest(range(1, length(best.audit) + 1)) AS k FROM solved)
), repaired AS (
  SELECT s.conv_id, sha256(string_agg(
    CASE WHEN s.edit = 'K' THEN r.role WHEN s.place % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN s.edit = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY s.k
  )) AS digest
  FROM spelled s LEFT JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND s.edit <> 'I' AND r.i = s.k - s.skipped
  WHERE s.edit <> 'D' GROUP BY s.conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v.best.cost, 0)::BIGINT AS cost,
  coalesce(v.best.audit, '') AS audit, coalesce(d.digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN solved v ON v.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN repaired d ON d.conv_id IS NOT DISTINCT FROM e.conv_id
"""


@query
def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from placeledger.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024).drop("ids")


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placeledger.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"), keep=8)
