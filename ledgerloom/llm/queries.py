"""The ``opN_*`` queries: thin, each one applies its operator to its whole table."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import rows_of, texts_of
from .chat_format import format_chats
from .embedding_dedup import embedding_dedup
from .html_extraction import extract_pages
from .mixing import mix
from .ngram_jaccard import ngram_jaccard
from .quality_classifier import quality_classifier
from .quality_rules import quality_rules
from .sentencepiece_model import decoding, encoding
from .shared import read_table
from .substring_dedup import substring_dedup
from .token_file import read_tokens, write_tokens


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(read_table(spark, sf_dir, "documents"))
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("kept_by_votes")).alias("kept"), "quality_probability",
    )


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(read_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(read_table(spark, sf_dir, "documents"))
    # the kept text has the kept words with the white space they stood in
    joined = F.regexp_replace(F.regexp_replace("kept_text", r"[\x20\x09-\x0D]+", " "), r"\A | \z", "")
    return found.select("doc_id", "n_words", "n_removed", F.sha2(joined, 256).alias("kept_sha256"))


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text, decode the ids again, and report both; the operator's two passes run in one worker."""
    path = piece_model_path()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in decoding(path)(encoding(path)(batches)):
            values, offsets = rows_of(batch.column(1), np.uint32)
            sums = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            texts = [hashlib.sha256(t).hexdigest() for t in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(sums, pa.int64()), pa.array(texts)], names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256"])

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(digest, "doc_id bigint, n_ids bigint, ids_crc32 bigint, decoded_sha256 string")


#: What the planted calls may be: a tool with required, listed, nested and repeated arguments.
PLANTED_TOOLS = (
    '<tools>[{"name": "weather", "parameters": {"type": "object", "properties": {"city": {"type": "string"}, "days": {"type": "integer"}, "unit": {"enum": ["C", "F"]}, '
    '"where": {"type": "object", "properties": {"lat": {"type": "number"}}, "required": ["lat"]}, "tags": {"type": "array", "items": {"type": "string"}}}, "required": ["city"]}}]</tools>'
)
#: Arguments by an eighth of the planted conversations: right ones first, then one fault each (the last names another tool).
PLANTED_ARGUMENTS = (
    '{"days": 3, "city": "Ooty", "unit": "C"}', '{"days": 3}', '{"city": "Ooty", "days": "three"}', '{"city": "Ooty", "unit": "K"}', '{"city": "Ooty", "where": {"lat": "north"}}',
    '{"tags": [1, "x"], "city": "Ooty"}', '{"q": null, "city": "Ooty"}', '{"city": "Ooty"}',
)


def planted_calls(turns: DataFrame) -> DataFrame:
    """Every fourth conversation goes on with tools, two calls and their results, the second result first.

    The tables hold no calls at all; these turns, derived from the conversation's
    id and last turn, make linking, order and validation work on all of them.  In
    every twelfth conversation the first call has no result.
    """
    ends = turns.where("conv_id % 4 = 0").groupBy("conv_id").agg(F.max("turn").alias("last"))
    kind = F.expr("conv_id div 4 % 8")
    arguments = F.element_at(F.array(*map(F.lit, PLANTED_ARGUMENTS)), (kind + 1).cast("int"))
    call = lambda name, args, tool: F.concat(F.lit('<tool_call>{"id": "'), name, F.lit('", "name": "'), tool, F.lit('", "arguments": '), args, F.lit("}</tool_call>"))
    result = lambda name: F.concat(F.lit('{"tool_call_id": "'), name, F.lit('", "content": "dry"}'))
    a, b = F.concat(F.lit("a"), "conv_id"), F.concat(F.lit("b"), "conv_id")
    said = F.concat(F.lit("I look. "), call(a, arguments, F.when(kind == 7, "forecast").otherwise("weather")), call(b, F.lit('{"city": "Pune"}'), F.lit("weather")))
    turn = lambda k, role, text: F.struct((F.col("last") + k).alias("turn"), F.lit(role).alias("role"), text.alias("text"))
    more = F.array(turn(1, "system", F.lit(PLANTED_TOOLS)), turn(2, "assistant", said), turn(3, "tool", result(b)), turn(4, "tool", result(a)))
    more = ends.select("conv_id", F.explode(F.when(F.col("conv_id") % 12 == 0, F.slice(more, 1, 3)).otherwise(more)).alias("t"))
    columns = [F.col(f"t.{c}").cast(turns.schema[c].dataType).alias(c) for c in ("turn", "role", "text")]
    return turns.select("conv_id", "turn", "role", "text").unionByName(more.select("conv_id", *columns))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, with calls planted in every fourth (see ``planted_calls``)."""
    return format_chats(planted_calls(read_table(spark, sf_dir, "conversations")))


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    segments = write_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_tokens(segments).withColumnRenamed("id", "doc_id")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read_table(spark, sf_dir, "documents"), weights=(5, 2, 1), cap=3.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(read_table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))


def held_out() -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels").where(~held_out())
    scored = quality_classifier(read_table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


OPERATORS = (op1_quality_rules, op2_embedding_dedup, op3_substring_dedup, op4_sentencepiece, op5_chat_format, op6_token_file, op7_mix_sources, op8_ngram_jaccard, op9_html_extraction, op10_quality_classifier)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in OPERATORS}

#: All messages in order with their calls linked and checked; the planted turns are made as above.
_CHAT_SQL = r"""
WITH ends AS (SELECT conv_id, max(turn) AS last, conv_id // 4 % 8 AS kind FROM conversations WHERE conv_id % 4 = 0 GROUP BY conv_id),
said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT conv_id, last + 1, 'system', 'TOOLS' FROM ends
  UNION ALL SELECT conv_id, last + 2, 'assistant', 'I look. <tool_call>{"id": "a' || conv_id || '", "name": "' || CASE WHEN kind = 7 THEN 'forecast' ELSE 'weather' END || '", "arguments": ' || [ARGUMENTS][kind + 1]
    || '}</tool_call><tool_call>{"id": "b' || conv_id || '", "name": "weather", "arguments": {"city": "Pune"}}</tool_call>' FROM ends
  UNION ALL SELECT conv_id, last + 3, 'tool', '{"tool_call_id": "b' || conv_id || '", "content": "dry"}' FROM ends
  UNION ALL SELECT conv_id, last + 4, 'tool', '{"tool_call_id": "a' || conv_id || '", "content": "dry"}' FROM ends WHERE conv_id % 12 <> 0),
blocks AS (SELECT conv_id, turn, text, regexp_extract_all(text, '(?s)<tool_call>(.*?)</tool_call>', 1) AS found FROM said WHERE role = 'assistant'),
calls AS (SELECT conv_id, turn, text, unnest(range(len(found))) AS place, unnest(found) AS block FROM blocks),
named AS (SELECT *, json_extract_string(block, '$.id') AS id, json_extract_string(block, '$.name') AS name, json_extract(block, '$.arguments') AS args FROM calls),
results AS (SELECT conv_id, turn, text, json_extract_string(sound, '$.tool_call_id') AS id, json_extract_string(sound, '$.content') AS content FROM (SELECT *, CASE WHEN json_valid(text) THEN text END AS sound FROM said WHERE role = 'tool') WHERE sound IS NOT NULL),
checked AS (
  SELECT n.*, EXISTS (SELECT 1 FROM results r WHERE r.conv_id = n.conv_id AND r.id = n.id) AS answered, list_sort(json_keys(args)) AS keys,
    list_concat(
      CASE WHEN json_extract(args, '$.city') IS NULL THEN ['missing city'] ELSE [] END,
      CASE WHEN json_type(args, '$.days') NOT IN ('UBIGINT', 'BIGINT') THEN ['type of days'] ELSE [] END,
      CASE WHEN json_extract_string(args, '$.unit') NOT IN ('C', 'F') THEN ['value of unit'] ELSE [] END,
      CASE WHEN json_type(args, '$.where.lat') NOT IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN ['type of where.lat'] ELSE [] END,
      list_transform(list_filter(range(CAST(coalesce(json_array_length(args, '$.tags'), 0) AS BIGINT)), lambda i: json_type(args, '$.tags[' || i || ']') <> 'VARCHAR'), lambda i: 'type of tags[' || i || ']'),
      list_transform(list_filter(json_keys(args), lambda k: k NOT IN ('city', 'days', 'unit', 'where', 'tags')), lambda k: 'undeclared ' || k)) AS faults
  FROM named n),
written AS (
  SELECT *, '{"arguments":{' || array_to_string(list_transform(keys, lambda k: CAST(to_json(k) AS VARCHAR) || ':' || CAST(json_extract(args, '$."' || k || '"') AS VARCHAR)), ',') || '},"id":' || CAST(to_json(id) AS VARCHAR) || ',"name":' || CAST(to_json(name) AS VARCHAR) || '}' AS written_call,
    array_to_string(list_concat(CASE WHEN answered THEN [] ELSE ['call without result'] END, CASE WHEN name = 'weather' THEN list_sort(faults) ELSE ['undeclared tool'] END), '; ') AS problem
  FROM checked),
of_calls AS (SELECT conv_id, turn, text, count(*) AS n_calls, count(*) FILTER (answered) AS n_linked, string_agg(written_call, ',' ORDER BY place) AS calls, coalesce(string_agg(problem, '; ' ORDER BY place) FILTER (problem <> ''), '') AS problems FROM written GROUP BY ALL),
owner AS (SELECT conv_id, id, min((turn, place)) AS own FROM named GROUP BY ALL),
lines AS (
  SELECT s.*, c.n_calls, c.n_linked, c.calls, c.problems, r.id, r.content, o.own[1] AS own_turn, o.own[2] AS own_at
  FROM said s LEFT JOIN of_calls c ON s.role = 'assistant' AND c.conv_id = s.conv_id AND c.turn = s.turn AND c.text = s.text
  LEFT JOIN results r ON s.role = 'tool' AND r.conv_id = s.conv_id AND r.turn = s.turn AND r.text = s.text LEFT JOIN owner o ON o.conv_id = r.conv_id AND o.id = r.id)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(own_turn, turn), CASE WHEN own_turn IS NULL THEN 0 ELSE 1 END, coalesce(own_at, -1), turn, role, text) AS position, turn, role,
  coalesce(n_calls, 0) AS n_calls, coalesce(n_linked, 0) AS n_linked, CASE WHEN role = 'tool' AND own_turn IS NULL THEN 'result without call' ELSE coalesce(problems, '') END AS problems,
  '{"content":' || CAST(to_json(CASE WHEN calls IS NOT NULL THEN trim(regexp_replace(text, '(?s)<tool_call>.*?</tool_call>', '', 'g')) ELSE coalesce(content, text) END) AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR)
    || coalesce(',"tool_call_id":' || CAST(to_json(id) AS VARCHAR), '') || coalesce(',"tool_calls":[' || calls || ']', '') || '}' AS message
FROM lines
""".replace("TOOLS", PLANTED_TOOLS.replace("'", "''")).replace("ARGUMENTS", ", ".join(f"'{a}'" for a in PLANTED_ARGUMENTS))

ORACLE_SQL: dict[str, str] = {"op5_chat_format": _CHAT_SQL}
