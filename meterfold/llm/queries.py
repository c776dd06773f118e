"""The operators' queries, each over its whole tables; registered by the entry module when this package is there.

Null texts count as empty ones, an empty table gives no rows, repeated rows give a row each unless a query says otherwise,
and other columns aren't carried; what else holds for odd rows stands at the operators themselves.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterfold.llm import bpe, chat, conversation_repair, decontamination, html_text, jaccard_join, lexical_search, quality_classifier, quality_rules, simhash, token_counts, token_files, toxicity
from meterfold.llm.common import materialised, scratch, table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of what they decode to, for every document."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position, size and checksum of every document, read from the token files that were written; ids are whole numbers, null ones come first."""
    folder = scratch(spark, "token-files")
    files = token_files.write(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"), tokenizers.PATTERN, folder)
    return token_files.with_checksum(token_files.read(files, folder))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, tokens and whether they are over the limit, for every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizers.path("piece_bpe_32k.model"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality of every document, and whether it is kept; without labels of both kinds all evidence is even."""
    return quality_classifier.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; a page without any has an empty one."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation and of its text under the loss mask, read back from the rows that were written."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.read_back(materialised(chat.format_chats(turns.unionByName(probe), tokenizers.path("byte_bpe_50k.json")), "chats"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document, copies that repeat an id included; a text without words is alone."""
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base rules and the verdict of the fertility bands, for every document."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), tokenizers.path("piece_bpe_32k.model"), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, by a model of the labels outside the held-out fold."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds; rows that share an id count as one."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with every fault that the repair knows, told by a checksum of id and turn; a null part of it, a null role or text is one space."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn"))) % 20).alias("kind")
    rows = turns.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), kind).where("kind <> 0")
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was wrong with every damaged conversation, the cheapest edits, and the digest of its rows after them."""
    turns = table(spark, sf_dir, "conversations")
    report, edited = conversation_repair.repair(damaged(turns))
    every = turns.select("conv_id").distinct()
    for part in (report, conversation_repair.digests(edited)):
        part = part.withColumnRenamed("conv_id", "own_id")
        every = every.join(part, every.conv_id.eqNullSafe(part.own_id), "left").drop("own_id")
    return every.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = op1_byte_bpe, op2_token_files, op3_quality, op4_token_counts, op5_html_text, op6_chat, op7_jaccard_join, op8_quality_rules, op9_toxicity, op10_leaks, op11_lexical_search, op12_simhash, op13_conversation_repair
    return {f.__name__: f for f in every}


_ESCAPED = r"replace(replace({0}, '\', '\\'), '<|', '<\|')"
OP6_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, COUNT(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(COALESCE(SUM(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(COALESCE(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(SUM(32 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
OP7_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(COALESCE(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM words),
sizes AS (SELECT doc_id, COUNT(*) AS n FROM grams GROUP BY 1),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, COUNT(*) AS m FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE m / (x.n + y.n - m) >= 0.8),
reach AS (SELECT DISTINCT u AS node, u AS seen FROM links UNION SELECT reach.node, links.v FROM reach JOIN links ON links.u = reach.seen)
SELECT d.doc_id, COALESCE(c.class_id, d.doc_id) AS class_id, COALESCE(k.n_links, 0) AS n_links FROM documents d
LEFT JOIN (SELECT node, MIN(seen) AS class_id FROM reach GROUP BY 1) c ON c.node = d.doc_id
LEFT JOIN (SELECT u, COUNT(*) AS n_links FROM links GROUP BY 1) k ON k.u = d.doc_id
"""


OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS row, unnest(regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
held AS (SELECT row, any_value(doc_id) AS doc_id, term, COUNT(*) AS tf FROM words GROUP BY row, term),
sizes AS (SELECT row, CAST(SUM(tf) AS BIGINT) AS n FROM held GROUP BY row),
total AS (SELECT COUNT(*) AS docs, CAST(SUM(n) AS BIGINT) AS terms FROM sizes),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * COUNT(*) + 1))) AS BIGINT) AS w FROM held, total GROUP BY term, docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, row, any_value(doc_id) AS doc_id, CAST(SUM(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN sizes USING (row), total GROUP BY item_id, row),
ranked AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
_BIT = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
_KEY = "COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ')"
_CRC = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({_KEY}, ''), lambda k: CAST(ascii(k) AS BIGINT))), lambda c, b: {_BIT}), 4294967295)"


def _then(to: str, cost: str, letter: str, line: str) -> str:
    return f"{{'c': {to}.c + {cost}, 'a': '{letter}' || {to}.a, 'r': {line} || {to}.r}}"


def _step(state: int) -> str:
    """SQL of the best (cost, audit, rows) from a state, by a row's own edits: x0 to x3 are those after it."""
    then, role = ("x2", "user") if state != 2 else ("x3", "assistant")
    kept = {0: "WHEN 's' THEN {s} WHEN 'u' THEN {u}", 1: "WHEN 'u' THEN {u}", 2: "WHEN 'a' THEN {a}", 3: "WHEN 'u' THEN {u}"}[state]
    own = {k: _then(to, "late", "K", "line") for k, to in (("s", "x1"), ("u", "x2"), ("a", "x3"))}
    gone = _then(f"x{state}", "3", "D", "''")
    far = "{'c': CAST(1000000000 AS BIGINT), 'a': '', 'r': ''}"
    return f"list_sort([{gone}, CASE WHEN must THEN {far} ELSE {_then(then, '2 + late', 'R', f"chr(10) || '{role}:' || text")} END, CASE WHEN must THEN {far} ELSE CASE initial {kept.format(**own)} ELSE {far} END END])[1]"


_USER, _ASSISTANT = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
OP13_SQL = f"""
WITH RECURSIVE src AS (SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text, {_CRC} % 20 AS kind FROM conversations),
rows AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM src WHERE kind <> 0)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM rows),
ranked AS (
  SELECT *, substr(role, 1, 1) AS initial, COUNT(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM placed),
told AS (
  SELECT conv_id, turn, i, n, role, text, initial, CASE WHEN t = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM ranked),
faults AS (
  SELECT conv_id, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (WHERE fault = 'blank') AS blank, COUNT(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    COUNT(*) FILTER (WHERE fault = 'truncated') AS truncated, COUNT(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY conv_id),
dp AS (
  SELECT conv_id, MAX(n) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 'r': ''}} AS x0, {{'c': CAST(4 AS BIGINT), 'a': 'II', 'r': {_USER} || {_ASSISTANT}}} AS x1,
    {{'c': CAST(2 AS BIGINT), 'a': 'I', 'r': {_ASSISTANT}}} AS x2, {{'c': CAST(0 AS BIGINT), 'a': '', 'r': ''}} AS x3 FROM told GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, list_sort([b0, {_then("x2", "2", "I", _USER)}])[1], list_sort([b1, {_then("x2", "2", "I", _USER)}])[1], x2, x3 FROM (
    SELECT conv_id, i, b0, b1, list_sort([b2, {_then("b3", "2", "I", _ASSISTANT)}])[1] AS x2, list_sort([b3, {_then("b2", "2", "I", _USER)}])[1] AS x3 FROM (
      SELECT conv_id, i - 1 AS i, {", ".join(f"{_step(q)} AS b{q}" for q in range(4))} FROM (
        SELECT dp.*, told.text, told.initial, chr(10) || told.role || ':' || told.text AS line, told.fault IN ('blank', 'duplicate') AS must, CASE WHEN told.fault = 'truncated' THEN 1 ELSE 0 END AS late
        FROM dp JOIN told ON told.conv_id IS NOT DISTINCT FROM dp.conv_id AND told.i = dp.i)))),
best AS (SELECT conv_id, x0 FROM dp WHERE i = 0)
SELECT c.conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated, COALESCE(illegal, 0) AS illegal,
  COALESCE(x0.c, 0) AS cost, COALESCE(x0.a, '') AS audit, sha256(COALESCE(substr(x0.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_chat": OP6_SQL, "op7_jaccard_join": OP7_SQL, "op11_lexical_search": OP11_SQL, "op13_conversation_repair": OP13_SQL}
