"""Registry of queries and shared input views.

A view exists twice: as a DataFrame over the given tables and as a common table expression
with the same rows, so that every statement can be checked against the DataFrame query.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeworks import constants as K
from tomeworks.functions.intent import IntentWords

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
STATEMENTS: dict[str, str] = {}
HEADLINE: list[str] = []


def query(name: str, sql: str | None = None, headline: bool = True) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            STATEMENTS[name] = sql
        if headline:
            HEADLINE.append(name)
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# --- SQL text helpers -------------------------------------------------------------------

def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_strip(expr: str) -> str:
    return f"trim({expr}, {quote(K.WHITESPACE)})"


def sql_any(expr: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {quote(w)})" for w in words) + ")"


def sql_set(expr: str, pattern: str, group: int = 0) -> str:
    """Sorted distinct matches."""
    return f"list_sort(list_distinct(regexp_extract_all({expr}, {quote(pattern)}, {group})))"


def sql_hash(expr: str) -> str:
    return f"('sha256:' || sha256({expr}))"


def sql_rnd(seed: int, purpose: str, expr: str) -> str:
    return f"md5({quote(f'{seed}|{purpose}|')} || CAST({expr} AS VARCHAR))"


def sql_first_sentences(expr: str, n: int) -> str:
    piece = "[^。!?\n]*[。!?\n]"
    whole = sql_strip(expr)
    return sql_strip(
        f"CASE WHEN regexp_matches({whole}, {quote(f'^({piece}){{{n}}}')}) "
        f"THEN regexp_extract({whole}, {quote(f'^({piece}){{{n}}}')}, 0) ELSE {whole} END"
    )


def sql_clean(expr: str) -> str:
    out = f"regexp_replace({expr}, {quote(r'!\[[^\]]*\]\([^)]*\)')}, '', 'g')"
    out = f"regexp_replace({out}, {quote(r'https?://\S+')}, '', 'g')"
    out = f"regexp_replace({out}, {quote('[ ' + chr(9) + ']*' + chr(10) + '{3,}[ ' + chr(9) + ']*')}, {quote(chr(10) * 2)}, 'g')"
    return sql_strip(out)


def sql_intent(expr: str, words: IntentWords) -> str:
    text = f"lower({sql_strip(expr)})"
    cases = " ".join(f"WHEN {sql_any(text, kw)} THEN {quote(name)}" for name, kw in words)
    return f"(CASE WHEN {text} = '' THEN 'general' {cases} ELSE 'general' END)"


# --- Word lists for the test tables, whose text is invented Latin-script prose -------------

DATA_CUES = ("nicht", "pas ", "only")
DATA_CONFLICT_CUES = ("pas", "und", "con")
DATA_INTENTS: IntentWords = (
    ("image_request", ("bild", "eauque")),
    ("troubleshooting", ("nicht", "pas ")),
    ("install_config", ("with by", "zu die")),
    ("parameter", ("ción",)),
    ("comparison", ("oder", "ther")),
    ("after_sales", ("menta",)),
    ("operation", ("the", "que")),
)


# --- Views --------------------------------------------------------------------------------

def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a chunk table; Spanish ones carry no item name."""
    d = documents(spark, sf_dir)
    return d.select(
        F.col("doc_id").alias("chunk_id"),
        F.col("text").alias("content"),
        F.regexp_extract("text", "^[A-Za-z]+", 0).alias("title"),
        F.col("lang").alias("parent_title"),
        F.col("source").alias("file_title"),
        F.when(F.col("lang") == "es", "").otherwise(F.concat_ws("-", "source", "lang")).alias("item_name"),
    )


CHUNKS = """chunks AS (
  SELECT doc_id AS chunk_id, text AS content, regexp_extract(text, '^[A-Za-z]+') AS title,
         lang AS parent_title, source AS file_title,
         CASE WHEN lang = 'es' THEN '' ELSE source || '-' || lang END AS item_name
  FROM documents)"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answer traces."""
    e = table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("bigint"))
    kind = F.col("event_type")
    return e.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"),
        F.concat(F.lit("task-"), F.col("event_id").cast("string")).alias("task_id"),
        F.when(kind.isin("purchase", "signup"), "sft").otherwise("base").alias("provider"),
        F.concat(F.lit("model-"), kind).alias("model_name"),
        F.round(F.col("value") * 300).cast("bigint").alias("latency_ms"),
        F.concat(F.lit("q"), F.concat_ws("-", F.col("user_id").cast("string"), kind)).alias("query_hash"),
        F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("answer_hash"),
        F.col("k").alias("answer_chars"),
        (F.col("k") * 100).alias("prompt_chars"),
        (F.col("k") % 4).alias("context_count"),
        F.when(kind == "view", F.array().cast("array<string>")).otherwise(
            F.array((F.col("k") % 3).cast("string"))).alias("used_citations"),
        (kind == "signup").alias("is_refusal"),
        F.lit(None).cast("boolean").alias("has_answer"),
        F.when((kind == "error") & (F.col("k") < 20), "timeout").otherwise(" ").alias("error"),
    )


TRACES = """traces AS (
  SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, 'task-' || event_id AS task_id,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'sft' ELSE 'base' END AS provider,
         'model-' || event_type AS model_name, CAST(round(value * 300) AS BIGINT) AS latency_ms,
         'q' || user_id || '-' || event_type AS query_hash, 'a' || event_id AS answer_hash,
         k AS answer_chars, k * 100 AS prompt_chars, k % 4 AS context_count,
         CASE WHEN event_type = 'view' THEN '' ELSE CAST(k % 3 AS VARCHAR) END AS used_citations,
         event_type = 'signup' AS is_refusal,
         CASE WHEN event_type = 'error' AND k < 20 THEN 'timeout' ELSE ' ' END AS error
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events))"""


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn that follows."""
    c = table(spark, sf_dir, "conversations")
    user = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    reply = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply")
    )
    return user.join(reply, ["conv_id", "turn"]).withColumn(
        "lines", F.filter(F.split("question", "\n"), lambda line: F.length(line) > 40)
    )


PAIRS = """pairs AS (
  SELECT u.conv_id, u.turn, u.text AS question, a.text AS reply,
         list_filter(string_split(u.text, chr(10)), lambda x: length(x) > 40) AS lines
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as stage-1 samples, with the faults real sets have: types outside the
    list, missing citations, citations out of range, answers that refuse or fail to."""
    p = turn_pairs(spark, sf_dir)
    turn = F.col("turn")
    kind = (
        F.when(turn == 0, "answerable").when(turn == 1, "multi_chunk").when(turn == 2, "unanswerable")
        .when(turn == 3, "conflicting").when(turn == 4, "answerable").otherwise("other")
    )
    marks = F.when(F.length("reply") % 3 == 0, " [C1]").when(F.length("reply") % 3 == 1, " [C1] [C3]").otherwise(" 1999")
    return p.select(
        F.concat_ws("-", F.lit("s"), F.col("conv_id").cast("string"), turn.cast("string")).alias("id"),
        kind.alias("type"),
        "question",
        F.concat("reply", marks).alias("answer"),
        F.transform("lines", lambda line, i: F.struct(
            F.concat(F.lit("C"), (i + 1).cast("string")).alias("cid"),
            F.concat(F.lit("conv "), F.col("conv_id").cast("string")).alias("source"), line.alias("text"))).alias("contexts"),
        F.struct(F.lit("").alias("item_name"), F.array("conv_id").alias("source_chunk_ids"), F.lit(True).alias("synthetic")).alias("meta"),
        F.when(F.substring(F.md5(F.col("conv_id").cast("string")), 1, 1) < "4", "holdout").otherwise("train").alias("split"),
        (F.col("conv_id") * 100 + turn).alias("pos"),
    )


SAMPLES = f"""{PAIRS},
samples AS (
  SELECT 's-' || conv_id || '-' || turn AS id, conv_id,
         CASE turn WHEN 0 THEN 'answerable' WHEN 1 THEN 'multi_chunk' WHEN 2 THEN 'unanswerable'
                   WHEN 3 THEN 'conflicting' WHEN 4 THEN 'answerable' ELSE 'other' END AS type,
         question,
         reply || CASE WHEN length(reply) % 3 = 0 THEN ' [C1]' WHEN length(reply) % 3 = 1 THEN ' [C1] [C3]' ELSE ' 1999' END AS answer,
         lines AS texts, 'conv ' || conv_id AS source,
         CASE WHEN substr(md5(CAST(conv_id AS VARCHAR)), 1, 1) < '4' THEN 'holdout' ELSE 'train' END AS split,
         conv_id * 100 + turn AS pos
  FROM pairs)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same turns in messages form."""
    from tomeworks.functions import rendering as R

    s = samples(spark, sf_dir)
    turn = F.col("pos") % 100
    kind = (
        F.when(turn == 0, "faithful").when(turn == 1, "multi_hop").when(turn == 2, "cite").when(turn == 3, "refuse")
        .when(turn == 4, "format").otherwise("refuse")
    )
    subtype = F.when(turn == 3, "no_recall").when(turn == 5, "weak_recall")
    user = R.user_message(R.render_contexts_n(F.col("contexts")), F.col("question"))
    answer = F.regexp_replace("answer", r"\[C", "[")
    return s.select(
        F.when(turn == 4, F.slice(R.messages("S", user, answer), 2, 2)).otherwise(R.messages("S", user, answer)).alias("messages"),
        F.struct(
            kind.alias("type"), subtype.alias("subtype"), F.col("id").alias("id"),
            F.when(turn == 2, F.array().cast("array<string>")).otherwise(F.array(kind)).alias("battle_capabilities"),
        ).alias("meta"),
        "split", "pos",
    )


MESSAGES = f"""{SAMPLES},
messages AS (
  SELECT id, split, pos, pos % 100 AS turn,
         CASE pos % 100 WHEN 0 THEN 'faithful' WHEN 1 THEN 'multi_hop' WHEN 2 THEN 'cite' WHEN 3 THEN 'refuse'
                        WHEN 4 THEN 'format' ELSE 'refuse' END AS type,
         CASE pos % 100 WHEN 3 THEN 'no_recall' WHEN 5 THEN 'weak_recall' END AS subtype,
         '{K.CONTEXT_SECTION}' || chr(10) ||
         coalesce(array_to_string(list_transform(texts, lambda x, i: '[' || i || '] {K.SOURCE_LABEL}' || source || chr(10) || x), chr(10) || chr(10)), '')
         || chr(10) || chr(10) || '{K.QUESTION_SECTION}' || chr(10) || question AS usr,
         replace(answer, '[C', '[') AS answer, question
  FROM samples)"""
