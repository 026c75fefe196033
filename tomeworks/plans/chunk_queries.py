"""Chunk tables and text columns over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeworks import constants as K
from tomeworks.functions import rendering as R
from tomeworks.functions import text as X
from tomeworks.functions.ordering import rnd
from tomeworks.operators import documents as D
from tomeworks.plans import base as b
from tomeworks.plans.base import query, quote
from tomeworks.sources import tables as S

_KEY = "CASE WHEN item_name <> '' THEN item_name WHEN file_title <> '' THEN file_title ELSE 'UNKNOWN' END"


@query("chunk_export", f"""WITH {b.CHUNKS}
SELECT * FROM chunks WHERE {b.sql_strip('content')} <> ''""")
def chunk_export(spark, sf_dir):
    return S.export_chunks(b.chunks(spark, sf_dir))[0]


@query("chunk_stats", f"""WITH {b.CHUNKS}
SELECT count(*) FILTER (WHERE kept) AS total_exported, count(*) FILTER (WHERE NOT kept) AS empty_content_skipped,
       count(DISTINCT CASE WHEN kept THEN {_KEY} END) AS distinct_items,
       count(DISTINCT CASE WHEN kept THEN {_KEY} END) >= 2 AS enough_items
FROM (SELECT *, {b.sql_strip('content')} <> '' AS kept FROM chunks)""")
def chunk_stats(spark, sf_dir):
    return S.export_chunks(b.chunks(spark, sf_dir))[1]


@query("chunk_scan", "SELECT doc_id AS chunk_id, text AS content, source AS file_title FROM documents "
                     "WHERE lang = 'de' AND n_chars > 500")
def chunk_scan(spark, sf_dir):
    fields = {"chunk_id": "doc_id", "content": "text", "file_title": "source"}
    return S.load_chunks(spark, f"{sf_dir}/documents.parquet", fields, "lang = 'de' AND n_chars > 500")


@query("clean_content", f"SELECT doc_id, {b.sql_clean('text')} AS cleaned, "
                        f"length({b.sql_clean('text')}) > 20 AS usable FROM documents")
def clean_content(spark, sf_dir):
    clean = X.clean_content(F.col("text"))
    return b.table(spark, sf_dir, "documents").select(
        "doc_id", clean.alias("cleaned"), (F.length(clean) > 20).alias("usable"))


@query("first_sentences", f"SELECT doc_id, {b.sql_first_sentences('text', 1)} AS one, "
                          f"{b.sql_first_sentences('text', 2)} AS two FROM documents")
def first_sentences(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select(
        "doc_id", X.first_sentences(F.col("text"), 1).alias("one"), X.first_sentences(F.col("text"), 2).alias("two"))


@query("numbers_and_citations", f"""
SELECT doc_id, array_to_string({b.sql_set('text', '[0-9]+(?:[.][0-9]+)?')}, ',') AS numbers,
       array_to_string({b.sql_set('marked', '[[](C[0-9]+)[]]', 1)}, ',') AS by_letter,
       array_to_string({b.sql_set('marked', '[[]([0-9]+)[]]', 1)}, ',') AS by_number,
       array_to_string({b.sql_set('marked', '[[](?:C)?([0-9]+)[]]', 1)}, ',') AS either,
       array_to_string({b.sql_set('marked', '(?m)^[[]([0-9]+)[]]', 1)}, ',') AS offered
FROM (SELECT doc_id, text, '[' || n_chars || '] ' || text || ' [C' || (n_chars % 7) || ']' || chr(10)
             || '[' || (n_chars % 5) || '] [C10]' AS marked FROM documents)""")
def numbers_and_citations(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents")

    def n(mod=None):
        return (F.col("n_chars") if mod is None else F.col("n_chars") % mod).cast("string")

    marked = d.withColumn("marked", F.concat(
        F.lit("["), n(), F.lit("] "), "text", F.lit(" [C"), n(7), F.lit("]\n["), n(5), F.lit("] [C10]")))
    columns = {
        "numbers": X.numbers_in(F.col("text")), "by_letter": X.citations_c(F.col("marked")),
        "by_number": X.citations_n(F.col("marked")), "either": X.citations_any(F.col("marked")),
        "offered": X.available_citations(F.col("marked")),
    }
    return marked.select("doc_id", *[F.array_join(c, ",").alias(name) for name, c in columns.items()])


@query("text_fingerprint", """
SELECT doc_id, md5(lang || '||' || array_to_string(list_sort(string_split(text, chr(10))), '||')) AS fp FROM documents""")
def text_fingerprint(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select(
        "doc_id", X.fingerprint(F.col("lang"), F.split("text", "\n", -1)).alias("fp"))


_NUM = quote("[0-9]+(?:[.][0-9]+)?")


def perturbed(text: str, pick: str, keep: str, source: str) -> str:
    """SQL of the number change over ``source``: adds ``old_value, new_value, new_text``."""
    return f"""
  SELECT *, array_to_string(list_transform(range(1, len(pieces) + 1), lambda i: pieces[i] ||
           CASE WHEN i = k THEN new_value WHEN i <= len(nums) THEN nums[i] ELSE '' END), '') AS new_text
  FROM (SELECT *, CASE WHEN contains(old_value, '.') THEN printf('%.1f', changed)
                       ELSE CAST(CAST(changed AS BIGINT) AS VARCHAR) END AS new_value
  FROM (SELECT *, CASE WHEN v < 10 THEN v * 2 ELSE v + greatest(1, round_even(v * 0.5, 0)) END AS changed
  FROM (SELECT *, nums[k] AS old_value, CAST(nums[k] AS DOUBLE) AS v
  FROM (SELECT *, pool[CAST(('0x' || substr({pick}, 1, 8)) AS BIGINT) % len(pool) + 1] AS k
  FROM (SELECT *, CASE WHEN len(long_at) > 0 THEN long_at ELSE any_at END AS pool
  FROM (SELECT *, list_filter(range(1, len(nums) + 1), lambda i: length(nums[i]) BETWEEN 2 AND 6) AS long_at,
                  list_filter(range(1, len(nums) + 1), lambda i: length(nums[i]) BETWEEN 1 AND 6) AS any_at
  FROM (SELECT {keep}, regexp_extract_all({text}, {_NUM}) AS nums, regexp_split_to_array({text}, {_NUM}) AS pieces
        FROM {source})) ) WHERE len(pool) > 0))))"""


@query("perturb_number", f"""SELECT doc_id, old_value, new_value, new_text FROM (
{perturbed('text', b.sql_rnd(7, 'number', 'doc_id'), 'doc_id', 'documents')})""")
def perturb_number(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents").withColumn(
        "p", X.perturb_number(F.col("text"), rnd(7, "number", F.col("doc_id"))))
    return d.where(F.col("p").isNotNull()).select(
        "doc_id", F.col("p.old").alias("old_value"), F.col("p.new").alias("new_value"), F.col("p.text").alias("new_text"))


@query("sources_and_keys", f"""WITH {b.CHUNKS}
SELECT chunk_id, {_KEY} AS item,
       coalesce(nullif(trim(file_title || ' / ' || coalesce(nullif(title, ''), parent_title), ' /'), ''), '未知来源') AS source1,
       coalesce(nullif(trim(file_title || ' / ' || coalesce(nullif(title, ''), parent_title), ' /'), ''),
                nullif(item_name, ''), '未知来源') AS source2 FROM chunks""", headline=False)
def sources_and_keys(spark, sf_dir):
    return b.chunks(spark, sf_dir).select(
        "chunk_id", R.item_key().alias("item"), R.source_stage1().alias("source1"), R.source_stage2().alias("source2"))


@query("redaction", f"""SELECT doc_id, {b.sql_hash('text')} AS text_hash,
  CASE WHEN length(text) <= 120 THEN text ELSE substr(text, 1, 120) || '...[truncated]' END AS preview FROM documents""",
       headline=False)
def redaction(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select(
        "doc_id", X.hash_text(F.col("text")).alias("text_hash"), X.truncate(F.col("text"), 120).alias("preview"))


_OUT = ("'```json' || chr(10) || '{\"question\": \"' || lang || '\", \"answer\": \"' || n_chars || '\"}' || chr(10) || '```'")


@query("model_json", f"""
SELECT doc_id, CASE WHEN lang <> 'es' THEN lang END AS question, CASE WHEN lang <> 'es' THEN CAST(n_chars AS VARCHAR) END AS answer
FROM documents""", headline=False)
def model_json(spark, sf_dir):
    """Stored generations in fences or among prose; the Spanish ones are broken JSON."""
    d = b.table(spark, sf_dir, "documents")
    body = F.concat(F.lit('{"question": "'), "lang", F.lit('", "answer": "'), F.col("n_chars").cast("string"), F.lit('"}'))
    raw = (
        F.when(F.col("lang") == "es", F.concat(F.lit("{broken "), body))
        .when(F.col("lang") == "de", F.concat(F.lit("Here it is: "), body, F.lit(" as asked")))
        .otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    )
    return d.select("doc_id", X.parse_model_json(raw, "question string, answer string").alias("j")).select(
        "doc_id", "j.question", "j.answer")


@query("item_name_requests", f"""WITH ranked AS (
  SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
SELECT source AS doc_id, source AS file_title,
       string_agg('【切片]】 - f' || (n - 1) || ' - ' || text, chr(10) ORDER BY n) AS context
FROM ranked WHERE n <= 3 GROUP BY source""")
def item_name_requests(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents").select(
        F.col("source").alias("doc_id"), F.col("source").alias("file_title"), F.col("doc_id").alias("pos"),
        F.col("text").alias("content"))
    return D.item_name_requests(d, 3)


@query("item_names", """WITH answers AS (
  SELECT source, CASE WHEN min(doc_id) % 3 = 0 THEN 'UNKNOWN' WHEN min(doc_id) % 3 = 1 THEN '' ELSE 'item of ' || source END AS answer
  FROM documents WHERE lang = 'de' GROUP BY source)
SELECT doc_id AS pos, d.source AS doc_id,
       coalesce(nullif(nullif(answer, ''), 'UNKNOWN'), d.source) AS item_name
FROM documents d LEFT JOIN answers a ON a.source = d.source""")
def item_names(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents")
    first = F.min("doc_id") % 3
    answers = d.where("lang = 'de'").groupBy(F.col("source").alias("doc_id")).agg(
        F.when(first == 0, K.UNKNOWN_ITEM).when(first == 1, "").otherwise(
            F.concat(F.lit("item of "), F.first("source"))).alias("item_name"))
    chunks = d.select(F.col("source").alias("doc_id"), F.col("source").alias("file_title"), F.col("doc_id").alias("pos"))
    return D.resolve_item_names(chunks, answers).select("pos", "doc_id", "item_name")


@query("chunk_load", """
SELECT d.doc_id, CASE WHEN e.embedding IS NULL THEN 'no dense vector' WHEN terms = 0 THEN 'no sparse vector' END AS reason,
       CASE WHEN e.embedding IS NOT NULL AND terms > 0 THEN 1 END AS sharing_id
FROM (SELECT *, len(regexp_extract_all(text, '[a-z]+')) AS terms FROM documents) d
LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def chunk_load(spark, sf_dir):
    """Both outcomes of a load: rows with an id, and how many rows share it, rejects with their reason.
    Title and position recur in many documents."""
    d = b.table(spark, sf_dir, "documents")
    e = b.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dense_vector"))
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)))
    sparse = F.map_from_arrays(F.sequence(F.lit(1), F.size(words)), F.transform(words, lambda w: F.lit(1.0)))
    rows = d.join(e, "doc_id", "left").select(
        "doc_id", F.col("source").alias("file_title"), (F.col("doc_id") % 3).alias("pos"), "dense_vector",
        F.when(F.size(words) > 0, sparse).alias("sparse_vector"))
    kept, rejects = S.load_chunk_table(rows, 64)
    shared = kept.groupBy("chunk_id").agg(F.count("*").alias("sharing_id"), F.min("doc_id").alias("doc_id"))
    return shared.select("doc_id", F.lit(None).cast("string").alias("reason"), "sharing_id").unionByName(
        rejects.select("doc_id", "reason", F.lit(None).cast("bigint").alias("sharing_id")))


@query("item_name_table", "SELECT DISTINCT source AS file_title, lang AS item_name FROM documents", headline=False)
def item_name_table(spark, sf_dir):
    return S.distinct_item_names(b.table(spark, sf_dir, "documents").select(
        F.col("source").alias("file_title"), F.col("lang").alias("item_name")))


@query("source_fallback", """SELECT doc_id AS chunk_id,
  coalesce(nullif(trim(CASE WHEN lang = 'fr' THEN 'from ' || source ELSE source END || ' / ' || lang, ' /'), ''), '未知来源') AS source FROM documents""", headline=False)
def source_fallback(spark, sf_dir):
    """Chunks without a file title are named by their source."""
    d = b.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.when(F.col("lang") == "fr", "").otherwise(F.col("source")).alias("file_title"),
        F.concat(F.lit("from "), "source").alias("source"), F.col("lang").alias("title"), F.lit("").alias("parent_title"), F.lit("").alias("item_name"))
    return d.select("chunk_id", R.source_stage2(F.col("source")).alias("source"))


@query("generated_questions", f"SELECT conv_id, turn, {b.sql_strip('text')} AS question FROM conversations", headline=False)
def generated_questions(spark, sf_dir):
    """Questions with the labels that models put before them."""
    c = b.table(spark, sf_dir, "conversations")
    label = F.when(F.col("turn") % 3 == 0, "问题：").when(F.col("turn") % 3 == 1, " 问题: ").otherwise("")
    return c.select("conv_id", "turn", X.clean_question(F.concat(label, "text")).alias("question"))


@query("online_refusals", f"""SELECT conv_id, turn, {b.sql_any("text || ' ' || cue", K.TRACE_REFUSAL_CUES)} AS is_refusal FROM (
  SELECT *, [{', '.join(quote(c) for c in [*K.TRACE_REFUSAL_CUES, ''])}][1 + (conv_id + turn) % {len(K.TRACE_REFUSAL_CUES) + 1}] AS cue FROM conversations)""", headline=False)
def online_refusals(spark, sf_dir):
    """The built-in list of refusals in answers, each word of it and none."""
    c = b.table(spark, sf_dir, "conversations")
    cues = F.array(*[F.lit(x) for x in [*K.TRACE_REFUSAL_CUES, ""]])
    cue = F.get(cues, ((F.col("conv_id") + F.col("turn")) % (len(K.TRACE_REFUSAL_CUES) + 1)).cast("int"))
    return c.select("conv_id", "turn", X.is_refusal(F.concat_ws(" ", "text", cue), K.TRACE_REFUSAL_CUES).alias("is_refusal"))
