"""Generated wording, prompts and query understanding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeworks import constants as K
from tomeworks.functions import rendering as R
from tomeworks.functions.intent import resolve_intent
from tomeworks.functions.text import clean_question, first_sentences, question_of
from tomeworks.operators import builders as B
from tomeworks.operators import retrieval
from tomeworks.operators import understanding as U
from tomeworks.operators.settle import settle
from tomeworks.plans import base as b
from tomeworks.plans.base import query, sql_rnd
from tomeworks.plans.builder_queries import FORMAT_SUBTYPE, S2, _block, _groups, sql_fill, user_message
from tomeworks.plans.chunk_queries import perturbed

def worded(chunks, kind="faithful", subtype="", where=None):
    """Requests from chunks, with stand-in wording: the question is the first sentence of the material,
    every third answer refuses or is missing."""
    asked = B.requests(chunks, kind, subtype, tries=None)
    asked = settle(asked if where is None else asked.where(where))
    return asked, stand_in(asked, "request_id")


def stand_in(asked, *carried):
    text = F.col("seeds")[0]["text"]
    n = F.length(text) % 3
    return asked.select(
        *carried, F.concat(F.lit("问题："), first_sentences(text, 1)).alias("question"),
        F.when(n == 0, "").when(n == 1, "It says so [1]").otherwise("无法回答").alias("answer"))


_ASKED = f"""asked AS (
  SELECT chunk_id, text AS seed, source, {b.sql_strip(b.sql_first_sentences('text', 1))} AS question,
         CASE length(text) % 3 WHEN 0 THEN '' WHEN 1 THEN 'It says so [1]' ELSE '无法回答' END AS answer
  FROM pool WHERE length(text) > 20),
q AS (SELECT chunk_id AS query_id, list_distinct(string_split(question, '')) AS chars FROM asked WHERE chunk_id % 20 = 0),
c AS (SELECT doc_id AS chunk_id, list_distinct(string_split(text, '')) AS chars FROM documents),
hits AS (
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY len(list_intersect(q.chars, c.chars)) DESC, chunk_id) AS rank
  FROM q, c QUALIFY rank <= 4),
found AS (
  SELECT a.chunk_id, max(CASE WHEN p.text = a.seed THEN 1 ELSE 0 END) = 1 AS hit, any_value(a.answer) AS answer,
         any_value(a.question) AS question, any_value(a.seed) AS seed, any_value(a.source) AS source,
         string_agg({_block("h.rank", "p.source", "p.text")}, chr(10) || chr(10) ORDER BY h.rank) AS shown
  FROM asked a JOIN hits h ON h.query_id = a.chunk_id JOIN pool p ON p.chunk_id = h.chunk_id GROUP BY a.chunk_id)"""


def generated(spark, sf_dir, kind):
    """Samples of one grounded type by searching with the generated question of every chunk whose id is
    divisible by 20, against all chunks; material that is not found makes a weak-recall refusal."""
    chunks = b.chunks(spark, sf_dir)
    asked, generations = worded(chunks.where("chunk_id % 20 = 0"), kind)
    return accepted(chunks, asked, generations, kind)


def accepted(chunks, asked, generations, kind):
    """Candidates from generated wording, searched for by the least chunk id of a request's material."""
    keys = settle(asked.select("request_id", F.array_min(F.transform("seeds", lambda c: c["chunk_id"])).cast("bigint").alias("query_id")))
    questions = generations.join(keys, "request_id").select("query_id", clean_question(F.col("question")).alias("query"))
    hits = retrieval.search_overlap(questions, chunks, 4)
    contexts = chunks.select("chunk_id", R.context_from_chunk().alias("ctx"))
    retrieved = retrieval.retrieved_contexts(hits, contexts).join(keys, "query_id").select("request_id", "contexts")
    done, missed = B.accept_grounded(asked, generations, retrieved, kind)
    return done.unionByName(B.accept_refusals(missed, generations, "weak_recall"))


def _generated_query(kind: str, subtype: str) -> None:
    @query(f"sft_generated_{kind}" if kind != "faithful" else "sft_generated", f"""WITH {S2}, {_ASKED}
SELECT '{kind}:' || chunk_id AS request_id, CASE WHEN hit THEN '{kind}' ELSE 'refuse' END AS type,
       CASE WHEN NOT hit THEN 'weak_recall' ELSE {subtype} END AS subtype,
       question, CASE WHEN hit THEN answer WHEN contains(answer, '无法回答') THEN answer ELSE '{K.S2_REFUSE_FALLBACK_A}' END AS answer,
       CAST(CASE WHEN hit THEN 4 ELSE 1 END AS INT) AS contexts
FROM (SELECT *, seed AS text FROM found) WHERE NOT hit OR answer <> ''""", headline=kind == "faithful")
    def run(spark, sf_dir):
        return generated(spark, sf_dir, kind).select(
            "request_id", "meta.type", "meta.subtype", question_of(R.turn(F.col("messages"), 1)).alias("question"),
            R.turn(F.col("messages"), 2).alias("answer"), F.size("meta.sources").alias("contexts"))


for _kind, _subtype in (("faithful", "NULL"), ("cite", "NULL"), ("format", FORMAT_SUBTYPE)):
    _generated_query(_kind, _subtype)


@query("sft_generated_multi_hop", f"""WITH {S2}, {_groups('multi_hop', 'pool', 'true')},
placed AS (
  SELECT g.key, (k.n - 1) % 3 + 1 AS n, p.chunk_id, p.text FROM multi_hop_groups g
  JOIN multi_hop_keyed k ON k.key = g.key JOIN pool p ON p.chunk_id = k.chunk_id WHERE (k.n - 1) % 3 < g.size),
asked AS (
  SELECT *, {b.sql_strip(b.sql_first_sentences('first', 1))} AS question,
         CASE length(first) % 3 WHEN 0 THEN '' WHEN 1 THEN 'It says so [1]' ELSE '无法回答' END AS answer
  FROM (SELECT key, min(chunk_id) AS query_id, list(text) AS seeds, arg_min(text, n) AS first FROM placed GROUP BY key) WHERE query_id % 20 = 0),
q AS (SELECT query_id, list_distinct(string_split(question, '')) AS chars FROM asked),
c AS (SELECT doc_id AS chunk_id, list_distinct(string_split(text, '')) AS chars FROM documents),
hits AS (
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY len(list_intersect(q.chars, c.chars)) DESC, chunk_id) AS rank
  FROM q, c QUALIFY rank <= 4),
found AS (
  SELECT a.key, bool_or(list_contains(a.seeds, p.text)) AS hit, any_value(a.question) AS question, any_value(a.answer) AS answer, any_value(len(a.seeds)) AS n
  FROM asked a JOIN hits h USING (query_id) JOIN pool p ON p.chunk_id = h.chunk_id WHERE a.question <> '' GROUP BY a.key)
SELECT 'multi_hop:' || key AS request_id, CASE WHEN hit THEN 'multi_hop' ELSE 'refuse' END AS type, CASE WHEN NOT hit THEN 'weak_recall' END AS subtype, question,
       CASE WHEN hit OR contains(answer, '无法回答') THEN answer ELSE '{K.S2_REFUSE_FALLBACK_A}' END AS answer, CAST(CASE WHEN hit THEN 4 ELSE n END AS INT) AS contexts
FROM found WHERE NOT hit OR answer <> ''""", headline=False)
def sft_generated_multi_hop(spark, sf_dir):
    """Questions over two or three chunks of one item, for the groups whose least chunk id is divisible by
    20, searched for among all chunks; bringing back any of the group's chunks counts as found."""
    chunks = b.chunks(spark, sf_dir)
    asked, generations = worded(chunks, "multi_hop", where=F.array_min(F.transform("seeds", lambda c: c["chunk_id"])) % 20 == 0)
    return accepted(chunks, asked, generations, "multi_hop").select(
        "request_id", "meta.type", "meta.subtype", question_of(R.turn(F.col("messages"), 1)).alias("question"),
        R.turn(F.col("messages"), 2).alias("answer"), F.size("meta.sources").alias("contexts"))


def refusals(spark, sf_dir):
    """Refusals of every kind from all material: they need no search."""
    asked = settle(B.requests_of_kinds(b.chunks(spark, sf_dir), [("refuse", subtype) for subtype in K.REFUSE_SUBTYPES], tries=None), codec="zstd")
    generations = settle(stand_in(asked, "request_id", "kind"))
    parts = []
    for subtype in K.REFUSE_SUBTYPES:
        own = F.col("kind") == subtype
        parts.append(B.accept_refusals(asked.where(own).drop("kind"), generations.where(own).drop("kind"), subtype))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_CHANGED = perturbed("seed", sql_rnd(42, "conflict-number", "'conflict:' || chunk_id"), "chunk_id, seed, source, answer", "numeric")
_REFUSALS = f"""numeric AS (SELECT * FROM asked WHERE regexp_matches(seed, '[0-9]')),
changed AS (SELECT chunk_id, old_value, new_value, new_text FROM ({_CHANGED})),
refused AS (
  SELECT k.subtype || ':' || chunk_id AS request_id, k.subtype, {user_message(_block("'1'", 'source', 'seed'), '')} || question AS usr,
         CASE WHEN contains(answer, '无法回答') THEN answer ELSE '{K.S2_REFUSE_FALLBACK_A}' END AS answer, false AS synthetic
  FROM asked, (SELECT unnest(['no_recall', 'weak_recall']) AS subtype) k
  UNION ALL
  SELECT 'conflict:' || chunk_id, 'conflict', CASE WHEN old_value <> new_value THEN {user_message(
      _block("'1'", 'source', 'seed') + " || chr(10) || chr(10) || " + _block("'2'", f"source || '{K.CONFLICT_SOURCE_SUFFIX}'", 'new_text'), K.S2_CONFLICT_Q)} END,
         CASE WHEN contains(answer, '无法回答') THEN answer ELSE {sql_fill(K.S2_CONFLICT_A, old='old_value', new='new_value')} END, true
  FROM numeric LEFT JOIN changed USING (chunk_id))"""


@query("sft_generated_refusals", f"WITH {S2}, {_ASKED}, {_REFUSALS} SELECT request_id, subtype, usr, answer, synthetic FROM refused WHERE usr IS NOT NULL", headline=False)
def sft_generated_refusals(spark, sf_dir):
    """Generated refusals of all three kinds; a conflict shows both versions."""
    return refusals(spark, sf_dir).where("messages IS NOT NULL").select(
        "request_id", "meta.subtype", R.turn(F.col("messages"), 1).alias("usr"), R.turn(F.col("messages"), 2).alias("answer"), "meta.synthetic")


NEEDS = {"cite": 40, "no_recall": 10, "conflict": 5, "weak_recall": 30}


@query("sft_generated_set", f"""WITH {S2}, {_ASKED}, {_REFUSALS},
candidates AS (
  SELECT 'cite:' || chunk_id AS request_id, CASE WHEN hit THEN 'cite' ELSE 'weak_recall' END AS kind, {sql_rnd(42, 'cite', 'chunk_id')} AS ord,
         {user_message("CASE WHEN hit THEN shown ELSE " + _block("'1'", 'source', 'seed') + " END", '')} || question AS usr,
         CASE WHEN hit THEN answer WHEN contains(answer, '无法回答') THEN answer ELSE '{K.S2_REFUSE_FALLBACK_A}' END AS answer
  FROM found WHERE NOT hit OR answer <> ''
  UNION ALL
  SELECT request_id, subtype, md5('42|' || subtype || '|' || split_part(request_id, ':', 2)), usr, answer FROM refused WHERE usr IS NOT NULL),
passed AS (SELECT *, md5(usr || '||' || usr) AS fp FROM candidates WHERE kind <> 'cite' OR NOT contains(answer, '无法回答')),
early AS (SELECT * FROM (SELECT * FROM passed WHERE kind <> 'weak_recall' QUALIFY row_number() OVER (PARTITION BY kind, fp ORDER BY ord) = 1)
          QUALIFY row_number() OVER (PARTITION BY kind ORDER BY ord) <= CASE kind {' '.join(f"WHEN '{k}' THEN {n}" for k, n in NEEDS.items())} END),
late AS (SELECT * FROM (SELECT * FROM passed WHERE kind = 'weak_recall' AND fp NOT IN (SELECT fp FROM early)
                        QUALIFY row_number() OVER (PARTITION BY fp ORDER BY ord) = 1) QUALIFY row_number() OVER (ORDER BY ord) <= {NEEDS['weak_recall']})
SELECT kind, request_id, usr, answer FROM (SELECT * FROM early UNION ALL SELECT * FROM late)""", headline=False)
def sft_generated_set(spark, sf_dir):
    """Generated citations and refusals through gate, de-duplication and needs."""
    built = B.finish_generated(generated(spark, sf_dir, "cite").unionByName(refusals(spark, sf_dir)), NEEDS).samples
    kind = F.when(F.col("meta.type") == "refuse", F.col("meta.subtype")).otherwise(F.col("meta.type"))
    return built.select(kind.alias("kind"), "request_id", R.turn(F.col("messages"), 1).alias("usr"), R.turn(F.col("messages"), 2).alias("answer"))


_TEMPLATE = "Material:\n{context}\n\nItems: {items}\nIntent: {intent}\nQuestion: {question}"


@query("answer_prompts", f"""WITH {b.PAIRS}
SELECT conv_id, turn, 'Material:' || chr(10) || coalesce(array_to_string(list_transform(lines, lambda x, i: '[' || i || '] ' || x), chr(10)), '')
       || chr(10) || chr(10) || 'Items: conv ' || conv_id || chr(10) || 'Intent: ' || {b.sql_intent('question', b.DATA_INTENTS)}
       || chr(10) || 'Question: ' || question AS prompt FROM pairs""")
def answer_prompts(spark, sf_dir):
    p = b.turn_pairs(spark, sf_dir)
    context = R.numbered_texts(F.transform("lines", lambda line: F.struct(line.alias("text"))))
    return p.select("conv_id", "turn", R.render_prompt(
        _TEMPLATE, context=context, items=F.concat(F.lit("conv "), F.col("conv_id").cast("string")),
        intent=resolve_intent(F.lit(None).cast("string"), F.col("question"), b.DATA_INTENTS), question=F.col("question")).alias("prompt"))


@query("query_understanding", f"""WITH {b.PAIRS}, u AS (
  SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN '' ELSE 'item ' || conv_id END AS items,
         CASE WHEN turn % 3 = 2 THEN question ELSE 'about item ' || conv_id END AS rewritten_query,
         CASE WHEN turn % 3 = 0 THEN 'parameter' ELSE {b.sql_intent("CASE WHEN turn % 3 = 2 THEN question ELSE 'about item ' || conv_id END", b.DATA_INTENTS)} END AS intent_type
  FROM pairs)
SELECT *, CASE intent_type {' '.join(f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in U.STRATEGIES.items())} END AS strategy FROM u""")
def query_understanding(spark, sf_dir):
    p = b.turn_pairs(spark, sf_dir)
    turn, conv = F.col("turn") % 3, F.col("conv_id").cast("string")
    output = F.when(turn == 2, "not json").otherwise(F.concat(
        F.lit('Sure: {"candidate_items": ["item '), conv, F.lit('", "item '), conv, F.lit('"], "rewritten_query": "about item '), conv,
        F.lit('", "intent_type": "'), F.when(turn == 0, "Parameter").otherwise("nonsense"), F.lit('"}')))
    parsed = U.parse_query_understanding(
        p.select("conv_id", "turn", F.col("question").alias("query"), output.alias("output")), b.DATA_INTENTS)
    return parsed.select(
        "conv_id", "turn", F.array_join("candidate_items", ",").alias("items"), "rewritten_query", "intent_type",
        F.array_join(U.retrieval_strategy(F.col("intent_type")), ",").alias("strategy"))


@query("query_metrics", """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
hits AS (SELECT a.vec_id, a.label, c.label AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, c.e), 6) DESC, c.vec_id) AS rank
         FROM v a, v c WHERE a.vec_id % 20 = 0),
r AS (SELECT vec_id, any_value(label) AS label, max(CASE WHEN rank = 2 THEN other END) AS second,
             max(CASE WHEN rank BETWEEN 2 AND 6 AND other = label THEN 1 ELSE 0 END) AS hit FROM hits WHERE rank <= 6 GROUP BY vec_id)
SELECT round(avg(CAST(second % 3 = label % 3 AS DOUBLE)), 9) AS intent_accuracy, round(avg(CAST(second = label AS DOUBLE)), 9) AS item_match_accuracy,
       round(avg(CASE WHEN second % 2 = 0 THEN CAST(label % 2 = 0 AS DOUBLE) END), 9) AS clarification_precision,
       round(avg(CAST(hit AS DOUBLE)), 9) AS retrieval_hit_rate,
       round(avg(CASE WHEN label % 3 = 0 THEN CAST(second % 3 = 0 AS DOUBLE) END), 9) AS image_request_hit_image_context FROM r""")
def query_metrics(spark, sf_dir):
    e = b.table(spark, sf_dir, "embeddings")
    hits = retrieval.search_dense(
        e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("dense_vector")),
        e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("dense_vector")), 6)
    found = hits.join(e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("other")), "chunk_id")
    rows = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "other"))).alias("h"))
    own = e.select(F.col("vec_id").alias("query_id"), "label").join(rows, "query_id")
    second = F.col("h")[1]["other"]
    kind = F.when
    labelled = own.select(
        kind(second % 3 == 0, "image_request").when(second % 3 == 1, "parameter").otherwise("general").alias("intent"),
        kind(F.col("label") % 3 == 0, "image_request").when(F.col("label") % 3 == 1, "parameter").otherwise("general").alias("gold_intent"),
        second.cast("string").alias("item"), F.col("label").cast("string").alias("gold_item"),
        (second % 2 == 0).alias("need_clarification"), (F.col("label") % 2 == 0).alias("gold_clarification"),
        F.slice(F.transform("h", lambda r: r["other"]), 2, 5).alias("retrieved"), F.array("label").alias("relevant"),
        (second % 3 == 0).alias("has_image_context"))
    m = U.query_metrics(labelled, 5)
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])
