"""Sample sets built from the documents."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tomeworks import constants as K
from tomeworks.functions import rendering as R
from tomeworks.operators import builders as B
from tomeworks.plans import base as b
from tomeworks.plans.base import query, quote, sql_rnd
from tomeworks.plans.chunk_queries import perturbed

TOTAL1 = 1200
TOTAL2 = 600
_PLAN1 = {kind: n for kind, _, n in B.plan_targets(TOTAL1, K.STAGE1_RATIOS)}
_PLAN2 = B.plan_targets(TOTAL2, K.STAGE2_RATIOS, K.REFUSE_SUBTYPES)


def sql_fill(template: str, **values: str) -> str:
    parts = [p for p in re.split(r"(\{\w+\})", template) if p]
    return " || ".join(values[p[1:-1]] if re.fullmatch(r"\{\w+\}", p) else quote(p) for p in parts)


def _pick(seed_expr: str, modulus: str) -> str:
    return f"CAST(('0x' || substr({seed_expr}, 1, 8)) AS BIGINT) % {modulus}"


def _groups(kind: str, source: str, limit: str) -> str:
    """CTEs ``{kind}_rows(request_id, ord, item, place, chunk_id)``: two or three chunks per group."""
    return f"""{kind}_ranked AS (
  SELECT item, chunk_id, row_number() OVER (PARTITION BY item ORDER BY {sql_rnd(42, kind + '-chunk', 'chunk_id')}) AS n FROM {source}),
{kind}_keyed AS (SELECT *, item || '#' || ((n - 1) // 3) AS key FROM {kind}_ranked WHERE {limit}),
{kind}_groups AS (
  SELECT key, item, {_pick(sql_rnd(42, kind + '-size', 'key'), '2')} + 2 AS size, {sql_rnd(42, kind, 'key')} AS ord
  FROM {kind}_keyed GROUP BY key, item HAVING count(*) >= 2)"""


S1 = f"""{b.CHUNKS},
pool AS (
  SELECT *, CASE WHEN item_name <> '' THEN item_name WHEN file_title <> '' THEN file_title ELSE 'UNKNOWN' END AS item,
         length(content) > 30 AS fits, coalesce(nullif(item_name, ''), nullif(file_title, ''), '') AS topic,
         nullif(title, '') AS head,
         coalesce(nullif(trim(file_title || ' / ' || coalesce(nullif(title, ''), parent_title), ' /'), ''), '未知来源') AS source
  FROM chunks)"""

ANSWERABLE = f"""answerable AS (
  SELECT 'answerable:' || chunk_id AS request_id, 'answerable' AS type,
         {sql_fill(K.S1_ANSWERABLE_Q, topic='topic', title=f"coalesce(head, {quote(K.S1_ANSWERABLE_TITLE)})")} AS question,
         {sql_fill(K.S1_ANSWERABLE_A, text=b.sql_first_sentences('content', 2))} AS answer,
         ['C1'] AS cids, [source] AS sources, [content] AS texts, item_name, [chunk_id] AS ids
  FROM pool WHERE fits ORDER BY {sql_rnd(42, 'answerable', 'chunk_id')} LIMIT {_PLAN1['answerable']})"""

MULTI = f"""fitting AS (SELECT * FROM pool WHERE fits),
{_groups('multi_chunk', 'fitting', 'n <= 3')},
chosen AS (SELECT * FROM multi_chunk_groups ORDER BY ord LIMIT {_PLAN1['multi_chunk']}),
placed AS (
  SELECT g.key, g.item, k.n, p.chunk_id, p.source, p.content
  FROM chosen g JOIN multi_chunk_keyed k ON k.key = g.key JOIN pool p ON p.chunk_id = k.chunk_id WHERE k.n <= g.size),
multi_chunk AS (
  SELECT 'multi_chunk:' || key AS request_id, 'multi_chunk' AS type, {sql_fill(K.S1_MULTI_Q, item='item')} AS question,
         string_agg({b.sql_first_sentences('content', 1)} || ' [C' || n || ']。', ' ' ORDER BY n) AS answer,
         list('C' || n ORDER BY n) AS cids, list(source ORDER BY n) AS sources, list(content ORDER BY n) AS texts,
         item AS item_name, list(chunk_id ORDER BY n) AS ids
  FROM placed GROUP BY key, item)"""


def ring(purpose: str, source: str) -> str:
    return f"""ranked_items AS (
  SELECT item, row_number() OVER (ORDER BY {sql_rnd(42, purpose, 'item')}) - 1 AS at, count(*) OVER () AS n
  FROM (SELECT DISTINCT item FROM {source})),
ring AS (
  SELECT a.item, o.item AS other FROM ranked_items a
  JOIN ranked_items o ON o.at = (a.at + 1 + {_pick(sql_rnd(42, purpose + '-step', 'a.item'), 'greatest(a.n - 1, 1)')}) % a.n
  WHERE a.item <> o.item)"""


UNANSWERABLE = f"""{ring('items', 'pool')},
shown AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY item ORDER BY fits DESC, {sql_rnd(42, 'unanswerable-chunk', 'chunk_id')}) = 1),
unanswerable AS (
  SELECT 'unanswerable:' || r.item AS request_id, 'unanswerable' AS type, {sql_fill(K.S1_UNANSWERABLE_Q, item='r.item')} AS question,
         {sql_fill(K.S1_UNANSWERABLE_A, other='r.other', item='r.item')} AS answer,
         ['C1'] AS cids, [s.source] AS sources, [s.content] AS texts, r.item AS item_name, [s.chunk_id] AS ids
  FROM ring r JOIN shown s ON s.item = r.other ORDER BY {sql_rnd(42, 'unanswerable', 'r.item')} LIMIT {_PLAN1['unanswerable']})"""

_CHANGED = perturbed("content", sql_rnd(42, "conflicting-number", "chunk_id"),
                     "chunk_id, content, topic, head, source, item_name", "pool")
CONFLICTING = f"""conflicting AS (
  SELECT 'conflicting:' || chunk_id AS request_id, 'conflicting' AS type,
         {sql_fill(K.S1_CONFLICT_Q, topic='topic', title=f"coalesce(head, {quote(K.S1_CONFLICT_TITLE)})")} AS question,
         {sql_fill(K.S1_CONFLICT_A, old='old_value', new='new_value')} AS answer,
         ['C1', 'C2'] AS cids, [source, source || '{K.CONFLICT_SOURCE_SUFFIX}'] AS sources, [content, new_text] AS texts,
         item_name, [chunk_id] AS ids
  FROM ({_CHANGED}) WHERE old_value <> new_value ORDER BY {sql_rnd(42, 'conflicting', 'chunk_id')} LIMIT {_PLAN1['conflicting']})"""

_CTES = {"answerable": ANSWERABLE, "multi_chunk": MULTI, "unanswerable": UNANSWERABLE, "conflicting": CONFLICTING}
_FLAT = ("type, question, answer, array_to_string(cids, '|') AS cids, array_to_string(sources, '|') AS sources, "
         "array_to_string(texts, '|') AS texts, item_name, array_to_string(ids, '|') AS chunk_ids")


def _flat(df):
    def joined(field):
        return F.array_join(F.transform("contexts", lambda c: c[field]), "|")

    return df.withColumns({
        "cids": joined("cid"), "sources": joined("source"), "texts": joined("text"),
        "item_name": F.col("meta.item_name"), "synthetic": F.col("meta.synthetic"),
        "chunk_ids": F.array_join(F.transform("meta.source_chunk_ids", lambda i: i.cast("string")), "|"),
    }).drop("contexts", "meta", "ord")


def _kind_query(kind: str) -> None:
    @query(f"sft_{kind}", f"WITH {S1}, {_CTES[kind]} SELECT request_id, {_FLAT}, true AS synthetic FROM {kind}")
    def run(spark, sf_dir):
        return _flat(B.build_kind(b.chunks(spark, sf_dir), kind, _PLAN1[kind]))


for _kind in _CTES:
    _kind_query(_kind)

STAGE1 = f"""{S1}, {', '.join(_CTES.values())},
drawn AS (SELECT *, {sql_rnd(42, 'shuffle', 'request_id')} AS ord,
                 md5(question || '||' || array_to_string(list_sort(texts), '||')) AS fp
          FROM ({' UNION ALL '.join(f'SELECT * FROM {k}' for k in _CTES)})),
kept AS (SELECT * FROM drawn QUALIFY row_number() OVER (PARTITION BY fp ORDER BY ord) = 1),
stage1 AS (
  SELECT *, 'kb-' || lpad(CAST(row_number() OVER (ORDER BY ord) AS VARCHAR), 6, '0') AS id,
         CASE WHEN row_number() OVER (PARTITION BY type ORDER BY ord)
                   <= greatest(1, round_even(CAST(count(*) OVER (PARTITION BY type) AS DOUBLE) * CAST({K.STAGE1_HOLDOUT} AS DOUBLE), 0))
              THEN 'holdout' ELSE 'train' END AS split FROM kept)"""


@query("sft_stage1", f"WITH {STAGE1} SELECT id, split, {_FLAT}, true AS synthetic FROM stage1")
def sft_stage1(spark, sf_dir):
    return _flat(B.build_stage1(b.chunks(spark, sf_dir), TOTAL1).samples)


@query("messages_convert", f"""WITH {b.SAMPLES}
SELECT id, type, split, 'S' AS system,
       '{K.CONTEXT_SECTION}' || chr(10) || coalesce(nullif({b.sql_strip("array_to_string(list_transform(texts, lambda x, i: '[C' || i || '] " + K.SOURCE_LABEL + "' || source || chr(10) || x), chr(10) || chr(10))")}, ''), '{K.NO_CONTEXT}')
       || chr(10) || chr(10) || '{K.QUESTION_SECTION}' || chr(10) || question AS usr, answer,
       CASE type WHEN 'answerable' THEN 'faithful,cite' WHEN 'multi_chunk' THEN 'multi_hop' WHEN 'unanswerable' THEN 'refuse'
                 WHEN 'conflicting' THEN 'refuse' ELSE '' END AS capabilities,
       '{K.STAGE1_SCHEMA}' AS source_schema FROM samples""")
def messages_convert(spark, sf_dir):
    m = B.to_messages(b.samples(spark, sf_dir), "S")
    return m.select(
        "meta.id", "meta.type", "split", R.turn(F.col("messages"), 0).alias("system"), R.turn(F.col("messages"), 1).alias("usr"),
        R.turn(F.col("messages"), 2).alias("answer"), F.array_join("meta.battle_capabilities", ",").alias("capabilities"),
        "meta.source_schema")


# --- Stage 2 ----------------------------------------------------------------------------------

S2 = f"""{b.CHUNKS},
pool AS (
  SELECT chunk_id, {b.sql_strip("CASE WHEN item_name <> '' THEN item_name WHEN file_title <> '' THEN file_title ELSE 'UNKNOWN' END")} AS item,
         {b.sql_clean('content')} AS text,
         coalesce(nullif(trim(file_title || ' / ' || coalesce(nullif(title, ''), parent_title), ' /'), ''),
                  nullif(item_name, ''), '未知来源') AS source
  FROM chunks)"""


def user_message(contexts: str, question: str) -> str:
    return (f"{quote(K.CONTEXT_SECTION + chr(10))} || {contexts} || "
            f"{quote(chr(10) * 2 + K.QUESTION_SECTION + chr(10) + question)}")


def _block(n: str, source: str, text: str) -> str:
    return f"'[' || {n} || '] {K.SOURCE_LABEL}' || {source} || chr(10) || {text}"


FORMAT_SUBTYPE = f"""CASE WHEN {b.sql_any('text', K.TROUBLESHOOTING_WORDS)} THEN 'troubleshooting'
  WHEN {b.sql_any('text', K.STEP_WORDS)} OR regexp_matches(text, '(^|\\n)\\s*[0-9]+[.、)]') THEN 'steps' ELSE 'definition' END"""


def _single(kind: str, question: str, answer: str, subtype: str = "CAST(NULL AS VARCHAR)", where: str = "") -> str:
    return f"""{kind}_found AS (
  SELECT '{kind}:' || chunk_id AS request_id, {sql_rnd(42, kind, 'chunk_id')} AS ord, {subtype} AS subtype,
         {user_message(_block("'1'", 'source', 'text'), question)} AS usr, {answer} AS answer
  FROM pool WHERE length(text) > 20 {where})"""


def _found(kind: str, subtype: str) -> str:
    one = b.sql_first_sentences("text", 1)
    if kind == "faithful":
        return _single(kind, K.S2_FAITHFUL_Q, sql_fill(K.S2_FAITHFUL_A, text=one))
    if kind == "cite":
        return _single(kind, K.S2_CITE_Q, sql_fill(K.S2_CITE_A, text=one))
    if kind == "format":
        return _single(kind, K.S2_FORMAT_Q, sql_fill(K.S2_FORMAT_A, text=one), FORMAT_SUBTYPE)
    if kind == "multi_hop":
        return f"""{_groups('multi_hop', 'pool', 'true')},
multi_hop_chosen AS (SELECT * FROM multi_hop_groups),
multi_hop_rows AS (
  SELECT g.key, g.ord, (k.n - 1) % 3 + 1 AS n, p.source, p.text FROM multi_hop_chosen g
  JOIN multi_hop_keyed k ON k.key = g.key JOIN pool p ON p.chunk_id = k.chunk_id WHERE (k.n - 1) % 3 < g.size),
multi_hop_found AS (
  SELECT 'multi_hop:' || key AS request_id, ord, CAST(NULL AS VARCHAR) AS subtype,
         {user_message("string_agg(" + _block('n', 'source', 'text') + ", chr(10) || chr(10) ORDER BY n)", K.S2_MULTI_Q)} AS usr,
         coalesce(string_agg(CASE WHEN text <> '' THEN {one} || ' [' || n || ']。' END, ' ' ORDER BY n), '') AS answer
  FROM multi_hop_rows GROUP BY key, ord)"""
    if subtype == "conflict":
        changed = perturbed("text", sql_rnd(42, "conflict-number", "request_id"), "request_id, ord, source, text", "conflict_picked")
        both = f"{_block(quote('1'), 'source', 'text')} || chr(10) || chr(10) || " + _block("'2'", f"source || '{K.CONFLICT_SOURCE_SUFFIX}'", "new_text")
        return f"""conflict_picked AS (
  SELECT 'conflict:' || chunk_id AS request_id, {sql_rnd(42, 'conflict', 'chunk_id')} AS ord, source, text
  FROM pool WHERE length(text) > 20 AND regexp_matches(text, '[0-9]')),
conflict_found AS (
  SELECT request_id, ord, 'conflict' AS subtype, CASE WHEN old_value <> new_value THEN {user_message(both, K.S2_CONFLICT_Q)} END AS usr,
         {sql_fill(K.S2_CONFLICT_A, old='old_value', new='new_value')} AS answer
  FROM conflict_picked LEFT JOIN (SELECT request_id, old_value, new_value, new_text FROM ({changed})) USING (request_id))"""
    return _single(subtype, K.S2_REFUSE_Q, quote(K.S2_REFUSE_A), f"'{subtype}'")


def _stage2_sql() -> str:
    order = [*K.GROUNDED_TYPES, "refuse"]
    parts, done = [S2], []
    for kind, subtype, need in sorted(_PLAN2, key=lambda p: order.index(p[0])):
        name = subtype or kind
        seen = " UNION ALL ".join(f"SELECT fp FROM {d}_kept" for d in done)
        parts.append(_found(kind, subtype))
        parts.append(f"""{name}_kept AS (
  SELECT * FROM (SELECT *, md5(usr || '||' || usr) AS fp, '{kind}' AS type FROM {name}_found)
  WHERE usr IS NOT NULL AND {f'fp NOT IN ({seen})' if seen else 'true'}
  QUALIFY row_number() OVER (PARTITION BY fp ORDER BY ord) = 1 ORDER BY ord LIMIT {need})""")
        done.append(name)
    parts.append("built AS (" + " UNION ALL ".join(
        f"SELECT request_id, type, subtype, usr, answer FROM {d}_kept" for d in done) + ")")
    parts.append(f"""split AS (
  SELECT *, {sql_rnd(42, 'shuffle', 'request_id')} AS ord2, CASE WHEN row_number() OVER (PARTITION BY type ORDER BY {sql_rnd(42, 'shuffle', 'request_id')})
       <= greatest(1, round_even(CAST(count(*) OVER (PARTITION BY type) AS DOUBLE) * CAST({K.STAGE2_HOLDOUT} AS DOUBLE), 0))
       THEN 'holdout' ELSE 'train' END AS split FROM built),
stage2 AS (SELECT *, 'sft-' || split || '-' || lpad(CAST(row_number() OVER (PARTITION BY split ORDER BY ord2) AS VARCHAR), 6, '0') AS id FROM split)""")
    return ",\n".join(parts)


STAGE2 = _stage2_sql()


@query("sft_expand", f"WITH {STAGE2} SELECT id, type, subtype, split, request_id, usr, answer FROM stage2")
def sft_expand(spark, sf_dir):
    built = B.expand(b.chunks(spark, sf_dir), TOTAL2).samples
    return built.select("meta.id", "meta.type", "meta.subtype", "split", "request_id",
                        R.turn(F.col("messages"), 1).alias("usr"), R.turn(F.col("messages"), 2).alias("answer"))


@query("sft_stats", f"""WITH {STAGE2}
SELECT type, subtype, CAST(GROUPING(type, subtype) AS INT) AS level, count(*) AS rows, count(*) FILTER (WHERE split = 'train') AS train,
       count(*) FILTER (WHERE split = 'holdout') AS holdout, count(*) AS synthetic
FROM stage2 GROUP BY GROUPING SETS ((type, subtype), (type), ())""")
def sft_stats(spark, sf_dir):
    return B.build_stats(B.expand(b.chunks(spark, sf_dir), TOTAL2).samples)


def _dropped_sql() -> str:
    parts = []
    for kind, subtype, need in _PLAN2:
        name = subtype or kind
        parts.append(f"""SELECT CASE WHEN usr IS NULL THEN 'empty' ELSE 'duplicate' END AS reason FROM {name}_found WHERE request_id NOT IN (SELECT request_id FROM {name}_kept)
  AND ord <= CASE WHEN (SELECT count(*) FROM {name}_kept) >= {need} THEN (SELECT max(ord) FROM {name}_kept) ELSE '~' END""")
    return f"WITH {STAGE2} SELECT reason, count(*) AS rows FROM ({' UNION ALL '.join(parts)}) GROUP BY reason"


@query("sft_dropped", _dropped_sql(), headline=False)
def sft_dropped(spark, sf_dir):
    return B.expand(b.chunks(spark, sf_dir), TOTAL2).dropped


def _set_stats_sql() -> str:
    return _dropped_sql().replace("SELECT reason, count(*) AS rows FROM", """, dropped AS (SELECT reason, count(*) AS n FROM""", 1) + f""")
SELECT name, CAST(value AS BIGINT) AS value, 'template, none' AS note FROM (
  SELECT 'requested_total' AS name, {TOTAL2} AS value UNION ALL SELECT 'actual_total', count(*) FROM stage2
  UNION ALL SELECT split, count(*) FROM stage2 GROUP BY split UNION ALL SELECT 'dropped: ' || reason, n FROM dropped)"""


@query("sft_set_stats", _set_stats_sql(), headline=False)
def sft_set_stats(spark, sf_dir):
    return B.set_stats(B.expand(b.chunks(spark, sf_dir), TOTAL2), TOTAL2)


@query("item_ring", f"WITH {S2}, {ring('items', 'pool')} SELECT * FROM ring", headline=False)
def item_ring(spark, sf_dir):
    return B.item_ring(B.stage2_pool(b.chunks(spark, sf_dir)))


@query("fewshot_examples", f"""WITH {b.MESSAGES}, first AS (
  SELECT type, turn, usr, answer, row_number() OVER (PARTITION BY type ORDER BY pos) AS n FROM messages)
SELECT type, string_agg('<示例>' || chr(10) || usr || chr(10) || '答：' || answer || chr(10) || '</示例>', chr(10) || chr(10) ORDER BY n) AS block
FROM first WHERE n <= 2 AND turn <> 4 GROUP BY type""")
def fewshot_examples(spark, sf_dir):
    return B.fewshot(b.messages(spark, sf_dir), 2)


@query("generation_prompts", f"""WITH {S2}
SELECT 'cite:' || chunk_id AS request_id, 'Material:' || chr(10) || '[1] ' || text || chr(10) || 'Ask about ' || item AS prompt
FROM pool WHERE length(text) > 20""", headline=False)
def generation_prompts(spark, sf_dir):
    """Prompts for a question model, from all material."""
    asked = B.requests(b.chunks(spark, sf_dir), "cite", tries=None)
    return asked.select("request_id", R.render_prompt(
        "Material:\n{context}\nAsk about {item}", context=R.numbered_texts(F.col("seeds")), item=F.col("item")).alias("prompt"))
