"""Validation and evaluation over conversation turns and document chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeworks import constants as K
from tomeworks.functions import rendering as R
from tomeworks.functions import text as X
from tomeworks.operators import builders as B
from tomeworks.operators import evaluation as E
from tomeworks.operators import sampling as P
from tomeworks.operators import similarity as N
from tomeworks.operators import validation as V
from tomeworks.plans import base as b
from tomeworks.plans.base import query, quote
from tomeworks.sources import tables as S

MAX = 900
FORMAT = ("und", "que", "the")

_OFFERED = "list_transform(texts, lambda x, i: 'C' || i)"
_USED = b.sql_set("answer", "[[](C[0-9]+)[]]", 1)
_REFUSED = b.sql_any("answer", b.DATA_CUES)
_NUMBERS = "regexp_extract_all({}, '[0-9]+(?:[.][0-9]+)?')"
_EXTRA = (f"list_sort(list_distinct(list_filter({_NUMBERS.format('answer')}, lambda n: NOT list_contains(list_concat("
          f"{_NUMBERS.format('source')}, {_NUMBERS.format('question')}, "
          f"flatten(list_transform(texts, lambda t: {_NUMBERS.format('t')}))), n))))")
_LENGTH = "(length(question) + length(answer) + coalesce(list_sum(list_transform(texts, lambda t: length(t))), 0))"
_OUT = f"list_filter({_USED}, lambda u: NOT list_contains({_OFFERED}, u))"
_RULES1 = [
    ("type = 'other'", "error", "invalid_type", "type"),
    (f"len({_OUT}) > 0", "error", "citation_out_of_range", f"array_to_string({_OUT}, ',')"),
    ("type IN ('answerable', 'multi_chunk') AND len(texts) = 0", "error", "no_contexts", "''"),
    (f"type IN ('answerable', 'multi_chunk') AND len({_USED}) = 0", "error", "no_citation", "''"),
    (f"type IN ('answerable', 'multi_chunk') AND {_REFUSED}", "error", "should_not_refuse", "''"),
    (f"type IN ('unanswerable', 'conflicting') AND NOT {_REFUSED}", "error", "should_refuse", "''"),
    (f"type = 'conflicting' AND NOT {b.sql_any('answer', b.DATA_CONFLICT_CUES)}", "error", "conflict_not_mentioned", "''"),
    (f"type = 'conflicting' AND len({_USED}) < 2", "warn", "few_conflict_citations", "''"),
    # A source adds its numbers only through a context.
    (f"type = 'unanswerable' AND len({_EXTRA.replace(_NUMBERS.format('source'), 'CASE WHEN len(texts) > 0 THEN ' + _NUMBERS.format('source') + ' ELSE [] END')}) > 0",
     "warn", "extra_numbers",
     f"array_to_string({_EXTRA.replace(_NUMBERS.format('source'), 'CASE WHEN len(texts) > 0 THEN ' + _NUMBERS.format('source') + ' ELSE [] END')}, ',')"),
    (f"{_LENGTH} > {MAX}", "warn", "too_long", f"CAST({_LENGTH} AS VARCHAR)"),
]


def _union(rules, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT id, split, '{level}' AS level, '{code}' AS code, {detail} AS detail FROM {source} WHERE {rule}"
        for rule, level, code, detail in rules)


ISSUES1 = f"{b.SAMPLES}, issues AS ({_union(_RULES1, 'samples')})"


def issues1(spark, sf_dir):
    return V.validate_samples(b.samples(spark, sf_dir), MAX, b.DATA_CUES, b.DATA_CONFLICT_CUES)


@query("validate_samples", f"WITH {ISSUES1} SELECT * FROM issues")
def validate_samples(spark, sf_dir):
    return issues1(spark, sf_dir)


_STRICT = f"""{b.SAMPLES}, strict_samples AS (
  SELECT * REPLACE (CASE WHEN length(question) % 5 = 0 THEN '  ' ELSE answer END AS answer,
                    list_transform(texts, lambda t: CASE WHEN length(t) % 4 = 0 THEN ' ' || substr(t, 1, 15) ELSE t END) AS texts) FROM samples)"""
_SHORT = f"list_filter(list_transform(texts, lambda t, i: CASE WHEN length({b.sql_strip('t')}) < 20 THEN 'C' || i END), lambda c: c IS NOT NULL)"


@query("validate_strict", f"""WITH {_STRICT}
SELECT id, split, code, detail FROM ({_union([
    ("type = 'multi_chunk' AND len(texts) < 2", "error", "few_contexts", "CAST(len(texts) AS VARCHAR)"),
    (f"len({_SHORT}) > 0", "error", "short_context", f"array_to_string(list_sort({_SHORT}), ',')"),
    (f"{b.sql_strip('answer')} = ''", "error", "empty_answer", "''"),
], 'strict_samples')})""", headline=False)
def validate_strict(spark, sf_dir):
    """The rules that only ``strict`` adds, over samples with blank answers and short contexts."""
    blank = F.length("question") % 5 == 0
    cut = F.transform("contexts", lambda c: c.withField("text", F.when(F.length(c["text"]) % 4 == 0, F.concat(F.lit(" "), F.substring(c["text"], 1, 15))).otherwise(c["text"])))
    made = b.samples(spark, sf_dir).withColumn("answer", F.when(blank, "  ").otherwise(F.col("answer"))).withColumn("contexts", cut)
    found = V.validate_samples(made, MAX, b.DATA_CUES, b.DATA_CONFLICT_CUES, strict=True)
    return found.where(F.col("code").isin("few_contexts", "short_context", "empty_answer")).select("id", "split", "code", "detail")


_MUSED = b.sql_set("answer", "[[]([0-9]+)[]]", 1)
_MOFFER = b.sql_set("usr", "(?m)^[[]([0-9]+)[]]", 1)
_MOUT = f"list_filter({_MUSED}, lambda u: NOT list_contains({_MOFFER}, u))"
_GROUNDED = "turn <> 4 AND type IN ('faithful', 'multi_hop', 'cite', 'format')"
_RULES2 = [
    ("turn = 4", "error", "invalid_roles", "'user,assistant'"),
    ("turn = 2", "error", "missing_capabilities", "''"),
    (f"{_GROUNDED} AND {_REFUSED}", "error", "should_not_refuse", "''"),
    (f"{_GROUNDED} AND len({_MUSED}) = 0", "error", "no_citation", "''"),
    (f"{_GROUNDED} AND len({_MOUT}) > 0", "error", "citation_out_of_range", f"array_to_string({_MOUT}, ',')"),
    (f"type = 'refuse' AND NOT {_REFUSED}", "error", "did_not_refuse", "''"),
    ("type = 'refuse' AND subtype IS NULL", "error", "invalid_subtype", "''"),
    (f"turn <> 4 AND 1 + length(usr) + length(answer) > {MAX}", "warn", "too_long", "CAST(1 + length(usr) + length(answer) AS VARCHAR)"),
]


@query("validate_messages", f"WITH {b.MESSAGES} {_union(_RULES2, 'messages')}")
def validate_messages(spark, sf_dir):
    return V.validate_messages(b.messages(spark, sf_dir), MAX, b.DATA_CUES, FORMAT)


@query("duplicate_documents", """WITH d AS (
  SELECT doc_id AS id, CASE WHEN lang = 'en' THEN 'train' ELSE 'holdout' END AS split, md5(text || '||' || text) AS fp FROM documents),
r AS (SELECT *, row_number() OVER w AS n, first(split || ':' || id) OVER w AS detail FROM d
      WINDOW w AS (PARTITION BY fp ORDER BY CASE WHEN split = 'train' THEN 0 ELSE 1 END, id))
SELECT id, split, 'error' AS level, 'duplicate' AS code, detail FROM r WHERE n > 1""")
def duplicate_documents(spark, sf_dir):
    """Exact copies among the documents, across and within splits."""
    d = b.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", "train").otherwise("holdout").alias("split"), "text")
    return V.duplicate_issues(d, V.message_fingerprint(F.col("text")), "id")


@query("review_sample", f"""WITH {b.MESSAGES},
strata AS (SELECT type, subtype, count(*) AS rows, round(ceil(round(sum(count(*)) OVER () * CAST(0.1 AS DOUBLE), 9)) * (count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)), 9) AS due,
                  ceil(round(sum(count(*)) OVER () * CAST(0.1 AS DOUBLE), 9)) AS wanted FROM messages GROUP BY type, subtype),
based AS (SELECT *, least(greatest(floor(due), 1), rows) AS base FROM strata),
quotas AS (
  SELECT type, subtype, rows, least(rows, base + CASE WHEN row_number() OVER (ORDER BY CASE WHEN due >= 1 THEN due - floor(due) ELSE 0 END DESC, type, coalesce(subtype, chr(0)))
         <= wanted - sum(base) OVER () THEN 1 ELSE 0 END) AS quota FROM based)
SELECT id, m.type, m.subtype, rows, CAST(quota AS BIGINT) AS quota, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY type, subtype ORDER BY {b.sql_rnd(42, 'review', 'id')}) AS rank FROM messages) m
JOIN quotas q ON q.type = m.type AND q.subtype IS NOT DISTINCT FROM m.subtype WHERE rank <= quota""", headline=False)
def review_sample(spark, sf_dir):
    """A tenth of the messages for people to check, every type and subtype among them."""
    m = b.messages(spark, sf_dir).select("meta.id", "meta.type", "meta.subtype")
    picked = P.review_sample(P.with_order(m, 42, "review", F.col("id")), "ord")
    return picked.select("id", "type", "subtype", F.col("stratum_rows").alias("rows"), "quota", "rank")


@query("holdout_near_leak", f"""WITH w AS (
  SELECT doc_id AS id, CASE WHEN substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '4' THEN 'holdout' ELSE 'train' END AS split,
         regexp_extract_all(lower(coalesce(text, '')), '[^ \\t\\n\\x0B\\f\\r]+') AS ws FROM documents),
s AS (SELECT id, split, list_sort(list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i : i + 4], ' ')))) AS shingles
      FROM w WHERE len(ws) > 0),
e AS (SELECT id, split, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
pairs AS (
  SELECT t.id AS train, h.id AS held, count(*) / CAST(any_value(t.n) + any_value(h.n) - count(*) AS DOUBLE) AS similarity
  FROM e t JOIN e h USING (shingle) WHERE t.split = 'train' AND h.split = 'holdout' GROUP BY t.id, h.id),
links AS (SELECT held, count(*) AS links, max(similarity) AS nearest FROM pairs WHERE similarity >= 0.8 GROUP BY held)
SELECT w.id, min(w.id) OVER (PARTITION BY coalesce(s.shingles, [])) AS class_id, coalesce(links, 0) AS links, round(coalesce(nearest, 0), 9) AS nearest
FROM w LEFT JOIN s USING (id) LEFT JOIN links ON links.held = w.id WHERE w.split = 'holdout'""")
def holdout_near_leak(spark, sf_dir):
    """Holdout documents with near copies among the training documents."""
    d = b.documents(spark, sf_dir).select("doc_id", "text", F.when(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "4", "holdout").otherwise("train").alias("split"))
    return N.near_leaks(d, F.col("text"), id_="doc_id").withColumn("nearest", F.round("nearest", 9))


@query("holdout_leak", """WITH passages AS (
  SELECT 'd' || doc_id AS id, 'train' AS split, trim(unnest(string_split(text, chr(10)))) AS passage FROM documents
  UNION ALL SELECT 'b' || item_id, 'holdout', trim(unnest(string_split(text, chr(10)))) FROM benchmark),
p AS (SELECT id, split, passage, row_number() OVER (PARTITION BY split, id, passage) AS c FROM passages WHERE passage <> ''),
r AS (SELECT *, row_number() OVER w AS n, first(split || ':' || id) OVER w AS detail FROM p WHERE c = 1
      WINDOW w AS (PARTITION BY passage ORDER BY CASE WHEN split = 'train' THEN 0 ELSE 1 END, id))
SELECT id, detail, count(*) AS passages FROM r WHERE n > 1 AND split = 'holdout' GROUP BY id, detail""")
def holdout_leak(spark, sf_dir):
    """Benchmark passages that also occur in the documents, with the first document."""
    def lines(name, key, prefix, split):
        t = b.table(spark, sf_dir, name)
        return t.select(
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.lit(split).alias("split"),
            F.explode(F.split("text", "\n", -1)).alias("passage")
        ).withColumn("passage", F.trim("passage")).where("passage <> ''").distinct()

    both = lines("documents", "doc_id", "d", "train").unionByName(lines("benchmark", "item_id", "b", "holdout"))
    issues = V.duplicate_issues(both, F.md5("passage"), "id")
    return issues.where("split = 'holdout'").groupBy("id", "detail").agg(F.count("*").alias("passages"))


@query("ratio_drift", f"""WITH {b.SAMPLES},
targets(type, target) AS (VALUES {', '.join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in K.STAGE1_RATIOS.items())}),
counts AS (SELECT type, count(*) AS n FROM samples GROUP BY type)
SELECT t.type, coalesce(n, 0) / CAST((SELECT count(*) FROM samples) AS DOUBLE) AS actual, target,
       abs(coalesce(n, 0) / CAST((SELECT count(*) FROM samples) AS DOUBLE) - target) > 0.10 AS drifted
FROM targets t LEFT JOIN counts c ON c.type = t.type""")
def ratio_drift(spark, sf_dir):
    return V.ratio_drift(b.samples(spark, sf_dir), K.STAGE1_RATIOS)


@query("coverage", f"""WITH {b.MESSAGES},
domain(kind, name) AS (VALUES {', '.join(f"('type', '{t}')" for t in K.STAGE2_TYPES)},
                              {', '.join(f"('refuse subtype', '{t}')" for t in K.REFUSE_SUBTYPES)})
SELECT kind, name FROM domain WHERE NOT EXISTS (
  SELECT 1 FROM messages m WHERE (kind = 'type' AND m.type = name) OR (kind = 'refuse subtype' AND m.type = 'refuse' AND m.subtype = name))""")
def coverage(spark, sf_dir):
    return V.coverage(b.messages(spark, sf_dir))


@query("verdict", f"""WITH {ISSUES1}
SELECT count(*) FILTER (WHERE level = 'error') AS errors, count(*) FILTER (WHERE level = 'warn') AS warnings,
       count(*) FILTER (WHERE level = 'error') = 0 AS passed FROM issues""", headline=False)
def verdict(spark, sf_dir):
    return V.verdict(issues1(spark, sf_dir))


@query("issue_counts", f"WITH {ISSUES1} SELECT split, level, code, count(*) AS rows FROM issues GROUP BY ALL", headline=False)
def issue_counts(spark, sf_dir):
    return V.issue_counts(issues1(spark, sf_dir))


@query("quality_gates", f"""WITH {ISSUES1}, {b.CHUNKS},
v AS (SELECT (SELECT count(*) FROM chunks WHERE {b.sql_strip('content')} <> '') AS exported,
  (SELECT count(DISTINCT CASE WHEN item_name <> '' THEN item_name ELSE file_title END) FROM chunks WHERE {b.sql_strip('content')} <> '') AS items,
  (SELECT count(*) FROM samples) AS built,
  3 - (SELECT count(DISTINCT type) FROM samples WHERE type IN ('answerable', 'multi_chunk', 'unanswerable')) AS missing,
  (SELECT count(*) FROM issues WHERE level = 'error') AS errors)
SELECT 'exported' AS gate, exported AS value, exported > 0 AS ok FROM v UNION ALL SELECT 'distinct_items', items, items >= 2 FROM v
UNION ALL SELECT 'samples', built, built > 0 FROM v UNION ALL SELECT 'missing_types', missing, missing = 0 FROM v
UNION ALL SELECT 'errors', errors, errors = 0 FROM v""")
def quality_gates(spark, sf_dir):
    stats = S.export_chunks(b.chunks(spark, sf_dir))[1]
    return V.quality_gates(stats, b.samples(spark, sf_dir), issues1(spark, sf_dir))


@query("format_gates", f"""WITH {b.MESSAGES},
v AS (SELECT count(*) FILTER (WHERE turn = 4) AS roles, count(*) FILTER (WHERE type = '') AS type, count(*) FILTER (WHERE turn = 2) AS capabilities FROM messages)
SELECT 'roles' AS gate, roles AS value, roles = 0 AS ok FROM v UNION ALL SELECT 'type', type, type = 0 FROM v
UNION ALL SELECT 'capabilities', capabilities, capabilities = 0 FROM v""", headline=False)
def format_gates(spark, sf_dir):
    return V.format_gates(b.messages(spark, sf_dir))


@query("pretrain_check", f"""WITH {b.MESSAGES}
SELECT id, 'messages must have 3 turns' AS problem FROM messages WHERE turn = 4""", headline=False)
def pretrain_check(spark, sf_dir):
    return V.pretrain_check(b.messages(spark, sf_dir))


# --- Evaluation ---------------------------------------------------------------------------------

def predictions(spark, sf_dir):
    """Two check models, and one that answers with the question's first half and a citation."""
    m = b.messages(spark, sf_dir)
    mixed = m.select(
        F.col("meta.id").alias("id"), F.lit("mixed").alias("model"),
        F.concat(F.substring(R.turn(F.col("messages"), 1), 1, 120), F.lit(" [1] ["),
                 (F.col("pos") % 3).cast("string"), F.lit("]")).alias("prediction"))
    return E.constant_predictor(m).unionByName(E.echo_predictor(m)).unionByName(mixed)


def scored(spark, sf_dir):
    m = b.messages(spark, sf_dir)
    # A judge's stored output: unreadable for some rows.
    judged = predictions(spark, sf_dir).withColumn("output", F.when(
        F.length("id") % 2 == 0, F.concat(F.lit('{"faithful": '), (F.length("prediction") % 2).cast("string"), F.lit(', "complete": 1}'))
    ).otherwise("no idea"))
    return E.score_rows(m, predictions(spark, sf_dir), E.parse_judge(judged), b.DATA_CUES)


SCORED = f"""{b.MESSAGES},
heard AS (SELECT *, CASE WHEN turn = 4 THEN answer ELSE usr END AS second FROM messages),
told AS (
  SELECT *, 'base' AS model, {quote(K.CONSTANT_PREDICTION)} AS prediction FROM heard
  UNION ALL SELECT *, 'sft', answer FROM heard
  UNION ALL SELECT *, 'mixed', substr(second, 1, 120) || ' [1] [' || (pos % 3) || ']' FROM heard),
refused AS (SELECT *, type = 'refuse' AS should_refuse, {b.sql_any('prediction', b.DATA_CUES)} AS did_refuse,
  {b.sql_set('prediction', '[[]([0-9]+)[]]', 1)} AS used, {b.sql_set('second', '(?m)^[[]([0-9]+)[]]', 1)} AS offered FROM told),
cited AS (SELECT *, NOT should_refuse AND NOT did_refuse AS opened,
  CASE WHEN NOT should_refuse AND NOT did_refuse
       THEN len(used) > 0 AND len(list_filter(used, lambda u: NOT list_contains(offered, u))) = 0 END AS citation_ok FROM refused),
scored AS (
  SELECT *, CASE WHEN opened AND length(id) % 2 = 0 THEN length(prediction) % 2 END AS faithful,
         CASE WHEN opened AND length(id) % 2 = 0 THEN 1 END AS complete FROM cited),
rows_ AS (
  SELECT id, model, type, subtype, CASE WHEN turn = 4 THEN '' ELSE {b.sql_strip('question')} END AS question, answer AS gold,
         prediction, should_refuse, did_refuse, citation_ok, faithful, complete,
         CASE WHEN should_refuse AND NOT did_refuse THEN 'missed_refusal' WHEN NOT should_refuse AND did_refuse THEN 'false_refusal'
              WHEN NOT citation_ok THEN 'citation_invalid' WHEN faithful = 0 THEN 'unfaithful' WHEN complete = 0 THEN 'incomplete' END AS bad_case
  FROM scored)"""


@query("eval_rows", f"WITH {SCORED} SELECT * FROM rows_")
def eval_rows(spark, sf_dir):
    return scored(spark, sf_dir)


def _div(a: str, c: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({c} AS DOUBLE), 0), 0)"


_P, _R = _div("tp", "tp + fp"), _div("tp", "tp + fn")
METRICS = f"""{SCORED},
counted AS (
  SELECT model, count(*) FILTER (WHERE should_refuse AND did_refuse) AS tp, count(*) FILTER (WHERE should_refuse AND NOT did_refuse) AS fn,
         count(*) FILTER (WHERE NOT should_refuse AND did_refuse) AS fp, count(*) FILTER (WHERE NOT should_refuse AND NOT did_refuse) AS tn,
         count(citation_ok) AS cited, count(*) FILTER (WHERE citation_ok) AS cited_ok, count(faithful) AS jf, sum(faithful) AS fo,
         count(complete) AS jc, sum(complete) AS co,
         {', '.join(f"count(*) FILTER (WHERE subtype = '{s}') AS n_{s}, count(*) FILTER (WHERE subtype = '{s}' AND did_refuse) AS r_{s}" for s in K.REFUSE_SUBTYPES)}
  FROM rows_ GROUP BY model),
metrics AS (
  SELECT model, 'refusal_precision' AS metric, {_P} AS value FROM counted UNION ALL SELECT model, 'refusal_recall', {_R} FROM counted
  UNION ALL SELECT model, 'refusal_f1', {_div(f'2 * {_P} * {_R}', f'{_P} + {_R}')} FROM counted
  UNION ALL SELECT model, 'false_refusal', {_div('fp', 'fp + tn')} FROM counted
  {' '.join(f"UNION ALL SELECT model, 'recall_{s}', {_div(f'r_{s}', f'n_{s}')} FROM counted WHERE n_{s} > 0" for s in K.REFUSE_SUBTYPES)}
  UNION ALL SELECT model, 'citation_validity', {_div('cited_ok', 'cited')} FROM counted
  UNION ALL SELECT model, 'faithfulness', {_div('fo', 'jf')} FROM counted WHERE jf > 0
  UNION ALL SELECT model, 'completeness', {_div('co', 'jc')} FROM counted WHERE jc > 0)"""


@query("eval_metrics", f"WITH {METRICS} SELECT model, metric, round(value, 9) AS value FROM metrics")
def eval_metrics(spark, sf_dir):
    return E.metrics(scored(spark, sf_dir)).withColumn("value", F.round("value", 9))


_BA = """ba AS (SELECT a.metric, a.value AS before, c.value AS after, c.value - a.value AS delta
  FROM metrics a JOIN metrics c ON a.metric = c.metric WHERE a.model = 'base' AND c.model = 'mixed')"""


@query("before_after", f"""WITH {METRICS}, {_BA}
SELECT metric, round(before, 9) AS before, round(after, 9) AS after, round(delta, 9) AS delta FROM ba""")
def before_after(spark, sf_dir):
    found = E.before_after(E.metrics(scored(spark, sf_dir)), "base", "mixed")
    return found.select("metric", *[F.round(c, 9).alias(c) for c in ("before", "after", "delta")])


@query("promotion_gate", f"""WITH {METRICS}, {_BA}
SELECT metric, CASE metric WHEN 'refusal_recall' THEN delta > 0 WHEN 'false_refusal' THEN delta <= 0 ELSE delta >= 0 END AS ok
FROM ba WHERE metric IN ('refusal_recall', 'false_refusal', 'citation_validity')""", headline=False)
def promotion_gate(spark, sf_dir):
    return E.promotion_gate(E.metrics(scored(spark, sf_dir)), "base", "mixed").select("metric", "ok")


@query("eval_bad_case_counts", f"""WITH {SCORED}
SELECT model, bad_case, count(*) AS cases FROM rows_ WHERE bad_case IS NOT NULL GROUP BY model, bad_case""")
def eval_bad_case_counts(spark, sf_dir):
    return E.bad_case_counts(scored(spark, sf_dir))


@query("holdout_schema", f"""WITH {b.MESSAGES}
SELECT count(*) AS samples, count(*) FILTER (WHERE turn = 4) AS invalid,
       count(*) > 0 AND count(*) FILTER (WHERE turn = 4) = 0 AS ok FROM messages""", headline=False)
def holdout_schema(spark, sf_dir):
    return E.check_schema(b.messages(spark, sf_dir))


@query("gate_samples", f"""WITH {b.MESSAGES}
SELECT id, CASE WHEN turn = 4 THEN 'messages roles invalid'
  WHEN {_GROUNDED} AND {_REFUSED} THEN 'grounded sample refused'
  WHEN {_GROUNDED} AND len({_MUSED}) = 0 THEN 'grounded answer has no citation'
  WHEN {_GROUNDED} AND len({_MOUT}) > 0 THEN 'citation out of range: ' || array_to_string({_MOUT}, ',')
  WHEN type = 'refuse' AND NOT {_REFUSED} THEN 'refuse sample did not refuse' END AS reason FROM messages""")
def gate_samples(spark, sf_dir):
    kept, dropped = B.gate_samples(b.messages(spark, sf_dir), b.DATA_CUES)
    return dropped.select("meta.id", "reason").unionByName(kept.select("meta.id", F.lit(None).cast("string").alias("reason")))


_JUDGE = "{user}\n\nAnswer:\n{answer}\n\nIs it supported and complete? Reply in JSON."


@query("judge_prompts", f"""WITH {b.MESSAGES}
SELECT id, usr || chr(10) || chr(10) || 'Answer:' || chr(10) || answer || chr(10) || chr(10) || 'Is it supported and complete? Reply in JSON.' AS prompt
FROM messages WHERE turn <> 4 AND type <> 'refuse' AND NOT {b.sql_any('answer', b.DATA_CUES)}""", headline=False)
def judge_prompts(spark, sf_dir):
    """Gold answers as predictions; only answers that neither refuse nor should are judged."""
    m = b.messages(spark, sf_dir).where(F.array_size("messages") == 3)
    answer = R.turn(F.col("messages"), 2)
    rows = m.select(
        F.col("meta.id").alias("id"), F.lit("gold").alias("model"), R.turn(F.col("messages"), 1).alias("user"), answer.alias("prediction"),
        (F.col("meta.type") == "refuse").alias("should_refuse"), X.is_refusal(answer, b.DATA_CUES).alias("did_refuse"))
    return E.judge_requests(rows, _JUDGE).drop("model")


@query("prompt_parts", f"""WITH {b.MESSAGES}
SELECT id, CASE WHEN turn = 4 THEN 'user' ELSE 'system,user' END AS roles, length(usr) + CASE WHEN turn = 4 THEN 0 ELSE 1 END AS chars FROM messages""", headline=False)
def prompt_parts(spark, sf_dir):
    part = R.prompt_messages(F.col("messages"))
    return b.messages(spark, sf_dir).select(
        F.col("meta.id").alias("id"), F.array_join(R.roles(part), ",").alias("roles"), R.messages_length(part).alias("chars"))
