"""Frequent and distinct values from sketches that are kept as tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tomeworks.functions.intent import resolve_intent
from tomeworks.operators import sketches as S
from tomeworks.operators.settle import settle
from tomeworks.plans import base as b
from tomeworks.plans.base import query

#: Shares of a window's words from which a word is frequent.
TERM_SHARE, UNKNOWN_SHARE = 0.01, 0.02
WORD = "[A-Za-z]+"


def _frequent_sql(source: str, share: float) -> str:
    return f"""WITH w AS ({source}), n AS (SELECT "window", value, count(*) AS n FROM w GROUP BY "window", value),
r AS (SELECT "window", count(*) AS rows FROM w GROUP BY "window")
SELECT "window", value, n, rows FROM n JOIN r USING ("window") WHERE n >= CAST({share} AS DOUBLE) * rows"""


@query("frequent_terms", _frequent_sql(f"SELECT lang AS \"window\", unnest(regexp_extract_all(text, '{WORD}')) AS value FROM documents WHERE lang IS NOT NULL", TERM_SHARE),
       headline=False)
def frequent_terms(spark, sf_dir):
    """Frequent words of each language: sketches by source and language are kept and merged by language."""
    docs = b.documents(spark, sf_dir).where("lang IS NOT NULL")
    words = docs.select(F.struct("source", "lang").alias("part"), "lang", F.explode(F.regexp_extract_all("text", F.lit(WORD), 0)).alias("value"))
    kept = settle(S.window_sketches(words, TERM_SHARE, "part"))
    merged = settle(S.merged_sketches(kept, F.col("window.lang"), TERM_SHARE))
    return S.frequent_values(words, merged, TERM_SHARE, "lang")


@query("frequent_unknown_terms", _frequent_sql(
    f"""SELECT turn AS "window", unnest(regexp_extract_all(text, '{WORD}')) AS value FROM conversations
  WHERE role = 'user' AND turn IS NOT NULL AND {b.sql_intent("coalesce(text, '')", b.DATA_INTENTS)} = 'general'""", UNKNOWN_SHARE), headline=False)
def frequent_unknown_terms(spark, sf_dir):
    """What questions of unknown intent are often about, by turn."""
    asked = b.table(spark, sf_dir, "conversations").where("role = 'user' AND turn IS NOT NULL")
    unknown = asked.where(resolve_intent(F.lit(None).cast("string"), F.coalesce("text", F.lit("")), b.DATA_INTENTS) == "general")
    words = unknown.select(F.col("turn").alias("window"), F.explode(F.regexp_extract_all("text", F.lit(WORD), 0)).alias("value"))
    return S.frequent_values(words, settle(S.window_sketches(words, UNKNOWN_SHARE)), UNKNOWN_SHARE)


_NAMES = ("content", "title")


@query("load_distincts", """WITH c AS (
  SELECT coalesce(source, '') AS load, text AS content, regexp_extract(text, '^[A-Za-z]+', 0) AS title FROM documents),
l AS (SELECT load, lead(load) OVER (ORDER BY load) AS other FROM (SELECT DISTINCT load FROM c)),
d AS (SELECT load, count(*) AS rows, count(DISTINCT content) AS content, count(DISTINCT title) AS title FROM c GROUP BY load),
t AS (SELECT DISTINCT load, title FROM c WHERE title IS NOT NULL),
n AS (SELECT l.load, l.other, count(*) FILTER (a.title IS NOT NULL AND o.title IS NULL) AS title_new
      FROM l LEFT JOIN t AS a ON a.load = l.load LEFT JOIN t AS o ON o.load = l.other AND o.title = a.title WHERE l.other IS NOT NULL GROUP BY l.load, l.other)
SELECT d.load, rows, content, title, true AS within, other, title_new, CASE WHEN other IS NOT NULL THEN true END AS new_within FROM d LEFT JOIN n ON d.load = n.load
UNION ALL SELECT 'all', count(*), count(DISTINCT content), count(DISTINCT title), true, NULL, NULL, NULL FROM c HAVING count(*) > 0""", headline=False)
def load_distincts(spark, sf_dir):
    """Distinct contents and titles of each source, as a load, and of all, and the titles that the next source lacks:
    exact numbers, and whether the estimates from kept sketches lie within their bound."""
    c = b.chunks(spark, sf_dir).select(F.coalesce("file_title", F.lit("")).alias("load"), "content", "title")
    kept = settle(S.load_sketches(c, F.col("load"), list(_NAMES)))

    def within(pairs):
        out = F.lit(True)
        for estimate, exact, union in pairs:
            out = out & (F.abs(F.col(estimate) - F.col(exact)) <= S.distinct_bound(F.col(union)) + 0.5)
        return out

    exact = [F.count_distinct(name).alias(name) for name in _NAMES]
    single = kept.select("load", *[F.theta_sketch_estimate(name).alias(f"_{name}") for name in _NAMES])
    each = c.groupBy("load").agg(F.count("*").alias("rows"), *exact).join(single, "load").withColumn("within", within((f"_{n}", n, n) for n in _NAMES))

    pairs = kept.select("load").join(_next(kept), "load")
    titles = c.where("title IS NOT NULL").select("load", "title").distinct()
    lacking = titles.join(pairs, "load").join(titles.select(F.col("load").alias("other"), "title"), ["other", "title"], "left_anti")
    counted = lacking.groupBy("load", "other").agg(F.count("*").alias("title_new"))
    compared = S.compared_loads(kept, pairs, ["title"]).select("load", "other", F.col("title_new").alias("_new"))
    sizes = each.select(F.col("load").alias("other"), F.col("title").alias("_others"))
    new = compared.join(counted, ["load", "other"], "left").join(each.select("load", "title"), "load").join(sizes, "other").select(
        "load", "other", F.coalesce("title_new", F.lit(0)).alias("title_new"), "_new", (F.col("title") + F.col("_others")).alias("_union"))
    new = new.withColumn("new_within", within([("_new", "title_new", "_union")])).select("load", "other", "title_new", "new_within")
    rows = each.join(new, "load", "left").select("load", "rows", *_NAMES, "within", "other", "title_new", "new_within")

    estimate = S.distinct_of_all(kept, list(_NAMES)).first()  # one row of numbers
    whole = c.agg(F.count("*").alias("rows"), *exact).where("rows > 0")
    none = F.lit(None)
    total = whole.withColumns({f"_{n}": F.lit(estimate[n]) for n in _NAMES}).withColumn("within", within((f"_{n}", n, n) for n in _NAMES)).select(
        F.lit("all").alias("load"), "rows", *_NAMES, "within", none.cast("string").alias("other"), none.cast("bigint").alias("title_new"), none.cast("boolean").alias("new_within"))
    return rows.unionByName(total)


def _next(kept):
    """``load, other``: each load and the next one by name; one row a load."""
    return kept.select("load", F.lead("load").over(Window.orderBy("load")).alias("other")).where("other IS NOT NULL")
