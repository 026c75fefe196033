"""Image references in Markdown: the text around them, and rewriting them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeworks import constants as K
from tomeworks.functions.text import let, strip, text_or_empty
from tomeworks.operators.sampling import first_per_key

IMAGE = r"!\[[^\n]*?\]\(([^\n]*?)\)"
IMAGE_LINE = r"^!\[.*?\]\(.*?\)$"
HEADING_START = r"(?U)^#{1,6}[\s\x1c-\x1f]+"
_CUT = "\x01"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/*$", 1)


def _paragraphs(lines: Column) -> Column:
    """Paragraphs of a run of lines; blank lines and lines that are only an image separate them."""
    marked = F.transform(
        lines,
        lambda line: F.when((strip(line) == "") | strip(line).rlike(IMAGE_LINE), F.lit(_CUT)).otherwise(line),
    )
    return F.filter(F.split(F.array_join(marked, "\n"), f"\n?{_CUT}\n?", -1), lambda p: p != "")


def _within_budget(paragraphs: Column, budget: int) -> Column:
    """Leading paragraphs while their total stays in the budget; the first one always."""
    zero = F.struct(
        F.lit(0).alias("total"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("taken")
    )

    def step(acc: Column, p: Column) -> Column:
        over = acc["full"] | ((acc["total"] + F.length(p) > budget) & (F.size(acc["taken"]) > 0))
        return F.struct(
            F.when(over, acc["total"]).otherwise(acc["total"] + F.length(p)).alias("total"),
            over.alias("full"),
            F.when(over, acc["taken"]).otherwise(F.concat(acc["taken"], F.array(p))).alias("taken"),
        )

    return F.aggregate(paragraphs, zero, step, lambda acc: acc["taken"])


def reference_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, name, line`` for every image named in a document."""
    lines = docs.select("doc_id", F.posexplode(F.split("md_content", "\n", -1)).alias("line", "text"))
    found = lines.where(F.col("text").contains("![")).select(
        "doc_id", "line", F.explode(F.regexp_extract_all("text", F.lit(IMAGE), F.lit(1))).alias("target")
    )
    return found.select("doc_id", base_name(F.col("target")).alias("name"), "line")


def referenced_contexts(docs: DataFrame, budget: int = K.IMAGE_CONTEXT) -> DataFrame:
    """Per document and image name: heading above, text before and after the first reference."""
    def around(d: Column) -> Column:
        lines, heads = d["lines"], d["heads"]

        def one(i: Column) -> Column:
            up = F.coalesce(F.array_max(F.filter(heads, lambda h: h < i)), F.lit(-1))
            down = F.coalesce(F.array_min(F.filter(heads, lambda h: h > i)), F.size(lines))
            return let(
                F.struct(up.alias("up"), down.alias("down"), i.alias("at")),
                lambda b: F.struct(
                    b["at"].alias("line"),
                    F.regexp_extract_all(F.get(lines, b["at"]), F.lit(IMAGE), F.lit(1)).alias("targets"),
                    F.when(b["up"] >= 0, F.get(lines, b["up"])).otherwise("").alias("head"),
                    F.array_join(
                        F.reverse(_within_budget(
                            F.reverse(_paragraphs(F.slice(lines, b["up"] + 2, b["at"] - b["up"] - 1))), budget)),
                        "\n\n").alias("pre_text"),
                    F.array_join(
                        _within_budget(_paragraphs(F.slice(lines, b["at"] + 2, b["down"] - b["at"] - 1)), budget),
                        "\n\n").alias("post_text"),
                ),
            )

        return F.transform(d["refs"], one)

    def numbered(lines: Column, wanted) -> Column:
        hits = F.transform(lines, lambda line, i: F.when(wanted(line), i))
        return F.filter(hits, lambda i: i.isNotNull())

    located = let(
        F.split(text_or_empty(F.col("md_content")), "\n", -1),
        lambda lines: let(
            F.struct(
                lines.alias("lines"),
                numbered(lines, lambda t: t.rlike(HEADING_START)).alias("heads"),
                numbered(lines, lambda t: t.rlike(IMAGE)).alias("refs"),
            ),
            around,
        ),
    )
    refs = docs.where(F.col("md_content").contains("![")).select("doc_id", F.explode_outer(located).alias("r"))
    named = refs.where(F.col("r").isNotNull()).select(
        "doc_id", F.explode("r.targets").alias("target"), "r.line", "r.head", "r.pre_text", "r.post_text"
    )
    rows = named.withColumn("name", base_name(F.col("target"))).drop("target")
    return first_per_key(rows, ["doc_id", "name"], [F.col("line")]).drop("_rank")


def image_contexts(
    docs: DataFrame, images: DataFrame, budget: int = K.IMAGE_CONTEXT, suffixes: Sequence[str] = K.IMAGE_SUFFIXES
) -> DataFrame:
    """``images(doc_id, name)`` of a known type with the context of their first reference.

    Images no document refers to drop out. Names are compared whole, suffixes without case.
    """
    suffix = F.lower(F.regexp_extract("name", r"^.+(\.[^.]+)$", 1))
    known = images.where(suffix.isin(*suffixes)).select("doc_id", "name").distinct()
    return known.join(referenced_contexts(docs, budget), ["doc_id", "name"])


def rewrite_images(docs: DataFrame, images: DataFrame) -> DataFrame:
    """``![alt](path)`` becomes ``![summary](url)`` where ``images(doc_id, name, summary, url)``
    knows the name. Only images a document refers to travel to it."""
    wanted = reference_lines(docs).select("doc_id", "name").distinct()
    used = first_per_key(
        wanted.join(images.select("doc_id", "name", "summary", "url"), ["doc_id", "name"]),
        ["doc_id", "name"], [F.col("url"), F.col("summary")],
    )
    # Bounded by the references inside one document, which is a single row itself.
    known = used.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("name", F.struct("summary", "url")))).alias("_known")
    )
    pattern = r"!\[[^\n]*?\]\([^\n]*?\)"

    def woven(b: Column) -> Column:
        def render(z: Column) -> Column:
            hit = F.try_element_at(b["known"], base_name(F.regexp_extract(z["m"], IMAGE, 1)))
            return let(hit, lambda h: F.concat(
                z["t"],
                F.when(h.isNull(), text_or_empty(z["m"])).otherwise(
                    F.concat(F.lit("!["), text_or_empty(h["summary"]), F.lit("]("), text_or_empty(h["url"]), F.lit(")"))
                ),
            ))

        return F.array_join(
            F.transform(F.arrays_zip(b["texts"].alias("t"), b["marks"].alias("m")), render), ""
        )

    rewritten = let(
        F.struct(
            F.split("md_content", pattern, -1).alias("texts"),
            F.regexp_extract_all("md_content", F.lit(pattern), F.lit(0)).alias("marks"),
            F.col("_known").alias("known"),
        ),
        woven,
    )
    # Documents without an image reference skip the join, and with it the shuffle of their text.
    refers = F.coalesce(F.col("md_content").contains("!["), F.lit(False))
    joined = docs.where(refers).join(known, "doc_id", "left")
    changed = joined.withColumn(
        "md_content", F.when(F.col("_known").isNull(), F.col("md_content")).otherwise(rewritten)
    ).drop("_known")
    return changed.unionByName(docs.where(~refers))
