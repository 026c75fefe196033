"""Markdown documents to titled chunks.

A document is one row from beginning to end: its sections stay in an array until the last
step, so the whole path is map-only and shuffles nothing. Only tables visit Python, and only their
own text is sent there.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomeworks import constants as K
from tomeworks.functions.text import let, nz, strip, strip_left, strip_right, text_or_empty
from tomeworks.operators.splitter import pieces_of
from tomeworks.operators.tables import linearize_text

# Whitespace inside a line, as Python sees it. A plain class: no group to recurse into.
_BLANK = r"[\s\x1c-\x1f&&[^\n]]"
_FENCE_LINE = rf"^{_BLANK}*+(?:```|~~~)[^\n]*+"
# A fenced stretch: from its opening line to the next fence line, or to the end.
FENCED = rf"(?mdU){_FENCE_LINE}(?s:.*?{_FENCE_LINE}|.*)"
HEADING = rf"(?mdU)^{_BLANK}*+#{{1,6}}{_BLANK}+[^\n]+$"
# Marks where a section starts; a pair of control characters that text files do not contain.
_MARK = "\x01\x02"

SECTION = "struct<title:string,parent_title:string,body:string>"
SECTIONS = f"array<{SECTION}>"


def normalize_newlines(md: Column) -> Column:
    return F.regexp_replace(text_or_empty(md), r"\r\n?", "\n")


def _segments(md: Column) -> Column:
    """The text cut before every heading line that is not inside a fence."""
    def mark(b: Column) -> Column:
        woven = F.transform(
            F.arrays_zip(b["outside"].alias("o"), b["fenced"].alias("f")),
            lambda z: F.concat(F.regexp_replace(z["o"], HEADING, _MARK + "$0"), text_or_empty(z["f"])),
        )
        return F.split(F.array_join(woven, ""), _MARK, -1)

    return let(
        normalize_newlines(md),
        lambda t: let(
            F.struct(
                F.split(t, FENCED, -1).alias("outside"),
                F.regexp_extract_all(t, F.lit(FENCED), F.lit(0)).alias("fenced"),
            ),
            mark,
        ),
    )


def _with_parents(headed: Column) -> Column:
    """Parent of each headed segment: the nearest earlier heading of a smaller level."""
    zero = F.struct(
        F.array_repeat(F.lit(""), 6).alias("path"),
        F.array().cast(SECTIONS).alias("out"),
    )

    def step(acc: Column, segment: Column) -> Column:
        def place(s: Column) -> Column:
            above = F.slice(acc["path"], F.lit(1), s["level"] - 1)
            parent = F.try_element_at(F.filter(above, lambda t: t != ""), F.lit(-1))
            section = F.struct(
                s["title"].alias("title"),
                F.coalesce(parent, s["title"]).alias("parent_title"),
                s["body"].alias("body"),
            )
            path = F.concat(above, F.array(s["title"]), F.array_repeat(F.lit(""), F.lit(6) - s["level"]))
            return F.struct(path.alias("path"), F.concat(acc["out"], F.array(section)).alias("out"))

        title = strip(F.substring_index(segment, "\n", 1))
        rest = F.substring(segment, F.length(F.substring_index(segment, "\n", 1)) + 1, F.length(segment))
        return let(
            F.struct(title.alias("title"), strip(rest).alias("body")),
            lambda s: let(
                F.struct(
                    F.length(F.regexp_extract(s["title"], "^#{1,6}", 0)).alias("level"),
                    s["title"].alias("title"),
                    s["body"].alias("body"),
                ),
                place,
            ),
        )

    return F.aggregate(headed, zero, step, lambda acc: acc["out"])


def sections_of(md: Column, file_title: Column) -> Column:
    """Sections of one document, text before the first heading under the file title."""
    def build(segments: Column) -> Column:
        preamble = strip(F.get(segments, F.lit(0)))
        opening = F.when(
            preamble != "",
            F.array(F.struct(
                text_or_empty(file_title).alias("title"),
                text_or_empty(file_title).alias("parent_title"),
                preamble.alias("body"),
            )),
        ).otherwise(F.array().cast(SECTIONS))
        headed = F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0)))
        return F.concat(opening, _with_parents(headed))

    return let(_segments(md), build)


def split_sections(docs: DataFrame) -> DataFrame:
    """``doc_id, file_title, md_content`` to ``doc_id, file_title, sections``."""
    return docs.select(
        "doc_id", "file_title", sections_of(F.col("md_content"), F.col("file_title")).alias("sections")
    )


def _replace_bodies(sections: Column, bodies: Column) -> Column:
    return F.transform(
        F.arrays_zip(sections.alias("s"), bodies.alias("b")),
        lambda z: F.struct(
            z["s"]["title"].alias("title"),
            z["s"]["parent_title"].alias("parent_title"),
            F.coalesce(z["b"], z["s"]["body"]).alias("body"),
        ),
    )


@F.pandas_udf(T.ArrayType(T.StringType()))
def _linearized(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda row: None if row is None else [b if b is None else linearize_text(b) for b in row])


def linearize_tables(docs: DataFrame, gate: str = "literal") -> DataFrame:
    """Rewrite tables in section bodies as sentences.

    ``gate='literal'`` touches bodies holding the plain tag ``<table>``; ``'any'`` also tables
    with attributes and Markdown tables. Other bodies stay in the JVM.
    """
    def has_table(body: Column) -> Column:
        if gate == "literal":
            return body.contains("<table>")
        return body.rlike(r"(?i)<table") | body.rlike(r"(?m)^[ \t]*\|.*\|[ \t]*$")

    held = F.transform("sections", lambda s: F.when(has_table(s["body"]), s["body"]))
    wanted = F.when(F.exists("sections", lambda s: has_table(s["body"])), held)
    done = docs.withColumn("_bodies", _linearized(wanted))
    merged = F.when(F.col("_bodies").isNull(), F.col("sections")).otherwise(
        _replace_bodies(F.col("sections"), F.col("_bodies"))
    )
    return done.withColumn("sections", merged).drop("_bodies")


def _room(title: Column, max_len: int) -> Column:
    """Characters left for a body after the title prefix."""
    return F.lit(max_len - 2) - F.least(F.length(title), F.lit(K.TITLE_PREFIX))


# Non-deterministic, so that no filter on a section evaluates it a second time.
_linearized = _linearized.asNondeterministic()


def split_long(docs: DataFrame, max_len: int = K.MAX_SECTION) -> DataFrame:
    """Cut sections that exceed ``max_len`` with their title into numbered sub-sections."""
    if max_len <= 0:
        raise ValueError("max_len must be positive")

    def numbered(s: Column, pieces: Column) -> Column:
        made = F.transform(
            pieces,
            lambda body, i: F.struct(
                F.concat(F.substring(s["title"], 1, K.TITLE_PREFIX), F.lit("_"), (i + 1).cast("string")).alias("title"),
                s["parent_title"].alias("parent_title"),
                body.alias("body"),
            ),
        )
        return F.when(F.size(pieces) > 1, made).otherwise(F.array(s))

    def cut(s: Column) -> Column:
        room = _room(s["title"], max_len)
        too_long = (F.length(s["body"]) > room) & (room > 0)
        return F.when(too_long, let(pieces_of(s["body"], room, K.SPLIT_SEPARATORS), lambda p: numbered(s, p))).otherwise(F.array(s))

    return docs.withColumn("sections", F.flatten(F.transform("sections", cut)))


def merged_sections(sections: Column, min_len: int) -> Column:
    """Left fold: a body shorter than ``min_len`` takes in the next one under the same parent."""
    zero = F.struct(F.array().cast(SECTIONS).alias("done"), F.lit(None).cast(SECTION).alias("open"))

    def step(acc: Column, nxt: Column) -> Column:
        open_ = acc["open"]
        joined = F.struct(
            open_["parent_title"].alias("title"),
            open_["parent_title"].alias("parent_title"),
            F.concat(strip_right(open_["body"]), F.lit("\n\n"), strip_left(nxt["body"])).alias("body"),
        )
        absorb = (open_["parent_title"] == nxt["parent_title"]) & (F.length(open_["body"]) < min_len)
        return (
            F.when(open_.isNull(), F.struct(acc["done"].alias("done"), nxt.alias("open")))
            .when(absorb, F.struct(acc["done"].alias("done"), joined.alias("open")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(open_)).alias("done"), nxt.alias("open")))
        )

    return F.aggregate(
        sections, zero, step,
        lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))),
    )


def merge_short(docs: DataFrame, min_len: int = K.MIN_SECTION) -> DataFrame:
    if min_len <= 0:
        raise ValueError("min_len must be positive")
    return docs.withColumn("sections", merged_sections(F.col("sections"), min_len))


def explode_sections(docs: DataFrame) -> DataFrame:
    # The outer form: a plain explode makes Spark infer ``size(sections) > 0`` and evaluate the
    # whole section expression a second time in a filter below it.
    rows = docs.select("doc_id", "file_title", F.posexplode_outer("sections").alias("pos", "s"))
    return rows.where(F.col("pos").isNotNull()).select(
        "doc_id", "file_title", "pos", "s.title", "s.parent_title", "s.body"
    )


def assemble_chunks(docs: DataFrame) -> DataFrame:
    """One row per chunk, with an id that depends on the document and position only."""
    rows = explode_sections(docs)
    return rows.select(
        F.xxhash64("doc_id", "file_title", "pos").alias("chunk_id"),
        "doc_id",
        "pos",
        F.concat(F.col("title"), F.lit("\n\n"), F.col("body")).alias("content"),
        "title",
        "parent_title",
        "file_title",
    )


def import_chunks(
    docs: DataFrame, max_len: int = K.MAX_SECTION, min_len: int = K.MIN_SECTION, table_gate: str = "literal"
) -> DataFrame:
    """Documents to chunks: sections, tables, long sections, short sections."""
    if max_len < min_len:
        raise ValueError("max_len must not be below min_len")
    sections = linearize_tables(split_sections(docs), table_gate)
    return assemble_chunks(merge_short(split_long(sections, max_len), min_len))


def item_name_requests(chunks: DataFrame, k: int = 3) -> DataFrame:
    """Request text per document from its first ``k`` chunks, for an item-name model."""
    from tomeworks.operators.sampling import first_per_key

    if k <= 0:
        raise ValueError("k must be positive")
    first = first_per_key(chunks, ["doc_id"], [F.col("pos")], k)
    lines = F.array_sort(F.collect_list(F.struct("_rank", "content")))
    text = F.array_join(
        F.transform(lines, lambda r: F.concat(F.lit("【切片]】 - f"), (r["_rank"] - 1).cast("string"),
                                              F.lit(" - "), text_or_empty(r["content"]))),
        "\n",
    )
    return first.groupBy("doc_id").agg(F.min("file_title").alias("file_title"), text.alias("context"))


def resolve_item_names(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Back-fill ``item_name`` from ``answers(doc_id, item_name)``; the file title when the
    answer is missing, empty or unknown."""
    named = answers.select("doc_id", F.col("item_name").alias("_answer"))
    name = F.coalesce(F.nullif(nz(F.col("_answer")), F.lit(K.UNKNOWN_ITEM)), F.col("file_title"))
    return chunks.drop("item_name").join(named, "doc_id", "left").withColumn("item_name", name).drop("_answer")
