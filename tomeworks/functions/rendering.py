"""Rendered contexts, messages and prompt columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomeworks import constants as K
from tomeworks.functions.text import clean_content, fill, nz, strip, text_or_empty


def join_source(file_title: Column, title: Column) -> Column:
    """``file / title`` without outer blanks and slashes, NULL when nothing is left."""
    return nz(F.btrim(F.concat(text_or_empty(strip(file_title)), F.lit(" / "), text_or_empty(strip(title))),
                      F.lit(" /")))


def source_stage1() -> Column:
    title = F.coalesce(nz(F.col("title")), nz(F.col("parent_title")))
    return F.coalesce(join_source(F.col("file_title"), title), F.lit(K.UNKNOWN_SOURCE))


def source_stage2(source: Column | None = None) -> Column:
    """File, or else ``source`` where the chunks have such a column, and title."""
    title = F.coalesce(nz(F.col("title")), nz(F.col("parent_title")))
    file = F.col("file_title") if source is None else F.coalesce(nz(F.col("file_title")), source)
    return F.coalesce(join_source(file, title), nz(F.col("item_name")), F.lit(K.UNKNOWN_SOURCE))


def item_key() -> Column:
    """Item name, else file title, else the unknown item."""
    return F.coalesce(nz(F.col("item_name")), nz(F.col("file_title")), F.lit(K.UNKNOWN_ITEM))


def context_from_chunk(source: Column | None = None) -> Column:
    """Messages context of a chunk row: cleaned text, source, chunk id, item."""
    return F.struct(
        clean_content(F.col("content")).alias("text"),
        source_stage2(source).alias("source"),
        F.col("chunk_id").cast("bigint").alias("chunk_id"),
        text_or_empty(F.col("item_name")).alias("item_name"),
    )


def render_contexts_c(contexts: Column) -> Column:
    """``[C1] source`` blocks from ``cid, source, text``."""
    blocks = F.transform(
        contexts,
        lambda c: F.concat(
            F.lit("["), text_or_empty(c["cid"]), F.lit("] " + K.SOURCE_LABEL),
            F.coalesce(c["source"], F.lit(K.UNKNOWN_SOURCE)), F.lit("\n"), text_or_empty(c["text"]),
        ),
    )
    return F.coalesce(nz(strip(F.array_join(blocks, "\n\n"))), F.lit(K.NO_CONTEXT))


def render_contexts_n(contexts: Column) -> Column:
    """``[1] source`` blocks, numbered by position."""
    blocks = F.transform(
        contexts,
        lambda c, i: F.concat(
            F.lit("["), (i + 1).cast("string"), F.lit("] " + K.SOURCE_LABEL),
            F.coalesce(nz(c["source"]), F.lit(K.UNKNOWN_SOURCE)), F.lit("\n"), text_or_empty(c["text"]),
        ),
    )
    return F.array_join(blocks, "\n\n")


def user_message(rendered: Column, question: Column) -> Column:
    return F.concat(
        F.lit(K.CONTEXT_SECTION + "\n"), rendered, F.lit("\n\n" + K.QUESTION_SECTION + "\n"),
        text_or_empty(question),
    )


def messages(system: str, user: Column, answer: Column) -> Column:
    turns = (("system", F.lit(system)), ("user", user), ("assistant", text_or_empty(answer)))
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in turns])


def turn(messages_col: Column, index: int) -> Column:
    return text_or_empty(F.get(messages_col, F.lit(index))["content"])


def roles(messages_col: Column) -> Column:
    return F.transform(messages_col, lambda m: text_or_empty(m["role"]))


def roles_valid(messages_col: Column) -> Column:
    wanted = F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    return F.coalesce(roles(messages_col) == wanted, F.lit(False))


def prompt_messages(messages_col: Column) -> Column:
    """Everything but the answer."""
    return F.filter(messages_col, lambda m: m["role"] != "assistant")


def capabilities(kind: Column, mapping: Mapping[str, Sequence[str]]) -> Column:
    out = F.lit(None).cast("array<string>")
    for name, caps in mapping.items():
        out = F.when(kind == name, F.array(*[F.lit(c) for c in caps])).otherwise(out)
    return F.coalesce(out, F.array().cast("array<string>"))


def rendered_length(question: Column, answer: Column, contexts: Column) -> Column:
    texts = F.array_join(F.transform(contexts, lambda c: text_or_empty(c["text"])), "")
    return F.length(text_or_empty(question)) + F.length(text_or_empty(answer)) + F.length(text_or_empty(texts))


def messages_length(messages_col: Column) -> Column:
    return F.length(F.array_join(F.transform(messages_col, lambda m: text_or_empty(m["content"])), ""))


def context_sources(contexts: Column) -> Column:
    return F.transform(
        contexts,
        lambda c, i: F.struct(
            (i + 1).alias("rank"), c["chunk_id"].alias("chunk_id"), c["title"].alias("title"),
            c["file_title"].alias("file_title"), c["score"].alias("score"),
        ),
    )


def render_prompt(template: str, **columns: Column) -> Column:
    """A prompt column from a caller's template; the model call stays outside."""
    return fill(template, **columns)


def numbered_texts(contexts: Column) -> Column:
    """``[1] text`` lines, the material block of a generation prompt."""
    return F.array_join(
        F.transform(contexts, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c["text"])),
        "\n",
    )
