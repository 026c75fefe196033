"""Text columns: whitespace, citations, numbers, sentences, cleaning, redaction."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomeworks import constants as K

NUMBER = r"\p{Nd}+(?:\.\p{Nd}+)?"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``. Inside a lambda Spark would otherwise evaluate an
    outer expression again for every array element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def nz(value: Column) -> Column:
    """NULL for the empty string, so that ``coalesce`` falls through like ``or``."""
    return F.nullif(value, F.lit(""))


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(K.WHITESPACE))


def strip_left(value: Column) -> Column:
    return F.ltrim(value, F.lit(K.WHITESPACE))


def strip_right(value: Column) -> Column:
    return F.rtrim(value, F.lit(K.WHITESPACE))


def matches(value: Column, pattern: str, group: int = 0) -> Column:
    """All matches in order; an empty array for NULL text."""
    return F.regexp_extract_all(text_or_empty(value), F.lit(pattern), F.lit(group))


def match_set(value: Column, pattern: str, group: int = 0) -> Column:
    return F.array_sort(F.array_distinct(matches(value, pattern, group)))


def citations_c(value: Column) -> Column:
    """Citations written ``[C12]``, as ``C12``."""
    return match_set(value, r"\[(C\p{Nd}+)\]", 1)


def citations_n(value: Column) -> Column:
    """Citations written ``[12]``, as ``12``."""
    return match_set(value, r"\[(\p{Nd}+)\]", 1)


def citations_any(value: Column) -> Column:
    """Citations of either form as numbers, in string order."""
    return match_set(value, r"\[(?:C)?(\p{Nd}+)\]", 1)


def available_citations(user: Column) -> Column:
    """Numbers a user message offers: ``[n]`` at the start of a line."""
    return match_set(user, r"(?md)^\[(\p{Nd}+)\]", 1)


def numbers_in(value: Column) -> Column:
    return match_set(value, NUMBER)


def has_number(value: Column) -> Column:
    return text_or_empty(value).rlike(r"\p{Nd}")


def contains_any(value: Column, words: Iterable[str]) -> Column:
    """One alternation of quoted words, compiled once per task."""
    return text_or_empty(value).rlike("|".join(re.escape(w) for w in words))


def is_refusal(value: Column, cues: Iterable[str] = K.REFUSAL_CUES) -> Column:
    return contains_any(value, cues)


def is_subset(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def fingerprint(question: Column, texts: Column) -> Column:
    """md5 over the question and the sorted context texts."""
    body = F.array_join(F.array_sort(F.transform(texts, text_or_empty)), "||")
    return F.md5(F.concat(text_or_empty(question), F.lit("||"), text_or_empty(body)))


def message_fingerprint(user: Column) -> Column:
    """The same over a rendered user message, which serves as question and as text."""
    return F.md5(F.concat_ws("||", text_or_empty(user), text_or_empty(user)))


def clean_content(value: Column) -> Column:
    """Without Markdown images, bare URLs and runs of blank lines. Texts that have none are only stripped."""
    out = F.regexp_replace(text_or_empty(value), r"!\[[^\]]*\]\([^)]*\)", "")
    out = F.regexp_replace(out, r"(?U)https?://[^\s\x1c-\x1f]+", "")
    out = F.regexp_replace(out, r"[ \t]*\n{3,}[ \t]*", "\n\n")
    some = value.contains("![") | value.contains("http") | value.contains("\n\n\n")
    return F.when(some, strip(out)).otherwise(strip(text_or_empty(value)))


def first_sentences(value: Column, n: int) -> Column:
    """The first ``n`` pieces ending in ``。 ! ?`` or a newline; all of it if there are fewer."""
    pattern = rf"(?s)^(?:(?:[^。!?\n]*[。!?\n]){{{n}}}|.*)"
    return strip(F.regexp_extract(strip(text_or_empty(value)), pattern, 0))


def format_subtype(value: Column) -> Column:
    numbered = text_or_empty(value).rlike(r"(?U)(^|\n)[\s\x1c-\x1f]*\p{Nd}+[.、)]")
    return (
        F.when(contains_any(value, K.TROUBLESHOOTING_WORDS), "troubleshooting")
        .when(contains_any(value, K.STEP_WORDS) | numbered, "steps")
        .otherwise("definition")
    )


def question_of(user: Column) -> Column:
    """What follows the first question mark-up of a user message; empty without it."""
    mark = K.QUESTION_SECTION
    start = F.locate(mark, text_or_empty(user))
    return F.when(start > 0, strip(F.substring(user, start + len(mark), F.length(user)))).otherwise("")


def clean_question(value: Column) -> Column:
    """Generated question text without a leading label."""
    out = F.regexp_replace(strip(text_or_empty(value)), r"^问题：", "")
    return strip(F.regexp_replace(out, r"^问题:", ""))


def hash_text(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text_or_empty(value), 256))


def truncate(value: Column, max_chars: int) -> Column:
    v = text_or_empty(value)
    cut = F.concat(F.substring(v, 1, max_chars), F.lit("...[truncated]"))
    return F.when(F.length(v) <= max_chars, v).otherwise(cut)


def fill(template: str, **values: Column) -> Column:
    """A template with ``{name}`` slots as one concat. Values are never scanned for slots."""
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if re.fullmatch(r"\{\w+\}", piece):
            parts.append(text_or_empty(values[piece[1:-1]].cast("string")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def unit_fraction(hex_hash: Column, size: Column) -> Column:
    """Index in ``[0, size)`` taken from the first eight hex digits of a hash."""
    return F.pmod(F.conv(F.substring(hex_hash, 1, 8), 16, 10).cast("bigint"), size)


def one_place(x: Column) -> Column:
    """A non-negative double with one decimal place, rounded by its exact binary value.

    ``20 x`` tells on which side of a half the value lies. It is kept as a double and its
    rounding error, so that 23.05 (a little above) and 18.15 (a little below) go different ways.
    """
    def tenths(b: Column) -> Column:
        side = (b["s"] - b["m"]) + (b["x"] * 4 - (b["s"] - b["x"] * 16))
        low = ((b["m"] - 1) / 2).cast("bigint")
        half = (F.abs(b["s"] - b["m"]) < 1e-6) & (F.pmod(b["m"].cast("bigint"), F.lit(2)) == 1)
        at_half = F.when(side > 0, low + 1).when(side < 0, low).otherwise(low + F.pmod(low, F.lit(2)))
        return F.when(half, at_half).otherwise(F.rint(b["x"] * 10).cast("bigint"))

    s = x * 16 + x * 4
    return let(
        let(F.struct(x.alias("x"), s.alias("s"), F.rint(s).alias("m")), tenths),
        lambda n: F.concat(F.floor(n / 10).cast("string"), F.lit("."), F.pmod(n, F.lit(10)).cast("string")),
    )


def perturb_number(value: Column, pick: Column) -> Column:
    """Change one number of a text: ``struct(text, old, new)``, NULL when there is none to change.

    Numbers of at most six characters qualify, those of two or more are preferred; ``pick``
    (a hex hash) chooses among them. Below ten the value doubles, otherwise it grows by half,
    rounded half-even and at least one. Integers stay integers, decimals keep one place.
    """

    def changed(old: Column) -> Column:
        v = F.translate(old, "０１２３４５６７８９", "0123456789").try_cast("double")
        new = F.when(v < 10, v * 2).otherwise(v + F.greatest(F.lit(1.0), F.bround(v * 0.5)))
        return F.when(old.contains("."), one_place(new)).otherwise(
            new.cast("bigint").cast("string")
        )

    def rebuild(b: Column) -> Column:
        nums, pieces, at = b["nums"], b["pieces"], b["at"]
        return let(
            F.struct(nums.alias("nums"), pieces.alias("pieces"), at.alias("at"),
                     changed(F.get(nums, at)).alias("new")),
            lambda c: F.struct(
                F.array_join(
                    F.transform(
                        F.arrays_zip(c["pieces"].alias("p"), c["nums"].alias("n")),
                        lambda z, i: F.concat(
                            z["p"], F.when(i == c["at"], c["new"]).otherwise(text_or_empty(z["n"]))
                        ),
                    ),
                    "",
                ).alias("text"),
                F.get(c["nums"], c["at"]).alias("old"),
                c["new"].alias("new"),
            ),
        )

    def choose(b: Column) -> Column:
        def indices(low: int) -> Column:
            sized = F.transform(
                b["nums"],
                lambda n, i: F.when(F.length(n).between(low, 6), i),
            )
            return F.filter(sized, lambda i: i.isNotNull())

        pool = let(
            F.struct(indices(2).alias("long"), indices(1).alias("any")),
            lambda p: F.when(F.size(p["long"]) > 0, p["long"]).otherwise(p["any"]),
        )
        return let(
            pool,
            lambda p: F.when(
                F.size(p) > 0,
                rebuild(F.struct(
                    b["nums"].alias("nums"),
                    b["pieces"].alias("pieces"),
                    F.get(p, unit_fraction(b["pick"], F.size(p)).cast("int")).alias("at"),
                )),
            ),
        )

    return let(
        F.struct(
            matches(value, NUMBER).alias("nums"),
            F.split(text_or_empty(value), NUMBER, -1).alias("pieces"),
            pick.alias("pick"),
        ),
        choose,
    )


def parse_model_json(value: Column, schema: str) -> Column:
    """Lenient JSON object from generated text: fences removed, then the outermost braces;
    NULL when that is not JSON."""
    bare = F.regexp_replace(text_or_empty(value), r"(?md)^```(?:json)?|```$", "")
    return let(
        F.regexp_extract(bare, r"(?s)\{.*\}", 0),
        lambda t: F.when(F.try_parse_json(nz(t)).isNotNull(), F.from_json(t, schema)),
    )
