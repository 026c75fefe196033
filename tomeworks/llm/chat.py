"""Chat formatting of heterogeneous records, in DataFrame functions only.

A record is a variant value of any layout: a prompt with a completion, an instruction with an input, a
list of messages under any name. Its *schema fingerprint* is the hash of its nested field paths; it
selects the declared layout with the same fingerprint, and the layout's mapping turns the record into
canonical turns (role, text). Records of no declared layout keep ``layout`` and ``turns`` null.

``format_turns`` renders turns with marks around role and text. Control strings inside them (the marks
and those of common chat templates) are broken up by an escape after their first character, and the escape
character itself is escaped, so ``parse`` gets back every turn exactly. The loss mask is run-length
coded: consecutive stretches of the formatted text with their code points and whether they are learned.

Edge cases: null roles and texts are empty; null or unparsable records have null turns; a record without
turns is the empty text. Turns keep their order; of equal turn numbers the order is by role, then text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
ESCAPE = "␛"

#: Strings that some chat template gives a meaning.
CONTROL = (OPEN, MIDDLE, "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

TURNS = "array<struct<role:string,text:string>>"


# --- Layouts ----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Layout:
    """How records with the field paths of one of ``samples`` (JSON) become turns.

    Either ``messages`` is the path of a list whose elements have ``role`` and ``text`` fields, or
    ``fields`` names the role of each path in order; paths of one role that follow each other are
    joined by ``joiner``, empty ones left out.
    """

    name: str
    samples: tuple[str, ...]
    messages: str | None = None
    role: str = "role"
    text: str = "content"
    roles: dict[str, str] = field(default_factory=dict)
    fields: tuple[tuple[str, str], ...] = ()
    joiner: str = "\n\n"

    def turns(self, record: Column) -> Column:
        if self.messages is not None:
            kind = f"array<struct<`{self.role}`:string,`{self.text}`:string>>"
            return F.transform(F.variant_get(record, self.messages, kind), lambda m: F.struct(
                self._canonical(F.coalesce(m[self.role], F.lit(""))).alias("role"), F.coalesce(m[self.text], F.lit("")).alias("text")))
        groups: list[tuple[str, list[Column]]] = []
        for path, role in self.fields:
            value = F.nullif(F.coalesce(F.variant_get(record, path, "string"), F.lit("")), F.lit(""))
            if groups and groups[-1][0] == role:
                groups[-1][1].append(value)
            else:
                groups.append((role, [value]))
        made = [F.struct(F.lit(role).alias("role"), F.concat_ws(self.joiner, *values).alias("text")) for role, values in groups]
        return F.filter(F.array(*made), lambda t: (t["role"] != "system") | (t["text"] != ""))

    def _canonical(self, role: Column) -> Column:
        for name, to in self.roles.items():
            role = F.when(role == name, to).otherwise(role)
        return role


SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

LAYOUTS = (
    Layout("messages", ('{"messages": [{"role": "", "content": ""}]}',), messages="$.messages", roles=SPEAKERS),
    Layout("rows", ('{"messages": [{"role": "", "text": ""}]}',), messages="$.messages", text="text", roles=SPEAKERS),
    Layout("conversations", ('{"conversations": [{"from": "", "value": ""}]}',), messages="$.conversations", role="from", text="value", roles=SPEAKERS),
    Layout("instruction", ('{"instruction": "", "input": "", "output": ""}', '{"instruction": "", "output": ""}', '{"instruction": "", "input": "", "output": "", "system": ""}'),
           fields=(("$.system", "system"), ("$.instruction", "user"), ("$.input", "user"), ("$.output", "assistant"))),
    Layout("prompt", ('{"prompt": "", "completion": ""}', '{"system": "", "prompt": "", "completion": ""}'),
           fields=(("$.system", "system"), ("$.prompt", "user"), ("$.completion", "assistant"))),
    Layout("question", ('{"question": "", "answer": ""}', '{"context": "", "question": "", "answer": ""}'),
           fields=(("$.context", "user"), ("$.question", "user"), ("$.answer", "assistant"))),
)


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a variant; values and the order of fields do not matter."""
    leaf = r": (?:STRING|VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|DATE|VARIANT|BINARY|TIMESTAMP(?:_NTZ)?|DECIMAL\([0-9]+,[0-9]+\))(?=[,>])"
    return F.sha2(F.regexp_replace(F.schema_of_variant(record), leaf, ""), 256)


def canonical(df: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``df`` with ``layout`` (its name) and ``turns`` of the variant column ``record``; columns of
    these names are replaced. JSON text is a variant after ``try_parse_json``."""
    kept = [c for c in df.columns if c not in ("layout", "turns")]
    value, mark = F.col(record), F.col("_fingerprint")
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in layouts:
        own = mark.isin(*[fingerprint(F.parse_json(F.lit(s))) for s in layout.samples])
        name, turns = F.when(own, layout.name).otherwise(name), F.when(own, layout.turns(value)).otherwise(turns)
    return df.select(*[c for c in {*kept, record}], fingerprint(value).alias("_fingerprint")).select(*kept, name.alias("layout"), turns.alias("turns"))


# --- Template ---------------------------------------------------------------------------------

def escaped(text: Column) -> Column:
    broken = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)
    return F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), broken, f"$0{ESCAPE}1")


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + "1"), F.lit("")), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def format_turns(df: DataFrame, turns: str = "turns", learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``df`` with ``formatted`` and ``loss_runs`` (``chars``, ``learned``); columns of these names are
    replaced. Texts of the ``learned`` roles are under the mask, marks and roles never."""
    kept = [c for c in df.columns if c not in ("formatted", "loss_runs")]
    safe = F.transform(turns, lambda t: F.struct(escaped(t["role"]).alias("role"), escaped(t["text"]).alias("text"), t["role"].isin(*learned).alias("learned")))
    out = df.select(*kept, safe.alias("_safe"))
    body = F.transform("_safe", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE)))

    def run(chars: Column, on: Column) -> Column:
        return F.struct(chars.cast("bigint").alias("chars"), on.alias("learned"))

    runs = F.flatten(F.transform("_safe", lambda t: F.array(
        run(F.length(t["role"]) + len(OPEN + MIDDLE), F.lit(False)), run(F.length(t["text"]), t["learned"]), run(F.lit(len(CLOSE)), F.lit(False)))))
    return out.select(*kept, F.array_join(body, "").alias("formatted"), runs.alias("loss_runs"))


def parse(df: DataFrame, formatted: str = "formatted", loss_runs: str = "loss_runs") -> DataFrame:
    """``df`` with ``turns`` and ``loss_texts`` (the texts under the mask, in order) read from the
    formatted text and its mask; columns of these names are replaced. A mask that does not fit ends the job."""
    kept = [c for c in df.columns if c not in ("turns", "loss_texts")]
    pieces = F.split(formatted, rf"\Q{CLOSE}\E", -1)
    head = df.select(*kept, F.slice(pieces, 1, F.size(pieces) - 1).alias("_pieces"))

    def halves(piece: Column) -> Column:
        role = F.substring_index(piece, MIDDLE, 1)
        return F.struct(F.substring(role, F.lit(len(OPEN) + 1), F.length(role)).alias("role"),
                        F.substring(piece, F.length(role) + len(MIDDLE) + 1, F.length(piece)).alias("text"))

    read = head.select(*kept, F.transform("_pieces", halves).alias("_read"))
    runs = F.col(loss_runs)

    def under(turn: Column, i: Column) -> Column:
        of = F.get(runs, 3 * i + 1)
        fits = (F.length(turn["text"]) == of["chars"]) & (F.size(runs) == 3 * F.size("_read"))
        return F.when(fits, F.when(of["learned"], unescaped(turn["text"]))).otherwise(F.raise_error(F.lit("the loss mask does not fit")))

    return read.select(
        *kept, F.transform("_read", lambda t: F.struct(unescaped(t["role"]).alias("role"), unescaped(t["text"]).alias("text"))).alias("turns"),
        F.filter(F.transform("_read", under), lambda t: t.isNotNull()).alias("loss_texts"))


def from_rows(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One record ``(key, record)`` per key from a table with one row per turn."""
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = F.transform(F.sort_array(F.collect_list(row)), lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
    return df.groupBy(key).agg(rows.alias("_rows")).select(key, F.to_variant_object(F.struct(F.col("_rows").alias("messages"))).alias("record"))
