"""Chat formatting with a grammar round trip.

The template's grammar, for a deterministic parser with one character of look-ahead:

    conversation := turn*            turn := "<s>" role "\\n" text "</s>"
    role, text   := (escape | other character)*     escape := "\\" any character

A control string (CONTROL) inside a role or a text, a new line inside a role, or an escape sign would be read as template or
lost. Each turn is rendered as it is, parsed again, and compared with its source; if they differ, the conflicting content
is escaped (a `\\` goes before every `\\`, and after the first character of every control string) until they are identical.
The loss mask covers the text between an assistant's "\\n" and "</s>".

Rendering and parsing take one turn at a time and need no order, so they run where the rows lie, however long a conversation is. Only
the digests of the recovered turns are in order: conversations are dealt out by id and sorted by turn (then role and text, so
that tied and repeated turns have one order), and tasks stream them with one turn in memory. A null text or role counts as
empty; rows with a null id form one conversation with a null id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema

BEGIN, END, BREAK, ESCAPE = "<s>", "</s>", "\n", "\\"
#: Strings that an unescaped text must not hold: this template's own and those of a widespread instruction template (fixed values).
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ANY = re.compile("|".join(map(re.escape, CONTROL)))


class GrammarError(ValueError):
    """The rendered text is not of the grammar."""


def escape(text: str, role: bool = False) -> str:
    text = _ANY.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text.replace(ESCAPE, ESCAPE * 2))
    return text.replace(BREAK, ESCAPE + BREAK) if role else text


def _field(rendered: str, at: int, stop: str) -> tuple[str, int]:
    """(unescaped content from at, place after the stop string)."""
    out, begin = [], at
    while at < len(rendered):
        if rendered[at] == ESCAPE:
            if at + 1 == len(rendered):
                raise GrammarError("an escape sign ends the text")
            out += [rendered[begin:at], rendered[at + 1]]
            at = begin = at + 2
        elif rendered.startswith(stop, at):
            return "".join([*out, rendered[begin:at]]), at + len(stop)
        elif m := _ANY.match(rendered, at):
            raise GrammarError(f"{m[0]} at {at}")
        else:
            at = min((p for c in (ESCAPE, stop[0], "<", "[") if (p := rendered.find(c, at + 1)) >= 0), default=len(rendered))
    raise GrammarError(f"no {stop!r}")


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, from, to) of every turn of a rendered conversation; from and to bound the text as rendered."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(BEGIN, at):
            raise GrammarError(f"no turn at {at}")
        role, begin = _field(rendered, at + len(BEGIN), BREAK)
        text, at = _field(rendered, begin, END)
        turns.append((role, text, begin, at - len(END)))
    return turns


def render(role: str, text: str) -> str:
    """One turn, escaped as far as the round trip asks for."""
    for own_role, own_text in ((role, text), (role, escape(text)), (escape(role, True), escape(text))):
        rendered = f"{BEGIN}{own_role}{BREAK}{own_text}{END}"
        try:
            if [t[:2] for t in parse(rendered)] == [(role, text)]:
                return rendered
        except GrammarError:
            continue
    raise GrammarError("a turn can't be rendered")


def format_turns(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, rendered, loss_from, loss_to) of every turn; a conversation is its turns' `rendered` in a row, by turn, then role and text.

    loss_from and loss_to bound an assistant's text within rendered; they are null for other roles.
    """
    ddl = "conv_id long, turn long, role string, rendered string, loss_from long, loss_to long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rendered, begin, end = [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                one = render(role, text)
                _, _, a, b = parse(one)[0]
                rendered.append(one)
                begin.append(a if role == "assistant" else None)
                end.append(b if role == "assistant" else None)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), batch.column("role").cast(pa.string()), pa.array(rendered, pa.string()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], schema=schema)

    rows = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, ddl)


def recovered_turns(formatted: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, learned, size), read from format_turns' output by its parser; learned: the text is under the loss mask; size: characters as rendered."""
    ddl = "conv_id long, turn long, role string, text string, learned boolean, size long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for rendered, a, b in zip(*(batch.column(c).to_pylist() for c in ("rendered", "loss_from", "loss_to")), strict=True):
                role, text, begin, end = parse(rendered)[0]
                if a is not None and (a, b) != (begin, end):
                    raise GrammarError("the loss mask isn't the text")
                found.append((role, text, a is not None, len(rendered)))
            columns = zip(*found, strict=True) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[2:], strict=True))], schema=schema)

    return formatted.mapInArrow(run, ddl)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of every conversation, from format_turns' output."""
    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turns, loss, counts = None, None, None, [0, 0, 0]

        def row() -> tuple:
            return conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]

        for batch in batches:
            done = []
            for own, role, text, learned, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "learned", "size")), strict=True):
                if turns is None or own != conv:
                    if turns is not None:
                        done.append(row())
                    conv, turns, loss, counts = own, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                turns.update(f"{role}\n{text}\n".encode())
                if learned:
                    loss.update(text.encode())
                    counts[1] += len(text)
                counts[0] += 1
                counts[2] += size
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        if turns is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row(), schema, strict=True)], schema=schema)

    return recovered_turns(formatted).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, ddl)


#: Conversation -1: control strings in both texts.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def with_probe(conversations: DataFrame) -> DataFrame:
    """conversations and the probe."""
    own = conversations.select("conv_id", "turn", "role", "text")
    return own.unionByName(own.sparkSession.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))


def _escaped(sql: str) -> str:
    out = f"replace({sql}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


def _needs(sql: str) -> str:
    return "(" + " or ".join(f"contains({sql}, '{c}')" for c in ("\\", *CONTROL)) + ")"


ORACLE = f"""
with c as (select conv_id, turn, role, text from conversations union all
           values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from c)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
       sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
       cast(sum({len(BEGIN) + len(BREAK) + len(END)} + length(role) + length(case when {_needs('text')} then {_escaped('text')} else text end)) as bigint) as formatted_chars
from t group by conv_id
"""
