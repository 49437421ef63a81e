"""Chat formatting: conversations rendered by a compiled template, with spans for the loss mask.

Control strings inside roles and texts are escaped with backslashes, so that the formatted text
can be read back exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .template import as_text, compile_template

TEMPLATE = (
    "{% for turn in turns %}"
    "### {{ turn.title | label }}: "
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}{% else %}{{ turn.text | escape }}{% endif %}"
    "</turn>\n"
    "{% endfor %}"
)

#: Possessive runs: no state is kept for each char of a long text.
_TURN = re.compile(r"### ([^\\:]*+(?:\\.[^\\:]*+)*+): ([^\\<]*+(?:\\.[^\\<]*+)*+)</turn>\n", re.S)


def escape(text: str) -> str:
    """A backslash before each backslash, `#` and `<`: no control string is left."""
    return re.sub(r"[\\#<]", r"\\\g<0>", as_text(text))


def label(text: str) -> str:
    return re.sub(r"[\\#<:]", r"\\\g<0>", as_text(text))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS = {"escape": escape, "label": label}


def title(role: str) -> str:
    """First letter of a lower-case ASCII role in upper case; a mark keeps other roles apart."""
    return role[0].upper() + role[1:] if role[:1].isascii() and role[:1].islower() else "=" + role


def role_of(shown: str) -> str:
    return shown[1:] if shown[:1] == "=" else shown[:1].lower() + shown[1:]


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError("not a formatted conversation")
        out.append((role_of(unescape(found[1])), unescape(found[2])))
        at = found.end()
    return out


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, formatted, loss_spans) from rows (conv_id, turn, role, text).

    Turns stand by number (null first), ties by role and text; repeated rows are repeated
    turns.  A null text or role counts as empty; a null conv_id is a conversation; ids are of any
    type that can be grouped by.  loss_spans:
    array of (start, end) in code points, the assistant's texts as escaped.  A conversation
    becomes one text, so its turns meet in one task.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns")).select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    out = T.StructType([T.StructField("conv_id", turns.schema["conv_id"].dataType), *T.StructType.fromDDL("formatted string, loss_spans array<struct<start:long,end:long>>").fields])
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        show = compile_template(template, FILTERS)
        for batch in batches:
            made = [show(turns=[{"role": r, "title": title(r), "text": t} for r, t in zip(roles, texts, strict=True)]) for roles, texts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            marked = pa.array([[{"start": a, "end": b} for a, b in own] for _, own in made], spans)
            # the id stays in Arrow: numbers beside a null stay whole
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text for text, _ in made], pa.string()), marked], names=out.names)

    return whole.mapInArrow(render, out)
