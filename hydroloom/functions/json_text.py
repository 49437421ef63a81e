"""JSON with remarks and commas too many: a lexer that keeps every place, and where a text breaks off.

The lexer runs once over a text, in tokens that never overlap: strings with their escapes,
remarks, commas.  What isn't JSON becomes blanks (line ends stay), so that places in the plain
text are places in the original.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings, remarks (// and # to the line's end, /* */), and commas before a closing bracket; no token looks back.
_TOKEN = re.compile(r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|(//[^\n]*+|\#[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/)', re.S)
_COMMA = re.compile(r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|,(?=\s*+[}\]])', re.S)
_INK = re.compile(r"[^\n]")
#: Chars on each side of a place that are shown or looked at for a hint.
EXCERPT, WINDOW = 120, 80

ERROR = "error string, line int, col int, pos int, hint string, excerpt string"


def plain(text: str) -> str:
    """The text with remarks and superfluous commas blanked, as long as before."""
    bare = _TOKEN.sub(lambda m: m[0] if m[1] else _INK.sub(" ", m[0]), text)
    return _COMMA.sub(lambda m: m[0] if m[1] else " ", bare)


def hint(text: str, pos: int) -> str:
    """What authors mostly do wrong near a place."""
    near = text[max(0, pos - WINDOW) : pos + WINDOW]
    if re.search(r",\s*[}\]]", near):
        return "trailing comma"
    if "'" in near and '"' not in near:
        return "single quotes"
    return "commas, quotes or brackets"


def error_of(text: str | None, tolerant: bool) -> tuple:
    """(error, line, col, pos, hint, excerpt) of a text, all None if it is JSON; places from the decoder (lines and columns from 1)."""
    if text is None or not text.strip():
        return "empty", None, None, None, None, None
    try:
        json.loads(plain(text) if tolerant else text)
    except json.JSONDecodeError as e:
        return e.msg, e.lineno, e.colno, e.pos, hint(text, e.pos), text[max(0, e.pos - EXCERPT) : e.pos + EXCERPT]
    except RecursionError:
        return "nested too deep", None, None, None, None, None
    except ValueError as e:  # a number with more digits than are converted
        return str(e).split(";")[0], None, None, None, None, None
    return (None,) * 6


def plain_json(text: Column) -> Column:
    """JSON without remarks (// # /* */ outside strings) and without commas before a closing bracket; NULL stays."""

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if t is None else plain(t) for t in batch], dtype=object)

    return of(text)


def json_error(text: Column, tolerant: bool = True) -> Column:
    """Struct (error, line, col, pos, hint, excerpt); error is NULL for JSON, `empty` for NULL and blank texts.

    `tolerant` takes remarks and superfluous commas for blanks; else they are errors.
    """

    @F.pandas_udf(ERROR)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = pd.DataFrame([error_of(t, tolerant) for t in batch], columns=[c.split()[0] for c in ERROR.split(", ")], dtype=object)
            yield rows.astype({c: "Int32" for c in ("line", "col", "pos")})

    return of(text)


def checked_json(documents: DataFrame, column: str = "json") -> DataFrame:
    """`documents` with `valid`, whether the text is JSON to a tolerant reader, and `problem` (`empty`, `no JSON` or NULL)."""
    error = json_error(F.col(f"`{column}`"))["error"]
    problem = F.when(error == "empty", "empty").when(error.isNotNull(), "no JSON")
    return documents.withColumn("problem", problem).withColumn("valid", F.col("problem").isNull()).select(*[F.col(f"`{c}`") for c in documents.columns if c not in ("valid", "problem")], "valid", "problem")
