"""The four column types, tagged values and the errors that everything here raises."""

from __future__ import annotations

from pyspark.sql import types as T

INT, FLOAT, TEXT, BOOL, NULL = "int", "float", "text", "bool", "null"
SPARK_TYPES = {INT: T.LongType(), FLOAT: T.DoubleType(), TEXT: T.StringType(), BOOL: T.BooleanType()}
I64_MIN, I64_MAX = -(1 << 63), (1 << 63) - 1


class EngineError(ValueError):
    """Anything an author can get wrong; the message names the thing and, where close, the right name."""


class ExprError(EngineError):
    """An expression or statement that cannot be read or typed; ``at`` is a character offset."""

    def __init__(self, message: str, at: int | None = None) -> None:
        super().__init__(message)
        self.at = at

    def with_caret(self, text: str) -> str:
        """The message above the line it is about, with a caret below the place."""
        if self.at is None:
            return str(self)
        start = text.rfind("\n", 0, self.at) + 1
        end = text.find("\n", self.at)
        line = text[start : end if end >= 0 else len(text)]
        return f"{self}\n  {line}\n  {' ' * (self.at - start)}^"


def type_of_value(value: object) -> str | None:
    """The tag of a scalar; None for what is no scalar."""
    if value is None:
        return NULL
    if isinstance(value, bool):
        return BOOL
    if isinstance(value, int):
        return INT
    if isinstance(value, float):
        return FLOAT
    return TEXT if isinstance(value, str) else None


def same_value(a: object, b: object) -> bool:
    """Equality that respects the tag: 0 and 0.0 and False are three values; NaN equals itself."""
    if type_of_value(a) != type_of_value(b):
        return False
    return a == b or (isinstance(a, float) and a != a and b != b)


def column_type(kind: T.DataType) -> str | None:
    """The engine type of a Spark type, or None where a cast has to be written out."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return FLOAT
    if isinstance(kind, T.BooleanType):
        return BOOL
    return TEXT if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)) else None


def _edits(a: str, b: str) -> int:
    """Edits between two words, where swapping neighbours is one edit."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j - 1] + 1, rows[-1][j] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def hint(name: str, known: list[str]) -> str:
    """``; did you mean ...`` where a known name is close, else what there is."""
    limit = max(1, min(2, len(name) // 3))
    near = sorted((_edits(name.lower(), k.lower()), k) for k in known)
    if near and near[0][0] <= limit:
        return f"; did you mean `{near[0][1]}`?"
    return f"; there is {', '.join(f'`{k}`' for k in known)}" if known else ""
