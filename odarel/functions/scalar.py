"""Expressions as Spark columns, with SQL's three-valued logic."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import UTC, date, datetime
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odarel.errors import ODataError
from odarel.plans.ast import Binary, Call, In, Lambda, Lit, Logic, Not, Path

_COMPARE: dict[str, Callable] = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
}
_PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}
_MIRROR = {"eq": "eq", "ne": "ne", "gt": "lt", "ge": "le", "lt": "gt", "le": "ge"}


def as_instant(text: str) -> datetime:
    """A date or date-time text in UTC; midnight for a date, UTC where no offset is given."""
    found = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return found.replace(tzinfo=UTC) if found.tzinfo is None else found.astimezone(UTC)


def _timestamp(moment: datetime, kind: T.DataType | None) -> Column:
    plain = moment.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(kind, T.TimestampNTZType):
        return F.lit(plain).cast("timestamp_ntz")
    return F.lit(f"{plain}+00:00").cast("timestamp")


def literal(lit: Lit, kind: T.DataType | None = None) -> Column:
    """The literal as a column of the type that it is compared with."""
    value = lit.value
    if value is None:
        return F.lit(None)
    bad = ODataError(f"{value!r} doesn't fit a column of type {kind.simpleString() if kind else '?'}")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        if lit.kind not in ("date", "datetime", "string"):
            raise bad
        try:
            return _timestamp(as_instant(value), kind)
        except ValueError:
            raise ODataError(f"invalid date-time {value!r}", code="invalid-datetimeoffset-literal") from None
    if isinstance(kind, T.DateType):
        try:
            return F.lit(as_instant(value).date() if isinstance(value, str) else date.fromisoformat(str(value)))
        except ValueError:
            raise ODataError(f"invalid date {value!r}", code="invalid-date-literal") from None
    if isinstance(kind, T.BooleanType):
        if lit.kind != "bool":
            raise bad
        return F.lit(value)
    if isinstance(kind, T.StringType):
        return F.lit(value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value))
    if isinstance(kind, T.NumericType):
        if isinstance(value, str) and lit.kind == "string" and re.fullmatch(r"[+-]?\d+(\.\d+)?([eE][+-]?\d+)?", value):
            value = Decimal(value)
        if isinstance(value, (str, bool)):
            raise bad
        if isinstance(kind, T.IntegralType) and isinstance(value, int):
            return F.lit(value).cast("long") if -(1 << 63) <= value < 1 << 63 else F.lit(Decimal(value))
        if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
            return F.lit(float(value))
        return F.lit(value)
    if lit.kind == "datetime":
        return _timestamp(as_instant(value), kind)
    if lit.kind == "date":
        return F.lit(date.fromisoformat(value))
    return F.lit(value)


def _text(x: Column) -> Column:
    return x.cast("string")


class Compiler:
    """Columns for trees; ``resolve`` gives a path's column and type, ``quantifier`` a lambda's truth."""

    def __init__(self, resolve: Callable[[Path], tuple[Column, T.DataType | None]], quantifier: Callable[[Lambda], Column] | None = None):
        self.resolve, self.quantifier = resolve, quantifier

    def column(self, node, like: T.DataType | None = None) -> Column:
        return self.typed(node, like)[0]

    def typed(self, node, like: T.DataType | None = None) -> tuple[Column, T.DataType | None]:
        if isinstance(node, Lit):
            return literal(node, like), like
        if isinstance(node, Path):
            return self.resolve(node)
        if isinstance(node, Logic):
            terms = [self.column(x) for x in node.terms]
            out = terms[0]
            for x in terms[1:]:
                out = out & x if node.op == "and" else out | x
            return out, T.BooleanType()
        if isinstance(node, Not):
            return ~self.column(node.term), T.BooleanType()
        if isinstance(node, In):
            return self._in(node), T.BooleanType()
        if isinstance(node, Lambda):
            if self.quantifier is None:
                raise ODataError("any and all are not allowed here")
            return self.quantifier(node), T.BooleanType()
        if isinstance(node, Binary):
            return self._compare(node) if node.op in _COMPARE else self._arithmetic(node)
        if isinstance(node, Call):
            return self._call(node)
        raise ODataError(f"can't evaluate {type(node).__name__}")

    def _in(self, node: In) -> Column:
        column, kind = self.typed(node.term)
        some = [x for x in node.items if x.value is not None]
        out = column.isin([literal(x, kind) for x in some]) if some else F.lit(False)
        if len(some) < len(node.items):
            # a null item asks for null; so the answer is never unknown
            out = F.coalesce(out, F.lit(False)) | column.isNull()
        return out

    def _compare(self, node: Binary) -> tuple[Column, T.DataType]:
        op, left, right = node.op, node.left, node.right
        if isinstance(left, Lit) and not isinstance(right, Lit):
            op, left, right = _MIRROR[op], right, left
        if isinstance(right, Lit) and right.value is None:
            if op not in ("eq", "ne"):
                return F.lit(None).cast("boolean"), T.BooleanType()
            column = self.column(left)
            return (column.isNull() if op == "eq" else column.isNotNull()), T.BooleanType()
        if isinstance(left, Call) and left.name == "year" and isinstance(right, Lit) and isinstance(right.value, int) and 1 <= right.value < 9999:
            column, kind = self.typed(left.args[0])
            if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):  # a range prunes files, a function doesn't
                low, high = (_timestamp(datetime(y, 1, 1, tzinfo=UTC), kind) for y in (right.value, right.value + 1))
                ranges = {"eq": (column >= low) & (column < high), "ne": (column < low) | (column >= high), "lt": column < low, "ge": column >= low, "gt": column >= high, "le": column < high}
                return ranges[op], T.BooleanType()
        column, kind = self.typed(left)
        if isinstance(right, Lit):
            value = literal(right, kind)
            if right.kind == "guid":
                column = F.lower(_text(column))
        else:
            value = self.column(right)
        return _COMPARE[op](column, value), T.BooleanType()

    def _number(self, node) -> tuple[Column, T.DataType]:
        if isinstance(node, Lit):
            if isinstance(node.value, str):
                return F.lit(node.value).try_cast("double"), T.DoubleType()
            return F.lit(node.value), T.DoubleType() if isinstance(node.value, float) else T.LongType()
        column, kind = self.typed(node)
        if isinstance(kind, T.StringType):
            return column.try_cast("double"), T.DoubleType()
        return column, kind or T.DoubleType()

    def _arithmetic(self, node: Binary) -> tuple[Column, T.DataType]:
        (a, ka), (b, kb) = self._number(node.left), self._number(node.right)
        if node.op == "div":
            return F.try_divide(a.cast("double"), b.cast("double")), T.DoubleType()
        if node.op == "mod":
            return F.try_mod(a, b), ka
        out = {"add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: a * b}[node.op]()
        wide = ka if isinstance(ka, T.FractionalType) else kb
        return out, wide

    def _call(self, node: Call) -> tuple[Column, T.DataType]:
        name, args = node.name, node.args
        text = T.StringType()
        if name in ("contains", "startswith", "endswith", "like", "ilike"):
            a, b = (F.lower(_text(self.column(x, text))) if name != "like" else _text(self.column(x, text)) for x in args)
            if name in ("like", "ilike"):
                return F.like(a, b), T.BooleanType()
            return {"contains": F.contains, "startswith": F.startswith, "endswith": F.endswith}[name](a, b), T.BooleanType()
        if name in ("tolower", "toupper", "trim"):
            return {"tolower": F.lower, "toupper": F.upper, "trim": F.trim}[name](_text(self.column(args[0], text))), text
        if name == "concat":
            return F.concat(*[F.coalesce(_text(self.column(x, text)), F.lit("")) for x in args]), text
        if name == "indexof":
            a, b = (F.lower(_text(self.column(x, text))) for x in args)
            return F.instr(a, b) - 1, T.IntegerType()
        if name == "substring":
            column = _text(self.column(args[0], text))
            numbers = [self.column(x).cast("int") for x in args[1:]]
            for x in args[1:]:
                if isinstance(x, Lit) and (not isinstance(x.value, int) or x.value < 0):
                    raise ODataError("substring takes non-negative integers")
            return F.substring(column, numbers[0] + 1, numbers[1] if len(numbers) > 1 else F.lit(2147483647)), text
        if name == "length":
            return F.char_length(_text(self.column(args[0], text))), T.IntegerType()
        if name in _PARTS:
            column, kind = self.typed(args[0])
            if not isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                column = column.try_cast("timestamp_ntz")
            elif isinstance(kind, T.TimestampType):
                column = F.convert_timezone(F.current_timezone(), F.lit("UTC"), column.cast("timestamp_ntz"))
            return _PARTS[name](column), T.IntegerType()
        if name in ("round", "floor", "ceiling"):
            column = self._number(args[0])[0].cast("double")
            return {"round": lambda: F.floor(column + 0.5), "floor": lambda: F.floor(column), "ceiling": lambda: F.ceil(column)}[name](), T.LongType()
        if name == "between":
            column, kind = self.typed(args[0])
            return column.between(self.column(args[1], kind), self.column(args[2], kind)), T.BooleanType()
        raise ODataError(f"unknown function {name!r}")
