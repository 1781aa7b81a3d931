"""Rule conditions as Column expressions.

A condition is written as a Python expression over known metrics and limits: comparisons, also
chained ones, `and`, `or` and `not`, arithmetic and parentheses. Python's own parser reads it, and only
the kinds of nodes below become Columns; nothing is evaluated as code.

Values are doubles, truth is 1 or 0, as in Python, and null stands for an error (a division by zero,
an unknown name, a metric that is null): it makes the whole condition false unless `and` or `or` have
decided before they come to it. What the whitelist lacks is reported beside the Column.
"""

from __future__ import annotations

import ast
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operators of the `when` form.
WHEN_OPERATORS = {"eq": "==", "ne": "!=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}

_COMPARE = {
    ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b,
}


def _error() -> Column:
    return F.lit(None).cast("double")


def _truth(test: Column) -> Column:
    return F.when(test, 1.0).when(~test, 0.0)


def _remainder(a: Column, b: Column) -> Column:
    """Python's: with the sign of the divisor."""
    m = F.try_mod(a, b)
    return F.when((m != 0) & ((b < 0) != (m < 0)), m + b).otherwise(m)


def _whole_quotient(a: Column, b: Column) -> Column:
    """Python's floor division of floats, by way of the remainder."""
    q = F.try_divide(a - _remainder(a, b), b)
    down = F.floor(q).cast("double")
    return F.when(q - down > 0.5, down + 1).otherwise(down)


_ARITHMETIC = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide, ast.Mod: _remainder, ast.FloorDiv: _whole_quotient}


def when_text(when: Mapping) -> str:
    """The `when` form of a rule (metric, operator, value) as an expression."""
    if when.get("metric") == "page_width_gt_height":
        return "width > height"
    return f"{when.get('metric', 'False')} {WHEN_OPERATORS.get(str(when.get('operator', 'eq')).lower(), '==')} {when.get('value')!r}"


def compile_text(text: str, columns: Mapping[str, str], limits: Mapping[str, float]) -> tuple[Column, list[str]]:
    """A boolean Column, never null, of a condition over `columns` (metric to column) and `limits` (name to number); and what is wrong with it."""
    wrong: list[str] = []

    def unknown(what: str) -> Column:
        wrong.append(what)
        return _error()

    def value(node: ast.expr) -> Column:
        match node:
            case ast.Constant(value=bool() | int() | float() as x):
                return F.lit(float(x))
            case ast.Name(id=name):
                if name in limits:
                    return F.lit(float(limits[name]))
                return F.col(columns[name]).cast("double") if name in columns else unknown(f"unknown name {name}")
            case ast.UnaryOp(op=ast.Not(), operand=x):
                return _truth(value(x) == 0)
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -value(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return value(x)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _ARITHMETIC:
                return _ARITHMETIC[type(op)](value(a), value(b))
            case ast.BoolOp(op=op, values=parts):
                out = value(parts[-1])
                for x in map(value, reversed(parts[:-1])):
                    decided = x != 0 if isinstance(op, ast.Or) else x == 0
                    out = F.when(x.isNull() | decided, x).otherwise(out)
                return out
            case ast.Compare(left=left, ops=ops, comparators=rest) if all(type(o) in _COMPARE for o in ops):
                sides = [value(x) for x in (left, *rest)]
                tests = [_truth(_COMPARE[type(o)](a, b)) for o, a, b in zip(ops, sides, sides[1:])]
                out = tests[-1]
                for t in reversed(tests[:-1]):
                    out = F.when(t.isNull() | (t == 0), t).otherwise(out)
                return out
            case _:
                return unknown(f"unknown form {ast.unparse(node)}")

    try:
        tree = ast.parse(text.strip(), mode="eval")
        found = value(tree.body)
    except (SyntaxError, ValueError, RecursionError):
        return F.lit(False), [f"no expression: {text}"]
    return F.coalesce(found != 0, F.lit(False)), wrong
