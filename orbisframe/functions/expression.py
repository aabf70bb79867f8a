"""Band expressions: a small, safe language compiled to Columns."""

from __future__ import annotations

import ast
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import missing as m

_BINARY = {ast.Add: m.add, ast.Sub: m.subtract, ast.Mult: m.multiply, ast.Div: m.divide, ast.FloorDiv: m.floor_divide, ast.Mod: m.modulo, ast.Pow: m.power}
_COMPARE = {ast.Gt: ">", ast.GtE: ">=", ast.Lt: "<", ast.LtE: "<=", ast.Eq: "==", ast.NotEq: "!="}
_CALLS = {k: m.UNARY[k] for k in ("abs", "sqrt", "log", "log10", "exp", "sin", "cos", "tan")}
_CALLS |= {"min": lambda a, b: m.both(F.least, a, b), "max": lambda a, b: m.both(F.greatest, a, b)}


def compile_expression(text: str, scope: Mapping[str, object]) -> Column:
    """A Column of doubles; scope gives the Columns and numbers that names stand for.

    Numbers, names, arithmetic, chained comparisons, and/or/not, conditionals and ten functions; ValueError for anything else and
    NameError for unknown names.
    """
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError as e:
        raise ValueError(f"not an expression: {text!r}") from e
    return m.col(_value(tree.body, scope))


def _truth(node: ast.AST, scope: Mapping[str, object]) -> Column:
    x = m.col(_value(node, scope))
    return x.isNull() | (x != 0)


def _value(node: ast.AST, scope: Mapping[str, object]):
    match node:
        case ast.Constant(value=v) if isinstance(v, (int, float)) and not isinstance(v, bool):
            return float(v)
        case ast.Name(id=name):
            if name not in scope:
                raise NameError(f"unknown band or variable {name!r}")
            return scope[name]
        case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
            return _BINARY[type(op)](_value(a, scope), _value(b, scope))
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return m.multiply(-1.0, _value(x, scope))
        case ast.UnaryOp(op=ast.UAdd(), operand=x):
            return _value(x, scope)
        case ast.UnaryOp(op=ast.Not(), operand=x):
            return (~_truth(x, scope)).cast("double")
        case ast.BoolOp(op=op, values=values):
            parts = [_truth(v, scope) for v in values]
            made = parts[0]
            for p in parts[1:]:
                made = made & p if isinstance(op, ast.And) else made | p
            return made.cast("double")
        case ast.Compare(left=left, ops=ops, comparators=others) if all(type(o) in _COMPARE for o in ops):
            sides = [_value(s, scope) for s in (left, *others)]
            made = F.lit(True)
            for a, op, b in zip(sides, ops, sides[1:], strict=False):
                made = made & (m.compare(a, _COMPARE[type(op)], b) == 1)
            return made.cast("double")
        case ast.IfExp(test=test, body=body, orelse=other):
            return F.when(_truth(test, scope), m.col(_value(body, scope))).otherwise(m.col(_value(other, scope)))
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in _CALLS and not any(isinstance(a, ast.Starred) for a in args):
            if len(args) != (2 if name in ("min", "max") else 1):
                raise ValueError(f"{name}() takes {2 if name in ('min', 'max') else 1} argument(s)")
            return _CALLS[name](*[_value(a, scope) for a in args])
    raise ValueError(f"not allowed in an expression: {type(node).__name__}")
