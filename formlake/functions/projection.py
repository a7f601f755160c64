"""A small expression language, compiled into Spark columns with Python's truth and null rules. Everything outside it is refused.

Constants, names, lists, tuples, sets and dictionaries; indexes and slices; and/or/not (whose value is an operand's, as in
Python), if-else, chains of comparisons, in, not in, is; + - * /; str int float bool len dict list tuple round min max abs;
strip split upper lower replace of texts and get of dictionaries; a program of assignments and a return. What Python raises an
error for (a missing key or place, a division by zero, a text that is no number) is null here.
"""

from __future__ import annotations

import ast
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Nodes of a program, and members of a text or list in it, at most.
MOST_NODES, MOST_MEMBERS = 500, 10_000


class Refused(ValueError):
    """An expression outside the language."""


@dataclass(frozen=True)
class Value:
    """A column and what it holds: text, int, float, bool, list, dict, none or any; inner: of a list's or dictionary's members.

    An and/or of unlike kinds is `mixed`: it has a truth (column), and for `and` a value where it is true, its last operand's.
    """

    column: Column
    kind: str
    inner: str = "any"
    last: Value | None = None


def kind_of(t: T.DataType) -> tuple[str, str]:
    match t:
        case T.StringType():
            return "text", "text"
        case T.BooleanType():
            return "bool", "any"
        case T.IntegralType():
            return "int", "any"
        case T.NumericType():
            return "float", "any"
        case T.ArrayType():
            return "list", kind_of(t.elementType)[0]
        case T.MapType():
            return "dict", kind_of(t.valueType)[0]
    return "any", "any"


def truth(v: Value) -> Column:
    """Python's truth: null, zero, empty texts and empty containers are false."""
    c = v.column
    match v.kind:
        case "none":
            return F.lit(False)
        case "bool" | "mixed":
            found = c
        case "int" | "float":
            found = c != 0
        case "text":
            found = c != ""
        case "list" | "dict":
            found = F.size(c) > 0
        case _:
            found = ~c.cast("string").isin("", "0", "0.0", "false")
    return F.coalesce(found, F.lit(False))


def _number(v: Value) -> Value:
    if v.kind == "bool":
        return Value(v.column.cast("long"), "int")
    if v.kind not in ("int", "float", "any"):
        raise Refused(f"{v.kind} is no number")
    return v


def _alike(a: Value, b: Value) -> str:
    """The kind that holds both values; refused where Spark has none."""
    kinds = {a.kind, b.kind} - {"none"}
    if "mixed" in kinds:
        raise Refused("values of unlike kinds")
    if kinds <= {"int", "float", "bool"} and "float" in kinds:
        return "float"
    if kinds <= {"int", "bool"} and "int" in kinds:
        return "int"
    if len(kinds - {"any"}) > 1:
        raise Refused("values of unlike kinds")
    return next(iter(kinds - {"any"}), "any")


def _as(v: Value, kind: str) -> Column:
    return v.column.cast("long" if kind == "int" else "double") if kind in ("int", "float") and v.kind != kind else v.column


def _usable(v: Value) -> Column:
    if v.kind == "mixed":
        raise Refused("values of unlike kinds")
    return v.column


def _equal(a: Value, b: Value) -> Column:
    numbers = {"int", "float", "bool"}
    if a.kind != b.kind and "any" not in (a.kind, b.kind) and "none" not in (a.kind, b.kind) and not {a.kind, b.kind} <= numbers:
        return F.lit(False)
    if "bool" in (a.kind, b.kind) and a.kind != b.kind and {a.kind, b.kind} <= numbers:
        a, b = _number(a), _number(b)
    return a.column.eqNullSafe(b.column)


def _within(a: Value, b: Value) -> Column:
    match b.kind:
        case "text" | "any":
            return F.coalesce(F.contains(b.column, a.column), F.lit(False))
        case "list":
            return F.coalesce(F.exists(b.column, lambda x: x.eqNullSafe(a.column)), F.lit(False))
        case "dict":
            return F.coalesce(F.map_contains_key(b.column, a.column), F.lit(False))
    raise Refused(f"in a {b.kind}")


def _size(v: Value) -> Column:
    if v.kind not in ("text", "list", "dict", "any"):
        raise Refused(f"len of a {v.kind}")
    return (F.length(v.column) if v.kind in ("text", "any") else F.size(v.column)).cast("long")


class _Compiler:
    def __init__(self, names: Mapping[str, tuple[str, str]]):
        self.env = {n: Value(F.col(n), *k) for n, k in names.items()}

    def of(self, node: ast.AST) -> Value:
        match node:
            case ast.Constant(value=None):
                return Value(F.lit(None), "none")
            case ast.Constant(value=bool() as v):
                return Value(F.lit(v), "bool")
            case ast.Constant(value=int() as v):
                return Value(F.lit(v).cast("long"), "int")
            case ast.Constant(value=float() as v):
                return Value(F.lit(v), "float")
            case ast.Constant(value=str() as v) if len(v) <= MOST_MEMBERS:
                return Value(F.lit(v), "text", "text")
            case ast.Name(id=n) if n in self.env:
                return self.env[n]
            case ast.List(elts=e) | ast.Tuple(elts=e) | ast.Set(elts=e):
                return self.listed([self.of(x) for x in e], isinstance(node, ast.Set))
            case ast.Dict(keys=k, values=v) if all(x is not None for x in k):
                values = [self.of(x) for x in v]
                inner = self.common(values)
                return Value(F.create_map(*[c for x, y in zip(k, values, strict=True) for c in (self.of(x).column, y.column)]), "dict", inner)
            case ast.Subscript(value=x, slice=ast.Slice(lower=a, upper=b, step=None)):
                return self.sliced(self.of(x), a, b)
            case ast.Subscript(value=x, slice=at):
                return self.member(self.of(x), self.of(at))
            case ast.BoolOp(op=op, values=values):
                out = self.of(values[0])
                for v in values[1:]:
                    out = self.either(isinstance(op, ast.And), out, self.of(v))
                return out
            case ast.UnaryOp(op=ast.Not(), operand=x):
                return Value(~truth(self.of(x)), "bool")
            case ast.UnaryOp(op=ast.USub() | ast.UAdd() as op, operand=x):
                v = _number(self.of(x))
                return Value(-v.column if isinstance(op, ast.USub) else v.column, v.kind)
            case ast.IfExp(test=t, body=a, orelse=b):
                x, y = self.of(a), self.of(b)
                kind = _alike(x, y)
                return Value(F.when(truth(self.of(t)), _as(x, kind)).otherwise(_as(y, kind)), kind, x.inner)
            case ast.Compare(left=a, ops=ops, comparators=right):
                left, out = self.of(a), F.lit(True)
                for op, b in zip(ops, right, strict=True):
                    value = self.of(b)
                    out, left = out & self.compared(op, left, value), value
                return Value(out, "bool")
            case ast.BinOp(left=a, op=op, right=b):
                return self.computed(op, self.of(a), self.of(b))
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]):
                return self.called(name, [self.of(x) for x in args])
            case ast.Call(func=ast.Attribute(value=x, attr=name), args=args, keywords=[]):
                return self.method(name, self.of(x), [self.of(y) for y in args])
        raise Refused(type(node).__name__)

    def either(self, both: bool, a: Value, b: Value) -> Value:
        if not both and a.kind == "mixed" and a.last:
            kind = _alike(a.last, b)
            return Value(F.when(truth(a), _as(a.last, kind)).otherwise(_as(b, kind)), kind, b.inner)
        try:
            kind = _alike(a, b)
        except Refused:
            return Value(truth(a) & truth(b) if both else truth(a) | truth(b), "mixed", last=b if both and b.kind != "mixed" else b.last if both else None)
        first, second = (b, a) if both else (a, b)
        return Value(F.when(truth(a), _as(first, kind)).otherwise(_as(second, kind)), kind, a.inner)

    def common(self, values: list[Value]) -> str:
        kind = Value(F.lit(None), "none")
        for v in values:
            kind = Value(v.column, _alike(kind, v))
        return kind.kind if values else "any"

    def listed(self, values: list[Value], distinct: bool = False) -> Value:
        out = F.array(*[v.column for v in values])
        return Value(F.array_distinct(out) if distinct else out, "list", self.common(values))

    def sliced(self, v: Value, a: ast.AST | None, b: ast.AST | None) -> Value:
        if v.kind not in ("text", "list"):
            raise Refused(f"slice of a {v.kind}")
        n = _size(v)
        edge = lambda x, default: default if x is None else F.when(self.of(x).column < 0, F.greatest(n + self.of(x).column, F.lit(0))).otherwise(F.least(self.of(x).column, n))
        low, high = edge(a, F.lit(0).cast("long")), edge(b, n)
        size = F.greatest(high - low, F.lit(0)).cast("int")
        start = (low + 1).cast("int")
        return Value(F.substr(v.column, start, size) if v.kind == "text" else F.slice(v.column, start, size), v.kind, v.inner)

    def member(self, v: Value, at: Value) -> Value:
        if v.kind == "dict":
            return Value(F.try_element_at(v.column, at.column), v.inner)
        if v.kind not in ("text", "list"):
            raise Refused(f"member of a {v.kind}")
        place = F.when(at.column < 0, at.column + _size(v)).otherwise(at.column).cast("int")
        if v.kind == "list":
            return Value(F.get(v.column, place), v.inner)
        return Value(F.when((place >= 0) & (place < F.length(v.column)), F.substr(v.column, place + 1, F.lit(1))), "text", "text")

    def compared(self, op: ast.cmpop, a: Value, b: Value) -> Column:
        match op:
            case ast.Eq():
                return _equal(a, b)
            case ast.NotEq():
                return ~_equal(a, b)
            case ast.Is() | ast.IsNot() if "none" in (a.kind, b.kind) or a.kind == b.kind == "bool":
                return a.column.eqNullSafe(b.column) if isinstance(op, ast.Is) else ~a.column.eqNullSafe(b.column)
            case ast.In():
                return _within(a, b)
            case ast.NotIn():
                return ~_within(a, b)
        names = {ast.Lt: "__lt__", ast.Gt: "__gt__", ast.LtE: "__le__", ast.GtE: "__ge__"}
        if type(op) not in names:
            raise Refused(type(op).__name__)
        _alike(a, b)
        return F.coalesce(getattr(a.column, names[type(op)])(b.column), F.lit(False))

    def computed(self, op: ast.operator, a: Value, b: Value) -> Value:
        if isinstance(op, ast.Add) and {a.kind, b.kind} & {"text", "list"}:
            if a.kind != b.kind and "any" not in (a.kind, b.kind):
                raise Refused("sum of unlike kinds")
            return Value(F.concat(a.column, b.column), a.kind if a.kind != "any" else b.kind, a.inner)
        if isinstance(op, ast.Mult) and "text" in (a.kind, b.kind):
            text, times = (a, b) if a.kind == "text" else (b, a)
            if times.kind != "int":
                raise Refused("a text times what is no number")
            # A result beyond the bound is null.
            return Value(F.when(F.length(text.column) * F.greatest(times.column, F.lit(0)) <= MOST_MEMBERS, F.repeat(text.column, times.column.cast("int"))), "text", "text")
        a, b = _number(a), _number(b)
        kind = "float" if "float" in (a.kind, b.kind) or isinstance(op, ast.Div) else "int"
        match op:
            case ast.Add():
                return Value(a.column + b.column, kind)
            case ast.Sub():
                return Value(a.column - b.column, kind)
            case ast.Mult():
                return Value(a.column * b.column, kind)
            case ast.Div():
                return Value(F.try_divide(a.column.cast("double"), b.column.cast("double")), "float")
        raise Refused(type(op).__name__)

    def called(self, name: str, args: list[Value]) -> Value:
        match name, args:
            case "str", [v] if v.kind == "bool":
                return Value(F.when(v.column, "True").when(~v.column, "False").otherwise("None"), "text", "text")
            case "str", [v] if v.kind in ("text", "int", "float", "none", "any"):
                return Value(F.coalesce(v.column.cast("string"), F.lit("None")), "text", "text")
            case "int", [v]:
                if v.kind == "text":
                    return Value(F.when(v.column.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(v.column).try_cast("long")), "int")
                return Value(_number(v).column.cast("long"), "int")
            case "float", [v]:
                return Value(F.trim(v.column).try_cast("double") if v.kind == "text" else _number(v).column.cast("double"), "float")
            case "bool", [v]:
                return Value(truth(v), "bool")
            case "len", [v]:
                return Value(_size(v), "int")
            case "list" | "tuple", [v] if v.kind == "list":
                return v
            case "list" | "tuple", [v] if v.kind == "text":
                return Value(F.filter(F.split(v.column, ""), lambda x: x != ""), "list", "text")
            case "list" | "tuple", [v] if v.kind == "dict":
                return Value(F.map_keys(v.column), "list", "text")
            case "dict", [v] if v.kind == "dict":
                return v
            case "round", [v]:
                return Value(F.bround(_number(v).column, 0).cast("long"), "int")
            case "round", [v, Value(kind="int") as n]:
                return Value(F.bround(_number(v).column, self.literal(n)), "float")
            case "min" | "max", [v] if v.kind == "list":
                return Value((F.array_min if name == "min" else F.array_max)(v.column), v.inner)
            case "min" | "max", [_, _, *_]:
                kind = self.common(args)
                return Value((F.least if name == "min" else F.greatest)(*[v.column for v in args]), kind)
            case "abs", [v]:
                v = _number(v)
                return Value(F.abs(v.column), v.kind)
        raise Refused(f"{name} of {len(args)} values")

    def literal(self, v: Value) -> Column:
        return v.column.cast("int")

    def method(self, name: str, v: Value, args: list[Value]) -> Value:
        if v.kind == "dict" and name == "get" and len(args) in (1, 2):
            found = F.try_element_at(v.column, args[0].column)
            if len(args) == 1:
                return Value(found, v.inner)
            there = F.map_contains_key(v.column, args[0].column)
            return Value(F.when(there, found).otherwise(args[1].column), _alike(Value(found, v.inner), args[1]))
        if v.kind not in ("text", "any"):
            raise Refused(f"{name} of a {v.kind}")
        match name, args:
            case "upper", []:
                return Value(F.upper(v.column), "text", "text")
            case "lower", []:
                return Value(F.lower(v.column), "text", "text")
            case "strip", []:
                return Value(F.regexp_replace(v.column, r"^\s+|\s+$", ""), "text", "text")
            case "strip", [chars]:
                return Value(F.btrim(v.column, chars.column), "text", "text")
            case "split", []:
                return Value(F.filter(F.split(v.column, r"\s+"), lambda x: x != ""), "list", "text")
            case "split", [by]:
                return Value(F.split(v.column, F.concat(F.lit("\\Q"), by.column, F.lit("\\E"))), "list", "text")
            case "replace", [a, b]:
                return Value(F.replace(v.column, a.column, b.column), "text", "text")
        raise Refused(name)

    def assign(self, target: ast.AST, value: ast.AST) -> None:
        match target, value:
            case ast.Name(id=n), _ if not n.startswith("_"):
                self.env[n] = self.of(value)
            case ast.Tuple(elts=names) | ast.List(elts=names), ast.Tuple(elts=values) | ast.List(elts=values) if len(names) == len(values):
                made = [self.of(v) for v in values]
                for name, v in zip(names, made, strict=True):
                    if not isinstance(name, ast.Name) or name.id.startswith("_"):
                        raise Refused("assignment")
                    self.env[name.id] = v
            case _:
                raise Refused("assignment")


def _names(names: Iterable[str] | T.StructType) -> dict[str, tuple[str, str]]:
    if isinstance(names, T.StructType):
        return {f.name: kind_of(f.dataType) for f in names}
    return {n: ("any", "any") for n in names}


def _bounded(tree: ast.AST) -> ast.AST:
    if sum(1 for _ in ast.walk(tree)) > MOST_NODES:
        raise Refused("too large")
    return tree


def compiled(text: str, names: Iterable[str] | T.StructType) -> Column:
    """The column of an expression over columns: a DataFrame's schema, or names of unknown kinds."""
    return _usable(_Compiler(_names(names)).of(_bounded(ast.parse(text, mode="eval")).body))


def program(text: str, names: Iterable[str] | T.StructType) -> Column:
    """The column of a function's body: assignments, constants that stand alone (comments), and a return."""
    tree = _bounded(ast.parse("def f():\n" + "\n".join("    " + line for line in text.strip("\n").split("\n"))))
    compiler = _Compiler(_names(names))
    for statement in tree.body[0].body:
        match statement:
            case ast.Expr(value=ast.Constant()):
                continue
            case ast.Assign(targets=targets, value=value):
                for target in targets:
                    compiler.assign(target, value)
            case ast.Return(value=ast.AST() as value):
                return _usable(compiler.of(value))
            case _:
                raise Refused(type(statement).__name__)
    raise Refused("no return")
