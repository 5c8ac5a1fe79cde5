"""The pipeline language: text to an expression tree, simplified, then evaluated to Collections and Columns.

    find [#amenity=cafe & #nation] | map {f -> get-string f "name"} | count-values

``a | f x`` gives ``a`` to ``f`` as its first argument; a call with too few
arguments binds its last ones. Lambdas are traced over Columns, so a pipeline
becomes one plan.
"""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane import ids, query as Q
from terrane.functions import numbers as N
from terrane.language import Join, column, functions, on, wrap
from terrane.operators.collections import Collection
from terrane.world import Change, World, Worlds


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Symbol:
    name: str


@dataclass(frozen=True)
class Call:
    function: Any
    args: tuple


@dataclass(frozen=True)
class Lambda:
    params: tuple
    body: Any


_TOKEN = re.compile(r"""\s*(?:(?P<arrow>->)|(?P<string>"(?:[^"\\]|\\.)*")|(?P<id>/[A-Za-z](?:[^\s(){}\[\],|]*[^\s(){}\[\],|:])?)|(?P<float>-?\d+\.\d+)|(?P<int>-?\d+)|(?P<key>[#@][^\s=\]\[&|(){},]+)|(?P<symbol>[A-Za-z_][\w:-]*)|(?P<mark>[|(){}\[\],:=&]))""")


def lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxError(f"unexpected {text[at:at + 10]!r} at {at}")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return out


class _Parser:
    def __init__(self, tokens):
        self.tokens, self.at = tokens, 0

    def peek(self, n=0):
        return self.tokens[self.at + n] if self.at + n < len(self.tokens) else (None, None)

    def take(self, value=None):
        kind, text = self.peek()
        if kind is None or value is not None and text != value:
            raise SyntaxError(f"expected {value or 'more'}, got {text!r}")
        self.at += 1
        return kind, text

    def pipeline(self):
        left = self.call()
        while self.peek()[1] == "|":
            self.take()
            right = self.call()
            left = Call(right.function, (left, *right.args)) if isinstance(right, Call) else Call(right, (left,))
        return left

    def call(self):
        head = self.atom()
        args = []
        while self.peek()[0] is not None and self.peek()[1] not in ("|", ")", "}", "]", ",", ":"):
            args.append(self.atom())
        return Call(head, tuple(args)) if args else head

    def atom(self):
        kind, text = self.take()
        if kind == "string":
            return Literal(re.sub(r"\\(.)", r"\1", text[1:-1]))
        if kind == "float" or kind == "int":
            v = float(text) if kind == "float" else int(text)
            if kind == "float" and self.peek()[1] == "," and self.peek(1)[0] == "float":
                self.take()
                return Literal((v, float(self.take()[1])))
            return Literal(v)
        if kind == "id":
            return Literal(ids.parse(text))
        if kind == "symbol":
            return Symbol(text)
        if text == "(":
            e = self.pipeline()
            self.take(")")
            return e
        if text == "[":
            e = self.query()
            self.take("]")
            return Literal(e)
        if text == "{":
            return self.braces()
        raise SyntaxError(f"unexpected {text!r}")

    def braces(self):
        start, params = self.at, []
        while self.peek()[0] == "symbol":
            params.append(self.take()[1])
            if self.peek()[1] != ",":
                break
            self.take()
        if self.peek()[0] == "arrow":
            self.take()
            body = self.pipeline()
            self.take("}")
            return Lambda(tuple(params), body)
        self.at = start
        items, i = [], 0
        while self.peek()[1] != "}":
            v = self.pipeline()
            if self.peek()[1] == ":":
                self.take()
                items.append((v, self.pipeline()))
            else:
                items.append((Literal(i), v))
            i += 1
            if self.peek()[1] == ",":
                self.take()
        self.take("}")
        return Call(Symbol("collection"), tuple(Call(Symbol("pair"), x) for x in items))

    def query(self):
        """Without precedence: what follows an ``&`` or ``|`` is its whole right side."""
        kind, text = self.take()
        if text == "(":
            left = self.query()
            self.take(")")
        elif kind in ("key", "symbol"):
            left = Q.Keyed(text)
            if self.peek()[1] == "=":
                self.take()
                k, v = self.take()
                left = Q.Tagged(text, v[1:-1] if k == "string" else v)
        else:
            raise SyntaxError(f"unexpected {text!r} in a query")
        if self.peek()[1] in ("&", "|"):
            op = self.take()[1]
            right = self.query()
            return left & right if op == "&" else left | right
        return left


def parse(text: str):
    p = _Parser(lex(text))
    e = p.pipeline()
    if p.peek()[0] is not None:
        raise SyntaxError(f"unexpected {p.peek()[1]!r}")
    return e


def free(e, name: str) -> bool:
    """Whether a name occurs unbound."""
    if isinstance(e, Symbol):
        return e.name == name
    if isinstance(e, Call):
        return free(e.function, name) or any(free(a, name) for a in e.args)
    return isinstance(e, Lambda) and name not in e.params and free(e.body, name)


_QUERIES = {"keyed": Q.Keyed, "tagged": Q.Tagged, "typed": Q.Typed, "and": lambda a, b: a & b, "or": lambda a, b: a | b, "all": Q.All, "is-valid": Q.IsValid}


def simplify(e):
    """Query constructors of literals become queries; ``{a -> f a x}`` becomes ``f x`` where ``a`` occurs nowhere else; lambdas without parameters become their bodies."""
    if isinstance(e, Lambda):
        body = simplify(e.body)
        if not e.params:
            return body
        if len(e.params) == 1 and isinstance(body, Call) and body.args and body.args[0] == Symbol(e.params[0]):
            rest = body.args[1:]
            if not any(free(x, e.params[0]) for x in (body.function, *rest)):
                return Call(body.function, rest) if rest else body.function
        return Lambda(e.params, body)
    if isinstance(e, Call):
        f, args = simplify(e.function), tuple(simplify(a) for a in e.args)
        if isinstance(f, Symbol) and f.name in _QUERIES and all(isinstance(a, Literal) for a in args):
            return Literal(_QUERIES[f.name](*[a.value for a in args]))
        return Call(f, args)
    return Literal(_QUERIES[e.name]()) if isinstance(e, Symbol) and e.name in ("all", "is-valid") else e


def unparse(e) -> str:
    if isinstance(e, Literal):
        v = e.value
        if isinstance(v, str):
            return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
        if isinstance(v, Q.Query):
            return f"[{_query_text(v)}]"
        return f"{v[0]}, {v[1]}" if isinstance(v, tuple) else str(v)
    if isinstance(e, Symbol):
        return e.name
    if isinstance(e, Lambda):
        return "{" + ", ".join(e.params) + " -> " + unparse(e.body) + "}"
    parts = [unparse(x) if not isinstance(x, Call) else f"({unparse(x)})" for x in (e.function, *e.args)]
    return " ".join(parts)


def _query_text(q) -> str:
    if isinstance(q, Q.Keyed):
        return q.key
    if isinstance(q, Q.Tagged):
        return f"{q.key}={q.value}" if re.fullmatch(r"[\w:-]+", q.value) else f'{q.key}="{q.value}"'
    if isinstance(q, (Q.And, Q.Or)):
        return (" & " if isinstance(q, Q.And) else " | ").join(f"({_query_text(x)})" if isinstance(x, (Q.And, Q.Or)) else _query_text(x) for x in q.queries)
    raise ValueError("a query without a text form")


def _tags(f) -> Column:
    return column(f)["tags"]


def _string(f, key):
    return F.coalesce(Q.first_value(key, _tags(f)), F.lit(""))


class Evaluator:
    """Evaluates expressions in a world. ``functions`` can be extended.

    ``change`` is what the world was made by, where it is known; ``worlds`` are the named ones.
    """

    def __init__(self, world: World, change: Change | None = None, worlds: Worlds | None = None):
        self.world, self.change, self.worlds = world, change, worlds or Worlds(world)
        c = column
        kind = lambda x: N.FLOAT if isinstance(x, float) else N.INT
        strict = lambda f, key, type: F.coalesce(Q.first_value(key, _tags(f)), F.raise_error(F.lit("no such tag")).cast("string")).cast(type)
        #: name: (number of arguments, function)
        self.functions: dict[str, tuple[int, Callable]] = {
            "find": (1, self._find), "find-areas": (1, lambda q: self._find(q, "area")), "find-relations": (1, lambda q: self._find(q, "relation")),
            "map": (2, self.map), "map-parallel": (2, self.map),
            "map-items": (2, lambda col, f: col.map_items(lambda p: column(f(p)))), "filter": (2, lambda col, f: col.filter(lambda v: self._predicate(f, wrap(v, col.types["value"])))),
            "take": (2, lambda col, n: col.take(n)), "top": (2, lambda col, n: col.top(n)), "count": (1, lambda col: col.count()), "sum": (1, lambda col: col.sum()), "flatten": (1, lambda col: col.flatten()),
            "count-values": (1, lambda col: col.count_values()), "count-keys": (1, lambda col: col.count_keys()), "count-valid-keys": (1, lambda col: col.count_valid_keys()), "sum-by-key": (1, lambda col: col.sum_by_key()),
            "percentiles": (1, lambda col: col.percentiles()), "join-missing": (2, lambda a, b: a.join_missing(b)),
            "get": (2, on(lambda f, k: F.coalesce(F.get(F.filter(_tags(f), lambda t: t["key"] == k), F.lit(0)), F.struct(F.lit("").alias("key"), F.lit("").alias("value"))))),
            "get-string": (2, on(_string)), "get-int": (2, on(lambda f, k: strict(f, k, "bigint"))), "get-float": (2, on(lambda f, k: strict(f, k, "double"))), "value": (1, on(lambda t: c(t)["value"])),
            "int-value": (1, on(lambda t: c(t)["value"].cast("bigint"))), "float-value": (1, on(lambda t: c(t)["value"].cast("double"))), "matches": (2, on(lambda f, q: q.on(c(f)))), "tag": (2, on(lambda k, v: F.struct(c(k).alias("key"), c(v).cast("string").alias("value")))),
            "add": (2, on(lambda a, b: c(a) + c(b))), "add-ints": (2, on(lambda a, b: N.add_ints(c(a), c(b)))), "divide": (2, on(lambda a, b: N.divide(c(a), c(b), kind(a), kind(b)))), "divide-int": (2, on(lambda a, b: N.divide_int(c(a), c(b)))),
            "gt": (2, on(lambda a, b: N.gt(c(a), c(b), N.FLOAT, N.FLOAT) if not isinstance(a, (int, float)) or not isinstance(b, (int, float)) else N.gt(c(a), c(b), kind(a), kind(b)))), "clamp": (3, on(lambda v, a, b: N.clamp(c(v), c(a), c(b)))), "to-str": (1, on(lambda a: N.to_str(c(a)))), "pair": (2, on(lambda a, b: F.struct(c(a).alias("first"), c(b).alias("second")))),
            "first": (1, on(lambda p: c(p)["first"])), "second": (1, on(lambda p: c(p)["second"])), "collection": (-1, self._collection),
            "call": (-1, lambda f, *a: f(*a)), "evaluate-feature": (1, self.evaluate_feature),
            **{n: (len(inspect.signature(q).parameters), q) for n, q in _QUERIES.items()},
        } | functions(self)

    def _find(self, query: Q.Query, type: str | None = None) -> Collection:
        hits = self.world.find(query, type, order=False)
        return Collection(hits.select(F.struct("type", "ns", "value").alias("key"), F.struct(*hits.columns).alias("value")))

    def map(self, c: Collection, f) -> Collection:
        """``f`` over every value; functions that are joins take all values at once."""
        if isinstance(f, Join):
            return f.over(c)
        return c.map(lambda v: column(f(wrap(v, c.types["value"]))))

    def _predicate(self, f, v) -> Column:
        # A query looks at the feature itself.
        return f.on(column(v)) if isinstance(f, Q.Query) else column(f(v))

    def within(self, inner: Evaluator, f):
        """What a function without parameters gives in another world: its expression is evaluated there."""
        return inner.evaluate(f.body, f.names) if isinstance(f, Delayed) else f

    def text_of(self, f) -> str:
        return unparse(f.body) if isinstance(f, Delayed) else ""

    def _collection(self, *pairs):
        raise TypeError("collections of literals are built where their values are known")

    def evaluate_feature(self, id: ids.FeatureID):
        """The stored expression of a feature, evaluated in this world."""
        text = self.world.find_feature(id).select(Q.first_value("expression")).first()[0]
        return self(text)

    def __call__(self, text: str):
        return self.evaluate(simplify(parse(text)), {})

    def evaluate(self, e, names: dict):
        if isinstance(e, Literal):
            return e.value
        if isinstance(e, Symbol):
            if e.name in names:
                return names[e.name]
            if e.name not in self.functions:
                raise NameError(e.name)
            return self._partial(e.name, ())
        if isinstance(e, Lambda):
            return lambda *args: self.evaluate(e.body, names | dict(zip(e.params, args)))
        if isinstance(e.function, Symbol) and e.function.name == "collection":
            pairs = [tuple(self.evaluate(x, names) for x in a.args) for a in e.args]
            if any(isinstance(p[1], Change) for p in pairs):
                return pairs
            if any(isinstance(v, (Column, ids.FeatureID)) for p in pairs for v in p):
                return Collection(reduce(DataFrame.unionByName, [self.world.spark.range(1).select(F.lit(i).cast("bigint").alias("ord"), column(k).alias("key"), column(v).alias("value")) for i, (k, v) in enumerate(pairs)]))
            kind = lambda vs: "bigint" if all(isinstance(v, int) for v in vs) else "double" if all(isinstance(v, (int, float)) for v in vs) else "string"
            keys, values = [p[0] for p in pairs], [p[1] for p in pairs]
            return Collection.of(self.world.spark, [(k, float(v) if kind(values) == "double" else v) for k, v in pairs], f"key {kind(keys)}, value {kind(values)}")
        delayed = _DELAYED.get(e.function.name) if isinstance(e.function, Symbol) else None
        # Some arguments are expressions that are evaluated later, perhaps in another world.
        args = [Delayed(self, a, names) if i == delayed else self.evaluate(a, names) for i, a in enumerate(e.args)]
        if isinstance(e.function, Symbol) and e.function.name in self.functions and e.function.name not in names:
            return self._partial(e.function.name, tuple(args))
        return self.evaluate(e.function, names)(*args)

    def _partial(self, name: str, bound: tuple):
        n, f = self.functions[name]
        if n < 0 and bound or len(bound) == n:
            return f(*bound)
        if len(bound) > n >= 0:
            raise TypeError(f"{name} takes {n} arguments")
        if len(bound) == n - 1 and hasattr(f, "join"):
            return Joining(self, name, bound, f.join)
        return lambda *more: self._partial(name, (*more, *bound))


class Joining(Join):
    """A function that is a join, with all arguments but its feature."""

    def __init__(self, ev: Evaluator, name: str, bound: tuple, f: Callable):
        super().__init__(f, bound)
        self.ev, self.name = ev, name

    def __call__(self, feature):
        return self.ev._partial(self.name, (feature, *self.args))


class Delayed:
    """An expression with the names it was written among."""

    def __init__(self, ev: Evaluator, body, names: dict):
        self.ev, self.body, self.names = ev, body, names

    def __call__(self, *args):
        got = self.ev.evaluate(self.body, self.names)
        return got(*args) if args or callable(got) and not isinstance(got, Join) else got


#: Which argument of a function is an expression to be evaluated later.
_DELAYED = {"with-change": 1, "materialise": 1, "add-expression": 2}
