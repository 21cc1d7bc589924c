"""Syntax trees to DataFrames.

A table of bindings has, for each node variable v, the columns v.id, v.label, ... and v.props, for each relationship its own, and
for each value one column. Patterns are equi-joins; Catalyst prunes the columns that nothing uses and, where labels are
literals of a union's branches, the branches that can't match. Where Catalyst has no rule of its own, the tree is rewritten
here: EXISTS becomes a semi or anti join, OPTIONAL MATCH with IS NULL on what it binds an anti join, and a regular expression
gets its literals as an extra filter.
"""

from __future__ import annotations

import re
import threading
import uuid
import warnings
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.patterns import regex_hints
from graphloom.plans.model import EDGE_FIELDS, NODE_FIELDS, GraphView, property_of
from graphloom.plans.syntax import Chain, CypherError, Expr, Match, NodePattern, Project, Query, RelPattern, UnsupportedCypher, Unwind, aggregates_in, names_in, parsed

#: Rows of an answer, hops of an unbounded path, and rows of a product of patterns that share no variable, at most.
MOST_ROWS, MOST_HOPS, MOST_PRODUCT = 100_000, 10, 10_000_000


class CypherWarning(UserWarning):
    pass


def _c(var: str, part: str) -> str:
    return f"{var}·{part}"


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


class Bindings:
    """A DataFrame, and what its columns stand for: "node", "edge" or "value" for each variable."""

    def __init__(self, df: DataFrame | None, kinds: dict[str, str]):
        self.df, self.kinds = df, kinds

    def columns(self, var: str) -> list[str]:
        parts = NODE_FIELDS + ["props"] if self.kinds[var] == "node" else EDGE_FIELDS + ["props"]
        return [var] if self.kinds[var] == "value" else [_c(var, p) for p in parts]


class Compiler:
    def __init__(self, graph: GraphView, most_hops: int = MOST_HOPS, most_product: int = MOST_PRODUCT):
        self.graph, self.most_hops, self.most_product = graph, most_hops, most_product
        self.spark = graph.nodes.sparkSession

    # Patterns
    def scan_node(self, n: NodePattern) -> Bindings:
        df = self.graph.nodes
        if n.labels:
            df = df.filter(F.col("label").isin(*n.labels) if len(n.labels) > 1 else F.col("label") == n.labels[0])
        df = df.select(*(F.col(f).alias(_c(n.var, f)) for f in [*NODE_FIELDS, "props"]))
        b = Bindings(df, {n.var: "node"})
        return Bindings(df.filter(self.inline(b, n)) if n.props else df, b.kinds)

    def inline(self, b: Bindings, n: NodePattern) -> Column:
        """Inline properties are compared as text."""
        cond = F.lit(True)
        for key, value in n.props:
            text = str(value).lower() if isinstance(value, bool) else str(value)
            cond &= self.prop(b, n.var, key).cast("string") == text if value is not None else F.lit(False)
        return cond

    def scan_edges(self, r: RelPattern) -> DataFrame:
        """The relationship's edges as from, to and its own columns."""
        df = self.graph.edges
        if r.types:
            df = df.filter(F.col("type").isin(*r.types) if len(r.types) > 1 else F.col("type") == r.types[0])
        own = [F.col(f).alias(_c(r.var, f)) for f in [*EDGE_FIELDS, "props"]]
        out = df.select(F.col("source_id").alias("·from"), F.col("target_id").alias("·to"), *own)
        back = df.select(F.col("target_id").alias("·from"), F.col("source_id").alias("·to"), *own)
        return out if r.direction == "out" else back if r.direction == "in" else out.union(back.filter(F.col("·from") != F.col("·to")))

    def walks(self, starts: DataFrame, r: RelPattern) -> DataFrame:
        """from, to, hops of all walks of the allowed lengths, one row for each (from, to, hops).

        Whether a walk may use an edge twice isn't settled by the language's description; walks may. A frontier holds each
        pair of nodes once, so it is bounded by the pairs in reach, not by the walks.
        """
        most = r.most
        if most == 0 or most > self.most_hops:
            if most == 0 or r.least <= self.most_hops:
                warnings.warn(f"a path's length was clamped to {self.most_hops}", CypherWarning, stacklevel=2)
            most = self.most_hops
        step = self.scan_edges(r).select(F.col("·from").alias("·mid"), F.col("·to").alias("·next")).distinct()
        front = starts.select(F.col("·from"), F.col("·from").alias("·to"))
        found: list[DataFrame] = []
        if r.least == 0:
            found.append(front.withColumn("·hops", F.lit(0)))
        for hop in range(1, most + 1):
            front = front.join(step, F.col("·to") == F.col("·mid")).select("·from", F.col("·next").alias("·to")).distinct()
            if hop >= r.least:
                found.append(front.withColumn("·hops", F.lit(hop)))
        if not found:
            return front.withColumn("·hops", F.lit(0)).limit(0)
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out

    def chain(self, b: Bindings | None, chain: Chain) -> Bindings:
        """b extended by what matches a chain; variables that b has already are joined on."""
        first = chain.nodes[0]
        if b is not None and b.df is not None and first.var not in b.kinds and any(n.var in b.kinds for n in chain.nodes):
            turn = {"out": "in", "in": "out", "any": "any"}
            if chain.nodes[-1].var in b.kinds:  # from the bound end
                chain = Chain(chain.nodes[::-1], tuple(replace(r, direction=turn[r.direction]) for r in chain.rels[::-1]))
            else:  # from a bound variable inside, both ways
                k = next(k for k, n in enumerate(chain.nodes) if n.var in b.kinds)
                left = Chain(chain.nodes[: k + 1][::-1], tuple(replace(r, direction=turn[r.direction]) for r in chain.rels[:k][::-1]))
                return self.chain(self.chain(b, left), Chain(chain.nodes[k:], chain.rels[k:]))
            first = chain.nodes[0]
        b = self.bind_node(b, first)
        for r, n in zip(chain.rels, chain.nodes[1:], strict=True):
            b = self.hop(b, self.at, r, n)
        return b

    def bind_node(self, b: Bindings | None, n: NodePattern) -> Bindings:
        self.at = n.var
        if b is None or b.df is None:
            return self.scan_node(n)
        if n.var in b.kinds:
            return self.restricted(b, n)
        new = self.scan_node(n)
        self.guard(b.df, new.df)
        return Bindings(b.df.crossJoin(new.df), b.kinds | new.kinds)

    def restricted(self, b: Bindings, n: NodePattern) -> Bindings:
        if b.kinds[n.var] != "node":
            raise CypherError(f"{n.var} is no node")
        cond = self.inline(b, n)
        if n.labels:
            cond &= _q(_c(n.var, "label")).isin(*n.labels)
        return Bindings(b.df.filter(cond), b.kinds) if n.labels or n.props else b

    def guard(self, left: DataFrame, right: DataFrame) -> None:
        """Refuses a product of too many rows; it counts no further than it needs."""
        n = left.limit(self.most_product + 1).count()
        m = right.limit(self.most_product // max(1, n) + 1).count()
        if n * m > self.most_product:
            raise CypherError(f"patterns without a common variable would make over {self.most_product} rows")

    def hop(self, b: Bindings, start: str, r: RelPattern, n: NodePattern) -> Bindings:
        source = _q(_c(start, "id"))
        if r.many:
            pairs = self.walks(b.df.select(source.alias("·from")).distinct(), r)
            kinds = {} if r.var.startswith(" ") else {r.var: "value"}
            steps = pairs.select("·from", "·to", *([F.col("·hops").alias(r.var)] if kinds else []))
        else:
            if r.var in b.kinds:
                raise UnsupportedCypher(f"unsupported second use of relationship {r.var}")
            steps, kinds = self.scan_edges(r), {r.var: "edge"}
        df = b.df.join(steps, source == F.col("·from")).drop("·from")
        self.at = n.var
        if n.var in b.kinds:
            return self.restricted(Bindings(df.filter(F.col("·to") == _q(_c(n.var, "id"))).drop("·to"), b.kinds | kinds), n)
        new = self.scan_node(n)
        df = df.join(new.df, F.col("·to") == _q(_c(n.var, "id"))).drop("·to")
        return Bindings(df, b.kinds | kinds | new.kinds)

    # Clauses
    def match(self, b: Bindings | None, m: Match, next_clause: Any) -> Bindings:
        if not m.optional:
            for c in self.ordered(b, m.chains):
                b = self.chain(b, c)
            return self.filtered(b, m.where) if m.where else b
        if b is None or b.df is None:
            b = Bindings(self.spark.range(1).select(F.lit(1).alias("·one")), {})
        used = {n.var for c in m.chains for n in c.nodes} | (names_in(m.where) if m.where else set())
        shared = [v for v in b.kinds if v in used]
        if shared:
            inner = Bindings(b.df.select(*(_q(c) for v in shared for c in b.columns(v))).dropDuplicates([b.columns(v)[0] for v in shared]), {v: b.kinds[v] for v in shared})
        else:
            inner = None
        for c in self.ordered(inner, m.chains):
            inner = self.chain(inner, c)
        if m.where:
            inner = self.filtered(inner, m.where)
        new = [v for v in inner.kinds if v not in b.kinds]
        keys = [b.columns(v)[0] for v in shared]
        right = inner.df.select(*(_q(k).alias(f"·{k}") for k in keys), *(_q(c) for v in new for c in inner.columns(v)))
        on = [_q(k).eqNullSafe(_q(f"·{k}")) for k in keys] or [F.lit(True)]
        kinds = b.kinds | {v: inner.kinds[v] for v in new}
        if self.asks_for_none(next_clause, set(new)):
            df = b.df.join(right, on, "left_anti")
            types = {f.name: f.dataType for f in right.schema.fields}
            return Bindings(df.select("*", *(F.lit(None).cast(types[c]).alias(c) for v in new for c in inner.columns(v))), kinds)
        return Bindings(b.df.join(right, on, "left").drop(*(f"·{k}" for k in keys)), kinds)

    @staticmethod
    def asks_for_none(clause: Any, new: set[str]) -> bool:
        """Whether the next clause passes variables through and keeps only rows whose new variable is null."""
        if not isinstance(clause, Project) or clause.final or clause.where is None or clause.limit is not None or clause.skip is not None:
            return False
        if any(i.expr.op != "var" or i.expr.args[0] != i.alias for i in clause.items):
            return False
        todo, parts = [clause.where], []
        while todo:
            e = todo.pop()
            todo += e.args if e.op == "and" else []
            parts += [] if e.op == "and" else [e]
        return any(e.op == "isnull" and e.args[0].op == "var" and e.args[0].args[0] in new for e in parts)

    @staticmethod
    def ordered(b: Bindings | None, chains: list[Chain]) -> list[Chain]:
        """Chains so that each shares a variable with those before, as far as any does."""
        left, seen, out = list(chains), set(b.kinds) if b is not None and b.df is not None else set(), []
        while left:
            k = next((k for k, c in enumerate(left) if not seen or any(n.var in seen for n in c.nodes)), 0)
            c = left.pop(k)
            seen |= {n.var for n in c.nodes}
            out.append(c)
        return out

    def filtered(self, b: Bindings, where: Expr) -> Bindings:
        """Conjuncts one by one: EXISTS and NOT EXISTS as semi and anti joins; elsewhere as a flag of a left join."""
        todo, df = [where], b.df
        while todo:
            e = todo.pop(0)
            if e.op == "and":
                todo = [*e.args, *todo]
            elif e.op == "exists" or e.op == "not" and e.args[0].op == "exists":
                df = self.exists_join(Bindings(df, b.kinds), e if e.op == "exists" else e.args[0], "left_semi" if e.op == "exists" else "left_anti")
            else:
                df, flags = self.flagged(Bindings(df, b.kinds), e)
                df = df.filter(self.cond(Bindings(df, b.kinds), e, flags)).drop(*flags.values())
        return Bindings(df, b.kinds)

    def exists_keys(self, b: Bindings, e: Expr) -> tuple[DataFrame, list[str]]:
        chain = e.args[0]
        bound = [n.var for n in chain.nodes if n.var in b.kinds]
        if not bound:
            raise CypherError("EXISTS names no variable of the query")
        inner = self.chain(None, chain)
        return inner.df.select(*(_q(_c(v, "id")).alias(f"·{v}") for v in dict.fromkeys(bound))), list(dict.fromkeys(bound))

    def exists_join(self, b: Bindings, e: Expr, how: str) -> DataFrame:
        keys, bound = self.exists_keys(b, e)
        return b.df.join(keys, [_q(_c(v, "id")) == _q(f"·{v}") for v in bound], how)

    def flagged(self, b: Bindings, e: Expr) -> tuple[DataFrame, dict[int, str]]:
        df, flags = b.df, {}

        def walk(x: Any) -> None:
            nonlocal df
            if isinstance(x, (tuple, list)):
                for y in x:
                    walk(y)
            elif isinstance(x, Expr) and x.op == "exists":
                keys, bound = self.exists_keys(b, x)
                name = f"·flag{len(flags)}"
                df = df.join(keys.distinct().withColumn(name, F.lit(True)), [_q(_c(v, "id")) == _q(f"·{v}") for v in bound], "left").drop(*(f"·{v}" for v in bound))
                flags[id(x)] = name
            elif isinstance(x, Expr):
                walk(x.args)

        walk(e)
        return df, flags

    # Expressions
    def prop(self, b: Bindings, var: str, name: str) -> Column:
        kind = b.kinds.get(var)
        if kind is None:
            raise CypherError(f"unknown variable {var}")
        if kind == "value":
            raise CypherError(f"{var} has no properties")
        if name in (NODE_FIELDS if kind == "node" else EDGE_FIELDS):
            return _q(_c(var, name))
        table = self.graph.nodes if kind == "node" else self.graph.edges
        return property_of(_q(_c(var, "props")), table.schema["props"].dataType, name)

    def type_of(self, b: Bindings, col: Column) -> T.DataType:
        return b.df.select(col.alias("x")).schema["x"].dataType

    def compared(self, b: Bindings, op: str, left: Column, right: Column, lit_left: Any, lit_right: Any) -> Column:
        """A boolean equals only a boolean, and its text; a number is compared as a number; all else as text."""
        ops = {"=": lambda x, y: x == y, "<>": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
        kinds = [lit if lit is not None else self.type_of(b, col) for lit, col in ((lit_left, left), (lit_right, right))]
        number = lambda k: isinstance(k, (int, float, T.NumericType)) and not isinstance(k, bool)
        boolean = lambda k: isinstance(k, (bool, T.BooleanType))
        if any(map(boolean, kinds)):
            return ops[op](F.lower(left.cast("string")), F.lower(right.cast("string")))
        if all(map(number, kinds)):
            return ops[op](left, right)
        if any(map(number, kinds)):
            as_number = lambda c, k: c if number(k) else c.cast("string").try_cast("double")
            return ops[op](as_number(left, kinds[0]), as_number(right, kinds[1]))
        return ops[op](left.cast("string"), right.cast("string"))

    def cond(self, b: Bindings, e: Expr, flags: dict[int, str] | None = None) -> Column:
        go = lambda x: self.cond(b, x, flags)
        val = lambda x: self.value(b, x, flags)
        if e.op == "and":
            return go(e.args[0]) & go(e.args[1])
        if e.op == "or":
            return go(e.args[0]) | go(e.args[1])
        if e.op == "xor":
            return F.coalesce(go(e.args[0]), F.lit(False)) != F.coalesce(go(e.args[1]), F.lit(False))
        if e.op == "not":
            return ~go(e.args[0])
        if e.op == "exists":
            if not flags or id(e) not in flags:
                raise UnsupportedCypher("unsupported place for EXISTS")
            return F.coalesce(_q(flags[id(e)]), F.lit(False))
        if e.op == "cmp":
            op, x, y = e.args
            if op == "=~":
                if y.op != "lit" or not isinstance(y.args[0], str):
                    raise UnsupportedCypher("unsupported regular expression: a text is needed")
                return self.matches(val(x).cast("string"), y.args[0])
            lits = [z.args[0] if z.op == "lit" else None for z in (x, y)]
            return self.compared(b, op, val(x), val(y), *lits)
        if e.op in ("contains", "startswith", "endswith"):
            return getattr(val(e.args[0]).cast("string"), e.op)(val(e.args[1]).cast("string"))
        if e.op == "in":
            x = val(e.args[0])
            cond = F.lit(False)
            for v in e.args[1]:
                cond |= self.compared(b, "=", x, F.lit(v), None, v)
            return cond
        if e.op in ("isnull", "isnotnull"):
            x = e.args[0]
            col = self.value(b, x, flags) if x.op != "var" or b.kinds.get(x.args[0]) == "value" else _q(_c(self.known(b, x.args[0]), "id"))
            return col.isNull() if e.op == "isnull" else col.isNotNull()
        if e.op == "haslabel":
            return _q(_c(self.known(b, e.args[0]), "label")).isin(*e.args[1])
        return val(e).cast("boolean")

    @staticmethod
    def known(b: Bindings, var: str) -> str:
        if var not in b.kinds:
            raise CypherError(f"unknown variable {var}")
        return var

    @staticmethod
    def matches(text: Column, pattern: str) -> Column:
        """The whole text matches; literals that any match contains are looked for first."""
        try:
            re.compile(pattern)
        except re.error as err:
            raise CypherError(f"bad regular expression: {err}") from None
        cond = F.lit(True)
        for hint in regex_hints(pattern):
            cond &= F.lower(text).contains(hint.lower()) if pattern.startswith("(?i)") else text.contains(hint)
        return cond & text.rlike(f"^(?:{pattern})$" if not pattern.startswith("(?i)") else f"(?i)^(?:{pattern[4:]})$")

    def value(self, b: Bindings, e: Expr, flags: dict[int, str] | None = None) -> Column:
        if e.op == "lit":
            return F.lit(e.args[0])
        if e.op == "list":
            return F.array(*map(F.lit, e.args)) if e.args else F.array().cast("array<string>")
        if e.op == "prop":
            return self.prop(b, *e.args)
        if e.op == "var":
            var = self.known(b, e.args[0])
            if b.kinds[var] == "value":
                return _q(var)
            parts = NODE_FIELDS + ["props"] if b.kinds[var] == "node" else EDGE_FIELDS + ["props"]
            return F.when(_q(_c(var, "id")).isNotNull(), F.struct(*(_q(_c(var, p)).alias(p) for p in parts)))
        if e.op == "case":
            out = self.value(b, e.args[1], flags)
            for when, then in reversed(e.args[0]):
                out = F.when(self.cond(b, when, flags), self.value(b, then, flags)).otherwise(out)
            return out
        if e.op == "fn":
            return self.function(b, *e.args, flags)
        if e.op == "agg":
            return self.aggregate(b, *e.args)
        return self.cond(b, e, flags)

    def element(self, b: Bindings, e: Expr, what: str, kinds: tuple[str, ...]) -> str:
        if e.op != "var" or b.kinds.get(e.args[0]) not in kinds:
            raise CypherError(f"{what} takes a {' or a '.join(kinds)}")
        return e.args[0]

    def function(self, b: Bindings, name: str, args: tuple[Expr, ...], flags) -> Column:
        counts = {"substring": (2, 3), "replace": (3, 3), "left": (2, 2), "right": (2, 2), "coalesce": (1, 99)}
        low, high = counts.get(name, (1, 1))
        if not low <= len(args) <= high:
            raise CypherError(f"{name} takes {low} to {high} arguments")
        if name == "labels":
            v = self.element(b, args[0], name, ("node",))
            return F.when(_q(_c(v, "id")).isNotNull(), F.array(_q(_c(v, "label"))))
        if name == "type":
            return _q(_c(self.element(b, args[0], name, ("edge",)), "type"))
        if name == "id":
            return _q(_c(self.element(b, args[0], name, ("node", "edge")), "id"))
        if name in ("keys", "properties"):
            v = self.element(b, args[0], name, ("node", "edge"))
            fields = NODE_FIELDS if b.kinds[v] == "node" else EDGE_FIELDS
            table = self.graph.nodes if b.kinds[v] == "node" else self.graph.edges
            props, kind = _q(_c(v, "props")), table.schema["props"].dataType
            if name == "properties":
                return props if isinstance(kind, T.StringType) else F.to_json(props)
            found = F.map_keys(props) if isinstance(kind, T.MapType) else F.array_compact(F.array(*(F.when(props[f].isNotNull(), F.lit(f)) for f in kind.names))) if isinstance(kind, T.StructType) else F.json_object_keys(props)
            return F.array_sort(F.array_union(F.array(*map(F.lit, fields)), F.coalesce(found, F.array().cast("array<string>"))))
        cols = [self.value(b, a, flags) for a in args]
        x, text = cols[0], cols[0].cast("string")
        if name == "coalesce":
            texts = [F.nullif(c.cast("string"), F.lit("")) if isinstance(self.type_of(b, c), T.StringType) and k + 1 < len(cols) else c for k, c in enumerate(cols)]
            return F.coalesce(*texts)
        if name in ("size", "length"):
            return F.size(x) if isinstance(self.type_of(b, x), (T.ArrayType, T.MapType)) else x if args[0].op == "var" and isinstance(self.type_of(b, x), T.IntegerType) else F.length(text)
        simple = {"tolower": F.lower, "toupper": F.upper, "tostring": lambda t: t, "tointeger": lambda t: t.try_cast("double").try_cast("bigint"), "tofloat": lambda t: t.try_cast("double"), "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim, "reverse": F.reverse,
                  "toboolean": lambda t: F.when(F.lower(t) == "true", F.lit(True)).when(F.lower(t) == "false", F.lit(False))}
        if name in simple:
            return simple[name](text)
        if name == "substring":
            start = cols[1].cast("int") + 1
            return F.substring(text, start, cols[2].cast("int")) if len(cols) > 2 else F.substring(text, start, F.lit(2**31 - 1))
        if name == "replace":
            return F.replace(text, cols[1].cast("string"), cols[2].cast("string"))
        return F.left(text, cols[1].cast("int")) if name == "left" else F.right(text, cols[1].cast("int"))

    def aggregate(self, b: Bindings, name: str, distinct: bool, arg: Expr | None) -> Column:
        if arg is None:
            return F.count(F.lit(1))
        col = _q(_c(arg.args[0], "id")) if arg.op == "var" and b.kinds.get(arg.args[0]) in ("node", "edge") and name == "count" else self.value(b, arg)
        if name == "count":
            return F.count_distinct(col) if distinct else F.count(col)
        if name in ("sum", "avg"):
            col = col if isinstance(self.type_of(b, col), T.NumericType) else col.cast("string").try_cast("double")
            return (F.sum_distinct(col) if distinct else F.sum(col)) if name == "sum" else F.avg(col)
        if name == "collect":
            return F.array_sort(F.collect_set(col) if distinct else F.collect_list(col))
        return F.min(col) if name == "min" else F.max(col)

    def lifted(self, e: Expr, found: dict[Expr, str]) -> Expr:
        """e with its aggregates replaced by names."""
        if e.op == "agg":
            return Expr("var", (found.setdefault(e, f"·agg{len(found)}"),))
        swap = lambda a: self.lifted(a, found) if isinstance(a, Expr) else tuple(map(swap, a)) if isinstance(a, tuple) else a
        return Expr(e.op, tuple(map(swap, e.args)))

    def project(self, b: Bindings, p: Project) -> Bindings:
        items = list(p.items)
        if p.star:
            from graphloom.plans.syntax import Item

            items = [Item(Expr("var", (v,)), v) for v in b.kinds if not v.startswith(" ")] + items
        seen = [i.alias for i in items]
        if len(set(seen)) != len(seen):
            raise CypherError("two results have one name")
        aliases = {i.alias: i.expr for i in items}
        order = [(aliases[e.args[0]] if e.op == "var" and e.args[0] in aliases else e, up) for e, up in p.order]
        grouped = any(aggregates_in(i.expr) for i in items)
        if grouped:
            b = self.grouped(b, items, order)
            items, order = self.regrouped
        df, flags = b.df, {}
        for i in items:
            df, more = self.flagged(Bindings(df, b.kinds), i.expr)
            flags |= more
        b = Bindings(df, b.kinds)
        columns, kinds, entity = [], {}, {}
        for i in items:
            whole = i.expr.op == "var" and b.kinds.get(i.expr.args[0]) in ("node", "edge")
            if whole and not p.final:
                v = i.expr.args[0]
                kinds[i.alias] = b.kinds[v]
                columns += [_q(c).alias(_c(i.alias, c.split("·")[-1])) for c in b.columns(v)]
            else:
                kinds[i.alias] = "value"
                columns.append(self.value(b, i.expr, flags).alias(i.alias))
            entity[i.alias] = whole
        keys = [self.value(b, e, flags) if not (e.op == "var" and b.kinds.get(e.args[0]) in ("node", "edge")) else _q(_c(e.args[0], "id")) for e, _ in order]
        if p.distinct:
            names = {repr(i.expr): i.alias for i in items}
            if any(repr(e) not in names for e, _ in order):
                raise CypherError("ORDER BY after DISTINCT takes what is returned")
            df = b.df.select(*columns).distinct()
            keys = [_q(names[repr(e)]) if kinds[names[repr(e)]] == "value" else _q(_c(names[repr(e)], "id")) for e, _ in order]
            hidden: list[str] = []
        else:
            hidden = [f"·key{k}" for k in range(len(keys))]
            df = b.df.select(*columns, *(k.alias(h) for k, h in zip(keys, hidden, strict=True)))
            keys = [_q(h) for h in hidden]
        if keys or p.skip is not None or p.limit is not None:
            ties = [_q(c) for c in df.columns if c not in hidden and isinstance(df.schema[c].dataType, (T.AtomicType,))]
            if p.limit == 0:
                df = df.limit(0)
            else:
                if keys or p.skip or p.limit is not None:
                    df = df.orderBy(*((k.asc_nulls_last() if up else k.desc_nulls_first()) for k, (_, up) in zip(keys, order, strict=True)), *ties)
                df = df.offset(p.skip) if p.skip else df
                df = df.limit(p.limit) if p.limit is not None else df
        out = Bindings(df.drop(*hidden), kinds)
        return self.filtered(out, p.where) if p.where else out

    def grouped(self, b: Bindings, items: list, order: list) -> Bindings:
        """Groups by the items without an aggregate; self.regrouped has the items and keys over the result."""
        from graphloom.plans.syntax import Item

        found: dict[Expr, str] = {}
        keys, kinds, new_items, named = [], {}, [], {}
        for i in items:
            if aggregates_in(i.expr):
                new_items.append(Item(self.lifted(i.expr, found), i.alias))
            elif i.expr.op == "var" and b.kinds.get(i.expr.args[0]) in ("node", "edge"):
                v = i.expr.args[0]
                kinds[v] = b.kinds[v]
                keys += [_q(c).alias(c) for c in b.columns(v)]
                new_items.append(i)
            else:
                name = f"·by{len(keys)}"
                keys.append(self.value(b, i.expr).alias(name))
                kinds[name] = "value"
                named[i.expr] = name
                new_items.append(Item(Expr("var", (name,)), i.alias))
        new_order = [(Expr("var", (named[e],)) if e in named else self.lifted(e, found), up) for e, up in order]
        aggs = [self.aggregate(b, *e.args).alias(name) for e, name in found.items()]
        df = b.df.groupBy(*keys).agg(*aggs)
        self.regrouped = new_items, new_order
        return Bindings(df, kinds | {name: "value" for name in found.values()})

    def unwind(self, b: Bindings | None, u: Unwind) -> Bindings:
        if b is None or b.df is None:
            b = Bindings(self.spark.range(1).select(F.lit(1).alias("·one")), {})
        return Bindings(b.df.withColumn(u.var, F.explode(self.value(b, u.expr))), b.kinds | {u.var: "value"})

    def query(self, q: Query) -> DataFrame:
        out: DataFrame | None = None
        for k, clauses in enumerate(q.parts):
            b: Bindings | None = None
            for n, clause in enumerate(clauses):
                if isinstance(clause, Match):
                    b = self.match(b, clause, clauses[n + 1] if n + 1 < len(clauses) else None)
                elif isinstance(clause, Unwind):
                    b = self.unwind(b, clause)
                else:
                    b = self.project(b or Bindings(self.spark.range(1).select(F.lit(1).alias("·one")), {}), clause)
            df = b.df.select(*(_q(i) for i in b.kinds))
            if out is None:
                out = df
            else:
                if out.columns != df.columns:
                    raise CypherError("the parts of a UNION return the same names")
                out = out.union(df) if q.keep_all[k - 1] else out.union(df).distinct()
        return out


def cypher(graph: GraphView, text: str, project: str | None = None, max_rows: int | None = 0, shadow: str | None = None, most_hops: int = MOST_HOPS) -> DataFrame:
    """The answer to a query, as a DataFrame of native types. project limits the graph; shadow names another graph of the same view; max_rows 0 is the ceiling, for interactive use, and None is all rows."""
    if shadow is not None and shadow not in graph.shadows:
        raise CypherError(f"no graph {shadow}")
    g = (graph.shadows[shadow] if shadow is not None else graph).scoped(project)
    df = Compiler(g, most_hops).query(parsed(text))
    return df if max_rows is None else df.limit(max_rows or MOST_ROWS)


def answered(graph: GraphView, text: str, max_rows: int = 0, **more: Any) -> tuple[DataFrame, bool]:
    """What cypher gives under the ceiling, and whether the ceiling has cut rows off."""
    df, most = cypher(graph, text, max_rows=None, **more), max_rows or MOST_ROWS
    return df.limit(most), df.limit(most + 1).count() > most


def as_strings(df: DataFrame) -> DataFrame:
    """Every cell as text, nested ones as JSON, null as the empty text."""
    return df.select(*(F.coalesce(F.to_json(_q(f.name)) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else _q(f.name).cast("string"), F.lit("")).alias(f.name) for f in df.schema.fields))


def within(spark: SparkSession, seconds: float, action) -> Any:
    """action() under a deadline: its jobs are cancelled when the time is over."""
    tag = f"deadline-{uuid.uuid4().hex}"
    spark.addTag(tag)
    timer = threading.Timer(seconds, lambda: spark.interruptTag(tag) if hasattr(spark, "interruptTag") else None)
    timer.start()
    try:
        return action()
    finally:
        timer.cancel()
        spark.removeTag(tag)
