"""SPARQL SELECT and ASK compiled to DataFrame plans over ``triples(s, p, o)``.

Text goes through a tokenizer and a recursive-descent parser to a small tree; each tree node becomes
a DataFrame operator and Catalyst plans the whole. Triple patterns are filters, shared variables
equi-joins, OPTIONAL an outer join, MINUS and NOT EXISTS anti joins, paths with ``+`` or ``*`` fix
points. The store holds no literals, as every triple is an edge; every result is a string, and an
unbound variable is null in the plan and "" in :func:`query`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.errors import LimitExceededError
from weft.functions import props as P
from weft.graph import PropertyGraph
from weft.operators.traversal import reach
from weft.operators.transform import closure_pairs
from weft.runtime import materialize
from weft.settings import DEFAULTS, Settings

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<iri><[^<>"{}|^`\\\s]*>)
    |(?P<str>\"{3}(?:[^\\]|\\.)*?\"{3}|'{3}(?:[^\\]|\\.)*?'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<var>[?$]\w+)
    |(?P<num>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<lang>@[a-zA-Z][\w-]*)
    |(?P<name>(?:_:[\w.-]*\w|[A-Za-z][\w-]*(?:\.[\w-]+)*:(?:[\w%][\w.%:-]*[\w%]|[\w%])?|:(?:[\w%][\w.%:-]*[\w%]|[\w%])?))
    |(?P<word>[A-Za-z_]\w*)
    |(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,=<>!+\-*/|^?])""",
    re.X | re.S,
)
_AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}


class SparqlError(ValueError):
    """A query that is malformed or not supported."""


# -- tree ------------------------------------------------------------------------------------------


@dataclass
class Term:
    kind: str  # var, iri, lit
    value: Any
    number: bool = False


@dataclass
class Path:
    op: str  # iri, inv, seq, alt, opt, star, plus, not
    args: list = field(default_factory=list)


@dataclass
class Expr:
    op: str
    args: list = field(default_factory=list)
    distinct: bool = False
    separator: str = " "


def _used(e: Any) -> set[str]:
    """The variables of an expression."""
    if isinstance(e, Expr):
        return {e.args[0]} if e.op == "var" else set().union(*map(_used, e.args))
    if isinstance(e, Term):
        return {e.value} if e.kind == "var" else set()
    return set().union(*map(_used, e)) if isinstance(e, (list, tuple)) else set()


@dataclass
class Group:
    parts: list = field(default_factory=list)


@dataclass
class Select:
    where: Group
    items: list = field(default_factory=list)  # (variable, Expr or None)
    everything: bool = False
    distinct: bool = False
    ask: bool = False
    group: list = field(default_factory=list)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


# -- parser ----------------------------------------------------------------------------------------


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            found = _TOKEN.match(text, at)
            if not found:
                raise SparqlError(f"Invalid SPARQL at {text[at : at + 20]!r}")
            if found.lastgroup:
                self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at = 0
        self.prefixes: dict[str, str] = {}
        self.base = ""
        self.fresh = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        k = self.at + ahead
        return self.tokens[k] if k < len(self.tokens) else ("end", "")

    def is_(self, *values: str) -> bool:
        kind, value = self.peek()
        return kind in ("op", "word") and (value in values or (kind == "word" and value.upper() in values))

    def take(self, *values: str) -> str:
        kind, value = self.peek()
        if values and not self.is_(*values):
            raise SparqlError(f"Invalid SPARQL: expected {' or '.join(values)}, found {value or 'the end'!r}")
        self.at += 1
        return value

    def eat(self, *values: str) -> bool:
        if self.is_(*values):
            self.at += 1
            return True
        return False

    def variable(self) -> str:
        kind, value = self.peek()
        if kind != "var":
            raise SparqlError(f"Invalid SPARQL: expected a variable, found {value!r}")
        self.at += 1
        return value[1:]

    def unnamed(self) -> Term:
        self.fresh += 1
        return Term("var", f"__blank{self.fresh}")

    def query(self) -> Select:
        while self.is_("PREFIX", "BASE"):
            if self.take().upper() == "BASE":
                self.base = self.peek()[1][1:-1]
                self.at += 1
            else:
                name = self.peek()[1]
                self.at += 1
                self.prefixes[name.removesuffix(":")] = self.resolve(self.peek()[1][1:-1])
                self.at += 1
        if self.is_("CONSTRUCT", "DESCRIBE"):
            raise SparqlError(f"{self.peek()[1].upper()} queries are not supported; use SELECT or ASK")
        if self.eat("ASK"):
            self.eat("WHERE")
            out = Select(self.group(), ask=True)
            self.modifiers(out)
        else:
            out = self.select()
        if self.peek()[0] != "end":
            raise SparqlError(f"Invalid SPARQL: {self.peek()[1]!r} after the query")
        return out

    def resolve(self, iri: str) -> str:
        return iri if re.match(r"[A-Za-z][\w+.-]*:", iri) or not self.base else self.base + iri

    def select(self) -> Select:
        self.take("SELECT")
        out = Select(Group())
        out.distinct = self.eat("DISTINCT") or self.eat("REDUCED")
        if self.eat("*"):
            out.everything = True
        while self.peek()[0] == "var" or self.is_("("):
            if self.eat("("):
                e = self.expression()
                self.take("AS")
                out.items.append((self.variable(), e))
                self.take(")")
            else:
                out.items.append((self.variable(), None))
        if not out.items and not out.everything:
            raise SparqlError("Invalid SPARQL: SELECT without variables")
        self.eat("WHERE")
        out.where = self.group()
        self.modifiers(out)
        return out

    def modifiers(self, out: Select) -> None:
        if self.eat("GROUP"):
            self.take("BY")
            while self.peek()[0] == "var" or self.is_("("):
                if self.eat("("):
                    e = self.expression()
                    name = self.variable() if self.eat("AS") else f"__group{len(out.group)}"
                    self.take(")")
                    out.group.append((name, e))
                else:
                    out.group.append((self.variable(), None))
        if self.eat("HAVING"):
            while self.is_("("):
                out.having.append(self.bracketed())
        if self.eat("ORDER"):
            self.take("BY")
            while True:
                if self.is_("ASC", "DESC"):
                    down = self.take().upper() == "DESC"
                    out.order.append((self.bracketed(), down))
                elif self.peek()[0] == "var":
                    out.order.append((Expr("var", [self.variable()]), False))
                elif self.is_("("):
                    out.order.append((self.bracketed(), False))
                else:
                    break
        for _ in range(2):
            if self.eat("LIMIT"):
                out.limit = int(self.peek()[1])
                self.at += 1
            elif self.eat("OFFSET"):
                out.offset = int(self.peek()[1])
                self.at += 1
        if self.is_("VALUES"):
            out.where.parts.append(self.values())

    def bracketed(self) -> Expr:
        self.take("(")
        e = self.expression()
        self.take(")")
        return e

    def group(self) -> Group:
        self.take("{")
        out = Group()
        if self.is_("SELECT"):
            out.parts.append(("subquery", self.select()))
        while not self.eat("}"):
            if self.peek()[0] == "end":
                raise SparqlError("Invalid SPARQL: a group is not closed")
            if self.eat("."):
                continue
            if self.eat("OPTIONAL"):
                out.parts.append(("optional", self.group()))
            elif self.eat("MINUS"):
                out.parts.append(("minus", self.group()))
            elif self.eat("FILTER"):
                out.parts.append(("filter", self.constraint()))
            elif self.eat("BIND"):
                self.take("(")
                e = self.expression()
                self.take("AS")
                out.parts.append(("bind", self.variable(), e))
                self.take(")")
            elif self.is_("VALUES"):
                out.parts.append(self.values())
            elif self.is_("GRAPH", "SERVICE"):
                raise SparqlError(f"{self.peek()[1].upper()} is not supported")
            elif self.is_("{"):
                branches = [self.group()]
                while self.eat("UNION"):
                    branches.append(self.group())
                out.parts.append(("union", branches))
            else:
                self.triples(out)
        return out

    def values(self) -> tuple:
        self.take("VALUES")
        names, rows = [], []
        if self.eat("("):
            while self.peek()[0] == "var":
                names.append(self.variable())
            self.take(")")
            self.take("{")
            while self.eat("("):
                row = []
                while not self.eat(")"):
                    row.append(None if self.eat("UNDEF") else self.term().value)
                rows.append(row)
        else:
            names.append(self.variable())
            self.take("{")
            while not self.is_("}"):
                rows.append([None if self.eat("UNDEF") else self.term().value])
        self.take("}")
        return ("values", names, [[None if v is None else str(v) for v in r] for r in rows])

    def triples(self, out: Group) -> None:
        if self.is_("["):
            subject = self.blank(out)
            if self.is_(".", "}"):
                return
        else:
            subject = self.term()
        self.properties(subject, out)

    def blank(self, out: Group) -> Term:
        self.take("[")
        node = self.unnamed()
        if not self.is_("]"):
            self.properties(node, out)
        self.take("]")
        return node

    def properties(self, subject: Term, out: Group) -> None:
        while True:
            verb = Term("var", self.variable()) if self.peek()[0] == "var" else self.path()
            while True:
                target = self.blank(out) if self.is_("[") else self.term()
                out.parts.append(("triple", subject, verb, target))
                if not self.eat(","):
                    break
            if not self.eat(";"):
                return
            while self.eat(";"):
                pass
            if self.is_(".", "}", "]"):
                return

    def path(self) -> Path:
        parts = [self.sequence()]
        while self.eat("|"):
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else Path("alt", parts)

    def sequence(self) -> Path:
        parts = [self.step()]
        while self.eat("/"):
            parts.append(self.step())
        return parts[0] if len(parts) == 1 else Path("seq", parts)

    def step(self) -> Path:
        if self.eat("^"):
            return Path("inv", [self.step()])
        if self.eat("!"):
            names = []
            if self.eat("("):
                while not self.eat(")"):
                    names.append(self.predicate())
                    self.eat("|")
            else:
                names.append(self.predicate())
            out = Path("not", names)
        elif self.eat("("):
            out = self.path()
            self.take(")")
        else:
            out = Path("iri", [self.predicate()])
        while self.is_("?", "*", "+"):
            out = Path({"?": "opt", "*": "star", "+": "plus"}[self.take()], [out])
        return out

    def predicate(self) -> str:
        if self.peek() == ("word", "a"):
            self.at += 1
            return RDF_TYPE
        t = self.term()
        if t.kind != "iri":
            raise SparqlError("Invalid SPARQL: a predicate must be an IRI")
        return t.value

    def term(self) -> Term:
        kind, value = self.peek()
        self.at += 1
        if kind == "var":
            return Term("var", value[1:])
        if kind == "iri":
            return Term("iri", self.resolve(value[1:-1]))
        if kind == "name":
            if value.startswith("_:"):
                return Term("var", f"__named_{value[2:]}")
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise SparqlError(f"Invalid SPARQL: unknown prefix {prefix!r}")
            return Term("iri", self.prefixes[prefix] + local)
        if kind == "num":
            return Term("lit", value, True)
        if kind == "op" and value in "+-" and self.peek()[0] == "num":
            return Term("lit", ("-" if value == "-" else "") + self.take(), True)
        if kind == "str":
            body = value[3:-3] if value[:3] in ('"""', "'''") else value[1:-1]
            body = re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}.get(m[1], chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else m[1]), body, flags=re.S)
            number = False
            if self.peek()[0] == "lang":
                self.at += 1
            elif self.eat("^^"):
                number = bool(re.search(r"integer|decimal|double|float|int|long", self.term().value))
            return Term("lit", body, number)
        if kind == "word" and value.lower() in ("true", "false"):
            return Term("lit", value.lower())
        raise SparqlError(f"Invalid SPARQL: unexpected {value or 'end'!r}")

    def constraint(self) -> Expr:
        if self.is_("EXISTS", "NOT"):
            return self.primary()
        if self.is_("("):
            return self.bracketed()
        return self.primary()

    def expression(self) -> Expr:
        out = self.conjunction()
        while self.eat("||"):
            out = Expr("or", [out, self.conjunction()])
        return out

    def conjunction(self) -> Expr:
        out = self.relation()
        while self.eat("&&"):
            out = Expr("and", [out, self.relation()])
        return out

    def relation(self) -> Expr:
        out = self.sum()
        if self.is_("=", "!=", "<", ">", "<=", ">="):
            return Expr(self.take(), [out, self.sum()])
        negative = self.is_("NOT") and self.peek(1)[1].upper() == "IN"
        if negative:
            self.take()
        if self.eat("IN"):
            self.take("(")
            items = []
            while not self.eat(")"):
                items.append(self.expression())
                self.eat(",")
            found = Expr("in", [out, *items])
            return Expr("not", [found]) if negative else found
        return out

    def sum(self) -> Expr:
        out = self.product()
        while self.is_("+", "-"):
            out = Expr(self.take(), [out, self.product()])
        return out

    def product(self) -> Expr:
        out = self.unary()
        while self.is_("*", "/"):
            out = Expr(self.take(), [out, self.unary()])
        return out

    def unary(self) -> Expr:
        if self.eat("!"):
            return Expr("not", [self.unary()])
        if self.eat("-"):
            return Expr("-", [Expr("term", [Term("lit", "0", True)]), self.unary()])
        self.eat("+")
        return self.primary()

    def primary(self) -> Expr:
        if self.is_("("):
            return self.bracketed()
        if self.eat("EXISTS"):
            return Expr("exists", [self.group()])
        if self.is_("NOT") and self.peek(1)[1].upper() == "EXISTS":
            self.take()
            self.take()
            return Expr("not", [Expr("exists", [self.group()])])
        kind, value = self.peek()
        if kind == "var":
            return Expr("var", [self.variable()])
        if kind == "word" and self.peek(1) == ("op", "("):
            name = self.take().upper()
            self.take("(")
            out = Expr(name)
            out.distinct = self.eat("DISTINCT")
            if name == "COUNT" and self.eat("*"):
                out.args = []
            while not self.eat(")"):
                if self.eat(";"):
                    self.take("SEPARATOR")
                    self.take("=")
                    out.separator = self.term().value
                else:
                    out.args.append(self.expression())
                self.eat(",")
            return out
        return Expr("term", [self.term()])


# -- compiler --------------------------------------------------------------------------------------


def _name(variable: str) -> str:
    """A column name that keeps variables apart which differ in case alone."""
    return "v_" + re.sub("[A-Z]", lambda m: f"0{m[0].lower()}", variable)


@dataclass
class Rows:
    """Solutions: a column for each variable; ``open`` ones may be null."""

    df: DataFrame
    variables: tuple[str, ...] = ()
    open: frozenset = frozenset()


def _col(v: str) -> Column:
    return F.col(_name(v))


class Compiler:
    def __init__(self, triples: DataFrame):
        self.triples = triples
        self.spark = triples.sparkSession

    def unit(self) -> Rows:
        return Rows(self.spark.range(1).select(F.lit(1).alias("_unit")))

    # Joins

    def join(self, a: Rows, b: Rows, how: str = "inner", condition=None, unbound: frozenset = frozenset()) -> Rows:
        """Rows of ``a`` with and without a value for a variable that may be open are joined apart, so
        that each join has equal keys; ``unbound`` variables of ``a`` have no value."""
        shared = [v for v in a.variables if v in b.variables]
        if (v := next((v for v in shared if v in a.open and v not in b.open and v not in unbound), None)) is not None:
            some = self.join(Rows(a.df.filter(_col(v).isNotNull()), a.variables, a.open - {v}), b, how, condition, unbound)
            none = self.join(Rows(a.df.filter(_col(v).isNull()), a.variables, a.open), b, how, condition, unbound | {v})
            return Rows(some.df.unionByName(none.df), some.variables, some.open | none.open)
        right = b.df.select(*[_col(v).alias(f"r_{_name(v)}") for v in b.variables]) if b.variables else b.df.select(F.lit(1).alias("r_unit"))
        tests = []
        for v in shared:
            if v in unbound:
                continue
            left_col, right_col = _col(v), F.col(f"r_{_name(v)}")
            same = left_col == right_col
            tests.append(same | left_col.isNull() | right_col.isNull() if v in a.open or v in b.open else same)
        extra = [v for v in b.variables if v not in shared]
        if condition is not None:
            tests.append(condition({**{v: _col(v) for v in a.variables}, **{v: F.col(f"r_{_name(v)}") for v in extra}}))
        if how in ("left_semi", "left_anti"):
            if not tests:
                tests = [F.lit(True)]
            return Rows(a.df.join(right, reduce(lambda x, y: x & y, tests), how), a.variables, a.open)
        joined = a.df.join(right, reduce(lambda x, y: x & y, tests), how) if tests else (a.df.crossJoin(right) if how == "inner" else a.df.join(right, F.lit(True), how))
        keep = [F.coalesce(_col(v), F.col(f"r_{_name(v)}")).alias(_name(v)) if v in shared and v in a.open else _col(v) for v in a.variables]
        keep += [F.col(f"r_{_name(v)}").alias(_name(v)) for v in extra]
        open_ = (a.open - {v for v in shared if v not in b.open and how == "inner"}) | {v for v in extra if v in b.open or how != "inner"}
        return Rows(joined.select(*(keep or [F.lit(1).alias("_unit")])), (*a.variables, *extra), frozenset(open_))

    # Patterns

    def pattern(self, subject: Term, verb, target: Term) -> Rows:
        if isinstance(verb, Term):
            rows = self.triples.select("s", "p", "o")
            slots = (("s", subject), ("p", verb), ("o", target))
        else:
            rows = self.walk(verb, subject, target)
            slots = (("s", subject), ("o", target))
        out: dict[str, Column] = {}
        for column, term in slots:
            if term.kind == "var":
                if term.value in out:
                    rows = rows.filter(F.col(column) == out[term.value])
                else:
                    out[term.value] = F.col(column)
            elif term.kind == "iri":
                rows = rows.filter(F.col(column) == term.value)
            else:
                rows = rows.filter(F.lit(False))
        names = tuple(out)
        return Rows(rows.select(*([c.alias(_name(v)) for v, c in out.items()] or [F.lit(1).alias("_unit")])), names)

    def pairs(self, path: Path) -> DataFrame:
        """``s, o`` of a path without closures at its ends."""
        op, args = path.op, path.args
        if op == "iri":
            return self.triples.filter(F.col("p") == args[0]).select("s", "o")
        if op == "not":
            return self.triples.filter(~F.col("p").isin(*args)).select("s", "o")
        if op == "inv":
            return self.pairs(args[0]).select(F.col("o").alias("s"), F.col("s").alias("o"))
        if op == "seq":
            return reduce(lambda a, b: a.select("s", F.col("o").alias("m")).join(b.select(F.col("s").alias("m"), "o"), "m").select("s", "o"), [self.pairs(x) for x in args])
        if op == "alt":
            return reduce(DataFrame.unionByName, [self.pairs(x) for x in args])
        if op == "opt":
            return self.pairs(args[0]).unionByName(self.identity()).distinct()
        edges = materialize(self.pairs(args[0]).select(F.col("s").alias("a"), F.col("o").alias("b")).distinct(), "path")
        closed = closure_pairs(edges).select(F.col("a").alias("s"), F.col("b").alias("o"))
        return closed if op == "plus" else closed.unionByName(self.identity()).distinct()

    def identity(self) -> DataFrame:
        nodes = self.triples.select(F.explode(F.array("s", "o")).alias("s")).distinct()
        return nodes.select("s", F.col("s").alias("o"))

    def walk(self, path: Path, subject: Term, target: Term) -> DataFrame:
        """Closures from a constant end are walked from it alone."""
        fixed = subject if subject.kind == "iri" else target if target.kind == "iri" else None
        if path.op in ("plus", "star", "opt") and fixed is not None:
            forward = fixed is subject
            pairs = self.pairs(path.args[0])
            edges = materialize(pairs.select(*((F.col("s").alias("a"), F.col("o").alias("b")) if forward else (F.col("o").alias("a"), F.col("s").alias("b")))).distinct(), "path")
            first = edges.filter(F.col("a") == fixed.value).select(F.col("b").alias("a")).distinct()
            found = (first if path.op == "opt" else reach(edges, first)).select(F.col("a").alias("end"))
            if path.op != "plus":
                found = found.unionByName(self.spark.createDataFrame([(fixed.value,)], "end string")).distinct()
            here = F.lit(fixed.value)
            return found.select(here.alias("s"), F.col("end").alias("o")) if forward else found.select(F.col("end").alias("s"), here.alias("o"))
        return self.pairs(path)

    def group(self, g: Group, start: Rows | None = None) -> Rows:
        out, filters = start, []
        patterns = [p for p in g.parts if p[0] == "triple"]
        bound = lambda p: sum(t.kind == "iri" for t in (p[1], p[3])) + (not isinstance(p[2], Term))
        waiting = sorted(patterns, key=lambda p: -bound(p))

        def add(rows: Rows) -> None:
            nonlocal out
            out = rows if out is None else self.join(out, rows)

        done_patterns = False
        for part in g.parts:
            kind = part[0]
            if kind == "triple":
                if not done_patterns:  # all patterns of the group join first, connected ones next to each other
                    done_patterns = True
                    while waiting:
                        known = set(out.variables) if out else set()
                        touch = lambda p: any(t.kind == "var" and t.value in known for t in (p[1], p[3], p[2]) if isinstance(t, Term))  # noqa: E731, B023
                        nxt = next((p for p in waiting if touch(p)), waiting[0])
                        waiting.remove(nxt)
                        add(self.pattern(*nxt[1:]))
            elif kind == "filter":
                filters.append(part[1])
            elif kind == "optional":
                inner = part[1]
                plain = Group([p for p in inner.parts if p[0] != "filter"])
                tests = [p[1] for p in inner.parts if p[0] == "filter"]
                right = self.group(plain)
                left = out or self.unit()
                test = (lambda env: reduce(lambda x, y: x & y, [self.truth(t, env) for t in tests])) if tests else None  # noqa: B023
                out = self.join(left, right, "left_outer", test)
            elif kind == "minus":
                right = self.group(part[1])
                if out and set(out.variables) & set(right.variables):
                    both = [v for v in out.variables if v in right.variables]
                    same = Rows(right.df.select(*[_col(v) for v in both]), tuple(both), right.open & set(both))
                    out = self.join(out, same, "left_anti")
            elif kind == "union":
                branches = [self.group(b) for b in part[1]]
                if len(branches) == 1:
                    add(branches[0])
                    continue
                names = tuple(dict.fromkeys(v for b in branches for v in b.variables))
                df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [b.df for b in branches])
                open_ = frozenset(v for v in names if any(v not in b.variables or v in b.open for b in branches))
                add(Rows(df.select(*([_col(v) for v in names] or [F.lit(1).alias("_unit")])), names, open_))
            elif kind == "bind":
                left = out or self.unit()
                if part[1] in left.variables:
                    raise SparqlError(f"Invalid SPARQL: ?{part[1]} is bound already")
                value = self.text(*self.value(part[2], {v: _col(v) for v in left.variables}))
                out = Rows(left.df.withColumn(_name(part[1]), value), (*left.variables, part[1]), left.open | {part[1]})
            elif kind == "values":
                schema = ", ".join(f"{_name(n)} string" for n in part[1])
                rows = Rows(self.spark.createDataFrame([tuple(r) for r in part[2]], schema), tuple(part[1]), frozenset(n for k, n in enumerate(part[1]) if any(r[k] is None for r in part[2])))
                add(rows)
            elif kind == "subquery":
                add(self.select(part[1]))
        out = out or self.unit()
        for test in filters:
            out = self.filtered(out, test)
        return out

    def filtered(self, rows: Rows, test: Expr) -> Rows:
        negative = test.op == "not" and test.args[0].op == "exists"
        if test.op == "exists" or negative:
            inner = (test.args[0] if negative else test).args[0]
            own = lambda p: p[0] == "filter" and p[1].op != "exists" and not (p[1].op == "not" and p[1].args[0].op == "exists")
            right = self.group(Group([p for p in inner.parts if not own(p)]))
            tests = [p[1] for p in inner.parts if own(p)]  # these see the outer row's variables as well
            both = [v for v in rows.variables if v in right.variables]
            if tests:
                used = set().union(*map(_used, tests))
                right = Rows(right.df.select(*[_col(v) for v in right.variables if v in both or v in used] or [F.lit(1).alias("_unit")]), tuple(v for v in right.variables if v in both or v in used), right.open & {*both, *used})
                return self.join(rows, right, "left_anti" if negative else "left_semi", lambda env: reduce(lambda x, y: x & y, [self.truth(t, env) for t in tests]))
            if not both:
                any_row = bool(right.df.limit(1).count())
                return rows if any_row != negative else Rows(rows.df.filter(F.lit(False)), rows.variables, rows.open)
            same = Rows(right.df.select(*[_col(v) for v in both]), tuple(both), right.open & set(both))
            return self.join(rows, same, "left_anti" if negative else "left_semi")
        if test.op == "and":
            return self.filtered(self.filtered(rows, test.args[0]), test.args[1])
        return Rows(rows.df.filter(self.truth(test, {v: _col(v) for v in rows.variables})), rows.variables, rows.open)

    # Expressions: (column, kind) with kind iri, str, num, int or bool

    def value(self, e: Expr, env: dict[str, Column]) -> tuple[Column, str]:
        op, args = e.op, e.args
        if op == "var":
            c = env.get(args[0])
            return (F.lit(None).cast("string"), "iri") if c is None else (c, self.kinds.get(args[0], "iri"))
        if op == "term":
            t = args[0]
            if t.kind == "var":
                return self.value(Expr("var", [t.value]), env)
            if t.number:
                return F.lit(float(t.value)), "int" if re.fullmatch(r"-?\d+", t.value) else "num"
            if t.kind == "lit" and t.value in ("true", "false"):
                return F.lit(t.value == "true"), "bool"
            return F.lit(t.value), "iri" if t.kind == "iri" else "str"
        if op in ("or", "and"):
            a, b = self.truth(args[0], env), self.truth(args[1], env)
            return (a | b if op == "or" else a & b), "bool"
        if op == "not":
            return ~self.truth(args[0], env), "bool"
        if op in ("=", "!=", "<", ">", "<=", ">="):
            (a, ka), (b, kb) = self.value(args[0], env), self.value(args[1], env)
            if {ka, kb} & {"num", "int"}:
                a, b = self.number(a, ka), self.number(b, kb)
            elif {ka, kb} & {"bool"}:
                a, b = a.cast("string"), b.cast("string")
            return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op], "bool"
        if op == "in":
            tests = [self.value(Expr("=", [args[0], x]), env)[0] for x in args[1:]]
            return (reduce(lambda x, y: x | y, tests) if tests else F.lit(False)), "bool"
        if op in ("+", "-", "*", "/"):
            (a, ka), (b, kb) = self.value(args[0], env), self.value(args[1], env)
            kind = "int" if ka == kb == "int" and op != "/" else "num"
            a, b = self.number(a, ka), self.number(b, kb)
            return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[op], kind
        if op == "exists":
            raise SparqlError("EXISTS is supported as a filter of its own only")
        return self.call(e, env)

    def call(self, e: Expr, env: dict[str, Column]) -> tuple[Column, str]:
        op, n = e.op, len(e.args)
        if op in _AGGREGATES:
            raise SparqlError(f"Invalid SPARQL: {op} outside of a projection or HAVING")
        texts = [self.text(*self.value(a, env)) for a in e.args] if op not in ("IF", "COALESCE", "BOUND") else []
        number = lambda k: self.number(*self.value(e.args[k], env))
        if op == "BOUND":
            return self.value(e.args[0], env)[0].isNotNull(), "bool"
        if op == "IF":
            a, b = self.value(e.args[1], env), self.value(e.args[2], env)
            test = self.truth(e.args[0], env)
            return (F.when(test, a[0]).otherwise(b[0]), a[1]) if a[1] == b[1] else (F.when(test, self.text(*a)).otherwise(self.text(*b)), "str")
        if op == "COALESCE":
            return F.coalesce(*[self.text(*self.value(a, env)) for a in e.args]), "str"
        if op in ("STR", "XSD:STRING"):
            return texts[0], "str"
        if op in ("IRI", "URI"):
            return texts[0], "iri"
        if op == "REGEX":
            flags = e.args[2].args[0].value if n > 2 else ""
            pattern = e.args[1].args[0].value
            return texts[0].rlike((f"(?{flags})" if flags else "") + pattern), "bool"
        if op in ("CONTAINS", "STRSTARTS", "STRENDS"):
            return {"CONTAINS": F.contains, "STRSTARTS": F.startswith, "STRENDS": F.endswith}[op](texts[0], texts[1]), "bool"
        if op == "STRLEN":
            return F.length(texts[0]).cast("double"), "int"
        if op in ("UCASE", "LCASE"):
            return (F.upper if op == "UCASE" else F.lower)(texts[0]), "str"
        if op == "SUBSTR":
            size = number(2).cast("int") if n > 2 else F.length(texts[0])
            return F.substring(texts[0], number(1).cast("int"), size), "str"
        if op == "CONCAT":
            return F.concat(*texts), "str"
        if op == "REPLACE":
            return F.regexp_replace(texts[0], texts[1], texts[2]), "str"
        if op in ("STRBEFORE", "STRAFTER"):
            at = F.locate(e.args[1].args[0].value, texts[0])
            size = len(e.args[1].args[0].value)
            cut = F.substring(texts[0], F.lit(1), at - 1) if op == "STRBEFORE" else F.substring(texts[0], at + size, F.length(texts[0]))
            return F.when(at > 0, cut).otherwise(""), "str"
        if op in ("ABS", "CEIL", "FLOOR", "ROUND"):
            f = {"ABS": F.abs, "CEIL": F.ceil, "FLOOR": F.floor, "ROUND": lambda c: F.floor(c + 0.5)}[op]
            return f(number(0)).cast("double"), "num"
        if op in ("ISIRI", "ISURI", "ISBLANK", "ISLITERAL", "ISNUMERIC"):
            c, kind = self.value(e.args[0], env)
            blank = c.cast("string").startswith("_:")
            return {"ISIRI": (kind == "iri") & ~blank if kind == "iri" else F.lit(False), "ISURI": ~blank if kind == "iri" else F.lit(False), "ISBLANK": blank if kind == "iri" else F.lit(False), "ISLITERAL": F.lit(kind != "iri"), "ISNUMERIC": F.lit(kind in ("int", "num"))}[op], "bool"
        if op == "SAMETERM":
            return texts[0] == texts[1], "bool"
        if op in ("LANG", "DATATYPE"):
            return F.lit(""), "str"
        raise SparqlError(f"function {op} is not supported")

    def truth(self, e: Expr, env: dict[str, Column]) -> Column:
        c, kind = self.value(e, env)
        if kind == "bool":
            return c
        if kind in ("num", "int"):
            return c != 0
        return c != ""

    @staticmethod
    def number(c: Column, kind: str) -> Column:
        return c if kind in ("num", "int") else c.cast("double") if kind == "bool" else c.try_cast("double")

    @staticmethod
    def text(c: Column, kind: str) -> Column:
        if kind == "int":
            return c.cast("long").cast("string")
        if kind == "num":
            return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))
        return c.cast("string")

    # Queries

    kinds: dict[str, str] = {}

    def aggregate(self, e: Expr, env: dict[str, Column], found: list[tuple[str, Column]]) -> Expr:
        """``e`` with its aggregates replaced by variables, whose columns go to ``found``."""
        if e.op in _AGGREGATES:
            name = f"__agg{len(found)}"
            if e.op == "COUNT":
                if not e.args:
                    c = F.countDistinct(F.struct(*env.values())) if e.distinct and env else F.count(F.lit(1))
                else:
                    own = self.text(*self.value(e.args[0], env))
                    c = F.countDistinct(own) if e.distinct else F.count(own)
                self.kinds[name] = "int"
                c = c.cast("double")
            elif e.op in ("SUM", "AVG"):
                own = self.number(*self.value(e.args[0], env))
                c = (F.sum_distinct(own) if e.distinct else F.sum(own)) if e.op == "SUM" else F.avg(own)
                c = F.coalesce(c, F.lit(0.0))
                self.kinds[name] = "num"
            elif e.op in ("MIN", "MAX"):
                own, kind = self.value(e.args[0], env)
                c = (F.min if e.op == "MIN" else F.max)(own)
                self.kinds[name] = kind
            else:
                own = self.text(*self.value(e.args[0], env))
                if e.op == "SAMPLE":
                    c = F.min(own)
                else:
                    c = F.array_join(F.sort_array(F.collect_set(own) if e.distinct else F.collect_list(own)), e.separator)
                self.kinds[name] = "str"
            found.append((name, c))
            return Expr("var", [name])
        if e.op in ("var", "term", "exists"):
            return e
        return Expr(e.op, [self.aggregate(a, env, found) for a in e.args], e.distinct, e.separator)

    def select(self, q: Select) -> Rows:
        rows = self.group(q.where)
        items = [(v, None) for v in rows.variables if not v.startswith("__")] if q.everything else list(q.items)
        has = lambda e: e is not None and (e.op in _AGGREGATES or any(has(a) for a in e.args if isinstance(a, Expr)))
        if q.group or any(has(e) for _, e in items) or q.having:
            env = {v: _col(v) for v in rows.variables}
            keys = []
            for v, e in q.group:
                keys.append(v)
                if e is not None:
                    rows = Rows(rows.df.withColumn(_name(v), self.text(*self.value(e, env))), (*rows.variables, v), rows.open)
            env = {v: _col(v) for v in rows.variables}
            found: list[tuple[str, Column]] = []
            items = [(v, self.aggregate(e, env, found) if e is not None else None) for v, e in items]
            having = [self.aggregate(e, env, found) for e in q.having]
            order = [(self.aggregate(e, env, found), d) for e, d in q.order]
            for v, e in items:
                if e is None and v not in keys:
                    raise SparqlError(f"Invalid SPARQL: ?{v} is neither grouped nor aggregated")
            grouped = rows.df.groupBy(*[_col(k) for k in keys])
            df = grouped.agg(*[c.alias(_name(v)) for v, c in found]) if found else rows.df.select(*[_col(k) for k in keys]).distinct()
            rows = Rows(df, (*keys, *(v for v, _ in found)), rows.open)
            for test in having:
                rows = self.filtered(rows, test)
        else:
            order = list(q.order)
        env = {v: _col(v) for v in rows.variables}
        df, names = rows.df, list(rows.variables)
        for v, e in items:
            if e is not None:
                c, kind = self.value(e, {n: _col(n) for n in names})
                df = df.withColumn(_name(v), c)
                self.kinds[v] = kind
                names.append(v)
            elif v not in names:
                df = df.withColumn(_name(v), F.lit(None).cast("string"))
                names.append(v)
        env = {v: _col(v) for v in names}
        sort = [(self.value(e, env)[0], down) for e, down in order]
        direct = lambda c, down: F.desc_nulls_last(c) if down else F.asc_nulls_first(c)
        final = [v for v, _ in items]
        keep = [self.text(_col(v), self.kinds.get(v, "iri")).alias(_name(v)) for v in final]
        if q.distinct and sort:
            ordered = df.select(*keep, *[c.alias(f"_o{k}") for k, (c, _) in enumerate(sort)])
            df = ordered.groupBy(*[_name(v) for v in final]).agg(*[(F.max if down else F.min)(f"_o{k}").alias(f"_o{k}") for k, (_, down) in enumerate(sort)])
            df = df.orderBy(*[direct(F.col(f"_o{k}"), down) for k, (_, down) in enumerate(sort)]).select(*[_name(v) for v in final])
        elif q.distinct:
            df = df.select(*keep).distinct()
        else:
            df = (df.orderBy(*[direct(c, down) for c, down in sort]) if sort else df).select(*keep)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        for v in final:
            self.kinds.pop(v, None)
        return Rows(df, tuple(final), frozenset(final))


# -- surface ---------------------------------------------------------------------------------------


def triples_of(g: PropertyGraph, default_predicate: str = DEFAULTS.default_predicate) -> DataFrame:
    """The distinct triples of a graph; the edge property ``type`` is not looked at."""
    return g.edges.select(F.col("src").alias("s"), P.predicate(F.col("props"), "sparql", default_predicate).alias("p"), F.col("dst").alias("o")).distinct()


def _parse(text: str, settings: Settings) -> Select:
    if len(text.encode()) > settings.max_query_bytes:
        raise LimitExceededError(f"the query has more than {settings.max_query_bytes} bytes")
    return Parser(text).query()


def compile_select(triples: DataFrame, text: str, settings: Settings = DEFAULTS) -> DataFrame:
    """The plan of a SELECT query: string columns named as its variables, unbound ones null."""
    query = _parse(text, settings)
    if query.ask:
        raise SparqlError("an ASK query has no rows; use ask()")
    compiler = Compiler(triples)
    compiler.kinds = {}
    rows = compiler.select(query)
    return rows.df.select(*[_col(v).alias(v) for v in rows.variables])


@dataclass
class SparqlResult:
    variables: list[str]
    rows: list[dict[str, str]]
    truncated: bool


def query(g: PropertyGraph, text: str, settings: Settings = DEFAULTS, max_rows: int | None = None) -> SparqlResult:
    """Rows as dictionaries, at most ``max_rows`` of them; stops after ``max_seconds``."""
    import threading

    spark = g.nodes.sparkSession
    limit = settings.max_rows if max_rows is None else max_rows
    tag = f"weft-sparql-{id(g)}"
    over = threading.Event()

    def stop() -> None:
        over.set()
        spark.interruptTag(tag)

    timer = threading.Timer(settings.max_seconds, stop)
    spark.addTag(tag)
    timer.start()
    try:
        df = compile_select(triples_of(g, settings.default_predicate), text, settings)
        got = df.limit(limit + 1).collect()
    except Exception as e:
        if over.is_set():
            raise TimeoutError(f"the query took more than {settings.max_seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.removeTag(tag)
    return SparqlResult(df.columns, [{c: "" if r[c] is None else r[c] for c in df.columns} for r in got[:limit]], len(got) > limit)


def ask(g: PropertyGraph, text: str, settings: Settings = DEFAULTS) -> bool:
    parsed = _parse(text, settings)
    if not parsed.ask:
        raise SparqlError("not an ASK query")
    compiler = Compiler(triples_of(g, settings.default_predicate))
    compiler.kinds = {}
    return bool(compiler.group(parsed.where).df.limit(1).count())
