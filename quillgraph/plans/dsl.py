"""The query language: text to a syntax tree to Column expressions.

    components [where CONDITION] [| count by FIELD]
    paths from REF to REF

A condition joins comparisons ``FIELD OP VALUE`` by and / or with parentheses; OP is one
of = != < <= > >= ~ (glob, ASCII case ignored). Literals stay data: no SQL text is built.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Evidence tiers.
TIERS = {"inferred": 1, "declared": 2, "locked": 3, "installed": 4, "observed": 5}
#: Columns of a component, with the kind that comparisons use.
COLUMNS = {"name": "text", "version": "text", "purl": "text", "type": "text", "confidence": "number", "tier": "tier", "id": "number"}
#: Attributes that can be named without ``attrs.``.
ATTRIBUTES = {
    "ecosystem", "scope", "excluded", "license", "supplier", "state", "direct", "marker", "observed", "observed_ports", "conditional",
    "pinned", "resolved", "requested", "family", "variant", "role", "introduced_by.layer", "introduced_by.base_image",
}
_COLUMN_NAMES = {"type": "ctype", "tier": "tier_cap"}

_TOKEN = re.compile(r"""\s*(?:(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>-?\d+(?:\.\d+)?)(?![\w.])|(?P<op><=|>=|!=|=|<|>|~)|(?P<pipe>\|)|(?P<open>\()|(?P<close>\))|(?P<word>[A-Za-z_@*?/:][\w.@*?/:+\-]*))""")


class QueryError(ValueError):
    """A message with the place in the query it is about."""

    def __init__(self, message: str, place: int, query: str):
        super().__init__(f"{message} at {place}\n  {query}\n  {' ' * max(place, 0)}^")
        self.place = place


@dataclass(frozen=True)
class Token:
    kind: str
    value: str
    place: int


@dataclass(frozen=True)
class Comparison:
    field: str
    op: str
    value: object
    place: int


@dataclass(frozen=True)
class Junction:
    op: str
    parts: tuple


@dataclass(frozen=True)
class ComponentsQuery:
    condition: Comparison | Junction | None
    count_by: str | None
    count_place: int = -1


@dataclass(frozen=True)
class PathsQuery:
    start: str
    end: str


def tokens(query: str) -> list[Token]:
    out, at = [], 0
    while query[at:].strip():
        m = _TOKEN.match(query, at)
        if not m:
            at += len(query[at:]) - len(query[at:].lstrip())
            raise QueryError(f"unexpected {query[at]!r}", at, query)
        out.append(Token(m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
        at = m.end()
    return out


class _Reader:
    def __init__(self, query: str):
        self.query, self.line, self.at = query, tokens(query), 0

    def peek(self) -> Token:
        return self.line[self.at] if self.at < len(self.line) else Token("end", "", len(self.query))

    def take(self, kind: str, *values: str) -> Token | None:
        t = self.peek()
        if t.kind == kind and (not values or t.value.lower() in values):
            self.at += 1
            return t
        return None

    def need(self, what: str, kind: str, *values: str) -> Token:
        found = self.take(kind, *values)
        if not found:
            raise QueryError(f"expected {what}", self.peek().place, self.query)
        return found

    def whole(self) -> ComponentsQuery | PathsQuery:
        if self.take("word", "paths"):
            self.need("'from'", "word", "from")
            start = self.reference()
            self.need("'to'", "word", "to")
            out = PathsQuery(start, self.reference())
        else:
            self.need("'components' or 'paths'", "word", "components")
            condition = self.either() if self.take("word", "where") else None
            field, place = None, -1
            if self.take("pipe"):
                self.need("'count'", "word", "count")
                self.need("'by'", "word", "by")
                t = self.need("a field", "word")
                field, place = t.value, t.place
            out = ComponentsQuery(condition, field, place)
        if self.peek().kind != "end":
            raise QueryError("expected the end", self.peek().place, self.query)
        return out

    def reference(self) -> str:
        t = self.take("string") or self.need("a reference", "word")
        return _plain(t.value) if t.kind == "string" else t.value

    def either(self):
        parts = [self.both()]
        while self.take("word", "or"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Junction("or", tuple(parts))

    def both(self):
        parts = [self.one()]
        while self.take("word", "and"):
            parts.append(self.one())
        return parts[0] if len(parts) == 1 else Junction("and", tuple(parts))

    def one(self):
        if self.take("open"):
            inner = self.either()
            self.need("')'", "close")
            return inner
        field = self.need("a field", "word")
        op = self.need("an operator", "op")
        value = self.peek()
        self.at += 1
        if value.kind == "string":
            return Comparison(field.value, op.value, _plain(value.value), field.place)
        if value.kind == "number":
            return Comparison(field.value, op.value, float(value.value) if "." in value.value else int(value.value), field.place)
        if value.kind == "word":
            said = {"true": True, "false": False}.get(value.value.lower(), value.value)
            return Comparison(field.value, op.value, said, field.place)
        raise QueryError("expected a value", value.place, self.query)


def _plain(quoted: str) -> str:
    return re.sub(r"\\(.)", r"\1", quoted[1:-1])


def parse(query: str) -> ComponentsQuery | PathsQuery:
    return _Reader(query).whole()


def glob_pattern(glob: str) -> str:
    """A LIKE pattern (escape ``\\``) for a glob of * and ?."""
    return "".join({"*": "%", "?": "_"}.get(c, "\\" + c if c in "%_\\" else c) for c in glob)


def field_column(field: str, place: int, query: str) -> tuple[Column, str]:
    """A field's column and kind: text, number, tier or attribute."""
    if field in COLUMNS:
        return F.col(_COLUMN_NAMES.get(field, field)), COLUMNS[field]
    if field == "excluded":
        return F.col("excluded"), "attribute"
    if field in ATTRIBUTES:
        return F.col("attrs")[field], "attribute"
    if re.fullmatch(r"attrs\.[A-Za-z0-9_.\-]+", field):
        return F.col("attrs")[field[6:]], "attribute"
    raise QueryError(f"unknown field {field!r}", place, query)


_OPS = {"=": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}


def _comparison(c: Comparison, query: str) -> Column:
    column, kind = field_column(c.field, c.place, query)
    value = c.value
    if kind == "tier" and isinstance(value, str):
        if value.lower() not in TIERS:
            raise QueryError(f"unknown tier {value!r}", c.place, query)
        value = TIERS[value.lower()]
    if c.op == "~":
        return column.cast("string").ilike(glob_pattern(str(value)))
    if isinstance(value, bool):
        if c.field == "introduced_by.base_image":
            return column.isNotNull() if value else column.isNull()
        return column == "true" if value else column.isNull() | (column != "true")
    if kind in ("number", "tier"):
        try:
            return _OPS[c.op](column, F.lit(float(value) if kind == "number" else int(value)))
        except ValueError:
            raise QueryError(f"{c.field} is compared with a number", c.place, query) from None
    if kind == "attribute" and not isinstance(value, str):
        return _OPS[c.op](column.try_cast("double"), F.lit(float(value)))
    return _OPS[c.op](column, F.lit(str(value)))


def condition(node: Comparison | Junction | None, query: str = "") -> Column:
    if node is None:
        return F.lit(True)
    if isinstance(node, Comparison):
        return _comparison(node, query)
    out = condition(node.parts[0], query)
    for part in node.parts[1:]:
        out = out & condition(part, query) if node.op == "and" else out | condition(part, query)
    return out


def tier_label(column: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, k in TIERS.items():
        out = F.when(column == k, name).otherwise(out)
    return out


def component_rows(found: DataFrame) -> DataFrame:
    """The columns that a component query returns."""
    eco = F.coalesce(F.col("attrs")["ecosystem"], F.regexp_extract("purl", "^pkg:([^/]+)/", 1))
    return found.select("id", "purl", "name", "version", eco.alias("ecosystem"), tier_label(F.col("tier_cap")).alias("tier"), "confidence", F.col("attrs")["scope"].alias("scope"), "excluded")


def run(components: DataFrame, query: str, edges: DataFrame | None = None) -> DataFrame:
    """The result of a query over component (and edge) tables; ORDER BY is by name, version, id."""
    tree = parse(query)
    if isinstance(tree, PathsQuery):
        from quillgraph.operators.graph import paths_between

        if edges is None:
            raise QueryError("paths need an edge table", 0, query)
        return paths_between(components, edges, tree.start, tree.end)
    found = components.where(condition(tree.condition, query))
    if tree.count_by:
        column, kind = field_column(tree.count_by, tree.count_place, query)
        bucket = F.coalesce(tier_label(column) if kind == "tier" else column.cast("string"), F.lit("(none)"))
        return found.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "bucket")
    return component_rows(found).orderBy("name", "version", "id")
