"""The query language over document relations: terms joined by AND become Columns, Catalyst does the rest.

A term is has:<field>, !has:<field>, links-to:<path>, !links-to:<path> or field op value with one of
= != ~ >= <= > <. A field that is absent differs from every value; a field that is null differs from none.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class QueryError(ValueError):
    """A term, field or operand that the language does not have."""


#: Fields of each entity: name to type. Fixed values.
ENTITIES: dict[str, dict[str, str]] = {
    "documents": {"file": "string", "title": "string", "h1": "boolean", "headings": "number", "links": "number", "tasks": "number", "code": "number", "words": "number"},
    "headings": {"file": "string", "line": "number", "depth": "number", "text": "string", "slug": "string"},
    "links": {"file": "string", "line": "number", "text": "string", "target": "string", "image": "boolean", "external": "boolean", "resolved": "string", "fragment": "string"},
    "tasks": {"file": "string", "line": "number", "checked": "boolean", "status": "string", "text": "string"},
    "code": {"file": "string", "line": "number", "end_line": "number", "language": "string", "content": "string"},
    "frontmatter": {"file": "string", "key": "string", "value": "string", "type": "string"},
}
#: Longest first, so that >= is not read as >.
OPERATORS = ("!=", ">=", "<=", "=", "~", ">", "<")


@dataclass(frozen=True)
class Predicate:
    name: str
    op: str
    operand: object
    dynamic: bool = False
    negated: bool = False


@dataclass
class Plan:
    entity: str
    predicates: list[Predicate] = field(default_factory=list)
    select: list[str] = field(default_factory=list)
    group_by: str | None = None


def resolve_field(entity: str, token: str) -> tuple[str, str, bool]:
    """(name, type, dynamic)."""
    if entity not in ENTITIES:
        raise QueryError(f"unknown entity {entity!r}; known: {', '.join(ENTITIES)}")
    if token.startswith("frontmatter."):
        if not token[12:]:
            raise QueryError("frontmatter. needs a key")
        return token[12:], "any", True
    if token not in ENTITIES[entity]:
        elsewhere = [e for e, fields in ENTITIES.items() if token in fields]
        raise QueryError(f"{entity} has no field {token!r}; it has {', '.join(ENTITIES[entity])}" + (f"; {elsewhere[0]} has it" if elsewhere else ""))
    return token, ENTITIES[entity][token], False


def parse_where(entity: str, term: str) -> Predicate:
    term = term.strip()
    if not term:
        raise QueryError("an empty term")
    if m := re.match(r"(!?)([A-Za-z-]+):(.*)$", term):
        negated, name, arg = m[1] == "!", m[2], m[3].strip()
        if name not in ("has", "links-to"):
            raise QueryError(f"unknown predicate {name!r}")
        if not arg:
            raise QueryError(f"{name}: needs an argument")
        if name == "has":
            token, _, dynamic = resolve_field(entity, arg)
            return Predicate(token, "has", None, dynamic, negated)
        if entity not in ("documents", "links"):
            raise QueryError("links-to works on documents and links")
        path, _, fragment = arg.partition("#")
        return Predicate("links-to", "links-to", (path, fragment or None), False, negated)
    found = [(term.find(op, 0), -len(op), op) for op in OPERATORS if op in term]
    if not found:
        raise QueryError(f"no operator in {term!r}")
    at, _, op = min(found)
    if at == 0:
        raise QueryError(f"no field before {op!r}")
    token, kind, dynamic = resolve_field(entity, term[:at].strip())
    raw = term[at + len(op) :].strip()
    if op in (">", ">=", "<", "<="):
        if not dynamic and kind != "number":
            raise QueryError(f"{op} needs a number field, {token} is a {kind}")
        return Predicate(token, op, _number(raw), dynamic)
    if op == "~" or dynamic or kind == "string":
        return Predicate(token, op, raw, dynamic)
    if kind == "boolean":
        if raw not in ("true", "false"):
            raise QueryError(f"{token} is true or false, not {raw!r}")
        return Predicate(token, op, raw == "true")
    return Predicate(token, op, _number(raw))


def _number(raw: str) -> float:
    try:
        x = float(raw)
    except ValueError:
        x = math.nan
    if not math.isfinite(x):
        raise QueryError(f"not a number: {raw!r}")
    return x


def plan(entity: str, where: str | list[str] = (), select: str | None = None, group_by: str | None = None) -> Plan:
    terms = [t for t in re.split(r"\s+AND\s+", where)] if isinstance(where, str) and where else list(where)
    out = Plan(entity, [parse_where(entity, t) for t in terms])
    for token in (select or "").split(","):
        if token.strip():
            resolve_field(entity, token.strip())
            if token.strip() not in out.select:
                out.select.append(token.strip())
    if group_by is not None:
        resolve_field(entity, group_by)
        out.group_by = group_by
    return out


def json_path(name: str, index: bool = True) -> str:
    """The path of a dotted name; a step of digits is a place in an array, or else a key."""
    if "'" in name and '"' in name:
        raise ValueError(f"{name!r}: a field's name may hold one kind of quotes")
    quote = '"' if "'" in name else "'"
    return "$" + "".join(f"[{int(p)}]" if index and p.isdecimal() else f"[{quote}{p}{quote}]" for p in name.split("."))


def field_value(name: str) -> Column:
    """A frontmatter field as a variant; null if it is absent. A step of digits is tried as a place first, then as a key."""
    data = F.try_parse_json("frontmatter")
    v = F.variant_get(data, json_path(name), "variant")
    if any(p.isdecimal() for p in name.split(".")):
        v = F.coalesce(v, F.variant_get(data, json_path(name, False), "variant"))
    return v


def _values(name: str) -> Column:
    """A frontmatter field as an array of its values; null if it is absent. JSON null is a null item."""
    v = field_value(name)
    many, one = F.try_variant_get(v, "$", "array<string>"), F.try_variant_get(v, "$", "string")
    return F.when(v.isNull(), F.lit(None)).when(F.schema_of_variant(v).startswith("ARRAY"), many).otherwise(F.array(one))


def frontmatter_value(parsed: DataFrame, name: str) -> DataFrame:
    """path, state, value of a dotted key: ok, absent, or missing, malformed, non-mapping as the header is. Objects and lists are given as JSON."""
    v = field_value(name)
    state = F.when(F.col("frontmatter_status") != "valid", F.col("frontmatter_status")).when(v.isNull(), "absent").otherwise("ok")
    return parsed.select("path", state.alias("state"), F.try_variant_get(v, "$", "string").alias("value"))


def _compare(x: Column, op: str, operand: object, dynamic: bool, kind: str) -> Column:
    if op == "~":
        return F.coalesce(F.contains(F.lower(x.cast("string")), F.lit(str(operand).lower())), F.lit(False))
    if op in (">", ">=", "<", "<="):
        n = x.try_cast("double")
        hit = {">": n > operand, ">=": n >= operand, "<": n < operand, "<=": n <= operand}[op]
        return F.coalesce(hit & ~F.isnan(n), F.lit(False))
    y = x.cast("string") if dynamic or kind == "string" else x.cast("double") if kind == "number" else x
    return F.coalesce(y == F.lit(operand), F.lit(False)) if op == "=" else F.coalesce(y != F.lit(operand), F.lit(False))


def condition(entity: str, p: Predicate) -> Column:
    """A Column that is never null, so that negation stays two-valued."""
    if p.dynamic:
        values = _values(p.name)
        if p.op == "has":
            kind = F.schema_of_variant(field_value(p.name))
            some = F.when(kind.startswith("ARRAY"), F.size(values) > 0).when(kind == "VOID", F.lit(False)).otherwise(~F.get(values, F.lit(0)).isin("", "0", "false"))
            hit = F.coalesce(some, F.lit(False))
        elif p.op == "!=":
            hit = F.when(values.isNull(), True).otherwise(F.forall(values, lambda x: _compare(x, "!=", p.operand, True, "any")))
        else:
            hit = F.coalesce(F.exists(values, lambda x: _compare(x, p.op, p.operand, True, "any")), F.lit(False))
    elif p.op == "links-to":
        path, fragment = p.operand
        one = lambda x: (x["resolved"] == path) & ((x["fragment"] == fragment) if fragment else F.lit(True))
        hit = F.exists("all_links", lambda x: F.coalesce(one(x), F.lit(False))) if entity == "documents" else F.coalesce(one({"resolved": F.col("resolved"), "fragment": F.col("fragment")}), F.lit(False))
    elif p.op == "has":
        kind, c = ENTITIES[entity][p.name], F.col(p.name)
        hit = F.coalesce({"string": c != "", "number": c.cast("double") != 0, "boolean": c}[kind], F.lit(False)) if kind != "string" else F.coalesce(c != "", F.lit(False))
    else:
        hit = _compare(F.col(p.name), p.op, p.operand, False, ENTITIES[entity][p.name])
    return ~hit if p.negated else hit


def run(relation: DataFrame, p: Plan) -> DataFrame:
    """Rows, or with group_by a row per key with its count and files; an array key fans out, a missing one is null.

    relation has the entity's fields and frontmatter (JSON text); documents also all_links.
    """
    out = relation
    for q in p.predicates:
        out = out.where(condition(p.entity, q))
    shown = p.select or list(ENTITIES[p.entity])
    columns = [(F.array_join(_values(c[12:]), ",") if c.startswith("frontmatter.") else F.col(c)).alias(c.replace(".", "_")) for c in shown]
    if p.group_by is None:
        return out.select(columns)
    name, _, dynamic = resolve_field(p.entity, p.group_by)
    keys = F.coalesce(F.when(F.size(_values(name)) > 0, F.array_distinct(_values(name))), F.array(F.lit(None).cast("string"))) if dynamic else F.array(F.col(name).cast("string"))
    return out.withColumn("key", F.explode(keys)).groupBy("key").agg(F.count("*").alias("count"), F.array_join(F.array_sort(F.collect_list("file")), ",").alias("files"))


def relation(parsed: DataFrame, entity: str) -> DataFrame:
    """An entity's rows from parsed documents (see extract), with the document's frontmatter on every row."""
    from lodestone.operators import extract

    base = ["path", "frontmatter"]
    if entity == "documents":
        first = F.get(F.filter("headings", lambda h: h["depth"] == 1), F.lit(0))["text"]
        rows = parsed.select("*", F.coalesce(F.try_variant_get(F.try_parse_json("frontmatter"), "$.title", "string"), first).alias("title"), F.exists("headings", lambda h: h["depth"] == 1).alias("h1"))
        links = extract.resolved(parsed.select("path", F.explode("links").alias("r")).select("path", "r.*")).groupBy("path").agg(F.collect_list(F.struct("resolved", "fragment")).alias("all_links"))
        rows = rows.select(F.col("path").alias("file"), "frontmatter", "title", "h1", F.size("headings").alias("headings"), F.size("links").alias("links"), F.size("tasks").alias("tasks"), F.size("code_blocks").alias("code"), "words")
        return rows.join(links.withColumnRenamed("path", "file"), "file", "left").withColumn("all_links", F.coalesce("all_links", F.array().cast(links.schema["all_links"].dataType)))
    if entity == "frontmatter":
        data = F.try_variant_get(F.try_parse_json("frontmatter"), "$", "map<string,variant>")
        kind = F.schema_of_variant("value_v")
        label = F.when(kind == "VOID", "null").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").otherwise("number")
        return parsed.select(*base, F.explode(data).alias("key", "value_v")).select(F.col("path").alias("file"), "frontmatter", "key", F.when(label != "null", F.coalesce(F.try_variant_get("value_v", "$", "string"), F.to_json("value_v"))).alias("value"), label.alias("type"))
    column = {"headings": "headings", "links": "links", "tasks": "tasks", "code": "code_blocks"}[entity]
    rows = parsed.select(*base, F.explode(column).alias("r")).select(F.col("path").alias("file"), "path", "frontmatter", "r.*")
    if entity == "links":
        rows = extract.resolved(rows)
    if entity == "tasks":
        rows = rows.withColumn("status", F.when(F.col("checked"), "done").otherwise("pending"))
    return rows.drop("path")
