"""JSON schemas (Draft 2020-12) compiled to expressions on variants.

A schema is a graph: ``$ref`` leads from node to node, perhaps back. Each node becomes an expression that lists where a value
breaks it; values are bound to lambda variables, so that each is taken out of its record once, and children that answer to
one node are checked by one lambda. References that lead back to themselves aren't unrolled: they are a fold over the levels of
a record, whose state is the list of values that still have to be checked, each with the reference it answers to. So the
expression is as large as the schema, whatever the depth of a record. ``anyOf``, ``oneOf``, ``not``, ``if`` and ``contains``
count the sub-results that list nothing; only where a cycle leads through one of these is it unrolled, as often as the
records are nested.

A keyword that isn't compiled is refused, so nothing that a schema forbids passes silently. Formats are checked as far as
plain text rules do: ``email``, ``idn-email``, ``ipv4``, ``date``, ``uuid``; ``ipv6`` and ``regex`` are refused; the others are
annotations.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = {"string", "number", "integer", "boolean", "null", "object", "array"}
COUNTS = {"maxLength", "minLength", "maxItems", "minItems", "maxProperties", "minProperties", "maxContains", "minContains"}
NUMBERS = {"minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"}
#: Keywords that hold a schema, a list of schemas, and schemas by name.
ONE = {"items", "contains", "additionalProperties", "propertyNames", "not", "if", "then", "else"}
LISTS = {"allOf", "anyOf", "oneOf", "prefixItems"}
MAPS = {"properties", "patternProperties", "dependentSchemas", "$defs", "definitions"}
OTHERS = {"type", "enum", "const", "pattern", "required", "dependentRequired", "uniqueItems", "format", "$ref"}
NOTES = {"title", "description", "default", "examples", "$schema", "$id", "$comment", "deprecated", "readOnly", "writeOnly", "contentEncoding", "contentMediaType", "contentSchema"}
KEYWORDS = COUNTS | NUMBERS | ONE | LISTS | MAPS | OTHERS | NOTES
#: Keywords without which a schema checks nothing.
CHECKING = KEYWORDS - NOTES - {"$defs", "definitions", "then", "else"}
#: Keywords about objects and about lists.
OBJECT = {"properties", "patternProperties", "additionalProperties", "propertyNames", "required", "dependentRequired", "dependentSchemas", "maxProperties", "minProperties"}
ARRAY = {"items", "prefixItems", "contains", "maxItems", "minItems", "uniqueItems"}
REFUSED_FORMATS = {"ipv6", "regex"}
FORMATS = {
    "email": "@",
    "idn-email": "@",
    "ipv4": r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(?!\z)|\z)){4}\z",
    "date": r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}\z",
    "uuid": r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\z",
}
#: Nodes that a compiled schema may have, over all unrolled levels.
MOST_NODES = 5_000

_NONE = "CAST(array() AS array<string>)"
_NO_TASKS = "CAST(array() AS array<struct<p: string, v: variant, s: int>>)"


class SchemaError(ValueError):
    """The schema isn't one, or says what isn't compiled."""


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a name for ``value``, which is evaluated once: the optimiser doesn't put it in each place of the name."""
    return F.transform(F.array(value), body)[0]


# ---- schemas ----


def subschemas(schema: dict) -> Iterator[tuple[str, object]]:
    """The schemas right below one, with their places."""
    for key in schema:
        if key in ONE:
            yield key, schema[key]
        elif key in LISTS and isinstance(schema[key], list):
            yield from ((f"{key}[{n}]", s) for n, s in enumerate(schema[key]))
        elif key in MAPS and isinstance(schema[key], dict):
            yield from ((f"{key}.{name}", s) for name, s in schema[key].items())


def _texts(value: object) -> bool:
    return isinstance(value, list) and all(isinstance(x, str) for x in value)


def _number(value: object) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)


def faults(schema: object, path: str = "$") -> list[str]:
    """What is wrong with a schema, or isn't compiled; nothing: it can be compiled."""
    if isinstance(schema, bool):
        return []
    if not isinstance(schema, dict):
        return [f"{path} is not an object"]
    out = [f"{path} has unknown keyword {k}" for k in sorted(set(schema) - KEYWORDS)]
    kinds = schema.get("type", [])
    if isinstance(kinds, list) and "type" in schema and not kinds:
        out.append(f"{path}.type has no types")
    out += [f"{path}.type {k!r} is no type" for k in (kinds if isinstance(kinds, list) else [kinds]) if not isinstance(k, str) or k not in TYPES]
    for k in sorted(COUNTS & set(schema)):
        if not (_number(schema[k]) and schema[k] >= 0 and schema[k] == int(schema[k])):
            out.append(f"{path}.{k} is not a count")
    for k in sorted(NUMBERS & set(schema)):
        if not _number(schema[k]):
            out.append(f"{path}.{k} is not a number")
        elif k == "multipleOf" and schema[k] <= 0:
            out.append(f"{path}.{k} is not over 0")
    for pattern in [*([schema["pattern"]] if "pattern" in schema else []), *(schema.get("patternProperties") or ())]:
        try:
            re.compile(pattern)
        except (re.error, TypeError):
            out.append(f"{path}.pattern is no pattern")
    if "enum" in schema and not isinstance(schema["enum"], list):
        out.append(f"{path}.enum is not a list")
    if "uniqueItems" in schema and not isinstance(schema["uniqueItems"], bool):
        out.append(f"{path}.uniqueItems is neither true nor false")
    if not _texts(schema.get("required", [])):
        out.append(f"{path}.required is not a list")
    needs = schema.get("dependentRequired", {})
    if not (isinstance(needs, dict) and all(map(_texts, needs.values()))):
        out.append(f"{path}.dependentRequired is no object of lists")
    if schema.get("format") in REFUSED_FORMATS:
        out.append(f"{path}.format {schema['format']} is not compiled")
    if "$ref" in schema and not (isinstance(schema["$ref"], str) and schema["$ref"].startswith("#")):
        out.append(f"{path}.$ref leads out of the schema")
    for k in sorted(LISTS & set(schema)):
        if not (isinstance(schema[k], list) and schema[k]):
            out.append(f"{path}.{k} is not a list of schemas")
    for k in sorted(MAPS & set(schema)):
        if not isinstance(schema[k], dict):
            out.append(f"{path}.{k} is not an object")
    for place, inner in subschemas(schema):
        out += faults(inner, f"{path}.{place}")
    return out


def inert(schema: dict) -> bool:
    """Whether a schema checks nothing."""
    return not CHECKING & set(schema)


def resolve(root: dict, ref: str) -> object:
    """What a reference (``#``, ``#/$defs/name``) leads to."""
    at = root
    for part in unquote(ref[1:]).split("/")[1:] if ref != "#" else []:
        part = part.replace("~1", "/").replace("~0", "~")
        try:
            at = at[int(part)] if isinstance(at, list) else at[part]
        except (KeyError, IndexError, ValueError, TypeError):
            raise SchemaError(f"$ref {ref} leads nowhere") from None
    if not ref.startswith(("#/",)) and ref != "#" or not isinstance(at, (dict, bool)):
        raise SchemaError(f"$ref {ref} leads to no schema")
    return at


#: Keywords whose schemas answer for the same value; and those whose results are counted.
SAME = ("allOf", "anyOf", "oneOf", "not", "if", "then", "else", "dependentSchemas")
COUNTED = ("anyOf", "oneOf", "not", "if", "contains")


def references(schema: object, skip: tuple[str, ...] = (), only: tuple[str, ...] = ()) -> Iterator[str]:
    """The references in a schema, not beyond them; without what stands under keywords to ``skip``, or under others than ``only``."""
    if isinstance(schema, dict):
        if "$ref" in schema:
            yield schema["$ref"]
        for place, inner in subschemas(schema):
            key = re.split(r"[.\[]", place)[0]
            if key not in ("$defs", "definitions", *skip) and (not only or key in only):
                yield from references(inner, skip, only)


def cycles(root: dict, skip: tuple[str, ...] = (), only: tuple[str, ...] = ()) -> list[str]:
    """The references that lead back to themselves, by way of the keywords that ``references`` takes."""
    edges: dict[str, list[str]] = {}
    todo = ["#", *references(root)]
    while todo:
        ref = todo.pop()
        if ref not in edges:
            found = resolve(root, ref)
            edges[ref] = list(references(found, skip, only))
            todo += references(found)

    def returns(start: str) -> bool:
        seen, waiting = set(), list(edges[start])
        while waiting:
            ref = waiting.pop()
            if ref == start:
                return True
            if ref not in seen:
                seen.add(ref)
                waiting += edges[ref]
        return False

    return [ref for ref in edges if returns(ref)]


# ---- expressions ----


def _when(test: Column, message: Column) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.array(message)).otherwise(F.expr(_NONE))


def _joined(parts: list[Column], none: str = _NONE) -> Column:
    return parts[0] if len(parts) == 1 else F.concat(*parts) if parts else F.expr(none)


def _task(path: Column, v: Column, ref: int) -> Column:
    return F.struct(path.alias("p"), v.alias("v"), F.lit(ref).alias("s"))


def _grouped(found: list[tuple[object, Column]]) -> list[tuple[object, Column]]:
    """Children (arrays of path and value, by schema) that are there, those of one schema in one array."""
    groups: dict[str, tuple[object, list[Column]]] = {}
    for schema, children in found:
        if schema is not True and schema != {}:
            groups.setdefault(json.dumps(schema, sort_keys=True), (schema, []))[1].append(children)
    return [(s, F.filter(F.concat(*arrays) if len(arrays) > 1 else arrays[0], lambda c: c["v"].isNotNull())) for s, arrays in groups.values()]


def _java(pattern: str) -> str:
    """A pattern of Python as one of Java: names, ends, and letters and digits of all scripts."""
    pattern = pattern.replace("(?P<", "(?<").replace(r"\Z", r"\z")
    return "(?U)" + pattern if re.search(r"\\[wWdDsSbB]", pattern) else pattern


def _matching(entries: Column, pattern: str) -> Column:
    return F.filter(entries, lambda e: e["key"].rlike(_java(pattern)))


class _Value:
    """A value in an expression: a variant, and what is asked of it. What several keywords ask is taken out once (``bound_to``)."""

    def __init__(self, v: Column, kind: Column | None = None, fields: Column | None = None, items: Column | None = None):
        self.v = v
        self.kind = F.schema_of_variant(v) if kind is None else kind
        self.fields = F.try_variant_get(v, "$", "map<string,variant>") if fields is None else fields
        self.items = F.try_variant_get(v, "$", "array<variant>") if items is None else items
        self.text = F.try_variant_get(v, "$", "string")
        self.double = F.try_variant_get(v, "$", "double")
        self.long = F.try_variant_get(v, "$", "long")
        self.is_long = self.kind == "BIGINT"
        self.is_number = self.is_long | self.kind.startswith("DECIMAL") | self.kind.isin("DOUBLE", "FLOAT")

    @classmethod
    def bound_to(cls, v: Column, schema: dict, body: Callable[["_Value"], Column]) -> Column:
        """``body`` of the value, with its kind, fields and items evaluated once if the schema asks for them."""
        kinds = schema.get("type", [])
        kinds = set(kinds if isinstance(kinds, list) else [kinds])
        asked = {
            "kind": kinds - {"object", "array", "null"} or {"enum", "const", "pattern", "format", "maxLength", "minLength", *NUMBERS} & set(schema),
            "fields": "object" in kinds or OBJECT & set(schema),
            "items": "array" in kinds or ARRAY & set(schema),
        }
        plain = cls(v)
        held = [getattr(plain, name).alias(name) for name, wanted in asked.items() if wanted]
        if not held:
            return body(plain)
        return bound(F.struct(v.alias("v"), *held), lambda n: body(cls(n["v"], *(n[name] if wanted else None for name, wanted in asked.items()))))

    def among(self, kinds: Iterable[str]) -> Column:
        tests = {
            "string": lambda: self.kind == "STRING",
            "boolean": lambda: self.kind == "BOOLEAN",
            "null": lambda: F.is_variant_null(self.v),
            "number": lambda: self.is_number,
            "integer": lambda: self.is_long | (self.is_number & (self.double == F.rint(self.double))),
            "array": lambda: self.items.isNotNull(),
            "object": lambda: self.fields.isNotNull(),
        }
        out = F.lit(False)
        for kind in kinds:
            out = out | F.coalesce(tests[kind](), F.lit(False))
        return out

    def compared(self, test: Callable[[Column, Column], Column], limit: float) -> Column:
        """A test of a number against a limit; whole numbers are compared as such."""
        exact = isinstance(limit, int) and abs(limit) < 1 << 62
        own = test(self.double, F.lit(float(limit)))
        return self.is_number & (F.when(self.is_long, test(self.long, F.lit(limit).cast("long"))).otherwise(own) if exact else own)

    def equals(self, value: object) -> Column:
        """Whether it is this value; 1 and 1.0 are the same, the order of fields doesn't matter."""
        if value is None:
            return F.is_variant_null(self.v)
        if isinstance(value, bool):
            return (self.kind == "BOOLEAN") & (F.try_variant_get(self.v, "$", "boolean") == F.lit(value))
        if isinstance(value, (int, float)):
            return self.compared(lambda a, b: a == b, value)
        if isinstance(value, str):
            return (self.kind == "STRING") & (self.text == value)
        if isinstance(value, list):
            out = F.size(self.items) == len(value)
            for n, x in enumerate(value):
                out = out & F.coalesce(_Value(F.try_element_at(self.items, F.lit(n + 1))).equals(x), F.lit(False))
            return F.coalesce(out, F.lit(False))
        out = F.size(self.fields) == len(value)
        for k, x in value.items():
            out = out & F.coalesce(_Value(F.try_element_at(self.fields, F.lit(k))).equals(x), F.lit(False))
        return F.coalesce(out, F.lit(False))


class Compiler:
    """Expressions of one schema. ``depth``: how deep the record at hand is nested; ``most``: how deep any record is."""

    def __init__(self, root: dict, depth: Column | None = None, most: int = 0):
        self.root, self.depth, self.most, self.nodes = root, depth, most, 0
        self.back = cycles(root)

    def errors(self, schema: object, v: Column, path: Column, nest: int = 0, folding: bool = False) -> Column:
        """Places, as texts, where the variant breaks the schema. While ``folding``, what a reference that leads back says is
        left to the fold. ``nest``: folds around this one."""
        self.nodes += 1
        if self.nodes > MOST_NODES:
            raise SchemaError(f"the schema unrolls to more than {MOST_NODES} nodes")
        says = lambda what: F.concat(path, F.lit(f" {what}"))
        if schema is True or schema == {}:
            return F.expr(_NONE)
        if schema is False:
            return _when(v.isNotNull(), says("is not allowed"))
        return _Value.bound_to(v, schema, lambda value: self._checks(schema, value, path, nest, folding, says))

    def _checks(self, schema: dict, value: _Value, path: Column, nest: int, folding: bool, says: Callable[[str], Column]) -> Column:
        v = value.v
        parts = [_when(test, says(what)) for what, test in self._own(schema, value)]
        if "$ref" in schema:
            ref = schema["$ref"]
            if ref not in self.back:
                parts.append(self.errors(resolve(self.root, ref), v, path, nest, folding))
            elif not folding:
                parts.append(self._fold(ref, v, path, nest))
        parts += self._combined(schema, v, path, nest, folding, says)
        if OBJECT & set(schema):
            parts.append(F.when(value.fields.isNotNull(), self._object(schema, value.fields, path, nest, folding, says)).otherwise(F.expr(_NONE)))
        if ARRAY & set(schema):
            parts.append(F.when(value.items.isNotNull(), self._array(schema, value.items, path, nest, folding, says)).otherwise(F.expr(_NONE)))
        return _joined(parts)

    def _fold(self, ref: str, v: Column, path: Column, nest: int) -> Column:
        """Errors of a value that answers to a reference which leads back: level after level of values that are left."""
        if nest > self.most:
            return _when(v.isNotNull(), F.concat(path, F.lit(" is nested deeper than the schema was unrolled")))
        first = F.array(_task(path, v, self.back.index(ref)))
        start = F.struct(F.filter(first, lambda c: c["v"].isNotNull()).alias("left"), F.expr(_NONE).alias("found"))
        targets = [resolve(self.root, r) for r in self.back]

        def chosen(c: Column, of: Callable[[object, Column, Column], Column | None], none: str) -> Column:
            out = F.expr(none)
            for n, target in enumerate(targets):
                if (own := of(target, c["v"], c["p"])) is not None:
                    out = F.when(c["s"] == n, own).otherwise(out)
            return out

        def level(state: Column, _: Column) -> Column:
            found = F.transform(state["left"], lambda c: chosen(c, lambda s, x, p: self.errors(s, x, p, nest + 1, True), _NONE))
            left = F.transform(state["left"], lambda c: chosen(c, lambda s, x, p: self.tasks(s, x, p, nest + 1), _NO_TASKS))
            return F.struct(F.flatten(left).alias("left"), F.concat(state["found"], F.flatten(found)).alias("found"))

        levels = F.sequence(F.lit(0), (self.depth + 1) * len(self.back))
        return F.aggregate(levels, start, level, lambda state: state["found"])

    def leads(self, schema: object) -> bool:
        """Whether a reference that leads back stands in a schema, other than where results are counted."""
        found = list(references(schema, skip=COUNTED))
        return any(r in self.back or self.leads(resolve(self.root, r)) for r in found)

    def tasks(self, schema: object, v: Column, path: Column, nest: int) -> Column | None:
        """The values below that answer to references which lead back: path, value and number of the reference."""
        if not self.leads(schema):
            return None
        self.nodes += 1
        value, parts = _Value(v), []
        if "$ref" in schema:
            ref = schema["$ref"]
            parts.append(F.array(_task(path, v, self.back.index(ref))) if ref in self.back else self.tasks(resolve(self.root, ref), v, path, nest))
        parts += [self.tasks(s, v, path, nest) for s in schema.get("allOf", ())]
        branches = [self.tasks(schema[k], v, path, nest) if "if" in schema and k in schema else None for k in ("then", "else")]
        if any(b is not None for b in branches):
            yes, no = (F.expr(_NO_TASKS) if b is None else b for b in branches)
            parts.append(F.when(self._fits(schema["if"], v, path, nest), yes).otherwise(no))
        for k, s in schema.get("dependentSchemas", {}).items():
            if (own := self.tasks(s, v, path, nest)) is not None:
                parts.append(F.when(F.map_contains_key(value.fields, F.lit(k)), own).otherwise(F.expr(_NO_TASKS)))
        for inner, children in ((value.fields, self._named), (value.items, self._listed)):
            if any(self.leads(s) for s in self._below(schema, children)):
                parts.append(F.coalesce(bound(inner, self._children_tasks(schema, path, nest, children)), F.expr(_NO_TASKS)))
        return _joined([p for p in parts if p is not None], _NO_TASKS)

    def _below(self, schema: dict, children: Callable) -> Iterator[object]:
        if children == self._named:
            yield from (s for k in ("properties", "patternProperties") for s in schema.get(k, {}).values())
            yield from (schema[k] for k in ("additionalProperties", "propertyNames") if k in schema)
        else:
            yield from schema.get("prefixItems", ())
            yield from (schema[k] for k in ("items",) if k in schema)

    def _children_tasks(self, schema: dict, path: Column, nest: int, children: Callable) -> Callable[[Column], Column]:
        def each(s: object, found: Column) -> Column:
            return F.flatten(F.transform(found, lambda c: self.tasks(s, c["v"], c["p"], nest)))

        return lambda inner: _joined([each(s, found) for s, found in _grouped(children(schema, inner, path)) if self.leads(s)], _NO_TASKS)

    def _own(self, schema: dict, value: _Value) -> Iterator[tuple[str, Column]]:
        """What of the value itself is wrong: keyword and test."""
        if "type" in schema:
            kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
            yield "type", ~value.among(kinds)
        choices = [("enum", schema["enum"])] if "enum" in schema else []
        if "const" in schema:
            choices.append(("const", [schema["const"]]))
        for keyword, among in choices:
            test = F.lit(False)
            texts = [x for x in among if isinstance(x, str)]
            if texts:
                test = (value.kind == "STRING") & value.text.isin(*texts)
            for x in among:
                if not isinstance(x, str):
                    test = F.coalesce(test, F.lit(False)) | F.coalesce(value.equals(x), F.lit(False))
            yield keyword, value.v.isNotNull() & ~F.coalesce(test, F.lit(False))
        is_text, size = value.kind == "STRING", F.length(value.text)
        if "maxLength" in schema:
            yield "maxLength", is_text & (size > int(schema["maxLength"]))
        if "minLength" in schema:
            yield "minLength", is_text & (size < int(schema["minLength"]))
        if "pattern" in schema:
            yield "pattern", is_text & ~value.text.rlike(_java(schema["pattern"]))
        if schema.get("format") in FORMATS:
            fits = value.text.rlike(FORMATS[schema["format"]])
            if schema["format"] == "date":
                fits = fits & value.text.try_cast("date").isNotNull()
            yield "format", is_text & ~F.coalesce(fits, F.lit(False))
        for keyword, test in (
            ("minimum", lambda a, b: a < b), ("maximum", lambda a, b: a > b), ("exclusiveMinimum", lambda a, b: a <= b), ("exclusiveMaximum", lambda a, b: a >= b),
        ):
            if keyword in schema:
                yield keyword, value.compared(test, schema[keyword])
        if "multipleOf" in schema:
            step = schema["multipleOf"]
            if isinstance(step, int):
                yield "multipleOf", value.compared(lambda a, b: a % b != 0, step)
            else:
                quotient = value.double / F.lit(step)
                yield "multipleOf", value.is_number & (quotient != F.rint(quotient))

    def _fits(self, schema: object, v: Column, path: Column, nest: int) -> Column:
        """Whether a value keeps to a schema, with all that references say."""
        return F.size(self.errors(schema, v, path, nest)) == 0

    def _combined(self, schema: dict, v: Column, path: Column, nest: int, folding: bool, says: Callable[[str], Column]) -> list[Column]:
        out = [self.errors(s, v, path, nest, folding) for s in schema.get("allOf", ())]
        for keyword in ("anyOf", "oneOf"):
            if keyword in schema:
                fits = [F.when(self._fits(s, v, path, nest), 1).otherwise(0) for s in schema[keyword]]
                count = fits[0]
                for more in fits[1:]:
                    count = count + more
                out.append(self._counted(keyword, len(fits), count, v, path))
        if "not" in schema:
            out.append(_when(v.isNotNull() & self._fits(schema["not"], v, path, nest), says("not")))
        if "if" in schema and {"then", "else"} & set(schema):
            branches = [self.errors(schema.get(k, True), v, path, nest, folding) for k in ("then", "else")]
            out.append(F.when(self._fits(schema["if"], v, path, nest), branches[0]).otherwise(branches[1]))
        return out

    def _counted(self, keyword: str, of: int, count: Column, v: Column, path: Column) -> Column:
        def told(n: Column) -> Column:
            wrong = n == 0 if keyword == "anyOf" else n != 1
            return F.when(v.isNotNull() & wrong, F.array(F.concat(path, F.lit(f" {keyword} ("), n.cast("string"), F.lit(f" of {of})")))).otherwise(F.expr(_NONE))

        return bound(count, told)

    def _each(self, schema: object, children: Column, nest: int, folding: bool) -> Column:
        """Errors of all children (path and value), which answer to one schema."""
        return F.flatten(F.transform(children, lambda c: self.errors(schema, c["v"], c["p"], nest, folding)))

    def _named(self, schema: dict, m: Column, path: Column) -> list[tuple[object, Column]]:
        """The children of an object (its map), by the schema they answer to."""
        properties, patterns, entries = schema.get("properties", {}), schema.get("patternProperties", {}), F.map_entries(m)
        child = lambda name, x: F.struct(F.concat(path, F.lit("."), name).alias("p"), x.alias("v"))
        found = [(s, F.array(child(F.lit(k), F.try_element_at(m, F.lit(k))))) for k, s in properties.items() if s is not True]
        for pattern, s in patterns.items():
            found.append((s, F.transform(_matching(entries, pattern), lambda e: child(e["key"], e["value"]))))
        if "additionalProperties" in schema:

            def additional(e: Column) -> Column:
                test = ~e["key"].isin(*properties) if properties else F.lit(True)
                for pattern in patterns:
                    test = test & ~e["key"].rlike(_java(pattern))
                return test

            found.append((schema["additionalProperties"], F.transform(F.filter(entries, additional), lambda e: child(e["key"], e["value"]))))
        if "propertyNames" in schema:
            found.append((schema["propertyNames"], F.transform(F.map_keys(m), lambda k: child(k, k.cast("variant")))))
        return found

    def _listed(self, schema: dict, a: Column, path: Column) -> list[tuple[object, Column]]:
        """The children of a list, by the schema they answer to."""
        first = schema.get("prefixItems", [])
        child = lambda n, x: F.struct(F.concat(path, F.lit("["), n, F.lit("]")).alias("p"), x.alias("v"))
        found = [(s, F.array(child(F.lit(str(n)), F.try_element_at(a, F.lit(n + 1))))) for n, s in enumerate(first)]
        if "items" in schema:
            all_items = F.transform(a, lambda x, n: child(n.cast("string"), x))
            found.append((schema["items"], F.slice(all_items, len(first) + 1, F.greatest(F.size(a) - len(first), F.lit(0))) if first else all_items))
        return found

    def _object(self, schema: dict, m: Column, path: Column, nest: int, folding: bool, says: Callable[[str], Column]) -> Column:
        """Errors of an object, of its map of fields."""
        has = lambda k: F.map_contains_key(m, F.lit(k))
        parts = [_when(~has(k), says(f"required {k}")) for k in schema.get("required", ())]
        for k, needed in schema.get("dependentRequired", {}).items():
            parts += [_when(has(k) & ~has(n), says(f"dependentRequired {n}")) for n in needed]
        if "maxProperties" in schema:
            parts.append(_when(F.size(m) > int(schema["maxProperties"]), says("maxProperties")))
        if "minProperties" in schema:
            parts.append(_when(F.size(m) < int(schema["minProperties"]), says("minProperties")))
        alone, rest = self._alone(schema)
        for k in alone:  # a field with a schema of its own needs no list of children
            parts.append(self._field(schema["properties"][k], F.try_element_at(m, F.lit(k)), F.concat(path, F.lit(f".{k}")), nest, folding))
        parts += [self._each(s, found, nest, folding) for s, found in _grouped(self._named(rest, m, path))]
        for k, s in schema.get("dependentSchemas", {}).items():
            own = F.array(F.struct(path.alias("p"), F.to_variant_object(m).alias("v")))
            parts.append(F.when(has(k), self._each(s, own, nest, folding)).otherwise(F.expr(_NONE)))
        return _joined(parts)

    def _alone(self, schema: dict) -> tuple[list[str], dict]:
        """The fields whose schema no other child has, and the schema with the others alone (known as fields still)."""
        told = lambda s: json.dumps(s, sort_keys=True)
        often = Counter(told(s) for s in self._below(schema, self._named))
        fields = schema.get("properties", {})
        alone = [k for k, s in fields.items() if often[told(s)] == 1 and s is not True]
        return alone, schema | {"properties": {k: True if k in alone else s for k, s in fields.items()}}

    def _field(self, schema: object, v: Column, path: Column, nest: int, folding: bool) -> Column:
        return bound(v, lambda x: F.when(x.isNotNull(), self.errors(schema, x, path, nest, folding)).otherwise(F.expr(_NONE)))

    def _array(self, schema: dict, a: Column, path: Column, nest: int, folding: bool, says: Callable[[str], Column]) -> Column:
        """Errors of a list."""
        parts = []
        if "maxItems" in schema:
            parts.append(_when(F.size(a) > int(schema["maxItems"]), says("maxItems")))
        if "minItems" in schema:
            parts.append(_when(F.size(a) < int(schema["minItems"]), says("minItems")))
        if schema.get("uniqueItems"):
            told = F.transform(a, lambda x: F.to_json(x))
            parts.append(_when(F.size(F.array_distinct(told)) < F.size(a), says("uniqueItems")))
        parts += [self._each(s, found, nest, folding) for s, found in _grouped(self._listed(schema, a, path))]
        if "contains" in schema:
            count = F.size(F.filter(a, lambda x: self._fits(schema["contains"], x, path, nest)))
            least, most = int(schema.get("minContains", 1)), schema.get("maxContains")
            parts.append(_when((count < least) | (F.lit(most is not None) & (count > int(most or 0))), says("contains")))
        return _joined(parts)


def checked(schema: object, strict: bool = False) -> dict:
    """The schema, if it can be compiled; ``strict``: and if it checks anything."""
    if not isinstance(schema, dict):
        raise TypeError("a schema is a dictionary")
    if not schema:
        raise SchemaError("the schema is empty")
    if found := faults(schema):
        raise SchemaError("; ".join(found))
    if strict and inert(schema):
        raise SchemaError("the schema checks nothing")
    if back := cycles(schema, only=SAME):
        raise SchemaError(f"$ref {back[0]} leads to itself at the same value")
    return schema


def nesting(json_text: Column) -> Column:
    """How deep arrays and objects of a JSON text are nested."""
    brackets = F.regexp_replace(F.regexp_replace(json_text, r'"(?:\\.|[^"\\])*+"', ""), r"[^\[\]{}]", "")
    fold = F.aggregate(
        F.split(brackets, ""),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda a, c: bound(
            a["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0), lambda n: F.struct(n.alias("now"), F.greatest(a["most"], n).alias("most"))
        ),
        lambda a: a["most"],
    )
    return F.coalesce(fold, F.lit(0))


def compiled(schema: dict, records: DataFrame, json_col: str) -> Callable[[Column, Column], Column]:
    """Variant and the nesting of its record to errors.

    If a cycle leads through results that are counted, ``records`` are asked how deep they are nested, in one job.
    """
    checked(schema)
    most = 0
    back = cycles(schema)
    for ref in back:
        target = resolve(schema, ref)
        if any((Counter(references(target)) - Counter(references(target, skip=COUNTED)))[r] for r in back):
            most = records.agg(F.max(nesting(F.col(json_col)))).first()[0] or 0
            break
    return lambda v, depth: Compiler(schema, depth, most).errors(schema, v, F.lit("$"))
