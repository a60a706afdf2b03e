"""JSON schemas on variants against a plain reading of each keyword."""

import datetime
import json
import random
import re

import pytest

from filelode.operators import schemas, validation


def kind(x):
    return {bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object", type(None): "null"}[type(x)]


def same(a, b):
    if kind(a) != kind(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return a == b


def holds(s, x, root):
    """Whether a value keeps to a schema, keyword by keyword."""
    if isinstance(s, bool):
        return s
    ok = []
    if "$ref" in s:
        ok.append(holds(schemas.resolve(root, s["$ref"]), x, root))
    if "type" in s:
        kinds = s["type"] if isinstance(s["type"], list) else [s["type"]]
        ok.append(kind(x) in kinds or ("integer" in kinds and kind(x) == "number" and x == int(x)))
    if "enum" in s:
        ok.append(any(same(x, e) for e in s["enum"]))
    if "const" in s:
        ok.append(same(x, s["const"]))
    ok += [holds(t, x, root) for t in s.get("allOf", [])]
    if "anyOf" in s:
        ok.append(any(holds(t, x, root) for t in s["anyOf"]))
    if "oneOf" in s:
        ok.append(sum(holds(t, x, root) for t in s["oneOf"]) == 1)
    if "not" in s:
        ok.append(not holds(s["not"], x, root))
    if "if" in s:
        ok.append(holds(s.get("then" if holds(s["if"], x, root) else "else", True), x, root))
    if kind(x) == "string":
        ok += [len(x) <= s.get("maxLength", 1e9), len(x) >= s.get("minLength", 0), bool(re.search(s.get("pattern", ""), x))]
        if s.get("format") == "email":
            ok.append("@" in x)
        if s.get("format") == "date":
            try:
                ok.append(bool(re.fullmatch(r"\d{4}-\d\d-\d\d", x)) and bool(datetime.date.fromisoformat(x)))
            except ValueError:
                ok.append(False)
    if kind(x) == "number":
        ok += [x >= s.get("minimum", -1e99), x <= s.get("maximum", 1e99), x > s.get("exclusiveMinimum", -1e99), x < s.get("exclusiveMaximum", 1e99)]
        if "multipleOf" in s:
            ok.append(x % s["multipleOf"] == 0)
    if kind(x) == "array":
        first = s.get("prefixItems", [])
        ok += [len(x) <= s.get("maxItems", 1e9), len(x) >= s.get("minItems", 0)]
        ok += [holds(t, y, root) for t, y in zip(first, x)] + [holds(s.get("items", True), y, root) for y in x[len(first) :]]
        if s.get("uniqueItems"):
            ok.append(not any(same(a, b) for n, a in enumerate(x) for b in x[:n]))
        if "contains" in s:
            ok.append(s.get("minContains", 1) <= sum(holds(s["contains"], y, root) for y in x) <= s.get("maxContains", 1e9))
    if kind(x) == "object":
        ok += [len(x) <= s.get("maxProperties", 1e9), len(x) >= s.get("minProperties", 0), all(k in x for k in s.get("required", []))]
        ok += [all(n in x for n in needs) for k, needs in s.get("dependentRequired", {}).items() if k in x]
        ok += [holds(t, x, root) for k, t in s.get("dependentSchemas", {}).items() if k in x]
        ok += [holds(s.get("propertyNames", True), k, root) for k in x]
        for k, y in x.items():
            own = [t for name, t in s.get("properties", {}).items() if name == k] + [t for p, t in s.get("patternProperties", {}).items() if re.search(p, k)]
            ok += [holds(t, y, root) for t in own or [s.get("additionalProperties", True)]]
    return all(ok)


VALUES = [None, True, False, 0, 1, 1.0, 2, 7, -3, 2.5, 1e20, "", "y", "xyz", "a@b", "2024-02-30", "2024-02-29", "日本", [], [1], [1, 1.0], [1, "1"], ["x", 2, True], [[1], [1]], {}, {"a": 1}]
VALUES += [{"a": 1, "b": "x"}, {"a": True, "c": None}, {"b": {"a": 2}, "c": [1]}, {"next": {"next": {"n": 3}}, "n": 1}, {"next": {"next": {"n": "no"}}}, {"kids": [{"n": 1}, {"kids": [{"n": "no"}]}]}, {"a.b": 1, "x1": 5, "x2": "s"}]
NODE = {"properties": {"n": {"type": "integer"}, "next": {"$ref": "#"}, "left": {"$ref": "#"}, "kids": {"items": {"$ref": "#"}}}}
EIGHT = [
    ({"type": "boolean"}, "x"),
    ({"type": "integer", "enum": [1, 2]}, 7),
    ({"type": ["string", "null"], "maxLength": 2}, "xyz"),
    ({"anyOf": [{"required": ["a", "b"]}, {"required": ["c"]}]}, {"a": 1}),
    ({"type": "object", "additionalProperties": {"type": "string"}}, {"a": 3}),
    ({"properties": {"a": {"anyOf": [{"type": "string"}, {"type": "integer"}]}}}, {"a": True}),
    ({"enum": ["x"]}, "y"),
    ({"type": "object"}, 3),
]
CASES = [
    *(s for s, _ in EIGHT),
    NODE,
    {"$ref": "#/$defs/t", "$defs": {"t": {"type": ["array", "object"], "items": {"$ref": "#/$defs/t"}, "additionalProperties": {"anyOf": [{"$ref": "#/$defs/t"}, {"type": "number"}]}}}},
    {"type": "integer"},
    {"enum": [1, None, "xyz", [1, "1"], {"a": 1}, {"b": {"a": 2.0}, "c": [1]}]},
    {"const": False},
    {"oneOf": [{"type": "number"}, {"minimum": 2}]},
    {"not": {"type": ["string", "number"]}},
    {"if": {"type": "number"}, "then": {"minimum": 1}, "else": {"type": ["string", "array"], "maxItems": 1}},
    {"allOf": [{"type": "number"}, {"exclusiveMaximum": 7}, {"exclusiveMinimum": -3}]},
    {"multipleOf": 2},
    {"multipleOf": 0.5},
    {"uniqueItems": True, "contains": {"type": "number"}, "maxContains": 1},
    {"contains": {"const": 1}, "minContains": 2},
    {"prefixItems": [{"type": "number"}, False], "items": {"type": "boolean"}},
    {"properties": {"a": True, "b": False}, "patternProperties": {"^x[0-9]": {"type": "integer"}}, "additionalProperties": {"type": ["null", "object"]}},
    {"propertyNames": {"maxLength": 1}, "minProperties": 1, "maxProperties": 2},
    {"dependentRequired": {"a": ["b"]}, "dependentSchemas": {"b": {"properties": {"c": {"type": "array"}}}}},
    {"format": "email"},
    {"format": "date", "minLength": 1},
    {"pattern": r"^\w+\Z", "maxLength": 3},
    False,
]


def test_eight_records_that_were_taken(spark):
    for schema, value in EIGHT:
        df = spark.createDataFrame([(json.dumps(value),)], "record string")
        row = validation.validate(df, schema).first()
        assert not row.valid and row.errors, schema


def test_each_keyword_on_each_value(spark):
    df = spark.createDataFrame([(n, json.dumps(x)) for n, x in enumerate(VALUES)], "n int, record string")
    named = {str(n): s if isinstance(s, dict) else {"allOf": [s]} for n, s in enumerate(CASES)}
    got = {(r.n, r.schema): r for r in validation.validate_each(df, named).collect()}
    assert len(got) == len(VALUES) * len(CASES)
    wrong = [(named[k], VALUES[n], r.errors) for (n, k), r in got.items() if r.valid != holds(named[k], VALUES[n], named[k])]
    assert wrong == []


def invented(rnd, depth=0):
    """A schema of some keywords."""
    s = {}
    for k in rnd.sample(["type", "enum", "minimum", "maxLength", "properties", "items", "required", "anyOf", "oneOf", "not", "additionalProperties", "$ref"], rnd.randrange(1, 4)):
        deeper = lambda: invented(rnd, depth + 1) if depth < 2 else rnd.choice([True, {"type": "string"}, {"type": "number"}])
        s[k] = {
            "type": lambda: rnd.sample(sorted(schemas.TYPES), 2),
            "enum": lambda: rnd.sample([x for x in VALUES if not isinstance(x, float)], 6),
            "minimum": lambda: 1,
            "maxLength": lambda: 2,
            "properties": lambda: {x: deeper() for x in rnd.sample("abcn", 2)} | {"next": deeper()},
            "items": deeper,
            "required": lambda: [rnd.choice("abcn")],
            "anyOf": lambda: [deeper(), deeper()],
            "oneOf": lambda: [deeper(), deeper()],
            "not": deeper,
            "additionalProperties": deeper,
            "$ref": lambda: "#/$defs/leaf",
        }[k]()
    return s


def test_invented_schemas(spark):
    rnd = random.Random(11)
    df = spark.createDataFrame([(n, json.dumps(x)) for n, x in enumerate(VALUES)], "n int, record string")
    named = {str(n): invented(rnd) | {"$defs": {"leaf": {"type": ["string", "object", "null"]}}} for n in range(25)}
    got = validation.validate_each(df, named).collect()
    assert [(named[r.schema], VALUES[r.n]) for r in got if r.valid != holds(named[r.schema], VALUES[r.n], named[r.schema])] == []


def test_deep_records_and_branching_cycles(spark):
    deep = {"n": "no"}
    for _ in range(30):
        deep = {"next": deep, "left": {"kids": []}}
    fine = json.loads(json.dumps(deep).replace('"no"', "7"))
    df = spark.createDataFrame([(json.dumps(x),) for x in (deep, fine)], "record string")
    bad, good = validation.validate(df, NODE).collect()
    assert not bad.valid and good.valid
    assert bad.errors == ["$" + ".next" * 30 + ".n type"]


def test_not_json_and_errors(spark):
    df = spark.createDataFrame([("{",), (None,), ('{"a": [1, {"b": 2}]}',)], "record string")
    schema = {"type": "object", "properties": {"a": {"items": {"type": "number"}}}, "required": ["z"]}
    assert [r.errors for r in validation.validate(df, schema).collect()] == [["$ is not JSON"], ["$ is not JSON"], ["$ required z", "$.a[1] type"]]


def test_what_is_refused():
    for schema in (
        {"unevaluatedProperties": False}, {"$dynamicRef": "#"}, {"format": "ipv6"}, {"$ref": "other.json"}, {"$ref": "#/$defs/none"}, {"type": []}, {"anyOf": []}, {"items": [1]},
        {"allOf": [{"kind": 1}]}, {"multipleOf": 0}, {"properties": {"a": 1}}, {"pattern": "("}, {},
    ):
        with pytest.raises(schemas.SchemaError):
            schemas.checked(schema)
    with pytest.raises(TypeError):
        schemas.checked([])
    with pytest.raises(schemas.SchemaError):
        schemas.checked({"title": "nothing"}, strict=True)
    assert schemas.checked({"title": "nothing"}) and schemas.checked({"type": "object"}, strict=True)
    assert schemas.cycles(CASES[0]) == [] and schemas.cycles(NODE) == ["#"]


def test_a_reference_to_itself_is_refused(spark):
    df = spark.createDataFrame([("1",)], "record string")
    with pytest.raises(schemas.SchemaError):
        validation.validate(df, {"$ref": "#/$defs/a", "$defs": {"a": {"$ref": "#/$defs/a"}}})


def test_a_record_is_parsed_once(spark):
    df = spark.createDataFrame([("{}",)], "record string")
    for schema in (NODE, "document-extraction", "classification"):
        plan = validation.validate(df, schema)._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"parse_?json", plan, re.I)) <= 1, schema
