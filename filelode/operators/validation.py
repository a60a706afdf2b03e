"""Validation of JSON records: rules compiled to native expressions on variants.

A rule is data. ``errors`` turns it into one expression that yields the places where a record breaks it, so a table of
records is validated in a scan, without a Python worker and without collecting anything.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelode.operators import schemas

_NONE = "CAST(array() AS array<string>)"


@dataclass(frozen=True)
class Text:
    most: int | None = None
    pattern: str | None = None
    among: tuple[str, ...] = ()


@dataclass(frozen=True)
class Number:
    least: float | None = None
    most: float | None = None
    whole: bool = False
    null: bool = False


@dataclass(frozen=True)
class Scalar:
    """A text of bounded length, a number, a boolean or null; or a text or whole number alone."""

    most: int = 1024
    id_only: bool = False


@dataclass(frozen=True)
class Items:
    rule: object
    least: int = 0
    most: int | None = None


@dataclass(frozen=True)
class Flat:
    """An object of any keys with scalar values."""

    most: int = 16


@dataclass(frozen=True)
class Any:
    pass


@dataclass(frozen=True)
class Fields:
    """An object: its fields, which of them are required, which groups need one of them, whether others may come."""

    fields: dict[str, object]
    required: tuple[str, ...] = ()
    any_of: tuple[tuple[str, ...], ...] = ()
    one_of: tuple[str, ...] = ()
    extra: bool = False
    #: Further rules: a message and a function of a getter (path, type) that is true where the rule is broken.
    broken: tuple[tuple[str, Callable[[Callable[[str, str], Column]], Column]], ...] = field(default=())


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _when(test: Column, message: str) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.array(F.lit(message))).otherwise(F.expr(_NONE))


def errors(v: Column, rule: object, path: str = "$") -> Column:
    """Places, as texts, where the variant ``v`` breaks ``rule``; ``v`` null (absent) breaks nothing."""
    kind = _kind(v)
    if isinstance(rule, Any):
        return F.expr(_NONE)
    if isinstance(rule, Text):
        text = _get(v, "$", "string")
        bad = kind != "STRING"
        if rule.most is not None:
            bad = bad | (F.length(text) > rule.most)
        if rule.pattern:
            bad = bad | ~text.rlike(rule.pattern)
        if rule.among:
            bad = bad | ~text.isin(*rule.among)
        return _when(v.isNotNull() & bad, path)
    if isinstance(rule, Number):
        value = _get(v, "$", "double")
        number = kind.rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        bad = ~number & ~((kind == "VOID") if rule.null else F.lit(False))
        if rule.least is not None:
            bad = bad | (number & (value < rule.least))
        if rule.most is not None:
            bad = bad | (number & (value > rule.most))
        if rule.whole:
            bad = bad | (number & (value != F.floor(value)))
        return _when(v.isNotNull() & bad, path)
    if isinstance(rule, Scalar):
        allowed = r"^(STRING|BIGINT)" if rule.id_only else r"^(STRING|BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN|VOID)"
        bad = ~kind.rlike(allowed) | ((kind == "STRING") & (F.length(_get(v, "$", "string")) > rule.most))
        return _when(v.isNotNull() & bad, path)
    if isinstance(rule, Items):
        items = _get(v, "$", "array<variant>")
        bad = ~kind.startswith("ARRAY") | (F.size(items) < rule.least)
        if rule.most is not None:
            bad = bad | (F.size(items) > rule.most)
        inner = F.flatten(F.transform(F.coalesce(items, F.expr("CAST(array() AS array<variant>)")), lambda x: errors(x, rule.rule, f"{path}[*]")))
        return F.concat(_when(v.isNotNull() & bad, path), F.array_distinct(inner))
    if isinstance(rule, Flat):
        entries = F.map_values(_get(v, "$", "map<string,variant>"))
        bad = ~kind.startswith("OBJECT") | (F.size(entries) > rule.most) | F.exists(entries, lambda x: F.size(errors(x, Scalar(), path)) > 0)
        return _when(v.isNotNull() & bad, path)
    assert isinstance(rule, Fields)
    is_object = kind.startswith("OBJECT")
    keys = F.map_keys(_get(v, "$", "map<string,variant>"))
    parts = [_when(v.isNotNull() & ~is_object, path)]
    has = lambda k: F.array_contains(keys, k)
    for k in rule.required:
        parts.append(_when(is_object & ~has(k), f"{path}.{k} missing"))
    for group in rule.any_of:
        test = F.lit(False)
        for k in group:
            test = test | has(k)
        parts.append(_when(is_object & ~test, f"{path} needs one of {', '.join(group)}"))
    if rule.one_of:
        count = sum((has(k).cast("int") for k in rule.one_of), F.lit(0))
        parts.append(_when(is_object & (count != 1), f"{path} needs just one of {', '.join(rule.one_of)}"))
    if not rule.extra:
        known = F.array(*(F.lit(k) for k in rule.fields))
        parts.append(_when(is_object & (F.size(F.array_except(keys, known)) > 0), f"{path} has other fields"))
    for message, broken in rule.broken:
        parts.append(_when(is_object & broken(lambda p, t: _get(v, p, t)), f"{path} {message}"))
    parts += [_field(v, k, r, path) for k, r in rule.fields.items()]
    return F.concat(*parts)


def _field(v: Column, name: str, rule: object, path: str) -> Column:
    return schemas.bound(F.try_variant_get(v, f"$.{name}", "variant"), lambda c: errors(c, rule, f"{path}.{name}"))


def _has_none(get: Callable[[str, str], Column], path: str) -> Column:
    return F.size(get(path, "array<variant>")) == 0


def _empty_needs(items: str, *names: str) -> tuple[str, Callable]:
    def broken(get: Callable[[str, str], Column]) -> Column:
        test = _has_none(get, f"$.{items}")
        for n in names:
            test = test & get(f"$.{n}", "variant").isNull()
        return test

    return f"needs {' or '.join(names)} without {items}", broken


def _corners(get: Callable[[str, str], Column], items: str, places: str) -> Column:
    """All coordinates of boxes and polygons of an item list."""
    box = lambda x: F.array(*(F.try_variant_get(x, f"$.box.{c}", "double") for c in ("x", "y", "width", "height")))
    points = lambda x: F.transform(F.try_variant_get(x, "$.polygon", "array<variant>"), lambda p: F.greatest(*(F.try_variant_get(p, f"$.{c}", "double") for c in "xy")))
    found = get(f"$.{items}", "array<variant>")
    if places:
        found = F.flatten(F.transform(found, lambda x: F.coalesce(F.try_variant_get(x, f"$.{places}", "array<variant>"), F.expr("CAST(array() AS array<variant>)"))))
    return F.flatten(F.transform(found, lambda x: F.concat(box(x), F.coalesce(points(x), F.expr("CAST(array() AS array<double>)")))))


def _beyond(items: str, places: str = "") -> tuple[tuple[str, Callable], ...]:
    def rule(unit: str, most: float) -> tuple[str, Callable]:
        return f"has {unit} coordinates over {most:g}", lambda get: (get("$.unit", "string") == unit) & F.exists(_corners(get, items, places), lambda c: c > most)

    return rule("normalized", 1), rule("per_mille", 1000)


# The record formats that are validated, by name.
_TARGET, _PRODUCER, _EXPLAINED = Text(128), Text(1024), Text(256)
_VOCABULARY = {"vocabulary": Items(Text(128), most=100), "vocabulary_url": Text(2048)}
_UNIT = Text(among=("px", "pt", "normalized", "per_mille"))
_BOX = Fields({c: Number(0) for c in ("x", "y", "width", "height")}, ("x", "y", "width", "height"))
_POINT = Fields({"x": Number(0), "y": Number(0)}, ("x", "y"))
_FREE_BOX = Fields({c: Number() for c in ("x", "y", "width", "height")}, ("x", "y", "width", "height"))
_FREE_POINT = Fields({"x": Number(), "y": Number()}, ("x", "y"), extra=True)
_LANGUAGE = Text(3, r"^[a-z]{3}\z")
_POSITION = Items(Number(), least=2)
_RINGS = Items(Items(_POSITION, least=4), most=1000)


def _geometry(get: Callable[[str, str], Column]) -> Column:
    kind, depth = get("$.geometry.type", "string"), get("$.geometry.coordinates", "variant")
    shape = (
        F.when(kind == "Point", F.size(errors(depth, _POSITION)))
        .when(kind == "LineString", F.size(errors(depth, Items(_POSITION, 2, 10000))))
        .when(kind == "MultiPoint", F.size(errors(depth, Items(_POSITION, 0, 10000))))
        .when(kind == "Polygon", F.size(errors(depth, _RINGS)))
        .when(kind == "MultiPolygon", F.size(errors(depth, Items(_RINGS, most=1000))))
        .otherwise(1)
    )
    present = _kind(get("$.geometry", "variant")) != "VOID"
    return present & (depth.isNull() | (shape > 0))


SCHEMAS: dict[str, Fields] = {
    "classification": Fields(
        {
            "target": _TARGET, "producer": _PRODUCER, "score_explanation": _EXPLAINED, **_VOCABULARY, "attributes": Flat(),
            "labels": Items(Fields({"label": Text(128), "score": Number(-1, 1), "timestamp": Text(), "attributes": Flat()}, ("label",)), most=10000),
        },
        ("labels",), broken=(_empty_needs("labels", "vocabulary", "vocabulary_url", "producer"),),
    ),
    "embedding": Fields({"model": Text(1024), "target": _TARGET, "vector": Items(Number(), 1, 16384), "attributes": Flat()}, ("vector",)),
    "generic": Fields({"description": Text(1024), "producer": _PRODUCER, "data": Flat(128)}, ("data",)),
    "llm-output": Fields(
        {
            "model": Text(1024), "prompt": Text(262144), "response_data": Text(524288), "language": _LANGUAGE, "score": Number(-1, 1), "score_explanation": _EXPLAINED,
            "generation_params": Fields(
                {
                    "system_prompt": Text(4096), "temperature": Number(0, 2), "top_p": Number(0, 1), "max_tokens": Number(1, whole=True), "seed": Number(whole=True), "stop": Any(),
                    "presence_penalty": Number(-2, 2), "frequency_penalty": Number(-2, 2), "response_format": Fields({"type": Text(among=("text", "json_object"))}, ("type",)),
                }
            ),
            "generation_metadata": Fields(
                {
                    "response_id": Text(128), "created": Text(), "finish_reason": Text(128), "system_fingerprint": Text(128),
                    "usage": Fields({k: Number(0, whole=True) for k in ("prompt_tokens", "completion_tokens", "total_tokens")}, ("prompt_tokens", "completion_tokens", "total_tokens")),
                }
            ),
            "attributes": Flat(),
        },
        ("model", "response_data"),
    ),
    "audio-transcription": Fields(
        {
            "track_id": Scalar(128, id_only=True), "producer": _PRODUCER, "language": _LANGUAGE, "score_explanation": _EXPLAINED, "text": Text(524288), "attributes": Flat(),
            "segments": Items(
                Fields(
                    {
                        "text": Text(4096), "start_time": Number(0), "end_time": Number(0), "language": _LANGUAGE, "events": Items(Text(128), most=64), "score": Number(0, 1), "attributes": Flat(),
                        "speaker": Fields({"id": Scalar(128, id_only=True), "name": Text(128), "score": Number(0, 1)}, ("id",)),
                    },
                    ("text", "start_time", "end_time"),
                ),
                most=100000,
            ),
        },
        any_of=(("text", "segments"),),
    ),
    "document-extraction": Fields(
        {
            "extraction_type": Text(among=("text", "lines", "boxes", "polygons", "mixed")), "producer": _PRODUCER, "unit": _UNIT, "score_explanation": _EXPLAINED, "attributes": Flat(),
            "blocks": Items(
                Fields(
                    {
                        "block_type": Text(among=("text", "line", "box", "polygon")), "id": Text(128), "text": Text(4096), "line_number": Number(1, whole=True), "page_number": Number(1, whole=True),
                        "score": Number(0, 1), "box": _BOX, "polygon": Items(_POINT, 3, 100), "attributes": Flat(),
                    },
                    ("text", "block_type"),
                    broken=(
                        ("needs its box", lambda get: (get("$.block_type", "string") == "box") & get("$.box", "variant").isNull()),
                        ("needs its polygon", lambda get: (get("$.block_type", "string") == "polygon") & get("$.polygon", "variant").isNull()),
                        ("needs a box or polygon", lambda get: (get("$.block_type", "string") == "line") & get("$.box", "variant").isNull() & get("$.polygon", "variant").isNull()),
                    ),
                ),
                most=100000,
            ),
        },
        ("extraction_type", "blocks"),
        broken=(("needs a unit", lambda get: get("$.extraction_type", "string").isin("boxes", "polygons", "mixed") & get("$.unit", "variant").isNull()), *_beyond("blocks")),
    ),
    "entity-extraction": Fields(
        {
            "unit": _UNIT, "producer": _PRODUCER, **_VOCABULARY, "score_explanation": _EXPLAINED, "attributes": Flat(),
            "entities": Items(
                Fields(
                    {
                        "id": Text(128), "concept": Text(128), "label": Text(128), "text": Text(4096), "value": Scalar(4096), "definition": Text(1024), "score": Number(0, 1), "attributes": Flat(),
                        "location": Items(
                            Fields(
                                {
                                    "type": Text(among=("block_ref", "block")), "block_id": Text(128), "block_type": Text(among=("box", "polygon")), "page_number": Number(1, whole=True),
                                    "box": _FREE_BOX, "polygon": Items(_FREE_POINT, 3, 100),
                                },
                                ("type",),
                                broken=(
                                    ("needs its block", lambda get: (get("$.type", "string") == "block_ref") & get("$.block_id", "variant").isNull()),
                                    (
                                        "needs block type and page",
                                        lambda get: (get("$.type", "string") == "block") & (get("$.block_type", "variant").isNull() | get("$.page_number", "variant").isNull()),
                                    ),
                                    ("needs its box", lambda get: (get("$.block_type", "string") == "box") & get("$.box", "variant").isNull()),
                                    ("needs its polygon", lambda get: (get("$.block_type", "string") == "polygon") & get("$.polygon", "variant").isNull()),
                                ),
                            ),
                            most=10,
                        ),
                    },
                    ("label",),
                ),
                most=100000,
            ),
        },
        ("entities",), broken=(_empty_needs("entities", "vocabulary", "vocabulary_url"), *_beyond("entities", "location")),
    ),
    "object-detection": Fields(
        {
            "unit": _UNIT, "producer": _PRODUCER, **_VOCABULARY, "score_explanation": _EXPLAINED, "attributes": Flat(),
            "objects": Items(
                Fields(
                    {"id": Text(128), "parent_id": Text(128), "label": Text(128), "score": Number(-1, 1), "box": _BOX, "polygon": Items(_POINT, 3, 1000), "attributes": Flat()},
                    ("label",), one_of=("box", "polygon"),
                ),
                most=100000,
            ),
        },
        ("unit", "objects"), broken=_beyond("objects"),
    ),
    "regression": Fields(
        {
            "target": _TARGET, "unit": Text(32), "producer": _PRODUCER, "score_explanation": _EXPLAINED, "attributes": Flat(),
            "points": Items(
                Fields(
                    {
                        "value": Number(null=True), "statistic": Text(among=("mean", "median", "mode", "min", "max", "quantile", "sample")), "quantile_level": Number(0, 1), "timestamp": Text(),
                        "interval_lower": Number(), "interval_upper": Number(), "score": Number(0, 1), "attributes": Flat(),
                    },
                    ("value",),
                ),
                most=10000,
            ),
        },
        ("points",), broken=(_empty_needs("points", "producer"),),
    ),
    "geolocation": Fields(
        {"type": Text(among=("Feature",)), "id": Scalar(128), "bbox": Items(Number(), 4, 6), "geometry": Any(), "properties": Any()},
        ("type", "geometry", "properties"), extra=True, broken=(("has no valid geometry", _geometry),),
    ),
}


def _parsed(json_col: str, deep: bool, judged: Callable[[Column, Column], Column]) -> Column:
    """What is judged of a record, parsed once, and of how deep it is nested (asked only if ``deep``)."""
    depth = schemas.nesting(F.col(json_col)) if deep else F.lit(0)
    return schemas.bound(F.struct(F.try_parse_json(json_col).alias("v"), depth.alias("depth")), lambda r: judged(r["v"], r["depth"]))


def validate(records: DataFrame, schema: str | dict | object, json_col: str = "record") -> DataFrame:
    """``records`` with ``errors`` (texts) and ``valid``. A record that isn't JSON is one error.

    ``schema`` names a format, or is a JSON schema or a rule. A record is parsed once.
    """
    if isinstance(schema, dict):
        judged, deep = schemas.compiled(schema, records, json_col), bool(schemas.cycles(schema))
    else:
        rule, deep = SCHEMAS[schema] if isinstance(schema, str) else schema, False
        judged = lambda v, _: errors(v, rule)
    found = _parsed(json_col, deep, lambda v, depth: F.when(v.isNull(), F.array(F.lit("$ is not JSON"))).otherwise(judged(v, depth)))
    return records.withColumn("errors", found).withColumn("valid", F.size("errors") == 0)


def validate_each(records: DataFrame, named: dict[str, dict], json_col: str = "record") -> DataFrame:
    """A row for each record and JSON schema, with ``schema`` (its name), ``errors`` and ``valid``; a record is parsed once."""
    judged = {name: schemas.compiled(schema, records, json_col) for name, schema in named.items()}
    none = F.array(F.lit("$ is not JSON"))

    def each(v: Column, depth: Column) -> Column:
        return F.array(*(F.struct(F.lit(name).alias("schema"), F.when(v.isNull(), none).otherwise(f(v, depth)).alias("errors")) for name, f in judged.items()))

    found = _parsed(json_col, any(map(schemas.cycles, named.values())), each)
    return records.select("*", F.inline(found)).withColumn("valid", F.size("errors") == 0)


def validate_named(records: DataFrame, schema_col: str = "schema", json_col: str = "record") -> DataFrame:
    """``records`` with ``errors`` and ``valid``, each by the format that it names; of an unknown format that is the error."""

    def judged(v: Column, _: Column) -> Column:
        out = F.array(F.lit("$ has no known format"))
        for name, rule in SCHEMAS.items():
            out = F.when(F.col(schema_col) == name, errors(v, rule)).otherwise(out)
        return F.when(v.isNull(), F.array(F.lit("$ is not JSON"))).otherwise(out)

    return records.withColumn("errors", _parsed(json_col, False, judged)).withColumn("valid", F.size("errors") == 0)


def summary(validated: DataFrame) -> DataFrame:
    """One row: total, valid and invalid records."""
    return validated.agg(F.count(F.lit(1)).alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))
