"""Records as JSON texts, built from columns. Optional fields that are null are left out; JSON texts nest as they are."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields of a generic record's data and of a place's properties, at most.
MOST_DATA, MOST_PROPERTIES = 128, 100


def as_json(value: Column) -> Column:
    """A value of any type as JSON text; null stays null."""
    wrapped = F.to_json(F.struct(value.alias("x")))
    return F.when(value.isNotNull(), F.substr(wrapped, F.lit(6), F.length(wrapped) - 6))


def json_object(fields: dict[str, Column], always: tuple[str, ...] = ()) -> Column:
    """An object from JSON texts by name; those that are null are left out, or written as null if named in ``always``."""
    parts = []
    for name, text in fields.items():
        lead = json.dumps(name) + ":"
        parts.append(F.concat(F.lit(lead), F.coalesce(text, F.lit("null")) if name in always else text))
    return F.concat(F.lit("{"), F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), ","), F.lit("}"))


def _given(fields: dict[str, Column | None]) -> dict[str, Column]:
    return {k: as_json(v) for k, v in fields.items() if v is not None}


def _at_most(entries: Column, most: int, what: str) -> Column:
    """``entries`` (a map), or a failure if it has too many."""
    message = F.concat(F.lit(f"{what} cannot have more than {most} items: "), F.size(entries).cast("string"))
    return F.when(F.size(entries) > most, F.raise_error(message).cast("string")).otherwise(as_json(entries))


def _told(text: Column | None) -> Column | None:
    """A text that isn't empty."""
    return None if text is None else F.when(text != "", text)


def llm_output_record(model: Column, response: Column, *, prompt: Column | None = None, language: Column | None = None, score: Column | None = None,
                      score_explanation: Column | None = None, generation_params: Column | None = None, generation_metadata: Column | None = None) -> Column:
    """``response`` is a text; of a struct or map give ``to_json`` of it, which then stands inside the text."""
    return json_object(
        _given({"model": model, "response_data": response, "prompt": prompt, "language": language, "score": score, "score_explanation": score_explanation,
                "generation_params": generation_params, "generation_metadata": generation_metadata})
    )


def location_record(longitude: Column, latitude: Column, *, feature_id: Column | None = None, bbox: Column | None = None, properties: Column | None = None) -> Column:
    """A GeoJSON feature of one point. ``properties`` is a map; empty or null ones are written as null."""
    point = json_object({"type": F.lit('"Point"'), "coordinates": as_json(F.array(longitude, latitude))})
    about = F.lit(None).cast("string") if properties is None else F.when(F.size(properties) > 0, _at_most(properties, MOST_PROPERTIES, "properties"))
    fields = {"type": F.lit('"Feature"'), "geometry": point, "properties": about} | _given({"id": feature_id, "bbox": bbox})
    return json_object(fields, always=("properties",))


def transcription_record(text: Column, *, language: Column | None = None, track_id: Column | None = None) -> Column:
    return json_object(_given({"text": text, "language": language, "track_id": track_id}))


def generic_record(data: Column, *, description: Column | None = None) -> Column:
    """``data`` is a map of texts, numbers or truth values, which can't nest by its type."""
    return json_object({"data": _at_most(data, MOST_DATA, "data")} | _given({"description": description}))


def regression_point(value: Column, *, statistic: Column | None = None, quantile_level: Column | None = None, interval_lower: Column | None = None,
                     interval_upper: Column | None = None, score: Column | None = None, timestamp: Column | None = None, attributes: Column | None = None) -> Column:
    """A point; its value is written even if it is null. Empty texts and maps are left out, zeros are not."""
    fields = _given({"statistic": _told(statistic), "quantile_level": quantile_level, "interval_lower": interval_lower, "interval_upper": interval_upper,
                     "score": score, "timestamp": _told(timestamp), "attributes": None if attributes is None else F.when(F.size(attributes) > 0, attributes)})
    return json_object({"value": as_json(value)} | fields, always=("value",))


def regression_record(points: Column, *, target: Column | None = None, unit: Column | None = None, producer: Column | None = None,
                      score_explanation: Column | None = None, attributes: Column | None = None) -> Column:
    """A record of an array of points as ``regression_point`` makes them."""
    listed = F.concat(F.lit("["), F.array_join(points, ","), F.lit("]"))
    fields = _given({"target": _told(target), "unit": _told(unit), "producer": _told(producer), "score_explanation": _told(score_explanation),
                     "attributes": None if attributes is None else F.when(F.size(attributes) > 0, attributes)})
    return json_object({"points": listed} | fields)


def single_point_record(value: Column, *, target: Column | None = None, unit: Column | None = None, producer: Column | None = None,
                        score_explanation: Column | None = None, **point: Column) -> Column:
    one = F.array(regression_point(value, **point))
    return regression_record(one, target=target, unit=unit, producer=producer, score_explanation=score_explanation)
