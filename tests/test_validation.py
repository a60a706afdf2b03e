import json

import pytest

from filelode.operators import validation

BOX = {"x": 0, "y": 0, "width": 1, "height": 1}
GOOD = {
    "classification": [{"labels": [{"label": "a", "score": -1}]}, {"labels": [], "vocabulary": []}],
    "embedding": [{"vector": [1, 2.5]}],
    "generic": [{"data": {"a": 1, "b": None, "c": True, "d": "x"}}],
    "llm-output": [{"model": "m", "response_data": "r", "generation_params": {"temperature": 2, "max_tokens": 1}}],
    "audio-transcription": [{"text": "t"}, {"segments": [{"text": "t", "start_time": 0, "end_time": 1, "speaker": {"id": 7}}]}],
    "document-extraction": [{"extraction_type": "text", "blocks": []}, {"extraction_type": "boxes", "unit": "px", "blocks": [{"text": "t", "block_type": "box", "box": BOX}]}],
    "entity-extraction": [{"entities": [{"label": "l", "location": [{"type": "block_ref", "block_id": "b"}]}]}, {"entities": [], "vocabulary": ["l"]}],
    "object-detection": [{"unit": "normalized", "objects": [{"label": "l", "box": BOX}]}],
    "regression": [{"points": [{"value": None}, {"value": 2, "statistic": "mean"}]}],
    "geolocation": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": None}, {"type": "Feature", "geometry": None, "properties": {}}],
}
BAD = {
    "classification": [{}, {"labels": []}, {"labels": [{"label": "x" * 129}]}, {"labels": "no"}, {"labels": [{"label": "a", "score": True}]}],
    "embedding": [{"vector": []}, {"vector": ["x"]}, {"vector": [1], "other": 1}],
    "generic": [{"data": {"a": []}}, {"data": {str(i): i for i in range(129)}}, [1]],
    "llm-output": [{"model": "m"}, {"model": "m", "response_data": "r", "language": "en"}, {"model": "m", "response_data": "r", "generation_params": {"max_tokens": 1.5}}],
    "audio-transcription": [{}, {"segments": [{"text": "t", "start_time": -1, "end_time": 1}]}],
    "document-extraction": [{"extraction_type": "boxes", "blocks": []}, {"extraction_type": "text", "blocks": [{"text": "t", "block_type": "box"}]}],
    "entity-extraction": [{"entities": []}, {"entities": [{"label": "l", "location": [{"type": "block"}]}]}],
    "object-detection": [{"unit": "px", "objects": [{"label": "l"}]}, {"unit": "normalized", "objects": [{"label": "l", "box": BOX | {"x": 2}}]}],
    "regression": [{"points": []}, {"points": [{"value": "x"}]}, {"points": [{"value": 1, "statistic": "avg"}]}],
    "geolocation": [{"type": "Point", "geometry": None, "properties": {}}, {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[1, 2]]}, "properties": {}}],
}


@pytest.mark.parametrize("schema", sorted(GOOD))
def test_records(spark, schema):
    cases = [(json.dumps(r), True) for r in GOOD[schema]] + [(json.dumps(r), False) for r in BAD[schema]] + [("{", False), (None, False)]
    df = spark.createDataFrame(cases, "record string, want boolean")
    rows = validation.validate(df, schema).collect()
    assert [(r.record, r.valid, r.errors) for r in rows if r.valid != r.want] == []
    assert all(bool(r.errors) != r.valid for r in rows)
