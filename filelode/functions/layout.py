"""Coordinates of text on a page: boxes from the lower left in points, to other units from the upper left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "array<struct<text: string, left: double, bottom: double, right: double, top: double>>"


def page_tokens(tokens: Column, width: Column, height: Column, unit: str) -> Column:
    """Tokens (``left``, ``bottom``, ``right``, ``top`` in points) as ``text`` and ``box`` (x0, y0, x1, y1), y downwards.

    ``per_mille`` is whole numbers from 0 to 1000, cut at the borders; ``normalized`` is shares of the page; ``pt`` is points.
    """
    if unit not in ("per_mille", "normalized", "pt"):
        raise ValueError(unit)

    def scaled(value: Column, whole: Column) -> Column:
        if unit == "pt":
            return value
        share = F.when(whole > 0, value / whole).otherwise(0.0)
        return share if unit == "normalized" else F.least(F.greatest((share * 1000).cast("int"), F.lit(0)), F.lit(1000))

    def one(t: Column) -> Column:
        box = F.array(scaled(t["left"], width), scaled(height - t["top"], height), scaled(t["right"], width), scaled(height - t["bottom"], height))
        return F.struct(t["text"].alias("text"), box.alias("box"))

    return F.transform(tokens, one)
