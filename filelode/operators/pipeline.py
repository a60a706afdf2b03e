"""A pipeline of annotation steps as a plan: each step is gated by dependencies and yields a result or an error as data."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelode.operators import validation
from filelode.operators.records import upsert_annotations


@dataclass(frozen=True)
class Step:
    """``model`` makes a JSON record column of the rows that ``allows`` lets through.

    A step whose dependency is unmet is skipped with a message; if it is not ``silent`` the job fails at that row.
    """

    name: str
    schema: str
    model: Callable[[DataFrame], Column]
    allows: Callable[[DataFrame], Column] | None = None
    silent: bool = True
    active: bool = True


@dataclass(frozen=True)
class Pipeline:
    steps: tuple[Step, ...] = ()

    def _at(self, which: int | str) -> int:
        if isinstance(which, int):
            if not -len(self.steps) <= which < len(self.steps):
                raise IndexError(which)
            return which % len(self.steps)
        hits = [i for i, s in enumerate(self.steps) if s.name == which]
        if len(hits) != 1:
            raise KeyError(f"{len(hits)} steps are named {which}")
        return hits[0]

    def upsert(self, step: Step) -> Pipeline:
        if any(s.name == step.name for s in self.steps):
            i = self._at(step.name)
            return Pipeline((*self.steps[:i], step, *self.steps[i + 1 :]))
        return Pipeline((*self.steps, step))

    def remove(self, which: int | str) -> Pipeline:
        i = self._at(which)
        if i == 0:
            raise ValueError("the base step stays")
        return Pipeline((*self.steps[:i], *self.steps[i + 1 :]))

    def activate(self, which: int | str, active: bool = True) -> Pipeline:
        i = self._at(which)
        if i == 0 and not active:
            raise ValueError("the base step stays")
        return Pipeline((*self.steps[:i], replace(self.steps[i], active=active), *self.steps[i + 1 :]))

    def run_one(self, which: int | str, files: DataFrame) -> DataFrame:
        """One step alone, whether active or not."""
        return Pipeline((replace(self.steps[self._at(which)], active=True),)).run(files)

    def run(self, files: DataFrame) -> DataFrame:
        """One row per file and active step: ``hash``, ``step``, ``schema``, ``record``, ``error``; one scan of the files."""
        results = []
        for n, step in enumerate(s for s in self.steps if s.active):
            record = step.model(files)
            if step.allows is not None:
                met = F.coalesce(step.allows(files), F.lit(False))
                unmet = F.concat(F.lit(f"Skipped {step.name}: dependency not met"))
                stop = F.lit(None).cast("string") if step.silent else F.raise_error(F.concat(F.lit(f"{step.name}: dependency not met for "), F.col("hash"))).cast("string")
                error = F.when(~met, unmet).when(record.isNull(), f"{step.name} gave no record")
                record = F.when(met, record).otherwise(stop)
            else:
                error = F.when(record.isNull(), f"{step.name} gave no record")
            results.append(F.struct(F.lit(n).alias("step"), F.lit(step.schema).alias("schema"), record.alias("record"), error.alias("error")))
        return files.select("hash", F.explode(F.array(*results)).alias("r")).select("hash", "r.*")


def _named(place: str) -> Callable:
    module, _, name = place.partition(":")
    return getattr(importlib.import_module(module), name)


def registered(specs: Sequence[Mapping[str, object]]) -> Pipeline:
    """The pipeline of a settings file: each entry names step, schema and an importable ``module:function`` for the model, and
    may name one for what it ``allows``. A later entry of a name replaces the earlier one."""
    pipeline = Pipeline()
    for spec in specs:
        if spec["schema"] not in ("file/base", *(f"open/{k}" for k in validation.SCHEMAS)) and "/" not in str(spec["schema"]):
            raise ValueError(f"{spec['schema']} is no schema id")
        allows = _named(str(spec["allows"])) if spec.get("allows") else None
        step = Step(str(spec["name"]), str(spec["schema"]), _named(str(spec["model"])), allows, bool(spec.get("silent", True)), bool(spec.get("active", True)))
        pipeline = pipeline.upsert(step)
    return pipeline


def annotate(files: DataFrame, annotations: DataFrame, pipeline: Pipeline, which: int | str, core: list[str]) -> DataFrame:
    """``annotations`` with what one step of the pipeline says of ``files``; files that it fails on keep what they have."""
    step = pipeline.steps[pipeline._at(which)]
    made = pipeline.run_one(which, files).where("error IS NULL").select(
        "hash", "schema", F.lit(step.name).alias("source_id"), F.lit("1").alias("version"), F.lit(None).cast("string").alias("variant"), "record"
    )
    return upsert_annotations(annotations, made, core)


def annotate_by_hand(annotations: DataFrame, rows: DataFrame, schema: str, core: list[str]) -> tuple[DataFrame, DataFrame]:
    """``annotations`` with records given by hand (``hash``, ``source_id``, ``version``, ``variant``, ``record``) of an open
    schema, and those that break it, with their ``errors``."""
    judged = validation.validate(rows, schema)
    good = judged.where("valid").select("hash", F.lit(f"open/{schema}").alias("schema"), "source_id", "version", "variant", "record")
    return upsert_annotations(annotations, good, core), judged.where("NOT valid")
