"""Row predicates: attribute filters, dependencies of pipeline steps, search queries, linters, integrity rules, tags."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filelode.functions.scalars import media_head, parse_size

OPERATORS = ("gt", "lt", "gte", "lte", "contains", "in")


def _field(schema: T.StructType, path: list[str]) -> tuple[str, T.DataType] | None:
    kind: T.DataType = schema
    for name in path:
        if not isinstance(kind, T.StructType) or name not in kind.fieldNames():
            return None
        kind = kind[name].dataType
    return ".".join(f"`{p}`" for p in path), kind


def _one(schema: T.StructType, key: str, value: object) -> Column:
    parts = key.split("__")
    op = parts.pop() if parts[-1] in OPERATORS and len(parts) > 1 else "exact"
    found = _field(schema, parts)
    if found is None:
        return F.lit(False)  # an attribute that isn't there matches nothing
    c, kind = F.col(found[0]), found[1]
    if op == "exact":
        return c.eqNullSafe(F.lit(value))
    if op == "in":
        test = c.isin(*value) if value else F.lit(False)  # type: ignore[misc]
    elif op == "contains":
        test = F.array_contains(c, value) if isinstance(kind, T.ArrayType) else c.contains(value) if isinstance(kind, T.StringType) else F.lit(False)
    elif isinstance(value, str) != isinstance(kind, T.StringType) and not isinstance(value, datetime):
        test = F.lit(False)  # values of different kinds don't compare
    else:
        test = {"gt": c > value, "lt": c < value, "gte": c >= value, "lte": c <= value}[op]
    return F.coalesce(test, F.lit(False))


def matching(files: DataFrame, **conditions: object) -> DataFrame:
    """Rows where all of ``path__to__attribute[__op]=value`` hold; plain Column predicates, so scans can use them."""
    test = F.lit(True)
    for key, value in conditions.items():
        test = test & _one(files.schema, key, value)
    return files.where(test)


def media_type_allows(
    media_type: Column, include: Iterable[str] = (), exclude: Iterable[str] = (), include_pattern: str | None = None, exclude_pattern: str | None = None
) -> Column:
    """Exclusion wins, by whole type, head or pattern from the start; then inclusion; with no inclusion rule all else passes."""
    head = media_head(media_type)

    def hit(names: list[str], pattern: str | None) -> Column:
        test = media_type.isin(names) | head.isin(names) if names else F.lit(False)
        if pattern:
            test = test | media_type.rlike(f"^(?:{pattern})") | head.rlike(f"^(?:{pattern})")
        return F.coalesce(test, F.lit(False))

    include, exclude = list(include), list(exclude)
    kept = hit(include, include_pattern) if include or include_pattern else F.lit(True)
    return ~hit(exclude, exclude_pattern) & kept


def extension_allows(extension: Column, names: Iterable[str]) -> Column:
    wanted = ["." + n.lower().lstrip(".") for n in names]
    return F.coalesce(F.lower(extension).isin(wanted), F.lit(False))


def size_allows(size: Column, least: int | None = None, most: int | None = None) -> Column:
    """Both bounds inclusive."""
    test = F.lit(True)
    if least is not None:
        test = test & (size >= least)
    if most is not None:
        test = test & (size <= most)
    return F.coalesce(test, F.lit(False))


def name_allows(name: Column, pattern: str) -> Column:
    return F.coalesce(name.rlike(pattern), F.lit(False))


_TERM = re.compile(r"""(?:(tag|name|extension|size|type):)?("[^"]*"|\S+)""")


def terms(query: str) -> list[tuple[str, str]]:
    """Field and value of each term of a query; a plain word has the field ""."""
    return [(field, raw.strip('"')) for field, raw in _TERM.findall(query)]


def search(files: DataFrame, query: str, match_any: bool = False, deduplicate: bool = False) -> DataFrame:
    """Rows that a query such as ``report extension:pdf size:>1MB`` matches: all terms, or any.

    A plain word must be in the name. ``size:`` takes >, >=, <, <= or nothing before a size. With ``deduplicate`` the
    first row of each hash stays.
    """
    tests = []
    for field, value in terms(query):
        if field == "size":
            op, text = re.match(r"(>=|<=|>|<|=)?(.*)", value).groups()  # type: ignore[union-attr]
            size, limit = F.col("size"), parse_size(F.lit(text))
            tests.append({">": size > limit, ">=": size >= limit, "<": size < limit, "<=": size <= limit}.get(op, size == limit))
        elif field == "extension":
            tests.append(F.lower("extension") == "." + value.lower().lstrip("."))
        elif field == "type":
            tests.append((F.col("media_type") == value) | (media_head(F.col("media_type")) == value))
        elif field == "tag":
            tests.append(F.exists("tags", lambda t: t["name"] == value))
        else:
            tests.append(F.lower("name").contains(value.lower()))
    whole = F.lit(not match_any) if tests else F.lit(True)
    for test in tests:
        test = F.coalesce(test, F.lit(False))
        whole = whole | test if match_any else whole & test
    found = files.where(whole)
    if deduplicate:
        first = found.groupBy("hash").agg(F.min("ordinal").alias("ordinal"))
        found = found.join(first, ["hash", "ordinal"], "left_semi")
    return found


def outside_vocabulary(labels: Column, vocabulary: Column) -> Column:
    """Labels that aren't in the vocabulary, in order, repeats kept; null without a vocabulary."""
    return F.when(vocabulary.isNotNull(), F.filter(labels, lambda x: ~F.array_contains(vocabulary, x)))


def vocabulary_message(labels: Column, vocabulary: Column, shown: int = 5) -> Column:
    """The first different labels outside the vocabulary, sorted, and how many more there are; null if none."""
    missing = F.array_sort(F.array_distinct(outside_vocabulary(labels, vocabulary)))
    more = F.size(missing) - shown
    text = F.array_join(F.slice(missing, 1, shown), ", ")
    return F.when(F.size(missing) > 0, F.concat(text, F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise("")))


def hash_faults(hash_: Column, all_hashes: Column, others: list[Column]) -> Column:
    """What is wrong with a record's hashes: required functions, repeated ids, disagreement, equal values."""
    ids = F.transform(all_hashes, lambda x: x["id"])
    sha = F.get(F.transform(F.filter(all_hashes, lambda x: x["id"] == "SHA-256"), lambda x: x["value"]), F.lit(0))
    known = F.filter(F.array(hash_, *others), lambda x: x.isNotNull())
    rules = [
        (~F.array_contains(ids, "SHA-256"), "SHA-256 missing"),
        (~F.array_contains(ids, "BLAKE3"), "BLAKE3 missing"),
        (F.size(F.array_distinct(ids)) != F.size(ids), "repeated hash id"),
        (sha.isNotNull() & (sha != hash_), "hash is not the SHA-256"),
        (F.size(F.array_distinct(known)) != F.size(known), "equal hashes"),
    ]
    return F.filter(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(text)) for test, text in rules)), lambda x: x.isNotNull())


def valid_tag_name(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[a-zA-Z0-9_]{3,64}\z"), F.lit(False))


def repeated_tags(tags: DataFrame, key: str = "hash") -> DataFrame:
    """Tags (``name``, ``value``) that a file has more than once."""
    return tags.groupBy(key, "name", "value").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
