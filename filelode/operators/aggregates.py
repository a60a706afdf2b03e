"""Summaries of a collection of file records (``ordinal``, ``hash``, ``name``, ``size``, ``media_type``, ``source``,
``date_modified``). "First" always means the smallest ``ordinal``; no summary gathers a collection in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filelode.functions.scalars import human_size
from filelode.sources.shared import checkpointed

#: Items of a panel before the rest is summed up.
PANEL = 14
#: What bytes of all files are summed in: a long ends at 9.2 * 10**18.
BYTES = "decimal(38,0)"
MOST_LONG = 2**63 - 1


def _first_of(order: Column, value: str) -> Column:
    return F.min(F.struct(order.alias("o"), F.col("ordinal"), F.col(value).alias("v")))["v"]


def overall(files: DataFrame) -> DataFrame:
    """One row: count, bytes, mean size and the first largest, smallest, newest and oldest file. No files: zeros, nulls."""
    out = files.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"),
        _first_of(-F.col("size"), "name").alias("largest"),
        _first_of(F.col("size"), "name").alias("smallest"),
        _first_of(-F.unix_micros("date_modified"), "name").alias("newest"),
        _first_of(F.unix_micros("date_modified"), "name").alias("oldest"),
    )
    mean = F.when(F.col("total_files") > 0, F.round(F.col("total_size") / F.col("total_files"), 6)).otherwise(0.0)
    return out.withColumn("avg_size", mean)


def share_by(files: DataFrame, key: str) -> DataFrame:
    """Count, bytes and share of all bytes for each value of ``key``; null or empty is "unknown".

    One partial aggregate over the files; the total is summed from the groups. Rows come by bytes descending, ties in
    scan order.
    """
    value = F.when(F.coalesce(F.col(key), F.lit("")) == "", "unknown").otherwise(F.col(key))
    groups = files.groupBy(value.alias(key)).agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"),
        F.min("ordinal").alias("__first"),
    )
    total = groups.agg(F.sum(F.col("total_size").cast(BYTES)).cast("double").alias("__all"))
    share = F.when(F.col("__all") > 0, F.round(F.col("total_size") * 100.0 / F.col("__all"), 6)).otherwise(F.lit(0.0))
    return (
        groups.crossJoin(F.broadcast(total))  # one row
        .orderBy(F.desc("total_size"), "__first")
        .select(key, "files", "total_size", share.alias("percentage"))
    )


def duplicate_sets(files: DataFrame, min_size: int | None = None, max_size: int | None = None) -> DataFrame:
    """Files of equal hash, most wasted bytes first: ``min_size`` is exclusive, ``max_size`` inclusive.

    ``first_name`` stands for the set; ``members`` lists them in another table, see ``duplicate_members``.
    """
    some = files
    if min_size is not None:
        some = some.where(F.col("size") > min_size)
    if max_size is not None:
        some = some.where(F.col("size") <= max_size)
    first = F.min(F.struct("ordinal", "size", "name"))
    sets = some.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"), first.alias("f")).where("copies > 1")
    wasted = F.col("f.size") * (F.col("copies") - 1)
    return (
        sets.select("hash", "copies", F.col("f.size").alias("size"), F.col("f.name").alias("first_name"), wasted.alias("wasted"), F.col("f.ordinal").alias("__o"))
        .orderBy(F.desc("wasted"), "__o")
        .drop("__o")
    )


def duplicate_members(files: DataFrame, sets: DataFrame) -> DataFrame:
    """One row for each file of a duplicate set, so that a set of any size is rows, not one array."""
    return files.join(sets.select("hash"), "hash", "left_semi").select("hash", "ordinal", "name")


def duplicate_totals(sets: DataFrame) -> DataFrame:
    """One row: number of sets, files in them, wasted bytes and how to show these."""
    total = F.coalesce(F.sum("wasted"), F.lit(0))
    return sets.agg(F.count(F.lit(1)).alias("total_sets"), F.coalesce(F.sum("copies"), F.lit(0)).alias("files"), total.alias("wasted"), human_size(total).alias("wasted_text"))


def staged_duplicates(files: DataFrame, min_size: int = 0, max_size: int | None = None, quick: str | None = None) -> DataFrame:
    """Duplicates as a directory scan finds them: by size, then by a cheap hash if given, then by full hash.

    Both bounds are inclusive. Each step keeps what the one before left in groups of two or more, found by a partial
    aggregate and a semi-join; the full hash of a file whose size is unique is never looked at. Largest files first.
    """
    some = files.where(F.col("size") >= min_size)
    if max_size is not None:
        some = some.where(F.col("size") <= max_size)
    for keys in (["size"], ["size", quick]) if quick else (["size"],):
        often = some.groupBy(*keys).count().where("count > 1").drop("count")
        some = some.join(often, keys, "left_semi")
    found = some.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("ordinal", "size")).alias("f")).where("copies > 1")
    return found.orderBy(F.desc("f.size"), "f.ordinal").select("hash", "copies", F.col("f.size").alias("size"))


def directory_summary(files: DataFrame) -> DataFrame:
    """One row over stat rows (``name``, ``size``, ``mode``, ``is_dir``): counts, hidden names, bytes, owner permissions.

    Rows without a size could not be read: they count as files but not in sizes or permissions.
    """
    plain, read = ~F.col("is_dir"), ~F.col("is_dir") & F.col("size").isNotNull()
    can_read, can_write, can_run = (F.col("mode").bitwiseAND(bit) != 0 for bit in (0o400, 0o200, 0o100))
    return files.agg(
        F.count_if(plain).alias("total_files"),
        F.count_if(F.col("is_dir")).alias("total_dirs"),
        F.count_if(plain & F.col("name").startswith(".")).alias("hidden_files"),
        F.coalesce(F.sum(F.when(read, F.col("size"))), F.lit(0)).alias("total_size"),
        F.coalesce(F.round(F.avg(F.when(read, F.col("size"))), 6), F.lit(0.0)).alias("avg_size"),
        F.count_if(read & can_read & ~can_write).alias("read_only"),
        F.count_if(read & can_write & ~can_read).alias("write_only"),
        F.count_if(read & can_run).alias("executable"),
    )


def top_and_other(rows: DataFrame, key: str, by: str, order: list[Column], k: int = PANEL) -> DataFrame:
    """The ``k`` first rows (``key``, ``by``) and one row "Other" with the sum of the rest, if there is any.

    The first rows come from a top-k, the rest by subtracting their sum from the total: nothing is ranked as a whole.
    """
    top = rows.orderBy(*order).limit(k).select(key, by)
    sums = top.agg(F.coalesce(F.sum(by), F.lit(0)).alias("s"), F.count(F.lit(1)).alias("n"))
    whole = rows.agg(F.coalesce(F.sum(by), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("m"))
    other = whole.crossJoin(sums).where("m > n").select(F.lit("Other").alias(key), (F.col("t") - F.col("s")).alias(by))  # a row each
    return top.unionByName(other)


def fitted(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` (few, computed here) with a column of ``BYTES`` as longs; if one of its values is no long, as it is."""
    rows = checkpointed(rows)
    most = rows.agg(F.max(F.abs(F.col(column)))).first()[0]
    return rows if most is not None and most > MOST_LONG else rows.withColumn(column, F.col(column).cast("long"))


def panel_by(files: DataFrame, key: str, measure: str, k: int = PANEL) -> DataFrame:
    """A panel of ``key`` by ``count`` or by ``total_size``; extensions that are null or empty are left out.

    Bytes are longs, or decimals where those of "Other" are no long.
    """
    some = files.where(F.coalesce(F.col(key), F.lit("")) != "") if key == "extension" else files
    value = F.count(F.lit(1)) if measure == "count" else F.sum(F.col("size").cast(BYTES))
    groups = some.groupBy(key).agg(value.alias(measure), F.min("ordinal").alias("__o"))
    found = top_and_other(groups, key, measure, [F.desc(measure), F.asc("__o")], k)
    return found if measure == "count" else fitted(found, measure)


def largest_files(files: DataFrame, k: int = PANEL) -> DataFrame:
    """The panel of largest files; "Other" only if it has bytes, nothing if no file has. Bytes as in ``panel_by``."""
    rows = files.select("name", F.col("size").cast(BYTES).alias("size"), "ordinal")
    found = top_and_other(rows, "name", "size", [F.desc("size"), F.asc("ordinal")], k)
    return fitted(found.where((F.col("name") != "Other") | (F.col("size") > 0)), "size")


def most_recent(files: DataFrame) -> DataFrame:
    return files.orderBy(F.desc("date_modified"), "ordinal").limit(1)


def size_histogram(files: DataFrame, most_bins: int = 25) -> DataFrame:
    """Positive sizes in Freedman-Diaconis bins, logarithmic if they span more than three orders of magnitude.

    Quartiles are the exclusive ones (position i (n + 1) / 4), interpolated between the sizes at the positions around it.
    Few values (under 5 different, under 20 in all) are counted one by one instead. ``bin`` counts from 0.
    """
    rows = files.where("size > 0").select("size")
    n, lo, hi, near = rows.agg(F.count(F.lit(1)), F.min("size"), F.max("size"), F.percentile_approx("size", list(BRACKETS), SKETCH)).first()
    size = F.col("size").cast("double")
    counts = rows.groupBy("size").agg(F.count(F.lit(1)).alias("c"))
    if not n:
        return counts.select(F.lit(0).alias("bin"), size.alias("lower"), size.alias("upper"), F.col("c").alias("count")).limit(0)
    if n < 20 and counts.count() < 5:
        rank = F.row_number().over(Window.orderBy("size")) - 1  # four rows at most
        return counts.select(rank.alias("bin"), size.alias("lower"), size.alias("upper"), F.col("c").alias("count"))
    bins = 1
    if n > 1:
        q1, q3 = _quartiles(rows, n, lo, hi, near)
        if q3 > q1:
            bins = -int(-(hi - lo) // (2 * (q3 - q1) / n ** (1 / 3)))
    bins = max(1, min(bins, most_bins))
    if hi / lo > 1000:
        a, b = F.log10(F.lit(float(lo))), F.log10(F.lit(float(hi)))
        edge = F.array(*(F.pow(F.lit(10.0), a + F.lit(i) * (b - a) / bins) for i in range(bins + 1)))
        guess = (F.log10(size) - a) / (b - a) * bins
    else:
        edge = F.array(*(F.lit(lo + i * (hi - lo) / bins) for i in range(bins + 1)))
        guess = (size - lo) / max(hi - lo, 1) * bins
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(guess).cast("int")))  # at most one off, by rounding
    above = (at < bins - 1) & (size >= F.get(edge, at + 1))
    at = F.when((at > 0) & (size < F.get(edge, at)), at - 1).when(above, at + 1).otherwise(at)
    inside = (size >= F.get(edge, F.lit(0))) & (size <= F.get(edge, F.lit(bins)))
    return (
        rows.where(inside).select(at.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
        .select("bin", F.round(F.get(edge, F.col("bin")), 3).alias("lower"), F.round(F.get(edge, F.col("bin") + 1), 3).alias("upper"), "count")
    )


#: Accuracy of the sketch of sizes: ranks are off by a SKETCH-th of all rows at most. Shares that enclose both quartiles.
SKETCH = 10_000
BRACKETS = tuple(share + side * 2 / SKETCH for share in (0.25, 0.75) for side in (-1, 1))
#: Values that a range is counted by one by one, if it can hold no more rows.
ONE_BY_ONE = 100_000


def values_at(rows: DataFrame, column: str, brackets: dict[tuple[int, int], list[int]], n: int, lo: int, hi: int, parts: int = 4096) -> dict[int, int]:
    """The whole numbers at positions (from 1) of a column of ``n`` rows in order, which lie from ``lo`` to ``hi``.

    ``brackets``: ranges (first and last value) that a sketch gives, each with the positions that should lie in it. A pass
    counts what lies below a range and in its parts: single values if the range can hold ``ONE_BY_ONE`` rows at most, else
    ``parts`` equal parts of it, so that up to some 10**9 rows one pass is enough and nothing is ever sorted. A position that
    is not in its range is looked for among all values.
    """
    # by range: how many rows it may hold, and the positions with their rank above what lies below the range (None: not known)
    share = 4 * n // SKETCH if n > ONE_BY_ONE else n
    open_ranges: dict[tuple[int, int], tuple[int, dict[int, int | None]]] = {r: (share, dict.fromkeys(p)) for r, p in brackets.items()}
    found: dict[int, int] = {}
    while open_ranges:
        tests, widths = [], []
        for k, ((a, z), (held, _)) in enumerate(open_ranges.items()):
            widths.append(1 if held <= ONE_BY_ONE else (z - a) // parts + 1)
            inside = F.when(F.col(column).between(a, z), F.expr(f"({column} - {a}L) div {widths[-1]}L")).when(F.col(column) < a, F.lit(-1).cast("long"))
            tests.append(F.struct(F.lit(k).alias("k"), inside.alias("part")))
        tall = rows.select(F.explode(F.array(*tests)).alias("x")).select("x.*").where("part IS NOT NULL")
        counts: dict[int, list] = {}
        for r in sorted(tall.groupBy("k", "part").count().collect()):
            counts.setdefault(r["k"], []).append((r["part"], r["count"]))
        then: dict[tuple[int, int], tuple[int, dict[int, int | None]]] = {}
        for k, ((a, z), (_, wanted)) in enumerate(open_ranges.items()):
            below = sum(c for part, c in counts.get(k, ()) if part < 0)
            within = [x for x in counts.get(k, ()) if x[0] >= 0]
            for position, rank in wanted.items():
                rank = position - below if rank is None else rank
                if not 0 < rank <= sum(c for _, c in within):
                    then.setdefault((lo, hi), (n, {}))[1][position] = position
                    continue
                for part, count in within:
                    if rank <= count:
                        break
                    rank -= count
                first = a + part * widths[k]
                if widths[k] == 1:
                    found[position] = first
                else:
                    then.setdefault((first, min(z, first + widths[k] - 1)), (count, {}))[1][position] = rank
        open_ranges = then
    return found


def _quartiles(rows: DataFrame, n: int, lo: int, hi: int, near: list[int]) -> tuple[float, float]:
    """The exclusive first and third quartile of ``size``. ``near``: the sketch's values at ``BRACKETS``."""
    places = [max(1, min(i * (n + 1) // 4, n - 1)) for i in (1, 3)]
    ranges = [(near[0], near[1]), (near[2], near[3])] if n > ONE_BY_ONE else [(lo, hi), (lo, hi)]
    brackets: dict[tuple[int, int], list[int]] = {}
    for r, p in zip(ranges, places):
        brackets.setdefault(r, []).extend((p, p + 1))
    at = values_at(rows, "size", brackets, n, lo, hi)
    shares = [i * (n + 1) - 4 * p for i, p in zip((1, 3), places)]
    q1, q3 = ((at[p] * (4 - d) + at[p + 1] * d) / 4 for p, d in zip(places, shares))
    return q1, q3


def timeline(files: DataFrame) -> DataFrame:
    """A point a file: when it was modified and its name."""
    return files.select("ordinal", F.date_format("date_modified", "yyyy-MM-dd'T'HH:mm:ss").alias("x"), F.col("name").alias("y"))


def cache_summary(cache: DataFrame) -> DataFrame:
    """One row: all cached rows, rows with a full record, rows with hashes alone."""
    full = F.count_if(F.col("record").isNotNull())
    return cache.agg(F.count(F.lit(1)).alias("total"), full.alias("full_records"), (F.count(F.lit(1)) - full).alias("hash_only"))


def batch_totals(rows: DataFrame, key: str, value: Column) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.sum(value).alias("total"))


def tracks_by_type(tracks: DataFrame, key: str = "file", kind: str = "kind", then: Sequence[str] = ()) -> DataFrame:
    """The first General track of each file and how many tracks of other kinds it has.

    Tracks of one number come in the order of the columns ``then``; without them the least format is first. Tracks without
    a number or a format are passed over.
    """
    some = (F.col(kind) == "General") & F.col("track_no").isNotNull() & F.col("format").isNotNull()
    general = F.min(F.when(some, F.struct("track_no", *then, "format")))
    return tracks.groupBy(key).agg(
        general["format"].alias("general_format"), F.count_if(F.col(kind) != "General").alias("other_tracks"), F.count_distinct(kind).alias("kinds")
    )


def merged_results(results: DataFrame, core: list[str]) -> DataFrame:
    """Model results (``file``, ``schema``, ``step``, ``record``, ``error``) merged: of a core schema the last, of others all
    in order. Results with an error are left out. ``step`` numbers the pipeline's steps, so a file has few results."""
    good = results.where(F.col("error").isNull())
    parts = F.transform(F.array_sort(F.collect_list(F.struct("step", "record"))), lambda x: x["record"])
    by = good.groupBy("file", "schema").agg(parts.alias("records"))
    return by.withColumn("records", F.when(F.col("schema").isin(core), F.slice("records", -1, 1)).otherwise(F.col("records")))
