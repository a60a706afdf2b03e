"""Near-duplicate embeddings by product quantisation over inverted lists, with an exact cosine rerank.

Equal vectors are one class with a count. Each class goes to an inverted list, as a code of its residual (one codeword a
subspace) with the length of what the code leaves out. Lists are in proportion to the classes: up to ``Sizes.lists`` of
them each have a centroid of its own; more are made of two levels, the nearest coarse centroid and then the nearest of the
fine centroids that all coarse cells share. Each class then searches its own list and the lists near it: those on whose
side of the bisecting plane, at both levels, a partner can lie. How far a partner reaches towards another centroid is
``PROBE_SIGMAS`` times its spread in that direction, at most the radius of the least cosine; spreads come from the
covariance of the sample and from that of its residuals, the larger of both, so vectors that lie in few dimensions reach
further than such that fill all of them. (Clusters that each fill a few dimensions of their own look fuller in these
covariances than they are: 0.97 of the links in the test on such.) In a list, distances to codes are summed from a table per query; a code stays if
the triangle inequality allows a partner (its distance is at most the radius plus what the code left out, so this filter
loses nothing), and the vectors that stay are compared exactly, in double precision.

Lists are cut into blocks and their queries into chunks of bounded size, each pair of which is one small task, so a list
that holds a third of all rows is spread over many. A task emits counts and a spanning star of what it linked, never all
pairs. The index is fitted on at most about ``Sizes.sample`` classes; every class is indexed and searched.

Defined cases: a vector that is null, empty or zero, or holds a null or non-finite component, links with nothing; vectors of
different length don't link; every row counts as a vector of its own, equal rows and equal ids too. Labels and other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelode.llm.common import attach_groups, checkpoint
from filelode.llm.graph import connected_components

COSINE = 0.95
PROBE_SIGMAS = 4.0


@dataclass(frozen=True)
class Sizes:
    """Bounds: classes to fit on (expected), classes of a list, centroids of a level, subspaces, codewords, rows of a block
    and queries of a chunk."""

    sample: int = 20_000
    per_list: int = 128
    lists: int = 4096
    subspaces: int = 8
    codewords: int = 256
    block: int = 1024
    chunk: int = 2048


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Lloyd's rounds from a random draw; a centre that loses all its rows stays where it was."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        owner = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, x)
        counts = np.bincount(owner, minlength=len(centres))
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None, :], 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def _spread(x: np.ndarray) -> np.ndarray:
    """A matrix A so that the length of A v is the standard deviation along v, times its length, of rows spread like ``x``
    whose mean squared length is 1."""
    covariance = x.T @ x
    values, vectors = np.linalg.eigh(covariance / max(np.trace(covariance), 1e-300))
    return np.sqrt(np.maximum(values, 0))[:, None] * vectors.T


class Level:
    """Centroids, and as the spreads see them."""

    def __init__(self, centres: np.ndarray, spreads: list[np.ndarray]):
        self.centres, self.seen = centres, [centres @ a.T for a in spreads]

    def near(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row, and which ones can be nearest to a partner of it."""
        d2 = squared(x, self.centres)
        own = d2.argmin(1)
        spread = np.sqrt(np.maximum.reduce([squared(s[own], s) for s in self.seen]))
        gap = np.sqrt(squared(self.centres[own], self.centres))
        near = d2 - d2.min(1, keepdims=True) <= 2 * radius * np.minimum(gap, PROBE_SIGMAS * spread)
        near[np.arange(len(x)), own] = True
        return own, near


class Index:
    """One or two levels of centroids and one codebook a subspace of the residuals. List ``i`` is that of coarse centroid
    ``i // fine`` and fine centroid ``i % fine``."""

    def __init__(self, sample: np.ndarray, lists: int, sizes: Sizes, cosine: float):
        self.dim = sample.shape[1]
        self.parts = min(sizes.subspaces, self.dim)
        self.edges = np.linspace(0, self.dim, self.parts + 1).astype(int)
        self.radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
        coarse = k_means(sample, min(lists, sizes.lists, len(sample)))
        residual = sample - coarse[nearest(sample, coarse)]
        spreads = [_spread(sample), _spread(residual)]
        self.coarse = Level(coarse, spreads)
        self.fine_count = min(-(-lists // len(coarse)), sizes.lists, len(sample))
        fine = k_means(residual, self.fine_count) if self.fine_count > 1 else np.zeros((1, self.dim))
        self.fine = Level(fine, spreads)
        residual = residual - fine[nearest(residual, fine)]
        k = min(sizes.codewords, len(sample))
        self.books = [k_means(residual[:, a:b], k) for a, b in zip(self.edges, self.edges[1:])]

    def centre(self, lists: np.ndarray | int) -> np.ndarray:
        return self.coarse.centres[lists // self.fine_count] + self.fine.centres[lists % self.fine_count]

    def codes(self, x: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the lengths of what they leave out."""
        residual = x - self.centre(owner)
        codes = np.stack([nearest(residual[:, a:b], book) for a, b, book in zip(self.edges, self.edges[1:], self.books)], 1)
        built = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], 1)
        return codes.astype(np.uint8), np.sqrt(((residual - built) ** 2).sum(1))

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The list of each vector, and the lists that it searches: its own and later ones within reach."""
        owner, near = self.coarse.near(x, self.radius)
        if self.fine_count == 1:
            near &= np.arange(near.shape[1])[None, :] >= owner[:, None]
            return owner, [np.flatnonzero(row) for row in near]
        who, cell = np.nonzero(near)
        found: list[list[np.ndarray]] = [[] for _ in x]
        lists = np.zeros(len(x), np.int64)
        step = max(1, (1 << 24) // max(self.fine_count, self.dim))
        for at in range(0, len(who), step):
            w, c = who[at : at + step], cell[at : at + step]
            own, inside = self.fine.near(x[w] - self.coarse.centres[c], self.radius)
            home = c == owner[w]
            lists[w[home]] = c[home] * self.fine_count + own[home]
            for i, k, row in zip(w.tolist(), c.tolist(), inside):
                found[i].append(k * self.fine_count + np.flatnonzero(row))
        return lists, [(both := np.concatenate(f))[both >= own] for f, own in zip(found, lists)]

    def candidates(self, queries: np.ndarray, at: int, codes: np.ndarray, left_out: np.ndarray) -> np.ndarray:
        """Which (query, code) pairs of a list can be partners."""
        residual = queries - self.centre(at)
        d2 = np.zeros((len(queries), len(codes)))
        for m, (a, b) in enumerate(zip(self.edges, self.edges[1:])):
            d2 += squared(residual[:, a:b], self.books[m])[:, codes[:, m]]
        return d2 <= (self.radius + left_out[None, :] + 1e-6) ** 2


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x**2).sum(1))[:, None]


def _classes(rows: DataFrame) -> DataFrame:
    """One row per distinct valid vector: node (smallest id), n."""
    return rows.where("ok").groupBy("vec").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n"))


def _links(classes: DataFrame, kind: str, cosine: float, sizes: Sizes) -> tuple[DataFrame, DataFrame]:
    """``(node, links)`` and ``(u, v)`` of classes ``(vec, node, n)`` of one length."""
    spark = classes.sparkSession
    total = classes.count()
    lists = max(1, total // sizes.per_list)
    share = min(1.0, sizes.sample / max(1, total))
    chosen = classes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) <= int(share * (1 << 20))).select("node", "vec").toArrow()
    order = np.argsort(chosen["node"].to_numpy(), kind="stable")
    if not len(order):
        order, chosen = np.zeros(1, int), classes.select("node", "vec").limit(1).toArrow()
    drawn = np.array(chosen["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(order), -1)[order]
    shared = spark.sparkContext.broadcast(Index(_unit(drawn), lists, sizes, cosine))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                raw = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(batch.num_rows, -1)
                x = _unit(raw.astype(np.float64))
                owner, probes = index.probes(x)
                codes, left_out = index.codes(x, owner)
                columns = [
                    batch.column(1), batch.column(2), pa.array(owner, pa.int64()), pa.array(probes, pa.list_(pa.int64())),
                    pa.array([r.tobytes() for r in raw], pa.binary()), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(left_out),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["node", "n", "list", "probes", "data", "codes", "left_out"])

    nodes = checkpoint(
        classes.select("vec", "node", "n").mapInArrow(encoded, "node long, n long, list long, probes array<long>, data binary, codes binary, left_out double")
    )
    asked = nodes.select(
        F.col("node").alias("q_node"), F.col("n").alias("q_n"), F.col("list").alias("home"), F.col("data").alias("q_data"), F.explode("probes").alias("list")
    )
    parts = (  # one row a list
        nodes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / sizes.block).cast("int").alias("blocks"))
        .join(asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / sizes.chunk).cast("int").alias("chunks")), "list")
    )
    parts = checkpoint(parts)
    keys = ["list", "block", "chunk"]
    base = (
        nodes.join(parts, "list")
        .withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)))
        .select(*keys, "node", "n", "data", "codes", "left_out")
    )
    queries = (
        asked.join(parts, "list")
        .withColumn("chunk", F.pmod(F.xxhash64("q_node", F.lit("query")), "chunks"))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
        .select(*(F.col(k).alias(f"q_{k}") for k in keys), "q_node", "q_n", "home", "q_data")
    )

    def searched(rows: pa.Table, asking: pa.Table) -> pa.Table:
        empty = np.zeros(0, np.int64)
        if not rows.num_rows or not asking.num_rows:
            return pa.table({"node": empty, "links": empty, "other": pa.array(empty, pa.int64())})
        index, at = shared.value, rows["list"][0].as_py()
        b_node, b_n, q_node, q_n = (t[c].to_numpy() for t, c in ((rows, "node"), (rows, "n"), (asking, "q_node"), (asking, "q_n")))
        own = asking["home"].to_numpy() == at
        b, q = _unit(_matrix(rows["data"], kind)), _unit(_matrix(asking["q_data"], kind))
        codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(len(b), -1)
        qi, bi = np.nonzero(index.candidates(q, at, codes, rows["left_out"].to_numpy()))
        linked = np.concatenate([np.einsum("ij,ij->i", q[qi[k : k + 65536]], b[bi[k : k + 65536]]) >= cosine for k in range(0, len(qi), 65536)] or [np.zeros(0, bool)])
        linked &= q_node[qi] != b_node[bi]
        qi, bi = qi[linked], bi[linked]
        both = ~own[qi]  # of another list: the partner won't search this one's
        ends, where = np.unique(np.concatenate([q_node, b_node]), return_inverse=True)
        u, v = where[qi], where[len(q_node) + bi]
        links = np.zeros(len(ends), np.int64)
        np.add.at(links, u, b_n[bi])
        np.add.at(links, v[both], q_n[qi[both]])
        part = np.arange(len(ends))
        while len(u):
            least = part.copy()
            np.minimum.at(least, u, part[v])
            np.minimum.at(least, v, part[u])
            least = least[least]
            if (least == part).all():
                break
            part = least
        some = links > 0
        some[u] = some[v] = True
        return pa.table({"node": ends[some], "links": links[some], "other": ends[part[some]]})

    found = checkpoint(base.groupBy(*keys).cogroup(queries.groupBy(*(f"q_{k}" for k in keys))).applyInArrow(searched, "node long, links long, other long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    return counts, found.where("node != other").select(F.col("node").alias("u"), F.col("other").alias("v"))


def embedding_dedup(
    table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, sizes: Sizes = Sizes()
) -> DataFrame:
    """One row per row of ``table``: id, ``n_links``, ``component_id``, ``kept``."""
    double = "double" in table.schema[vec_col].dataType.simpleString()
    kind = "<f8" if double else "<f4"
    vec = F.col(vec_col).cast("array<double>" if double else "array<float>")
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists(vec, lambda x: x != 0)
    ok = F.coalesce(~odd & ~zero, F.lit(False))
    rows = checkpoint(table.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"), ok.alias("ok")))
    classes = checkpoint(_classes(rows))
    lengths = [r[0] for r in classes.where("node IS NOT NULL").select(F.size("vec").alias("d")).distinct().orderBy("d").collect()]
    counts, links = None, None
    for d in lengths:  # one, unless vectors of several models are mixed
        c, e = _links(classes.where((F.size("vec") == d) & F.col("node").isNotNull()), kind, cosine, sizes)
        counts = c if counts is None else counts.unionByName(c)
        links = e if links is None else links.unionByName(e)
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if counts is not None:
        linked = connected_components(links)
        groups = (
            classes.join(counts, "node", "left")
            .join(linked.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left")
            .select("vec", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
        )
        valid = rows.where("ok")
        alone = alone.unionByName(attach_groups(valid, groups, "vec", "n", valid.count()).select("vec_id", "n_links", "component_id"))
    return alone.select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
