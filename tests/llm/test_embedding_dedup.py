import numpy as np

from filelode.llm.embedding_dedup import Sizes, embedding_dedup


def brute(rows):
    ok = {}
    for k, (i, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[k] = np.array(v, np.float32).astype(np.float64)
    links = {k: set() for k in range(len(rows))}
    for a in ok:
        for b in ok:
            if a != b and len(ok[a]) == len(ok[b]):
                if ok[a] @ ok[b] / np.sqrt(ok[a] @ ok[a]) / np.sqrt(ok[b] @ ok[b]) >= 0.95:
                    links[a].add(b)
    part = {}
    for k in links:
        todo, seen = [k], {k}
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        part[k] = min(rows[x][0] for x in seen)
    return sorted((rows[k][0], len(links[k]), part[k], rows[k][0] == part[k]) for k in links)


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(120, 16))
    vecs = [*base] + [base[i % 7] + rng.normal(size=16) * 0.1 for i in range(60)] + [base[3]] * 5 + [base[2] * 4]
    rows = [(1000 - k, [float(x) for x in np.float32(v)]) for k, v in enumerate(vecs)]
    rows += [(1, None), (2, []), (3, [0.0] * 16), (4, [float("nan")] + [1.0] * 15), (5, [None] + [1.0] * 15), (6, [float("inf")] * 16)]
    rows += [(7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, -2.0]), rows[0]]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, n int, list int")
    for sizes in (Sizes(), Sizes(block=8, chunk=8), Sizes(per_list=4, lists=8)):
        got = sorted(tuple(r) for r in embedding_dedup(df, sizes=sizes).collect())
        assert got == brute(rows)
    assert embedding_dedup(df.limit(0)).collect() == []


def test_recall_on_random_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(3000, 64))
    twins = base[:400] + rng.normal(size=(400, 64)) * 0.31 * np.linalg.norm(base[:400], axis=1)[:, None] / 8
    x = np.float32(np.concatenate([base, twins]))
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    want = (u @ u.T >= 0.95).sum() - len(u)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = sum(r.n_links for r in embedding_dedup(df).collect())
    assert want > 400 and 0.99 * want <= found <= want


def links_of(spark, x, sizes):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    return sum(r.n_links for r in embedding_dedup(df, sizes=sizes).collect())


def test_recall_on_vectors_of_few_dimensions(spark):
    """Vectors of 64 components that lie near 4 or 8 dimensions, and clusters of such; with one and with two levels."""
    rng = np.random.default_rng(4)
    for rank in (4, 8):
        x = np.float32(rng.normal(size=(3000, rank)) @ rng.normal(size=(rank, 64)) + rng.normal(size=(3000, 64)) * 0.05)
        u = x.astype(np.float64)
        u /= np.linalg.norm(u, axis=1)[:, None]
        want = int((u @ u.T >= 0.95).sum()) - len(u)
        for sizes in (Sizes(), Sizes(per_list=10, lists=16)):
            assert want > 400 and 0.99 * want <= links_of(spark, x, sizes) <= want
    planes = [rng.normal(size=(3, 64)) * 0.25 for _ in range(30)]
    x = np.float32(np.concatenate([rng.normal(size=64) + rng.normal(size=(100, 3)) @ p for p in planes]))
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    want = int((u @ u.T >= 0.95).sum()) - len(u)
    assert want > 500 and 0.95 * want <= links_of(spark, x, Sizes(per_list=20)) <= want
