"""Centroid clustering in integers: Lloyd's rounds with kd-trees that settle whole boxes of vectors at once.

Vectors become integers, floor(1024 * x) of each component. Each partition deals its vectors into kd-trees of up to TREE
vectors; a node holds the number of its vectors, their sum and their box. The trees are written once; every round reads
them and takes each node down with the centroids that can still be nearest: one is struck out if another is strictly nearer
at the corner of the box that favours it most, and so at every vector of the box. With one left the node's count and sum go
to it; in a leaf the distances of what is left are compared. All of it is integer arithmetic, so the result is the same
however vectors are dealt out. What a round sends on is one sum for each partition, centroid and component, added up by
Spark; the driver sees the centroids only.

The first centroids are the vectors with the smallest SHA-256 of `seed:id`; equal distances go to the smaller number. A
round replaces each centroid that has vectors by their mean, rounded down. Vectors of another length, and those with null or
non-finite components, are left out. Rows that repeat an id are vectors of their own, of which equal hashes go by components;
rows with a null id are assigned as others are, and begin a cluster only if there are too few ids. Components beyond what
squared distances of a long can hold (2**27 in size for 64 components, 131072 before scaling) count as that. Sums of distances
beyond a long are the largest long. With fewer vectors than clusters there are fewer; without vectors there is no row.
Columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table

CLUSTERS, ROUNDS, DIMENSIONS, SEED, SCALE = 8, 10, 64, 3, 1024
TREE, LEAF = 2048, 32
_LONG = (1 << 63) - 1


def nodes(n: int) -> int:
    """Nodes of a tree of n vectors: one that holds more than LEAF has two halves below it."""
    return 1 if n <= LEAF else 1 + nodes(n // 2) + nodes(n - n // 2)


def grow(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order in which nodes hold runs of points, and each node's lowest and highest components and sums, parents first."""
    order, low, high, total = np.arange(len(points)), [], [], []
    todo = [(0, len(points))]
    while todo:
        a, b = todo.pop()
        own = points[order[a:b]]
        low.append(own.min(0))
        high.append(own.max(0))
        total.append(own.sum(0))
        if b - a > LEAF:
            half = (b - a) // 2
            axis = int((high[-1] - low[-1]).argmax())
            order[a:b] = order[a:b][np.argpartition(own[:, axis], half)]
            todo += [(a + half, b), (a, a + half)]
    return order, np.array(low), np.array(high), np.array(total)


def _squares(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(-1)


def settle(points: np.ndarray, low: np.ndarray, high: np.ndarray, total: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of each point, and each centroid's number and sum of points. Points lie as the nodes hold them."""
    nearest, count, sums = np.zeros(len(points), np.int32), np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
    todo = [(0, 0, len(points), np.arange(len(centroids)))]
    while todo:
        node, a, b, able = todo.pop()
        if len(able) > 1:
            own, lowest, highest = centroids[able], low[node], high[node]
            best = own[int(_squares(own - (lowest + highest) // 2).argmin())]
            corner = np.where(own > best, highest, lowest)
            able = able[_squares(corner - own) <= _squares(corner - best)]
        if len(able) == 1:
            nearest[a:b] = able[0]
            count[able[0]] += b - a
            sums[able[0]] += total[node]
        elif b - a <= LEAF:
            got = able[_squares(points[a:b, None] - centroids[None, able]).argmin(1)]
            nearest[a:b] = got
            np.add.at(count, got, 1)
            np.add.at(sums, got, points[a:b])
        else:
            half = (b - a) // 2
            todo += [(node + 1 + nodes(half), a + half, b, able), (node + 1, a, a + half, able)]
    return nearest, count, sums


def _planted(vectors: DataFrame, dimensions: int) -> DataFrame:
    """One row for each tree: its vectors' ids and components and its nodes, as little-endian integers."""

    def tree(ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        points = np.concatenate(parts)
        order, low, high, total = grow(points)
        # boxes and components fit 32 bits, sums of TREE of them 64
        blobs = [points[order].astype("<i4"), low.astype("<i4"), high.astype("<i4"), total.astype("<i8")]
        return pa.RecordBatch.from_arrays([pa.array([[ids[i] for i in order]], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], ["ids", "points", "low", "high", "total"])

    def run(batches):
        ids, parts = [], []
        for batch in batches:
            matrix = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)
            own, at = batch.column(0).to_pylist(), 0
            while at < len(own):
                n = min(TREE - len(ids), len(own) - at)
                ids += own[at : at + n]
                parts.append(matrix[at : at + n])
                at += n
                if len(ids) == TREE:
                    yield tree(ids, parts)
                    ids, parts = [], []
        if ids:
            yield tree(ids, parts)

    return vectors.mapInArrow(run, "ids array<long>, points binary, low binary, high binary, total binary")


def _trees(batches, dimensions: int):
    """Ids and arrays of each tree in record batches."""
    for batch in batches:
        for i in range(batch.num_rows):
            arrays = [np.frombuffer(batch.column(c)[i].as_buffer(), d).astype(np.int64).reshape(-1, dimensions) for c, d in ((1, "<i4"), (2, "<i4"), (3, "<i4"), (4, "<i8"))]
            yield batch.column(0)[i].values, arrays


def clustered(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """id, cluster and distance of each vector, and the centroids that they were held against."""
    most = math.isqrt((1 << 62) // dimensions) // 2
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter((F.size("v") == dimensions) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.select("id", F.transform("v", lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(x * SCALE))).cast("long")).alias("v"))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(hashed.asc_nulls_last(), "v").limit(clusters).collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(-1, dimensions)
    trees = stored(_planted(rows, dimensions))

    def sums_of(centroids):
        def run(batches):
            whole = np.zeros((len(centroids), dimensions + 1), np.int64)
            for _, arrays in _trees(batches, dimensions):
                _, count, sums = settle(*arrays, centroids)
                whole[:, 0] += count
                whole[:, 1:] += sums
            some = np.flatnonzero(whole[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(whole[some].tolist(), pa.list_(pa.int64()))], ["cluster", "sums"])

        # no more rows than clusters * (dimensions + 1) reach the driver
        each = trees.mapInArrow(run, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("at", "x"))
        return each.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()

    for _ in range(rounds if len(centroids) else 0):
        found: dict[int, dict[int, int]] = {}
        for r in sums_of(centroids):
            found.setdefault(r["cluster"], {})[r["at"]] = int(r["x"])
        moved = centroids.copy()
        for c, own in found.items():
            moved[c] = [own[i + 1] // own[0] for i in range(dimensions)]
        if (moved == centroids).all():
            break  # the rounds that are left would change nothing
        centroids = moved

    def assign(batches):
        for ids, arrays in _trees(batches, dimensions):
            nearest, _, _ = settle(*arrays, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(nearest), pa.array(_squares(arrays[0] - centroids[nearest]))], ["id", "cluster", "distance"])

    return trees.mapInArrow(assign, "id long, cluster int, distance long"), centroids.tolist()


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def op13_centroids(spark, sf_dir: str) -> DataFrame:
    rows, centroids = clustered(table(spark, sf_dir, "embeddings"))
    rows = stored(rows)
    # one row for each cluster
    sums = {r["cluster"]: int(r["x"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}
    most = lambda x: F.lit(min(x, _LONG)).cast("long")
    inertia, name = F.lit(None).cast("long"), F.lit(None).cast("string")
    for c, x in sums.items():
        inertia, name = F.when(F.col("cluster") == c, most(x)).otherwise(inertia), F.when(F.col("cluster") == c, digest(centroids[c])).otherwise(name)
    return rows.select(F.col("id").alias("vec_id"), "cluster", "distance", inertia.alias("cluster_inertia"), most(sum(sums.values())).alias("inertia"), name.alias("centroid_sha256"))


def _oracle() -> str:
    """Lloyd's rounds, each a pair of tables: components of the centroids, and each vector's nearest."""
    assign = """SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT k.vec_id, m.c, list_sum(list_transform(list_zip(k.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM k, {m} m) GROUP BY vec_id"""
    move = """SELECT m.c, coalesce(x.v, m.v) AS v FROM {m} m LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM
 (SELECT a.c, i, CAST(sum(k.v[i]) AS BIGINT) AS s, count(*) AS n FROM {a} a JOIN k USING (vec_id), (SELECT unnest(range(1, 65)) AS i) GROUP BY a.c, i) GROUP BY c) x USING (c)"""
    out = """WITH k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT v, sha256(concat('3:', vec_id)) AS h FROM k ORDER BY h LIMIT 8))"""
    for n in range(ROUNDS):
        out += f",\na{n} AS MATERIALIZED ({assign.format(m=f'm{n}')}),\nm{n + 1} AS MATERIALIZED ({move.format(m=f'm{n}', a=f'a{n}')})"
    return f"""{out},\na AS MATERIALIZED ({assign.format(m=f"m{ROUNDS}")})
SELECT vec_id, CAST(a.c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a JOIN m{ROUNDS} m USING (c)"""


ORACLE = _oracle()
