"""Embedding near-dedup by sorted projection passes.

Vectors with the same label are linked if their cosine, in double precision, is at least `threshold`. In each pass
every vector gets BITS concatenated random hashes (signs of projections), all vectors are ordered by label, hash string
and id, and each is compared with at least the WINDOW before it. The order is a range partitioning, so equal hash
strings are split like any others. Verified pairs of all passes are united into components. Hashes are taken of unit
vectors less their label's mean, so that a direction that a label shares costs no bits. The number of passes of a label
follows from how crowded the sorted keys of a sample of it are: as many as meet a pair at the threshold with the target
recall; a label of one window needs one pass. Only labels so crowded that more than MOST passes would be needed are compared
wholly, in pairs of blocks. The windows bound what one pass sees of a large group; the exact way for the rest is that afterwards all vectors of a component are
compared with each other, in pairs of blocks, which gives every link inside it.

Null labels, null or zero vectors, and vectors with null or non-finite components link with nothing; vectors of
different lengths don't link with each other. Rows with a null id are returned with no links. Rows that repeat an id
count once (the smallest vector, if they differ). A cosine of exactly the threshold links; equal sort keys go by id. Vectors
of any length are read whole; a block of BLOCK vectors is what a task holds of them. Other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, slices, table
from .groups import blocks, components, forest

THRESHOLD, RECALL = 0.93, 0.9999
BITS, WINDOW, BLOCK, MOST = 32, 64, 512, 512
ROUND, _STRIDE = 32, 128
_FEW, _SAMPLE, _PILOT, _LAG = 4, 4096, 8, 16


def passes(largest: int, threshold: float = THRESHOLD, recall: float = RECALL, window: int = WINDOW) -> int:
    """Passes after which a pair at the threshold was within the window once with the target recall."""
    same = 1 - math.acos(threshold) / math.pi
    met = same ** max(0.0, math.log2(max(1, largest) / window))
    return _FEW if met >= 1 else max(_FEW, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _binary(a: np.ndarray, size: int) -> pa.Array:
    """Each vector as its bytes, so many for each number."""
    offsets = (np.arange(len(a) + 1) * a.shape[1] * size).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(a, f"f{size}"))])


def _found(a: np.ndarray, b: np.ndarray, part: int, kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), part, np.int32)), pa.array(np.full(len(a), kind, np.int32))], ["a", "b", "p", "kind"])


def _unit(a: np.ndarray) -> np.ndarray:
    unit = a / np.abs(a).max(1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    return unit


def linked(a: np.ndarray, threshold: float) -> np.ndarray:
    """Which two rows have a cosine of at least the threshold."""
    unit = _unit(a)
    return unit @ unit.T >= threshold


def _keys(x: np.ndarray, turn: int) -> np.ndarray:
    """The hash strings of one pass."""
    planes = np.random.default_rng((11, x.shape[1], turn)).standard_normal((x.shape[1], BITS))
    return (x @ planes > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def crowded(x: np.ndarray, size: int, threshold: float, recall: float, window: int) -> int:
    """Passes for a label of this size, from a sample less its mean; `size` at most.

    Depth is the number of bits that part a vector from the one a lag away in the sorted keys. It is carried from the
    sample's lag to the window by the bits that a halved lag takes. A partner at the threshold shares a bit as their
    angle at the mean has it, which is wider for vectors near the mean.
    """
    square = (x * x).sum(1)
    same = 1 - np.arccos(np.clip(1 - (1 - threshold) / np.maximum(square, 1e-12), -1, 1)) / math.pi
    lag = max(1, min(_LAG, len(x) // 4))
    met = np.zeros(len(x))
    for turn in range(_PILOT):
        keys = _keys(x, turn)
        order = np.argsort(keys, kind="stable")
        own = keys[order]
        # the bits shared with the vector a lag before, and with the one twice as far
        near, far = (np.concatenate([np.zeros(k), BITS - np.ceil(np.log2((own[k:] ^ own[:-k]) + 1.0))]) for k in (lag, 2 * lag))
        halving = max(1.0, float((near[2 * lag :] - far[2 * lag :]).mean()))
        depth = np.maximum(0, near + 1 + halving * math.log2(lag * size / len(x) / window))
        met[order] += np.where(depth > BITS, 0, same[order] ** depth) / _PILOT
    n = _FEW
    while n < size and ((1 - met) ** n).mean() > 1 - recall:
        n = n * 5 // 4
    return min(n, size)


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row for each id: n_links, component_id, kept."""
    # single precision is moved as it is and compared in double precision
    single = vectors.schema[vector_col].dataType.elementType.typeName() == "float"
    kind, size = ("array<float>", 4) if single else ("array<double>", 8)
    every = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(kind).alias("v"))
    sound = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    # vectors of another length are of another label
    good = every.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & sound).select("id", F.concat_ws(":", F.size("v"), "label").alias("label"), "v")
    good = cut(good.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v"))
    sizes = good.groupBy("label").count().filter(F.col("count") > 1)
    sample = good.join(sizes, "label").filter(F.pmod(F.xxhash64("id", F.lit(9)), F.col("count")) < _SAMPLE)
    span = WINDOW

    def measure(batch: pa.Table) -> pa.Table:
        size, unit = batch.column("count")[0].as_py(), _unit(_matrix(batch.column("v")))
        mean = unit.mean(0)
        n = 1 if size <= span else max(passes(size, threshold, recall, span), crowded(unit - mean, size, threshold, recall, span))
        return pa.table({"label": batch.column("label")[:1], "n": pa.array([n if n <= MOST else 0], pa.int32()), "mean": pa.array([mean.tolist()])})

    # a row for each label; a label's sample is a bounded group
    plan = cut(sample.select("label", "count", "v").groupBy("label").applyInArrow(measure, "label string, n int, mean array<double>"))

    def keys_of(start: int):
        def keys(batches):
            for batch in slices(batches, 4096):
                labels = np.array(batch.column(1).to_pylist())
                for label in np.unique(labels):
                    own = batch.filter(pa.array(labels == label))
                    a = _matrix(own.column(2))
                    x, raw = _unit(a) - _matrix(own.column(4).slice(0, 1)), _binary(a, size)
                    for turn in range(start, min(own.column(3)[0].as_py(), start + ROUND)):
                        yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(np.full(len(x), turn, np.int32)), pa.array(_keys(x, turn)), raw], ["id", "label", "pass", "key", "v"])

        return keys

    def neighbours(batches):
        """Of a sorted partition the links of each vector with the WINDOW before it; kind 1: what lies at its ends, with places; kind 2: its size."""
        at, part, last = 0, 0, []
        for batch in slices(batches, 4096):
            part, ids = batch.column(0)[0].as_py(), batch.column(1).to_numpy()
            run = np.array([f"{turn}:{label}" for turn, label in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)])
            raw = batch.column(4).to_pylist()
            first = np.arange(max(0, min(len(ids), span - at)))
            yield _found(ids[first], at + first, part, 1)
            whole = [*last, *zip(ids.tolist(), run.tolist(), raw, strict=True)]
            nodes, run = np.array([w[0] for w in whole]), np.array([w[1] for w in whole])
            for begin in range(len(last), len(whole), _STRIDE):
                low, high = max(0, begin - span), min(len(whole), begin + _STRIDE)
                for label in np.unique(run[begin:high]):
                    own = low + np.flatnonzero(run[low:high] == label)
                    if len(own) > 1:
                        a = np.stack([np.frombuffer(whole[i][2], f"f{size}") for i in own]).astype(np.float64)
                        left, right = np.nonzero(np.triu(linked(a, threshold) & (nodes[own][:, None] != nodes[own][None, :])))
                        roots = forest(nodes[own], left, right)
                        yield _found(nodes[own][roots != nodes[own]], roots[roots != nodes[own]], part, 0)
            last, at = whole[-span:], at + len(ids)
        if at:
            end = np.arange(max(span, at - len(last)), at)  # what is among the first was said before
            yield _found(np.array([w[0] for w in last], np.int64)[len(last) - len(end) :], end, part, 1)
            yield _found(np.zeros(1, np.int64), np.array([at]), part, 2)

    def compare(batch: pa.Table) -> pa.Table:
        ids, labels = batch.column("id").to_numpy(), np.array(batch.column("label").to_pylist())
        out_nodes, out_roots = [], []
        for label in np.unique(labels):
            own = np.flatnonzero(labels == label)
            if len(own) > 1:
                nodes = ids[own]
                left, right = np.nonzero(np.triu(linked(_matrix(batch.column("v").take(pa.array(own))), threshold) & (nodes[:, None] != nodes[None, :])))
                roots = forest(nodes, left, right)
                out_nodes.append(nodes[roots != nodes])
                out_roots.append(roots[roots != nodes])
        none = [np.zeros(0, np.int64)]
        return pa.table({"a": np.concatenate(out_nodes or none), "b": np.concatenate(out_roots or none)})

    def across(batch: pa.Table) -> pa.Table:
        nodes, side = batch.column("id").to_numpy(), batch.column("side").to_numpy()
        match = linked(_matrix(batch.column("v")), threshold) & ((side[:, None] == 2) | (side[:, None] != side[None, :])) & (nodes[:, None] != nodes[None, :])
        roots = forest(nodes, *np.nonzero(np.triu(match)))
        return pa.table({"a": nodes[roots != nodes], "b": roots[roots != nodes]})

    order = ["pass", "label", "key", "id"]
    turned = good.join(plan.filter("n > 0"), "label").select("id", "label", "v", "n", "mean")
    last_pass, edges = plan.agg(F.max("n")).first()[0] or 0, None
    for start in range(0, last_pass, ROUND):
        ranked = turned.filter(F.col("n") > start).mapInArrow(keys_of(start), "id long, label string, pass int, key long, v binary").repartitionByRange(*order).sortWithinPartitions(*order)
        ranked = ranked.select(F.spark_partition_id().alias("p"), "id", "pass", "label", "v")
        found = cut(ranked.mapInArrow(neighbours, "a long, b long, p int, kind int"))
        # where each partition's places begin: a row for each partition
        before = W.partitionBy(F.lit(0)).orderBy("p").rowsBetween(W.unboundedPreceding, -1)
        offsets = found.filter("kind = 2").select("p", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("offset"))
        window = F.floor((F.col("offset") + F.col("b")) / WINDOW).cast("long")
        ends = found.filter("kind = 1").join(F.broadcast(offsets), "p").select(F.col("a").alias("id"), F.explode(F.array(window, window + 1)).alias("window"))
        across_parts = ends.distinct().join(good, "id").groupBy("window").applyInArrow(compare, "a long, b long")
        links = cut(found.filter("kind = 0").select("a", "b").unionByName(across_parts).distinct())
        edges = links if edges is None else edges.unionByName(links)

    # labels for which passes would be too many
    whole = good.select("id", "label").join(plan.filter("n = 0").select("label"), "label", "left_semi")
    whole = blocks(whole, "label", "id", BLOCK).select("id", "block_pair", "side").join(good.select("id", "v"), "id")
    whole = whole.groupBy("block_pair").applyInArrow(across, "a long, b long")
    edges = whole if edges is None else edges.unionByName(whole)
    group = cut(components(edges))

    def count(batch: pa.Table) -> pa.Table:
        nodes, side = batch.column("id").to_numpy(), batch.column("side").to_numpy()
        match = linked(_matrix(batch.column("v")), threshold)
        match &= ((side[:, None] == 2) | (side[:, None] != side[None, :])) & (nodes[:, None] != nodes[None, :])
        return pa.table({"id": nodes, "links": match.sum(1)})

    pairs = blocks(group.select(F.col("node").alias("id"), "component"), "component", "id", BLOCK).join(good, "id")
    found = pairs.groupBy("block_pair").applyInArrow(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    found = found.join(group.withColumnRenamed("node", "id"), "id")
    ids = every.select("id").filter("id is not null").distinct().unionByName(every.select("id").filter("id is null"))
    component = F.coalesce("component", "id")
    return ids.join(found, "id", "left").select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op8_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, label, e, sqrt(list_sum([x * x for x in e])) AS n FROM v),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0
  AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT vec_id, (SELECT count(*) FROM p WHERE p.a = vec_id) AS n_links,
  least(vec_id, coalesce((SELECT min(b) FROM r WHERE r.a = vec_id), vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce((SELECT min(b) FROM r WHERE r.a = vec_id), vec_id)) AS kept FROM embeddings
"""
