"""N-gram Jaccard join: MinHash bands propose, exact verification decides.

Shingles are five consecutive lower-cased words; a text of one to four words has one shingle, all its words. Two
documents are linked if the Jaccard similarity of their shingle sets is at least `threshold`.

Documents with the same lower-cased words in the same order form one class (told by 128 bits of BLAKE2 of the words), whose
smallest id represents it. Classes that share a band (a run of MinHash values, hashed into one key) are candidates; hashes
only propose: the shingles that are compared are the words themselves. This is banding, not an LSH forest: the length of a band is worked
out from the threshold alone, longer prefixes are not looked at, and there are as many bands as it takes for a pair at
the threshold to share one with at least the target recall. Candidates' components are verified all against all: components
larger than a block in pairs of blocks, so no candidate is capped or dropped, and no pair of rows is ever emitted: each
block returns a count of links for each class and a spanning forest.

Texts that are null or have no word link with nothing. Rows with a null id are left out. Rows that repeat an id are one
document; if their texts differ, the one whose words have the smallest digest counts, and those without a word don't.
Whole texts are read, however long; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, table
from .groups import blocks, components, forest
from .words import SHINGLE, Words, mix

THRESHOLD, RECALL = 0.8, 0.9999995  # of two million pairs at the threshold one is missed
TREES, DEPTH, FIRST = 20, 8, 0.999
BLOCK = 512
_COLUMNS = 4096


def prefix_length(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix that finds a pair at the threshold in some tree with the target recall; 1 at least."""
    length = depth
    while length > 1 and 1 - (1 - threshold**length) ** trees < recall:
        length -= 1
    return length


def bands(threshold: float, recall: float) -> tuple[int, int]:
    """Length of a band and number of bands: TREES, and more until a pair at the threshold shares one with the target recall."""
    length = prefix_length(threshold, min(recall, FIRST))
    met = threshold**length
    return length, TREES if met >= 1 else max(TREES, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def shingle_sets(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Of each list of words the set of its shingles, as numbers that all the lists share: equal numbers are equal words."""
    number: dict[bytes, int] = {}
    out = []
    for words in texts:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.append(0, ends[:-1] + 1)[: max(1, len(words) - SHINGLE + 1)]
        stops = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
        own = {joined[i:j] for i, j in zip(starts.tolist(), stops.tolist(), strict=False)}
        out.append(np.array(sorted(number.setdefault(x, len(number)) for x in own), np.int64))
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str, length: int, trees: int) -> DataFrame:
    """id, set_key (digest of the words), nodes (the key of each of `trees` bands of this length)."""
    rng = np.random.default_rng(5)
    factors = rng.integers(1, 1 << 63, trees * length, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        for batch in slices(batches, 128):
            keys, nodes = [], []
            words = Words(batch.column(1), lower=True)
            for i, s in enumerate(words.shingles()):
                if not len(s):
                    keys.append(None)
                    nodes.append(None)
                    continue
                keys.append(_digest(words.words_of(i)))
                low = np.full(len(factors), 0xFFFFFFFFFFFFFFFF, np.uint64)
                for at in range(0, len(s), 2048):
                    np.minimum(low, (s[at : at + 2048, None] * factors).min(0), out=low)
                path = np.arange(trees, dtype=np.uint64)
                for level in low.reshape(length, trees):
                    path = mix(path + level)
                nodes.append(path.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))], ["id", "set_key", "nodes"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.col("id").isNotNull())
    return own.mapInArrow(run, "id long, set_key binary, nodes array<long>")


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which two of these sets have a Jaccard similarity of at least the threshold."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes.astype(int))
    shared = count[place] > 1
    column = np.cumsum(count > 1)[place[shared]] - 1
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((n, n), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        low, high = np.searchsorted(column, [at, at + _COLUMNS])
        m = np.zeros((n, _COLUMNS), np.float32)
        m[owner[low:high], column[low:high] - at] = 1
        both += m @ m.T
    return both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-6


def links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row for each document: id, class_id (smallest id reachable by links), n_links (other documents linked directly)."""
    own = sketches(docs, id_col, text_col, *bands(threshold, recall)).groupBy("id").agg(F.min(F.when(F.col("set_key").isNotNull(), F.struct("set_key", "nodes"))).alias("s"))
    own = cut(own.select("id", "s.set_key", "s.nodes"))
    classes = own.filter(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    member = cut(own.filter(F.col("set_key").isNotNull()).select("id", "set_key").join(classes, "set_key").select("id", "rep", "copies", "set_key"))
    reps = own.select("id", "set_key", "nodes").join(classes.select(F.col("rep").alias("id"), "set_key"), ["id", "set_key"]).select("id", F.explode("nodes").alias("node"))
    tops = reps.groupBy("node").agg(F.min("id").alias("top"), F.count("*").alias("n")).filter("n > 1").drop("n")
    near = components(reps.join(tops, "node").filter("id != top").select(F.col("id").alias("a"), F.col("top").alias("b")))
    copies = member.filter("id = rep").select(F.col("id").alias("node"), "copies", "set_key")
    todo = blocks(near.join(copies, "node"), "component", "node", BLOCK)
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))

    def verify(batch: pa.Table) -> pa.Table:
        read = Words(batch.column("text").combine_chunks(), lower=True)
        # of rows that repeat an id, one with the words that count for it
        place: dict[int, int] = {}
        texts = {}
        for i, (node, key) in enumerate(zip(batch.column("node").to_pylist(), batch.column("set_key").to_pylist(), strict=True)):
            if node not in place and _digest(own := read.words_of(i)) == key:
                place[node], texts[i] = i, own
        if not place:
            return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        batch, sets = batch.take(list(place.values())), shingle_sets([texts[i] for i in place.values()])
        nodes, side, copies = (batch.column(c).to_numpy() for c in ("node", "side", "copies"))
        match = similar(sets, threshold)
        # both sides meet only across; a block with itself meets wholly; no document is linked with itself
        match &= (side[:, None] == 2) | (side[:, None] != side[None, :])
        np.fill_diagonal(match, False)
        left, right = np.nonzero(np.triu(match))
        return pa.table({"node": nodes, "links": match @ copies.astype(np.int64), "root": forest(nodes, left, right)})

    found = todo.join(texts, "node").groupBy("block_pair").applyInArrow(verify, "node long, links long, root long")
    found = cut(found.filter("links > 0"))
    total = found.groupBy("node").agg(F.sum("links").alias("links"))
    classed = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    by_rep = total.join(classed, "node", "full").select(F.col("node").alias("rep"), "links", "component")
    out = member.join(by_rep, "rep", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("class_id"), F.sum(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    ids = own.select("id").distinct()
    return ids.join(out, "id", "left").select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without those whose class holds a smaller id; rows without id stay."""
    gone = links(docs, id_col=id_col, text_col=text_col, **options).filter(F.col("class_id") != F.col(id_col)).select(F.col(id_col).alias("_gone"))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


def op10_jaccard(spark, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, string_split_regex(trim(lower(text), E' \\t\\n\\x0B\\f\\r'), '[ \\x09-\\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d) WHERE len(w) >= 5 OR w[1] <> ''),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE m >= 0.8 * (x.n + y.n - m) - 1e-6),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, least(doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = doc_id), doc_id)) AS class_id,
  (SELECT count(*) FROM e WHERE e.a = doc_id) AS n_links FROM documents
"""
