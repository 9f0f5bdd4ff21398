"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Shingles are five consecutive lower-cased words; a text of one to four words has one shingle, all its words.
An item leaks into a document if at least `threshold` of the item's distinct shingles occur in the document.

The items are partitioned by size (powers of two of their shingle counts). Each keeps a bottom-k MinHash sketch of
its shingles. k depends on the partition: within an item of n shingles of which `threshold` must be shared, more than
n - ceil(threshold n) sketched ones can't all be missing, so small items are found for certain; for larger ones k is
what makes a miss rarer than `miss`. Every shingle of every document is looked up in the sketches, and each item met
is verified against the document's whole shingle set, at last by the shingles' words and not their hashes. Documents are never shuffled. The items are sent out in blocks
of at most `block_shingles` shingles; a larger benchmark takes more passes over the documents.

An item of fewer than five words is found only in a document that is exactly those words. Nulls and texts without a word
have no shingle and leak nothing. Repeated rows give repeated results; of a document that holds several items each is
returned, whatever their order. Rows with a null id keep it. Whole texts are read, however long. Other columns are not
looked at, and `drop_leaks` returns them as they are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table
from .words import SHINGLE, Words, mix

THRESHOLD = 0.8
MISS = 1e-9
BLOCK_SHINGLES = 2_000_000
_TABLE_BITS = 20


def sketch_size(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """Sketch size of the partition that holds items of n shingles (taken at the partition's upper end)."""
    top = (1 << n.bit_length()) - 1
    certain = top - math.ceil(threshold * top) + 1
    return min(certain, math.ceil(math.log(miss) / math.log(1 - threshold))) if threshold < 1 else 1


def exact_shingles(words: list[bytes], width: int = SHINGLE) -> set[bytes]:
    """The shingles of these words as bytes; of fewer words than a shingle has, all of them."""
    return {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}


class Index:
    """Sketches and shingle sets of one block of items: id, hashes of the shingles, and the words that they are made of."""

    def __init__(self, items: list[tuple[int, np.ndarray, bytes]], threshold: float):
        self.threshold = threshold
        self.ids = [i for i, _, _ in items]
        self.sets = [s for _, s, _ in items]
        self.exact = [exact_shingles(w.split()) for _, _, w in items]
        keys = [s[np.argsort(mix(s), kind="stable")[: sketch_size(len(s), threshold)]] for s in self.sets]
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        order = np.argsort(flat, kind="stable")
        self.keys, self.owner = flat[order], owner[order]
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.keys & np.uint64((1 << _TABLE_BITS) - 1)] = True

    def probe(self, words: Words) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """For each text that contains items, by its place: (item id, shared shingles, item's shingles) of each."""
        hashes, cut = words.shingle_hashes()
        near = np.flatnonzero(self.table[hashes & np.uint64((1 << _TABLE_BITS) - 1)])
        if not len(near) or not len(self.keys):
            return []
        low = np.searchsorted(self.keys, hashes[near], "left")
        near, low = (x[self.keys[np.minimum(low, len(self.keys) - 1)] == hashes[near]] for x in (near, low))
        met: dict[int, set[int]] = {}
        for i, a in zip(np.searchsorted(cut, near, "right") - 1, low, strict=True):
            key = self.keys[a]
            while a < len(self.keys) and self.keys[a] == key:
                met.setdefault(int(i), set()).add(int(self.owner[a]))
                a += 1
        out = []
        for i, owners in met.items():
            shingles, hits, spelled = np.unique(hashes[cut[i] : cut[i + 1]]), [], None
            for o in sorted(owners):
                own = self.sets[o]
                at = np.minimum(np.searchsorted(shingles, own), len(shingles) - 1)
                if (shingles[at] == own).sum() < self.threshold * len(own) - 1e-9:
                    continue
                if spelled is None:
                    spelled = exact_shingles(words.words_of(i))
                shared = len(self.exact[o] & spelled)
                if shared >= self.threshold * len(self.exact[o]) - 1e-9:
                    hits.append((self.ids[o], shared, len(self.exact[o])))
            if hits:
                out.append((i, hits))
        return out


def _item_shingles(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for batch in slices(batches):
            words = Words(batch.column(1), lower=True)
            hashes = [s.view(np.int64).tolist() for s in words.shingles()]
            spelled = [b" ".join(words.words_of(i)) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.list_(pa.int64())), pa.array(spelled, pa.binary())], ["item", "shingles", "words"])

    got = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    return got.mapInArrow(run, "item long, shingles array<long>, words binary").filter(F.size("shingles") > 0)


def _indexes(benchmark: DataFrame, id_col: str, text_col: str, threshold: float, block_shingles: int):
    """One broadcast index for each block of items; a block holds about block_shingles shingles."""
    items = _item_shingles(benchmark, id_col, text_col)
    total = items.agg(F.sum(F.size("shingles"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_shingles))
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()
        rows = [(r.item, np.array(r.shingles, np.int64).view(np.uint64), bytes(r.words)) for r in rows]
        yield benchmark.sparkSession.sparkContext.broadcast(Index(rows, threshold))


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row for each document and item that it contains: id, item, shared and item's shingles, containment."""
    schema = f"{id_col} long, {item_col} long, n_shared long, n_item long, containment double"
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = []
    for sent in _indexes(benchmark, item_col, item_text_col, threshold, block_shingles):

        def run(batches, sent=sent):
            index = sent.value
            for batch in slices(batches):
                ids, found = batch.column(0).to_pylist(), []
                for i, hits in index.probe(Words(batch.column(1), lower=True)):
                    found += [(ids[i], *hit) for hit in hits]
                cols = list(zip(*found, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array([s / n for _, _, s, n in found], pa.float64())], [id_col, item_col, "n_shared", "n_item", "containment"])

        parts.append(texts.mapInArrow(run, schema))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    at = docs.columns.index(text_col)
    for sent in _indexes(benchmark, item_col, item_text_col, threshold, block_shingles):

        def run(batches, sent=sent):
            index = sent.value
            for batch in slices(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[i for i, _ in index.probe(Words(batch.column(at), lower=True))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = """
WITH d AS (SELECT doc_id, string_split_regex(trim(lower(text), E' \\t\\n\\x0B\\f\\r'), '[ \\x09-\\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, string_split_regex(trim(lower(text), E' \\t\\n\\x0B\\f\\r'), '[ \\x09-\\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d) WHERE len(w) >= 5 OR w[1] <> ''),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM b) WHERE len(w) >= 5 OR w[1] <> ''),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*) / CAST(n_item AS DOUBLE) AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item - 1e-9
"""
