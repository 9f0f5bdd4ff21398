"""Substring dedup by fixed-block anchors.

A window is `width` (13) consecutive words of one document. A word is removed if a window that covers it also starts in
a document with a smaller id. Any window holds a whole block of (width + 1) // 2 words that begins at a multiple of
that length in its own document: those non-overlapping blocks are the reference index, and every rolling window of
the same length probes it. Blocks met in another document are anchors; only windows around an anchor are compared in
full, and overlapping hits run together to maximal exact repeats.

How it is laid out: documents are dealt into chunks of about CHUNK bytes of text (by a hash of id and text). A chunk
sends, for each bucket of hashes, the sorted set of its probe hashes (bytes of their differences, plane by plane) and
whether each is also a reference block or in several of its documents. The bucket answers one bit for each: does it
anchor anything? The chunk then sends the full windows around anchors with the smallest id that has each, and gets a
bit again: does a smaller id have it elsewhere? A hash as common as a third of all documents is one entry for each
chunk. The texts are shuffled once; the hashes take about three bytes a word, the answers a bit.

Anchors use 32 bits of a quick hash beside the bucket: a false one costs a comparison and no more. Full windows are held
against each other by 128 bits of BLAKE2 of their words, joined by single spaces, so that no two different windows that
anyone can write down are taken for the same.

Words are runs of what is not ASCII white space. Null texts have no words. A row with a null id is never changed and
removes nothing. Rows that repeat an id don't remove each other's words. Texts shorter than a window are unchanged.
One row out for each row in.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .words import Words, mix

WIDTH = 13
CHUNK = 4_000_000
BUCKET_WORDS = 3_000_000


def _pack(values: np.ndarray) -> bytes:
    """Differences of a sorted array, byte plane by byte plane: the high planes are mostly zeros, which shuffles compress."""
    return np.ascontiguousarray(np.diff(values, prepend=values.dtype.type(0)).view(np.uint8).reshape(len(values), -1).T).tobytes()


def _unpack(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel(), dtype=dtype)


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T).tobytes()


def _unplanes(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()


class _Chunk:
    """The documents of a chunk in a fixed order, with the hashes of their words. Texts are hashed some at a time."""

    def __init__(self, batch: pa.Table, width: int):
        keys = [("id", "ascending"), ("text", "ascending")]
        self.batch = batch.select(["id", "text"]).sort_by(keys).combine_chunks()
        ids = self.batch.column("id")
        self.named = np.asarray(ids.is_valid().combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids.is_valid())
        self.ids = np.asarray(ids.fill_null(0).combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids.fill_null(0))
        self.width, self.block = width, (width + 1) // 2
        hashes, counts = [], []
        texts = self.batch.column("text")
        for at in range(0, len(texts), 128):
            words = Words(texts.slice(at, 128).combine_chunks())
            hashes.append(words.hashes())
            counts.append(words.counts)
        self.words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.at = np.arange(len(self.words)) - self.first[self.doc]

    def places(self, width: int, of: np.ndarray | None = None) -> np.ndarray:
        """The first word of every window within one named document, or of those of the first words given."""
        n = max(0, len(self.words) - width + 1)
        at = np.arange(n) if of is None else of[of < n]
        return at[(self.doc[at] == self.doc[at + width - 1]) & self.named[self.doc[at]]]

    def hashed(self, width: int, at: np.ndarray) -> np.ndarray:
        """A quick hash of each window."""
        total = np.zeros(len(at), np.uint64)
        for k in range(width):
            total = total * np.uint64(0xD6E8FEB86659FD93) + self.words[at + k]
        return mix(total)

    def digests(self, width: int, at: np.ndarray) -> np.ndarray:
        """128 bits of the words of each window (ascending places), as two columns of 64."""
        out = bytearray()
        for doc, a, b in _by_bucket(self.doc[at]):
            words = (self.batch.column("text")[doc].as_py() or "").encode().split()
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            first = self.at[at[a:b]]
            starts = np.where(first > 0, ends[first - 1], 0)
            for i, j in zip(starts.tolist(), (ends[first + width - 1] - 1).tolist(), strict=True):
                out += hashlib.blake2b(joined[i:j], digest_size=16).digest()
        return np.frombuffer(bytes(out), "<u8").reshape(-1, 2)

    def probes(self, buckets: int):
        """For each bucket its sorted probe hashes (32 bits), flags (1: reference block, 2: in several documents), and the probes' words and places."""
        at = self.places(self.block)
        hashes = self.hashed(self.block, at)
        bucket = (hashes >> np.uint64(32)) % np.uint64(buckets)
        key = (bucket << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))
        unique, place = np.unique(key, return_inverse=True)
        reference = np.zeros(len(unique), bool)
        reference[place[self.at[at] % self.block == 0]] = True
        ids = self.ids[self.doc[at]]
        low, high = np.full(len(unique), np.iinfo(np.int64).max), np.full(len(unique), np.iinfo(np.int64).min)
        np.minimum.at(low, place, ids)
        np.maximum.at(high, place, ids)
        return unique, reference | (low < high).astype(np.uint8) * np.uint8(2), at, place

    def around(self, anchors: np.ndarray, buckets: int):
        """For the full windows that hold an anchored probe: sorted digests by bucket, smallest ids, and the windows' words and places."""
        near = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(near, np.maximum(anchors - (self.width - self.block), 0), 1)
        np.add.at(near, anchors + 1, -1)
        at = self.places(self.width, np.flatnonzero(np.cumsum(near[:-1]) > 0))
        digests = self.digests(self.width, at)
        bucket = digests[:, 1] % np.uint64(buckets)
        order = np.lexsort((digests[:, 1], digests[:, 0], bucket))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(digests[order], axis=0) != 0).any(1)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        first = order[new]
        low = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(low, place, self.ids[self.doc[at]])
        return digests[first], bucket[first], low, at, place


def _by_bucket(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """Each bucket in a sorted array, and where it begins and ends."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(bucket)]])
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(starts, ends, strict=True)] if len(bucket) else []


def _answers(answers: pa.Table, n: int, parts: list[tuple[int, int, int]]) -> np.ndarray:
    bits = np.zeros(n, bool)
    by = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True))
    for bucket, a, b in parts:
        if bucket in by:
            bits[a:b] = np.unpackbits(np.frombuffer(by[bucket], np.uint8), count=b - a).astype(bool)
    return bits


_SENT = "chunk long, bucket long, hashes binary, more binary"
_GOT = "chunk long, bucket long, bits binary"


def _sent(chunk: int, rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.table([pa.array([chunk] * len(rows), pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["chunk", "bucket", "hashes", "more"])


def _reply(batch: pa.Table, hashes: list[np.ndarray], answer: np.ndarray) -> pa.Table:
    cuts = np.cumsum([0, *[len(h) for h in hashes]])
    bits = [np.packbits(answer[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table([batch.column("chunk"), batch.column("bucket"), pa.array(bits, pa.binary())], names=["chunk", "bucket", "bits"])


def mark_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, chunk_bytes: int = CHUNK, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """Each document's number of words and of removed words, and the kept words joined by single spaces."""
    return _repeats(docs, id_col, text_col, width, chunk_bytes, bucket_words, False)


def _repeats(docs, id_col, text_col, width, chunk_bytes, bucket_words, digest):
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = max(1, math.ceil(size / chunk_bytes)), max(1, math.ceil(size / 6 / bucket_words))
    own = own.select(F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).alias("chunk"), "id", "text")
    dealt = own.groupBy("chunk")

    def send_probes(key, batch):
        unique, flags, _, _ = _Chunk(batch, width).probes(buckets)
        return _sent(key[0].as_py(), [(b, _pack(unique[s:e].astype(np.uint32)), flags[s:e].tobytes()) for b, s, e in _by_bucket(unique >> np.uint64(32))])

    def find_anchors(batch):
        hashes = [_unpack(x, np.uint32) for x in batch.column("hashes").to_pylist()]
        flags = np.frombuffer(b"".join(batch.column("more").to_pylist()), np.uint8)
        _, place, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        reference, several = np.zeros(len(count), bool), count > 1
        reference[place[flags & 1 > 0]] = True
        several[place[flags & 2 > 0]] = True
        return _reply(batch, hashes, (reference & several)[place])

    def anchored(chunk: _Chunk, answers: pa.Table) -> np.ndarray:
        unique, _, at, place = chunk.probes(buckets)
        return at[_answers(answers, len(unique), _by_bucket(unique >> np.uint64(32)))[place]]

    def send_windows(key, batch, answers):
        chunk = _Chunk(batch, width)
        digests, bucket, low, _, _ = chunk.around(anchored(chunk, answers), buckets)
        return _sent(key[0].as_py(), [(b, _pack(digests[s:e, 0]), _planes(digests[s:e, 1]) + _planes(low[s:e])) for b, s, e in _by_bucket(bucket)])

    def find_repeats(batch):
        high = [_unpack(x, np.uint64) for x in batch.column("hashes").to_pylist()]
        more = batch.column("more").to_pylist()
        rest = np.concatenate([_unplanes(x[: len(x) // 2], np.uint64) for x in more])
        low = np.concatenate([_unplanes(x[len(x) // 2 :], np.int64) for x in more])
        every = np.concatenate(high)
        order = np.lexsort((rest, every))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(every[order]) != 0) | (np.diff(rest[order]) != 0)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        least = np.full(int(new.sum()), np.iinfo(np.int64).max)
        np.minimum.at(least, place, low)
        return _reply(batch, high, least[place] < low)

    names = [id_col, "n_words", "n_removed", "kept_sha256" if digest else "kept"]

    def remove(key, batch, answers):
        chunk = _Chunk(batch, width)
        first = answers.filter(pa.compute.equal(answers.column("round"), 1))
        second = answers.filter(pa.compute.equal(answers.column("round"), 2))
        digests, bucket, low, at, place = chunk.around(anchored(chunk, first), buckets)
        elsewhere = _answers(second, len(digests), _by_bucket(bucket))
        hit = at[elsewhere[place] | (low[place] < chunk.ids[chunk.doc[at]])]
        cover = np.zeros(len(chunk.words) + 1, np.int64)
        cover[: len(chunk.words)] += np.bincount(hit, minlength=len(chunk.words))[: len(chunk.words)]
        np.subtract.at(cover, hit + width, 1)
        gone = np.cumsum(cover[:-1]) > 0
        removed = np.bincount(chunk.doc[gone], minlength=len(chunk.counts))
        kept = []
        for i, text in enumerate(chunk.batch.column("text").to_pylist()):
            words = (text or "").encode().split()
            if removed[i]:
                words = [w for w, g in zip(words, gone[chunk.first[i] : chunk.first[i] + len(words)], strict=True) if not g]
            joined = b" ".join(words)
            kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
        return pa.table([chunk.batch.column("id"), pa.array(chunk.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=names)

    import pyarrow.compute  # noqa: F401

    anchors = dealt.applyInArrow(send_probes, _SENT).groupBy("bucket").applyInArrow(find_anchors, _GOT)
    windows = dealt.cogroup(anchors.groupBy("chunk")).applyInArrow(send_windows, _SENT).groupBy("bucket").applyInArrow(find_repeats, _GOT)
    answers = anchors.withColumn("round", F.lit(1)).unionByName(windows.withColumn("round", F.lit(2)))
    return dealt.cogroup(answers.groupBy("chunk")).applyInArrow(remove, f"{names[0]} long, {names[1]} long, {names[2]} long, {names[3]} string")


def op6_substrings(spark, sf_dir: str) -> DataFrame:
    return _repeats(table(spark, sf_dir, "documents"), "doc_id", "text", WIDTH, CHUNK, BUCKET_WORDS, True)


ORACLE = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM v GROUP BY s HAVING count(*) > 1),
h AS (SELECT doc_id, i FROM v JOIN f USING (s) WHERE first < doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM h),
x AS (SELECT doc_id, count(*) AS n_removed FROM g GROUP BY doc_id),
k AS (SELECT d.doc_id, string_agg(d.word, ' ' ORDER BY d.k) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d) d
  LEFT JOIN g ON g.doc_id = d.doc_id AND g.k = d.k WHERE g.k IS NULL GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN k USING (doc_id)
"""
