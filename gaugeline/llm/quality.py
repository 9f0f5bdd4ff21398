"""Quality rules: counted rules, then a hashed n-gram log-likelihood ratio between trusted texts and the whole corpus.

Words and pairs of neighbouring words are hashed into 2**BITS buckets. Two multinomials over the buckets are counted: the
raw one of every document, and the target one of the documents that are labelled as good. The target's is smoothed with
PRIOR pseudo-counts spread as the raw one is, so that a bucket the trusted texts lack costs the same however rare it is. A
text's score is the mean log ratio of its buckets (its length doesn't count). The threshold is fixed, not drawn: trusted
texts are scored with their own counts taken out of the target; from the median of these scores it lies SPREAD times as
far down as their lowest hundredth does. Every document is held against it.

Counted rules come first: a text of fewer than SHORTEST words, or of which more than REPEATED in a hundred words stand in
three-word windows that the text has twice, fails whatever its score.

Words are maximal runs of characters other than ASCII white space. A null or empty text has no words: it fails the counted
rules and has score 0. Whole texts are read, however long; repeated rows are counted and returned each; rows that repeat an
id are trusted together. Ids with several labels are trusted if one of them is 1; rows with a null id are never trusted. A
score of exactly the threshold is kept. Without trusted texts the threshold is minus infinity and the counted rules alone
decide. Columns of the input that have a result's name are replaced by it; other columns are kept by `judged`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table, unused
from .words import Words

BITS = 18
PRIOR = 1 << BITS
SPREAD = 1.5
SHORTEST, REPEATED = 50, 50
BROADCAST_IDS = 200_000  # trusted ids are broadcast up to so many (about 14 MB), joined beyond
_SYMBOLS = b"#*$%&|<>"
_BINS = 1000  # to one unit of a score, where its quantiles are looked up
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """The words that stand in a window of three words which occurs twice or more; windows are compared as numbers of words."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    own = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pairs = np.unique(own[:-1] * len(number) + own[1:], return_inverse=True)[1]
    _, which, times = np.unique(pairs[:-1] * len(number) + own[2:], return_inverse=True, return_counts=True)
    again = times[which] > 1
    covered = np.zeros(len(own), bool)
    for k in range(3):
        covered[k : len(again) + k] |= again
    return int(covered.sum())


def counted(text: bytes) -> tuple[int, int, int, int, int]:
    """COUNTS of a text in UTF-8."""
    words = text.split()
    seen: set[bytes] = set()
    lines = 0
    for line in text.split(b"\n"):
        if line in seen:
            lines += 1
        elif line.strip():
            seen.add(line)
    return len(words), len(b"".join(words).decode()), sum(text.count(c) for c in _SYMBOLS), lines, repeated_words(words)


def failed(n_words, n_repeat):
    """The counted rules, of numbers, arrays or columns."""
    return (n_words < SHORTEST) | (100 * n_repeat > REPEATED * n_words)


def buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words and pairs of neighbours, and the text that each is of."""
    words = Words(column)
    single = words.hashes()
    double, at = words.windows(2, of=single)
    places = (np.concatenate([single, double]) >> np.uint64(64 - BITS)).astype(np.int64)
    return places, np.concatenate([words.text_of, words.text_of[at]])


class Model:
    """The log ratio of each bucket and the threshold. Its size is that of the buckets, whatever the corpus."""

    def __init__(self, raw: np.ndarray, target: np.ndarray, threshold: float = float("-inf")):
        self.share = raw / max(1, raw.sum())
        self.target, self.total, self.threshold = target, float(target.sum()), threshold
        with np.errstate(divide="ignore", invalid="ignore"):
            self.ratio = np.log(np.where(raw > 0, target / self.share + PRIOR, PRIOR) / (self.total + PRIOR))

    def scores(self, column: pa.Array) -> np.ndarray:
        place, text = buckets(column)
        n = np.bincount(text, minlength=len(column))
        return np.bincount(text, self.ratio[place], len(column)) / np.maximum(n, 1)

    def own_left_out(self, column: pa.Array) -> np.ndarray:
        """Scores of texts that the target has counted, without their own share of it."""
        place, text = buckets(column)
        n = np.bincount(text, minlength=len(column))
        _, which, times = np.unique(text * len(self.ratio) + place, return_inverse=True, return_counts=True)
        rest = np.maximum(self.target[place] - times[which], 0) / np.maximum(self.share[place], 1e-300)
        each = np.log((rest + PRIOR) / (np.maximum(self.total - n, 0)[text] + PRIOR))
        return np.bincount(text, each, len(column)) / np.maximum(n, 1)


def _trusted(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    return labels.filter((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct()


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Counts over all documents, target counts over all those labelled 1, the threshold of all the latter."""
    ids = _trusted(labels, id_col, label_col).persist()
    n = ids.count()
    near = F.broadcast(ids) if n <= BROADCAST_IDS else ids
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    marked = rows.join(near.withColumn("_trusted", F.lit(True)), "_id", "left").select("_text", F.coalesce("_trusted", F.lit(False)).alias("_trusted"))

    def count(batches):
        raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in slices(batches):
            place, text = buckets(batch.column(0))
            raw += np.bincount(place, minlength=len(raw))
            target += np.bincount(place[batch.column(1).to_numpy(zero_copy_only=False)[text]], minlength=len(raw))
        some = np.flatnonzero(raw)
        for at in range(0, len(some), 1 << 14):
            own = some[at : at + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(raw[own]), pa.array(target[own])], ["bucket", "raw", "target"])

    # one row for each bucket, of which there are no more than 2**BITS
    sums = marked.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    place = sums.column("bucket").to_numpy()
    raw[place], target[place] = sums.column("raw").to_numpy(), sums.column("target").to_numpy()
    model = Model(raw, target)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def bins(batches):
        for batch in slices(batches):
            rules = np.array([counted(t or b"") for t in batch.column(0).cast(pa.binary()).to_pylist()])
            sound = ~failed(rules[:, 0], rules[:, 4])
            yield pa.RecordBatch.from_arrays([pa.array(np.floor(sent.value.own_left_out(batch.column(0))[sound] * _BINS).astype(np.int32))], ["bin"])

    # scores lie between the logs of a share's least and greatest ratio, so there are few thousands of bins
    found = rows.join(near, "_id", "left_semi").select("_text").mapInArrow(bins, "bin int").groupBy("bin").count().collect()
    ids.unpersist()
    if found:
        at, n = np.array(sorted(tuple(r) for r in found)).T
        quantile = lambda q: at[np.searchsorted(np.cumsum(n), q * n.sum())] / _BINS
        middle = quantile(0.5)
        model.threshold = float(middle - SPREAD * (middle - quantile(0.01)))
    return model


def judged(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """All rows and columns, with COUNTS, base_failed, score and kept."""
    added = [*COUNTS, "base_failed", "score", "kept"]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.drop(*[c for c in docs.columns if c in added and c != text_col])
    read = unused(own, "read")
    rows = own.withColumn(read, F.col(text_col).cast("string"))
    keep = [i for i, c in enumerate(rows.columns) if c != read and c not in added]
    schema = rows.drop(read, *added).schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    schema = schema.add("base_failed", "boolean").add("score", "double").add("kept", "boolean")
    at = rows.columns.index(read)

    def run(batches):
        for batch in slices(batches):
            text = batch.column(at)
            rules = np.array([counted(t or b"") for t in text.cast(pa.binary()).to_pylist()], np.int64)
            bad, score = failed(rules[:, 0], rules[:, 4]), sent.value.scores(text)
            kept = ~bad & (score >= sent.value.threshold)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *(pa.array(c) for c in rules.T.copy()), pa.array(bad), pa.array(score), pa.array(kept)], schema.names)

    return rows.mapInArrow(run, schema)


def op11_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return judged(docs, model).drop("text").select("doc_id", *COUNTS, "base_failed", "kept", "score")
