"""Language identification by word-first backoff.

A word known from training scores its log frequency in each language. An unseen word falls back to its character
n-grams, longest first: the first length of which some n-gram is known gives the mean log frequency of the known ones,
with a penalty for each length given up. A text's score is the softmax of the languages' sums over all its words.

Training: word counts come from a sample of labelled rows, bounded by `sample` for each language (chosen by a hash of the
id), so that a language is learned however rare it is beside others. Of each language its most frequent words and n-grams
are kept, as many as an equal share of `vocabulary` and `ngrams` allows and LEAST_EACH at least, so that a language with few
words beside one with very many still has them; ties go by string. Words are runs of letters (by Unicode category:
superscripts, fractions and Roman numerals are none), lower-cased; those of more than LONGEST_WORD letters are looked up
whole, but give no n-grams to learn from. A language whose texts hold no letter is not learned.

Null or letterless texts, and all texts where nothing was learned, give `und` with score 0. Ties between languages go to
the first by name. One row out for each row in; repeated rows are repeated; a null id is kept. Whole texts are read.
Columns of the input that have the result's names are replaced by it; `identified` returns the input's columns as they are.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_strings, crc_mod, sample_of_each, slices, table, unused

_RUN = re.compile(r"[^\W\d_]+")
SAMPLE = 1500  # of each language
LONGEST_WORD = 64
VOCABULARY = 120_000
NGRAMS = 60_000
LEAST_EACH = 1000  # words and n-grams of a language, however many languages there are
LONGEST = 4
PENALTY = math.log(0.4)
UNDETERMINED = "und"
_CACHE = 250_000


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters. The pattern's runs may hold numbers that are no digits; these part words as well."""
    words = _RUN.findall(text.lower())
    if all(map(str.isalpha, words)):
        return words
    return [part for w in words for part in (w,) * w.isalpha() or "".join(c if c.isalpha() else " " for c in w).split()]


class Model:
    """Log frequencies by language. Scores of words are kept as rows of a matrix, bounded in number."""

    def __init__(self, words: list[tuple[str, str, int]], grams: list[tuple[str, str, int]]):
        self.langs = sorted({lang for lang, _, _ in [*words, *grams]})
        place = {lang: i for i, lang in enumerate(self.langs)}

        def logs(counted):
            total = np.ones(len(self.langs))
            for lang, _, n in counted:
                total[place[lang]] += n
            floor = np.log(0.5 / total)
            out: dict[str, np.ndarray] = {}
            for lang, s, n in counted:
                if s not in out:
                    out[s] = floor.copy()
                out[s][place[lang]] = math.log(n / total[place[lang]])
            return out, floor

        self.words, _ = logs(words)
        self.grams, self.floor = logs(grams)
        self._empty()

    def _empty(self):
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, max(1, len(self.langs))))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("place", "rows")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._empty()

    def word(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is not None:
            return known
        marked = f"<{word}>"
        for n in range(LONGEST, 0, -1):
            found = [g for i in range(len(marked) - n + 1) if (g := self.grams.get(marked[i : i + n])) is not None]
            if found:
                return sum(found) / len(found) + PENALTY * (LONGEST + 1 - n)
        return self.floor

    def score(self, text: str) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.langs:
            return UNDETERMINED, 0.0
        place = self.place
        for w in {w for w in words if w not in place}:
            if len(place) >= len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[len(place)] = self.word(w)
            place[w] = len(place)
        total = self.rows[[place[w] for w in words]].sum(0)
        if len(place) > _CACHE:
            self._empty()
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())


def train(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, vocabulary: int = VOCABULARY, ngrams: int = NGRAMS) -> Model:
    """From the labelled rows; rows without label or text teach nothing."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches):
        from collections import Counter

        for batch in slices(batches, 1024):
            counts = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.update((lang, w) for w in words_of(text))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])

    words = sample_of_each(rows, "lang", "id", sample).select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = words.persist()
    marked = F.concat(F.lit("<"), F.col("word"), F.lit(">"))
    grams = words.filter(F.length("word") <= LONGEST_WORD).select("lang", "n", marked.alias("w"), F.explode(F.sequence(F.lit(1), F.lit(LONGEST))).alias("k")).filter(F.length("w") >= F.col("k"))
    grams = grams.select("lang", "n", F.explode(F.expr("transform(sequence(1, length(w) - k + 1), i -> substring(w, i, k))")).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    langs = words.select("lang").distinct().count()

    def top(df, s, most):
        # a language's strings are those of its sample: a bounded group
        rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), s))
        return [tuple(r) for r in df.withColumn("rank", rank).filter(F.col("rank") <= max(LEAST_EACH, most // max(1, langs))).select("lang", s, "n").collect()]

    model = Model(top(words, "word", vocabulary), top(grams, "gram", ngrams))
    words.unpersist()
    return model


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All rows and columns, with the predicted language and its score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    schema = docs.drop(lang_col, score_col).schema.add(lang_col, "string").add(score_col, "double")
    keep = [i for i, c in enumerate(docs.columns) if c not in (lang_col, score_col)]

    def run(batches):
        for batch in slices(batches):
            got = [sent.value.score(t) for t in as_strings(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], schema.names)

    return docs.mapInArrow(run, schema)


def op1_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(crc_mod("doc_id", 4) != 2))
    held = docs.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "text")
    return predict(held.select("doc_id", "held_out", "text"), model).drop("text")


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """The documents in a language that the model knows; the rest are rejected."""
    names = unused(docs, "pred"), unused(docs, "score")
    return predict(docs, model, lang_col=names[0], score_col=names[1]).filter(F.col(names[0]) != UNDETERMINED).drop(*names)
