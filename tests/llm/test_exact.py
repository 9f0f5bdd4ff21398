"""Samples, hashes and queries that other tests leave out: held-out accuracy, brute force, rows that repeat an id."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gaugeline.llm import common, toxicity
from gaugeline.llm import jaccard as J
from gaugeline.llm import language as L
from gaugeline.llm import lines as N
from gaugeline.llm import substrings as S
from gaugeline.llm.words import Words

DATA = "/root/testdata/sf0.01"


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s[:n]


@pytest.mark.parametrize("n", [1, 7, 8, 9, 16, 64, 1024, 4096])
def test_hash_of_words_with_a_pattern(n):
    words = [thue_morse(n), thue_morse(n).translate(str.maketrans("ab", "ba")), "a" * n, "a" * (n + 1), "b" + "a" * n, "a" * n + "b", "\0" * n, "\0" * (n + 1)]
    hashes = Words(pa.array(words)).hashes()
    by_word = dict(zip(words, hashes.tolist(), strict=True))
    assert len(set(by_word.values())) == len(by_word)
    again = Words(pa.array(["x " + " ".join(words)])).hashes()
    assert again[1:].tolist() == [by_word[w] for w in words]


def test_windows_with_a_pattern_are_told_apart(spark, docs):
    one, other = thue_morse(1024), thue_morse(1024).translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join([one] * 13)), (2, " ".join([other] * 13))]
    assert {r.doc_id: r.n_removed for r in S.mark_repeats(docs(rows)).collect()} == {1: 0, 2: 0}


@pytest.mark.parametrize("n", [7, 10**6, 10**11, 10**18])
def test_share_of_any_number_of_rows(n):
    kept = common.share(6000, n) / 2**63 * n
    assert common.share(6000, n) >= 1 and (n <= 6000 or abs(kept - 6000) < 1)


def test_sample_of_each(spark):
    df = spark.range(20000).selectExpr("id", "CASE WHEN id % 1000 = 0 THEN 'rare' ELSE 'hot' END AS lang")
    got = {r.lang: r["count"] for r in common.sample_of_each(df, "lang", "id", 500).groupBy("lang").count().collect()}
    assert got["rare"] == 20 and 400 < got["hot"] < 600
    assert common.sample_of_each(df.limit(0), "lang", "id", 5).count() == 0


@pytest.mark.parametrize(("text", "words"), [("² ½ Ⅷ ١ 12", []), ("a² b", ["a", "b"]), ("x½y", ["x", "y"]), ("Été_9", ["été"]), ("", [])])
def test_words_are_letters(text, words):
    assert L.words_of(text) == words


def test_letterless_texts(spark, docs):
    model = L.train(spark.createDataFrame([(1, "the cat", "en")], "doc_id long, text string, lang string"))
    assert [model.score(t) for t in ("² ½", "Ⅷ", "12")] == [("und", 0.0)] * 3 and model.score("the²")[0] == "en"


def test_repeated_id_with_a_null_text(spark, docs):
    text = "one two three four five six seven"
    got = J.links(docs([(1, None), (1, text), (2, text)])).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == {1: (1, 1), 2: (1, 1)}


def gapped(word, n=3, span=toxicity.SPAN):
    """The kernel's feature map by enumeration: each occurrence of a subsequence weighs DECAY ** its span."""
    out = {}
    for places in itertools.combinations(range(len(word)), n):
        width = places[-1] - places[0] + 1
        if width <= span:
            key = "".join(word[p] for p in places)
            out.setdefault(key, []).append(toxicity.DECAY**width)
    return out


@pytest.mark.parametrize("words", [("loser", "lozser"), ("idiot", "idioot"), ("pathetic", "apathetic"), ("abc", "xyz"), ("aaaa", "aaa")])
def test_kernel_by_enumeration(words):
    columns = toxicity._columns(list(words))
    a, b = toxicity.phi(list(words), columns)
    maps = [gapped(w) for w in words]
    norms = [np.sqrt(sum(x * x for own in m.values() for x in own)) for m in maps]
    want = sum(sum(maps[0][k]) * sum(maps[1].get(k, [0])) for k in maps[0]) / (norms[0] * norms[1])
    assert a @ b == pytest.approx(want)


def test_toxicity_query_held_out(spark):
    got = toxicity.op7_toxicity(spark, DATA).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and labels.get(r.doc_id) is not None]
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    assert bad and good
    ahead = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert ahead > 0.9


def test_large_group_of_near_lines(spark, docs):
    rng = random.Random(5)
    base = [f"g{i}" for i in range(40)]
    rows = []
    for d in range(300):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(40)] = f"own{d}x{rng.randint(0, 9)}"
        rows.append((d, " ".join(own)))
    sets = {d: set(t.split()) for d, t in rows}
    want = {d for d in sets if any(len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e]) for e in range(d))}
    got = N.dedup_lines(docs(rows)).filter("__n_removed = 1").collect()
    assert {r.doc_id for r in got} == want and len(want) > 250


def test_pipeline_stages_on_odd_tables(spark):
    import corpus_pipeline

    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    labelled = [(i, "the cat and the dog went home with the other one " + str(i), "en", "s", 50) for i in range(3)]
    for rows in ([], [(None, None, None, None, None)], [*labelled, labelled[0], (None, "the cat and more", "en", None, 3), (7, None, "en", "s", 0)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, DATA)
            assert docs.columns == schema.names
        out = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
        assert out.count() == docs.count()
