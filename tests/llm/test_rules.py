"""Quality rules, the filter audit and centroids, against brute force; languages beside a very wordy one."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gaugeline.llm import centroids as C
from gaugeline.llm import interactions as I  # noqa: E741
from gaugeline.llm import language as L
from gaugeline.llm import quality as Q

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_counts(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = text.split("\n")
    again = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered)


def test_counted_rules():
    rng = random.Random(3)
    pieces = ["a", "bé", "c#", "d|", "a", "\u00a0x", "e\x1cf", "<>", "漢字"]
    spaces = [" ", "\n", "\t", "\x0b", "\x0c", "  ", "\r\n"]
    texts = ["", " \n ", "a a a a", "x\nx\n\n\nx", "a b c a b c a b c", "a b c d a b c"]
    texts += ["".join(rng.choice(pieces) + rng.choice(spaces) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    for text in texts:
        assert Q.counted(text.encode()) == brute_counts(text), text


def _prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def test_quality(spark, docs):
    rng = random.Random(5)
    good, bad = [f"w{i}" for i in range(200)], [f"w{i}###" for i in range(200)]
    rows = [(i, _prose(rng, 80, good if i % 4 else bad)) for i in range(200)]
    odd = [(900, None), (901, ""), (902, "w1 w2"), (903, "same words here " * 40), (904, _prose(rng, 60000, good)), (None, _prose(rng, 90, good)), (1, rows[1][1])]
    labels = spark.createDataFrame([(i, 1 if i % 4 else 0, 0) for i in range(100)] + [(1, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    made = docs([*rows, *odd])
    out = Q.judged(made, Q.train(made, labels)).collect()
    assert len(out) == len(rows) + len(odd) and {"lang", "id", "removed", "text"} <= set(out[0].asDict())
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == Q.counted((r.text or "").encode())
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    kept = {r.doc_id: r.kept for r in out}
    # words of good texts that no label covers are kept, junk goes, and so does what the counted rules reject
    assert [kept[i] for i in range(200)].count(True) == 150 and all(kept[i] == bool(i % 4) for i in range(200))
    assert [kept[i] for i in (900, 901, 902, 903, 904, None)] == [False, False, False, False, True, True]
    assert Q.judged(docs([]), Q.train(docs([]), labels)).count() == 0
    alone = {r.doc_id: r.kept for r in Q.judged(made, Q.train(made, labels.limit(0))).collect()}
    assert alone[0] and not alone[902]  # nothing trusted: the counted rules decide
    twice = Q.judged(made.withColumnRenamed("lang", "kept").withColumnRenamed("source", "score"), Q.train(made, labels))
    assert twice.columns.count("kept") == 1 and twice.columns.count("score") == 1


def test_own_counts_left_out():
    texts = ["a b c d a b", "b c d e", "x y z x"]
    column = pa.array(texts)
    place, text = Q.buckets(column)
    count = lambda of: np.bincount(place[np.isin(text, of)], minlength=1 << Q.BITS).astype(float)
    got = Q.Model(count([0, 1, 2]), count([0, 1])).own_left_out(column.slice(0, 2))
    for i, other in ((0, 1), (1, 0)):
        assert got[i] == pytest.approx(Q.Model(count([0, 1, 2]), count([other])).scores(column)[i], abs=1e-12)


def test_quality_held_out(spark):
    """Half of the labels train; of the other half trusted texts stay and the others go."""
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = Q.judged(docs, Q.train(docs, labels.filter("doc_id % 2 = 0"))).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").select("quality", "kept").collect()
    rate = {q: np.mean([r.kept for r in got if r.quality == q]) for q in (0, 1)}
    assert rate[1] > 0.995 and rate[0] < 0.05, rate


def test_swaps():
    order, seen = list("ABCDE"), set()
    seen.add(tuple(order))
    for k in I.swaps(5):
        order[k], order[k + 1] = order[k + 1], order[k]
        seen.add(tuple(order))
    assert seen == set(itertools.permutations("ABCDE")) and len(list(I.swaps(5))) == 119


def brute_audit(rows, labels):
    """Filters applied one after the other, document by document."""
    said = {}
    for i, q, t in labels:
        g, x = said.get(i, (0, 0))
        said[i] = (max(g, int(q == 1)), max(x, int(t == 1)))
    fails = []
    for i, text, part in rows:
        text = text or ""
        words = WORD.findall(text)
        own = {"A"} if len(words) < 200 else set()
        own |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        own |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
        own |= {"D"} if re.search("[#$%&*|]", text) else set()
        own |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == text for j, u, _ in rows) else set()
        fails.append((part or "", own, *said.get(i, (0, 0))))
    out = {}
    for part in {f[0] for f in fails}:
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = [f for f in fails if f[0] == part]
            every, before = left, set()
            for k, c in enumerate(order, 1):
                gone = [f for f in left if c in f[1]]
                left = [f for f in left if c not in f[1]]
                redundant = sum(1 for f in every if c in f[1] and f[1] & before)
                before.add(c)
                total[c] += len(gone)
                out[part, "".join(order), k] = [len(left), len(gone), redundant, sum(f[1] == {c} for f in every), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(total[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_interactions(spark):
    rng = random.Random(8)
    long = [" ".join(rng.choice(["alpha", "Beta", "c%"] if rng.random() < 0.1 else [f"x{i}" for i in range(400)]) for _ in range(rng.randint(150, 320))) for _ in range(12)]
    rows = [(i, rng.choice([*long, None, "", "UPPER CASE", "a | b", "same " * 300]), rng.choice(["s", "t", None, ""])) for i in range(120)]
    rows += [(5, rows[5][1], "s"), (None, rows[7][1], "t"), (None, None, "only"), (-1, "", "t"), (-1, "", "s")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, source string, part string, mask int")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in I.audit(I.cells(docs, said)).collect()}
    assert got == brute_audit(rows, [x for x in labels if x[0] is not None])
    assert I.audit(I.cells(docs.limit(0), said)).count() == 0


def brute_centroids(rows, clusters, rounds, dims, seed=3):
    own = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows]
    first = sorted(own, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    centroids = [v for _, v in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min(range(len(centroids)), key=lambda k: (far(v, centroids[k]), k))
    for _ in range(rounds):
        groups = {}
        for _, v in own:
            groups.setdefault(near(v), []).append(v)
        moved = list(centroids)
        for k, g in groups.items():
            moved[k] = [sum(x) // len(g) for x in zip(*g, strict=True)]
        centroids = moved
    return sorted((str(i), near(v), far(v, centroids[near(v)])) for i, v in own), centroids


@pytest.mark.parametrize(("leaf", "tree"), [(2, 16), (32, 2048)])
def test_centroids(spark, monkeypatch, leaf, tree):
    monkeypatch.setattr(C, "LEAF", leaf)
    monkeypatch.setattr(C, "TREE", tree)
    rng = np.random.default_rng(6)
    middles = rng.standard_normal((5, 4))
    rows = [(i, (middles[i % 5] + 0.1 * rng.standard_normal(4)).astype(np.float32).tolist()) for i in range(150)]
    rows += [(i, [float(i % 3), 0.0, 0.0, 0.5]) for i in range(200, 230)]  # ties
    rows += [rows[3], (None, [0.25, -0.25, 0.0, 1.0])]
    odd = [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0, None, 1.0, 1.0]), (904, [float("nan")] * 4), (905, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in [*rows, *odd]], "vec_id long, embedding array<float>, cluster int, distance string").repartition(3)
    got, centroids = C.clustered(df, clusters=6, rounds=4, dimensions=4)
    want = brute_centroids(rows, 6, 4, 4)
    assert sorted((str(r.id), r.cluster, r.distance) for r in got.collect()) == want[0] and centroids == want[1]
    assert C.clustered(df.limit(0), dimensions=4)[0].count() == 0
    few, two = C.clustered(df.filter("vec_id in (1, 2)"), dimensions=4)
    assert len(two) == 2 and {r.distance for r in few.collect()} == {0}
    huge = spark.createDataFrame([(1, [1e300] * 4), (2, [-1e300] * 4), (3, [0.0] * 4)], "vec_id long, embedding array<double>")
    assert C.clustered(huge, clusters=2, dimensions=4)[0].count() == 3


def test_whole_boxes_are_settled():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-50, 50, (500, 8)) + 10000 * k for k in range(4)])
    order, low, high, total = C.grow(points)
    assert len(low) == C.nodes(len(points)) and (total[0] == points.sum(0)).all()
    reads = []

    class Counting(np.ndarray):
        def __getitem__(self, at):
            reads.append(at)
            return np.asarray(super().__getitem__(at))

    centroids = np.array([[10000 * k] * 8 for k in range(4)])
    nearest, count, sums = C.settle(points[order].view(Counting), low, high, total, centroids)
    assert (nearest == order // 500).all() and (count == 500).all() and (sums.sum(0) == points.sum(0)).all()
    assert len(reads) <= 4  # leaves that straddle groups, no others


def test_languages_beside_a_wordy_one(spark):
    """A language is learned however few words it has beside those of the others, and however many languages there are."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    rows = [(i, " ".join(word(9) for _ in range(500)), "en") for i in range(60)]
    own = {f"l{k}": word(12) for k in range(200)}
    rows += [(1000 + k, f"{w} {w}", lang) for k, (lang, w) in enumerate(own.items())] + [(5000, "1 2 3", "digits")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(df, vocabulary=2000, ngrams=2000)
    assert set(model.langs) == {"en", *own}
    assert all(model.score(w)[0] == lang for lang, w in own.items())
