"""Lines, substrings, near duplicates and vectors: operators that compare documents, against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import groups as G
from gaugeline.llm import jaccard as J
from gaugeline.llm import lines as N
from gaugeline.llm import substrings as S
from gaugeline.llm import vectors as V
from gaugeline.llm.common import stored


def closure(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(500, 560)] + [(600, 600)] + [(700, i) for i in range(701, 720)]
    got = {r.node: r.component for r in G.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == closure({n for e in edges for n in e}, edges)
    assert G.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest():
    nodes = np.array([9, 4, 7, 1, 5])
    assert G.forest(nodes, np.array([0, 2]), np.array([1, 4])).tolist() == [4, 4, 5, 1, 5]


def test_blocks(spark):
    members = spark.createDataFrame([(1, i) for i in range(23)] + [(2, 100)], "component long, node long")
    rows = G.blocks(members, "component", "node", 5).collect()
    met = defaultdict(int)
    by = defaultdict(list)
    for r in rows:
        by[r.block_pair].append(r)
    for own in by.values():
        assert len(own) <= 23
        for a in own:
            for b in own:
                if a.node < b.node and (a.side == 2 or a.side != b.side):
                    met[a.node, b.node] += 1
    assert set(met.values()) == {1} and len(met) == 23 * 22 // 2


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def near_copies(rng, n, group):
    rows, words = [], [f"w{i}" for i in range(400)]
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(1, 90))]
        for _ in range(rng.randint(1, group)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows), " ".join(own)))
    return rows


def test_jaccard(spark, docs, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 4)  # components of more than four go through pairs of blocks
    rng = random.Random(3)
    rows = near_copies(rng, 40, 9) + [(1000, None), (1001, ""), (1002, "a"), (1003, "a"), (1004, "word " * 30000)]
    sets = {i: shingles(t) for i, t in rows}
    edges = [(a, b) for a in sets for b in sets if a != b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root, n = closure(sets, edges), defaultdict(int)
    for a, _ in edges:
        n[a] += 1
    got = J.links(docs([*rows, rows[0], (None, rows[1][1])]), recall=0.99999).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == {i: (root[i], n[i]) for i in sets} and len(got) == len(sets)
    kept = J.one_of_each(docs([*rows, (None, rows[1][1])]), recall=0.99999)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([str(i) for i in sets if root[i] == i] + ["None"]) and kept.columns == docs([]).columns
    assert J.links(docs([])).count() == 0


def test_prefix_length():
    assert J.prefix_length(0.8, 0.999) == 5 and J.prefix_length(0.8, 0.9999999999) < 5 and J.prefix_length(1.0, 0.999) == J.DEPTH


def test_registered_bands(spark, docs):
    length, trees = J.bands(J.THRESHOLD, J.RECALL)
    assert (1 - J.THRESHOLD**length) ** trees < 1e-6
    assert J.bands(1.0, J.RECALL) == (J.DEPTH, J.TREES)
    # isolated pairs of 9 shingles each, 8 of them shared: exactly 0.8
    rows = []
    for i in range(12000):
        words = [f"p{i}w{k}" for k in range(13)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:12], "other"]))]
    got = J.links(docs(rows))
    assert got.filter("n_links = 1 and class_id = doc_id - doc_id % 2").count() == len(rows)


def brute_lines(rows, threshold=0.8, least=1):
    every = [(i, k, frozenset(line.lower().replace("\t", " ").split(" ")) - {""}) for i, t in rows if t is not None and i is not None for k, line in enumerate(t.split("\n"))]
    every = sorted(x for x in every if len(x[2]) >= least)
    return {(i, k) for n, (i, k, s) in enumerate(every) if any(len(s & o) >= threshold * len(s | o) - 1e-9 for _, _, o in every[:n])}


def test_lines(spark, docs):
    rng = random.Random(7)
    words = [f"v{i}" for i in range(60)]
    pool = [[rng.choice(words) for _ in range(rng.randint(1, 25))] for _ in range(40)]
    rows = []
    for d in range(60):
        own = []
        for _ in range(rng.randint(1, 6)):
            line = list(rng.choice(pool))
            for _ in range(rng.randint(0, 2)):
                line[rng.randrange(len(line))] = rng.choice(words)
            own.append(" ".join(line))
        rows.append((d, "\n".join(own)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "A  b\tc"), (104, "c a B\nx"), (105, "word " * 30000 + "\n" + "line\n" * 2000)]
    gone = brute_lines(rows)
    want = {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}
    out = N.dedup_lines(docs(rows))
    assert {r.doc_id: r.text for r in out.collect()} == want
    rest = N.without_repeats(docs([*rows, (None, rows[0][1])]))
    assert rest.columns == docs([]).columns and rest.filter("doc_id is null").first().text == rows[0][1]
    assert rest.filter("doc_id = 104").first().text == "x"
    assert N.dedup_lines(docs([])).count() == 0
    assert N.dedup_lines(docs([(1, "p q r"), (1, "p q r")])).filter("text = 'p q r'").count() == 2


def test_pairs_of_a_group_whose_words_are_no_more_frequent_than_others(spark, docs):
    """Most members of a group are settled by leaders, so that it does not give all its pairs (some 30000 here)."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"g{k}" if k != i % 30 else f"v{i % 7}" for k in range(30))) for i in range(250)]
    rows = [(i, f"{text} w{rng.randrange(40)}") for i, text in rows] + [(1000 + i, " ".join(rng.sample([f"w{k}" for k in range(40)], 12))) for i in range(700)]
    texts = docs(rows).selectExpr("doc_id AS id", "text")
    lines = N.line_sets(texts, N.rarity(texts.select("text")), 0.8, 1)
    classes = stored(lines.groupBy("k1", "k2").agg(F.min(F.struct("id", "no", "n", "b1", "b2", "prefix", "lead")).alias("s")).select("s.*").filter(F.size("prefix") > 0))
    early = N._verified(texts, stored(N._led(classes, 0.8)), 0.8)
    group = N._joined(classes, early, 0.8).filter("x_id < 1000")
    assert group.count() < 10 * 250
    gone = brute_lines(rows)
    assert {(r.id, n) for r in N.removed_lines(docs(rows)).collect() for n in r.removed} == set(gone)


def test_short_lines(spark, docs):
    import corpus_pipeline

    rng = random.Random(11)
    rows = [(d, "\n".join(" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 6))) for _ in range(5))) for d in range(40)]
    rows += [(100, "Les.\nAnd ornd.\n\nx1 x2 x3 x4"), (101, "les.\nornd. and\n\nword word word\nx1 x2 x3 x4 x5"), (102, "Les.")]
    gone = brute_lines(rows, least=1)
    assert {(101, 0), (101, 1), (101, 4), (102, 0)} <= gone and (101, 2) not in gone
    want = {i: "\n".join(own) for i, t in rows if (own := [x for k, x in enumerate(t.split("\n")) if (i, k) not in gone])}
    made = docs(rows).selectExpr("doc_id", "text", "lang", "source", "n_chars")
    got = corpus_pipeline.line_dedup(spark, made, None).collect()
    assert {r.doc_id: r.text for r in got} == want and 102 not in want


def brute_windows(rows, width=13):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - width + 1):
            if i is not None:
                key = tuple(w[k : k + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        out.append((str(i), len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


@pytest.mark.parametrize("chunk", [300, 10**9])
def test_substrings(spark, docs, chunk):
    rng = random.Random(9)
    words = [f"u{i}" for i in range(300)]
    passages = [[rng.choice(words) for _ in range(rng.randint(10, 40))] for _ in range(12)]
    rows = []
    for d in range(70):
        own = []
        for _ in range(rng.randint(0, 5)):
            own += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randint(1, 20))]
        rows.append((rng.randint(0, 10**6) - 500, " ".join(own)))
    rows += [(i, "same " * 20) for i in (7, 7, 8)] + [(-3, None), (-4, ""), (-5, "x y \t z"), (None, " ".join(passages[0])), (10**15, "word " * 20000)]
    got = S.mark_repeats(docs(rows), chunk_bytes=chunk, bucket_words=200 if chunk < 1000 else 10**6).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == brute_windows(rows)
    assert S.mark_repeats(docs([])).count() == 0


def test_substring_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in S.op6_substrings(spark, d).collect())
    assert got == [(i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute_windows(rows)]


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(V, "WINDOW", 4)
    monkeypatch.setattr(V, "BLOCK", 5)
    rng = np.random.default_rng(2)
    rows = []
    for label in range(3):
        for _ in range(15):
            base = rng.standard_normal(16)
            for _ in range(rng.integers(1, 14)):
                rows.append((len(rows), (base + 0.12 * rng.standard_normal(16)).astype(np.float32).tolist(), label))
    n = len(rows)
    odd = [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, rows[0][1], None), (n + 4, [None] * 16, 1), (n + 5, [], 1), (n + 6, rows[0][1][:8], rows[0][2]), (n + 7, [float("inf")] * 16, 1)]
    a = {i: np.array(v, np.float64) for i, v, _ in rows}
    label = {i: k for i, _, k in rows}
    edges = [(i, j) for i in a for j in a if i != j and label[i] == label[j] and a[i] @ a[j] / np.sqrt((a[i] @ a[i]) * (a[j] @ a[j])) >= 0.93]
    root, links = closure([*a, *range(n, n + 8)], edges), defaultdict(int)
    for i, _ in edges:
        links[i] += 1
    df = spark.createDataFrame([*rows, *odd, rows[0]], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in V.near_duplicates(df, recall=0.9999999).collect()}
    assert got == {i: (links[i], root[i], root[i] == i) for i in root}
    assert V.near_duplicates(df.limit(0)).count() == 0 and V.passes(10**6) > V.passes(10**4) >= V.passes(10)


def test_vectors_of_one_direction(spark):
    rng = np.random.default_rng(4)
    n, dim, turn = 4000, 64, 2 * np.pi / 360 * 20.7  # cosine 0.935
    own = rng.standard_normal((n, dim)) / 8 + 2 * np.eye(dim)[0]  # mean cosine 0.8
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    for i in range(0, 800, 2):
        off = rng.standard_normal(dim)
        off[0] = 0
        off -= off @ own[i] * own[i]
        own[i + 1] = np.cos(turn) * own[i] + np.sin(turn) * off / np.linalg.norm(off)
    cosine = own @ own.T
    want = (cosine >= 0.93).sum(1) - 1
    got = np.zeros(n, int)
    for r in V.near_duplicates(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(own)], "vec_id long, embedding array<double>, label int")).collect():
        got[r.vec_id] = r.n_links
    assert want.sum() >= 800 and 0.75 < cosine.mean() < 0.85
    assert (got != want).sum() <= 2


def test_vectors_of_many_passes(spark, monkeypatch):
    """What is kept of the passes does not grow with their number, and links across the ends of partitions are met."""
    monkeypatch.setattr(V, "WINDOW", 4)
    monkeypatch.setattr(V, "crowded", lambda x, size, *_: 60)
    kept, cut = [], V.cut
    monkeypatch.setattr(V, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    rng = np.random.default_rng(5)
    own = np.repeat(rng.standard_normal((40, 16)), 2, 0) + 0.05 * rng.standard_normal((80, 16))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(own)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in V.near_duplicates(df.repartition(7)).collect()}
    assert got == {i: (1, i // 2 * 2) for i in range(80)}
    assert max(k.count() for k in kept) < 60 * 80


def test_vectors_in_whole_labels(spark, monkeypatch):
    """Labels too crowded for passes are compared in blocks; a cosine of exactly the threshold links."""
    monkeypatch.setattr(V, "MOST", 0)
    monkeypatch.setattr(V, "BLOCK", 3)
    rows = [(i, [1.0, 1.0, 1.0, 1.0] if i % 2 else [1.0, 1.0, 1.0, -1.0], i % 3) for i in range(30)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in V.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), threshold=0.5).collect()}
    assert got == {i: (9, i % 3) for i in range(30)}
    apart = V.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), threshold=0.51).collect()
    assert {r.n_links for r in apart} == {4}


# words of sixteen letters that the quick hash takes for the same
ALIKE = ("nmspanheeoqczcva", "kgbqzfpxo!#0m4r%")


def test_hashes_only_propose(spark, docs):
    from gaugeline.llm.words import Words
    import pyarrow as pa

    one, two = Words(pa.array(ALIKE)).hashes()
    rows = [(1, " ".join([ALIKE[0]] * 13)), (2, " ".join([ALIKE[1]] * 13))]
    made = docs(rows)
    assert {r.n_removed for r in S.mark_repeats(made).collect()} == {0}
    assert {r.doc_id: r.text for r in N.dedup_lines(made).collect()} == dict(rows)
    assert {r.n_links for r in J.links(made).collect()} == {0}
    assert one == two  # or this test shows nothing


def test_lines_of_one_set_in_another_order(spark, docs):
    rows = [(1, "a b c d e f"), (2, "f e d c b a"), (3, "x y"), (4, "y  x x"), (5, "y"), (6, "x y z")]
    got = {r.doc_id: r.text for r in N.dedup_lines(docs(rows)).collect()}
    assert got == {1: "a b c d e f", 2: "", 3: "x y", 4: "", 5: "y", 6: "x y z"}


def test_links_of_one_set_in_another_order(spark, docs):
    a, b = "p q r s t u v", "k l m n o p0 q0"
    rows = [(1, f"{a} {b} {a} {b}"), (2, f"{a} {b} {a} {b} {a} {b}"), (3, f" {a.upper()}\n{b} {a} {b}"), (4, "z")]
    assert {r.doc_id: (r.class_id, r.n_links) for r in J.links(docs(rows)).collect()} == {1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (4, 0)}


def test_lines_take_no_python_on_executors(spark, docs, monkeypatch):
    rows = [(1, "a b c d e f\nx \u0391\u03a3"), (2, "A B C D E F g\n\u03b1\u03c3 X"), (3, "k\u0130 l\nK\u0130\tL")]
    made = docs(rows)
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(made), name, lambda *_, **__: pytest.fail("Python on the executors"))
    assert {r.doc_id: r.text for r in N.dedup_lines(made).collect()} == {1: rows[0][1], 2: "", 3: "k\u0130 l"}
