"""Language, pieces, decontamination, secrets, personal data, toxicity: operators that keep to one document."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from gaugeline.llm import decontamination as D
from gaugeline.llm import language as L
from gaugeline.llm import pieces as P
from gaugeline.llm import pii, secrets, toxicity
from gaugeline.llm.words import Words

ODD = ["", None, " ", "a", "a  b\tc\n", "ünï ▁ cödé 日本😀", "\0", "x" * 20000, "word " * 30000]
DATA = "/root/testdata/sf0.001"


def test_words():
    w = Words(pa.array(["a b\tc", None, "", " x ", "é f"]))
    assert w.counts.tolist() == [3, 0, 0, 1, 1]
    assert [bytes(w.raw[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)] == ["a", "b", "c", "x", "é f"]
    s = Words(pa.array(["p q r s t u", "p q r s t", "p", "q p", "p q r s t u"]).slice(0, 5)).shingles()
    assert [len(x) for x in s] == [2, 1, 1, 1, 2] and (s[0] == s[4]).all() and s[1][0] in s[0]


def test_language(spark, docs):
    text = {"en": "the cat and the dog with that other one", "fr": "le chat et le chien avec une autre chose", "de": "der hund und die katze mit einem anderen"}
    rows = [(i, t, lang) for i, (lang, t) in enumerate(list(text.items()) * 4)]
    model = L.train(spark.createDataFrame([*rows, (90, None, "en"), (91, "x", None)], "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en", "fr"]
    got = {r.doc_id: (r.lang_pred, r["score"]) for r in L.predict(docs([(1, "the dog"), (2, "chienne"), (3, None), (4, "12 !?"), (5, "katzen " * 5000), (5, "katzen " * 5000)]), model, score_col="score").collect()}
    assert [got[i][0] for i in range(1, 6)] == ["en", "fr", "und", "und", "de"] and got[3][1] == 0.0 and 0 < got[1][1] <= 1
    assert L.predict(docs([]), model).count() == 0 and L.identified(docs([(1, "the"), (2, "")]), model).columns == docs([]).columns
    nothing = L.train(docs([]))
    assert nothing.score("the")[0] == "und"


def test_language_held_out(spark):
    got = L.op1_language(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.95 * got.count()


def test_pieces_exact():
    model = P.Pieces(P.default_model())
    texts = [t or "" for t in ODD] + [" lead", "trail ", "a ▁ b", "▁", "<s> </s> <0x0A> <unk>", "\n\n x"]
    want = model.library.encode(texts, add_bos=True, add_eos=True)
    got = model.ids(texts)
    assert [g.tolist() for g in got] == want and model.chunked
    for t, ids in zip(texts, got, strict=True):
        starts, ends = model.spans(t, ids)
        assert starts[0] == 0 and ends[-1] == len(t.encode()) and (np.diff(ends) >= 0).all()
        assert b"".join(t.encode()[a:b] for a, b in zip(starts, ends, strict=True)) == t.encode()
        assert model.decode(ids) == model.library.decode(ids.tolist())


def test_character_map():
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = sentencepiece_model_pb2.ModelProto.FromString(library.serialized_model_proto()).normalizer_spec
    ours = P.Normaliser(spec)
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab  ﬁ①Ⅷ㍿ａｂ é́ ​日ｶﾞ") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    for t in texts:
        made, source = ours.normalise(t)
        assert made.decode() == library.normalize(t)
        assert len(source) == len(made) + 1 and (np.diff(source) >= 0).all()
    assert P.CharMap(b"").longest(b"x", 0) is None


def test_pieces_query(spark, docs):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "a"), (None, "b")]
    got = P.digests(docs(rows), P.default_model()).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 1
    empty = next(r for r in got if r.doc_id == 0)
    assert empty.n_tokens == 2 and empty.ids_sha256 == hashlib.sha256(np.array([1, 2], "<u4").tobytes()).hexdigest() and empty.decoded_sha256 == hashlib.sha256(b"").hexdigest()
    back = {r.doc_id: r.decoded for r in P.decode(P.encode(docs(rows[:9]), P.default_model()), P.default_model()).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in rows[:9])


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_leaks(spark, docs):
    rng = random.Random(5)
    word = lambda: rng.choice(["ab", "cd", "ef", "gh", "ij", "kl", "mn"]) + str(rng.randint(0, 30))
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 70)))) for i in range(30)] + [(90, None), (91, "")]
    rows = []
    for d in range(80):
        t = [word() for _ in range(rng.randint(0, 90))]
        own = (items[rng.randrange(30)][1]).split()
        for k in range(rng.randint(0, len(own) // 12 + 1)):
            own[rng.randrange(len(own))] = f"new{k}"
        rows.append((d, " ".join(t + own + t)))
    rows += [(200 + i, t) for i, t in enumerate(ODD)] + [(1, rows[1][1]), (None, items[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(d), i) for d, t in rows for i, x in items if (s := shingles(x)) and len(s & shingles(t)) >= 0.8 * len(s))
    for size in (10**6, 60):  # one block of items, and several
        got = D.find_leaks(docs(rows), bench, block_shingles=size).collect()
        assert sorted((str(r.doc_id), r.item_id) for r in got) == want
    kept = D.drop_leaks(docs(rows), bench)
    assert kept.count() == sum(not any(d == str(x) for d, _ in want) for x, _ in rows) and kept.columns == docs([]).columns
    assert D.find_leaks(docs([]), bench).count() == 0 and D.drop_leaks(docs(rows), bench.limit(0)).count() == len(rows)


def brute_secrets(text):
    out = []
    for rank, (kind, p, g, n) in enumerate((("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16))):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(p, text or "") if len(m[g]) >= n]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def test_secrets(spark, docs):
    rng = random.Random(2)
    parts = ["password=", "Token: '", "api_key = ", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", " ", "é😀", "x", ":", "secret:token:", "abcdefghijklmno", '"']
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(300)] + [(900 + i, t) for i, t in enumerate(ODD)] + [(1, "password=abcdefghijklmnop"), (None, "AKIA" + "A" * 20)]
    got = secrets.findings(docs(rows), secrets.scan(docs(rows))).collect()
    assert len(got) == len(rows)
    made = sorted((str(r.doc_id), ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.rank < 3)) for r in got)
    assert made == sorted((str(i), ",".join(brute_secrets(t))) for i, t in rows)
    assert secrets.findings(docs([]), secrets.scan(docs([]))).count() == 0


def test_secret_ledger(spark, docs, tmp_path):
    path = f"{tmp_path}/ledger"
    first = secrets.update(docs([(1, "password=abcdefghijklmnop"), (2, "clean"), (3, "password=abcdefghijklmnop")]), path)
    assert first.count() == 2 * len(secrets.RULES)
    versions = docs([(1, "clean"), (2, "clean"), (4, "AKIA" + "B" * 20), (5, "password=abcdefghijklmnop")])
    assert secrets.scan(versions, first).select("blob").distinct().count() == 1
    whole = secrets.update(versions, path)
    assert whole.count() == 3 * len(secrets.RULES)
    assert {r.doc_id: len(r.spans) for r in secrets.findings(versions, whole).collect()} == {1: 0, 2: 0, 4: 1, 5: 1}
    newer = tuple(secrets.Rule(r.kind, r.pattern, r.group, r.least, 2) if r.kind == "hex" else r for r in secrets.RULES)
    assert {(r.kind, r.version) for r in secrets.scan(versions, whole, rules=newer).collect()} == {("hex", 2)}


def brute_pii(t):
    rules = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    out = []
    for kind, p in rules:
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
            if (kind == "ip" and any(int(x) > 255 for x in m[0].split("."))) or (kind == "card" and not (13 <= len(d) <= 19 and luhn)) or (kind == "phone" and not 9 <= len(d) <= 15):
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_pii_base():
    rng = random.Random(1)
    for _ in range(8000):
        t = "".join(rng.choice("ab.@-+1234 ()9é_0") for _ in range(rng.randint(0, 60)))
        assert [tuple(c) for c in pii.base_spans(t)] == brute_pii(t)
    assert [c.kind for c in pii.base_spans("card 4111 1111 1111 1111 tel +49 (30) 1234-567 a@b.co 10.0.0.1")] == ["email", "ip", "card", "phone"]


def test_pii(spark, docs):
    rows = [(i, f"please call (030) 4567 {8901 + i} or mail jo{i} at mail dot org") for i in range(40)] + [(50, "version 12.34.5678.9012"), (51, "see jo@mail.org, ip 10.1.2.3")] + [(100 + i, t) for i, t in enumerate(ODD)] + [(None, "a@b.co"), (51, "see jo@mail.org, ip 10.1.2.3")]
    df = docs(rows)
    model = pii.train(df)
    got = pii.find(df, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: [s.kind for s in r.spans] for r in got}
    assert by[51] == ["email", "ip"] and by[None] == ["email"] and by[100] == [] and "phone_text" in by[0]
    assert pii.find(docs([]), pii.train(docs([]))).count() == 0
    assert np.isfinite(model.weights).all() and ((model.reliability >= 0) & (model.reliability <= 1)).all()


def test_pii_gate():
    texts = ["jane [at] example.org", "jane at example.org", "jane(AT)example.org", "jane At example dot org", "jane@example.org", "jane [at] example [dot] org", "ip ١ 10.1.2.3", "4111 1111 1111 1111", "+49 (30) 1234-567", "(030) 4567 8901", "no.123-45-6789"]
    kinds = {c.kind for t in texts for c in pii.candidates(t)}
    batch = pa.RecordBatch.from_arrays([pa.array([*texts, "no candidate."])], ["text"])
    passed = [t for _, own in pii._texts([batch], 0) for _, t, _ in own]
    assert kinds == set(pii.KINDS) and all(pii.candidates(t) for t in texts) and passed == texts
    rng = random.Random(6)
    parts = ["jane", "a", " at ", "[at]", "(At)", " AT ", " dot ", "[dot]", ".", "org", " ", "é", "-", "ſ", "\u212a", "@", "+", "(", ")", "1", "22", "333", "4444", "10.0.0.1", "123-45-6789", "4111111111111111", "\n"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(30000)]
    found = set()
    for t, kinds in zip(texts, pii.possible(pa.array(texts, pa.large_string())), strict=True):
        whole = pii.candidates(t)
        assert pii.candidates(t, kinds) == whole
        found |= {c.kind for c in whole}
    assert found == set(pii.KINDS)


INSULTS = ["loser", "idiot", "pathetic", "moron"]


def toxic_rows(n, rng):
    clean = "the house and river near a garden where people walk along quiet streets reading books about travel music loose ideas path".split()
    for i in range(n):
        words = [rng.choice(clean) for _ in range(30)]
        bad = i % 3 == 0
        if bad:
            for _ in range(2):
                words.insert(rng.randrange(30), rng.choice(INSULTS))
        yield i, " ".join(words), int(bad)


def test_toxicity(spark, docs):
    rng = random.Random(4)
    rows = list(toxic_rows(300, rng))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs([(i, t) for i, t, _ in rows]), labels)
    probe = [(0, "you are a lo.ser and an id-iot"), (1, "the garden and the river"), (2, "an idi0t, a mor*on"), (3, None), (4, ""), (5, "the house " * 20000), (6, "p a t h e t i c loser"), (6, "p a t h e t i c loser")]
    got = toxicity.score(docs(probe), model, score_col="toxicity").collect()
    by = {r.doc_id: r.toxicity for r in got}
    assert len(got) == len(probe) and all(0 <= s <= 1 for s in by.values())
    assert min(by[0], by[2], by[6]) > 0.7 > 0.3 > max(by[1], by[3], by[4], by[5])
    assert toxicity.score(docs([(1, "x")]), toxicity.fit(["a"], [0])).first()["score"] == 0.0
    assert toxicity.score(docs([]), model).count() == 0


def test_kernel():
    columns = toxicity._columns(["loser"])
    a, b, c = toxicity.phi(["loser", "lo.ser", "garden"], columns)
    assert a @ a > a @ b > 0 and a @ c < a @ b / 2
    assert toxicity.words_of("a l o s e r now")[-1] == "aloser" or "loser" in "".join(toxicity.words_of("a l o s e r now"))


@pytest.mark.parametrize("n", [3, 60, 5000])
def test_sketch_size(n):
    k = D.sketch_size(n)
    assert 1 <= k <= 13 and (k == 13 or k > n - int(np.ceil(0.8 * n)))


def test_queries_and_pipeline_names(spark):
    import corpus_pipeline
    from gaugeline.llm import queries

    assert {int(q[2:].split("_")[0]) for q in queries.QUERIES} == set(range(1, 14)) and set(queries.SQL) <= set(queries.QUERIES)
    assert len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, DATA)
        assert kept.columns == docs.columns
    assert 0 < kept.filter(F.col("text").isNotNull()).count() <= docs.count()
