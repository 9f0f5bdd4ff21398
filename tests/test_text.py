import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeline.functions import text as T

GOLDEN = {
    "user 42 not found": "user <n> not found",
    "took 4200ms 3.5s 512kb": "took <n>ms <n>s <n>kb",
    "prj_1013 user_42 order_9f3ac2d144": "prj_<n> user_<n> order_<hex>",
    "sha256 utf8 deadbeefcafe DEADBEEF12": "sha256 utf8 <hex> <hex>",
    "id=550e8400-e29b-41d4-a716-446655440000": "id=<uuid>",
    "_12.5x _12.5 a_1b": "_<n>.<n>x _<n> a_1b",
    "é12 12é ü_12 été9": "é<n> <n>é ü_<n> été<n>",
    "\"unclosed 'in\" z": "<str> z",
    " a 　b ": "a b",
    "": "",
}


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column(*map(F.col, names)).alias("x")).first().x


def test_messages(spark):
    df = spark.createDataFrame(list(GOLDEN.items()), "m string, want string").select("m", "want", T.normalize_message(F.col("m")).alias("got"))
    assert [(r.m, r.got) for r in df.collect()] == list(GOLDEN.items())


def plain_message(s: str) -> str:
    """An independent version with Python's patterns in ASCII mode."""
    s = s[:500]
    s = re.sub(r"([\"'`])(?:\\[^\n\r  ]|(?!\1)[^\n\r  ])*\1", "<str>", s)
    for p, put in ((T.UUID, "<uuid>"), (r"\b[0-9a-fA-F]{8,}\b", "<hex>"), (r"_[0-9a-fA-F]{8,}\b", "_<hex>"), (r"_[0-9]+(\.[0-9]+)?\b", "_<n>"), (r"\b[0-9]+(\.[0-9]+)?", "<n>")):
        s = re.sub(p, put, s, flags=re.A)
    return re.sub("[\t\n\x0b\f\r    -     　﻿]+", " ", s).strip(" ")


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab19f_-.\"'`\\ \n\té ", max_size=60), min_size=1, max_size=40))
def test_messages_like_python(spark, texts):
    got = spark.createDataFrame([(t,) for t in texts], "m string").select("m", T.normalize_message(F.col("m")).alias("g")).collect()
    assert [r.g for r in got] == [plain_message(t) for t in texts]


def test_routes(spark):
    cases = [(None, ""), ("", ""), ("/orders/812", "/orders/:id"), ("/a//b/", "/a//b/"), ("/u/550E8400-e29b-41d4-a716-446655440000?x=1", "/u/:id"), ("/f/deadbeef", "/f/:id"), ("/474.html#top", "/474.html#top"), ("?q", "")]
    df = spark.createDataFrame(cases, "r string, want string").select("want", T.normalize_route(F.col("r")).alias("got"))
    assert all(r.got == r.want for r in df.collect())


def test_frames(spark):
    stack = "Error: boom\n    at f (https://x.test/a.js?v=1:10:5)\n  File \"x.py\", line 1\nplain\n g@http://h/b.ts:3:4\n" + "\n".join(f"at h{i} (c.js:{i}:1)" for i in range(9))
    assert one(spark, T.stack_frames, stack) == ["at f (https://x.test/a.js", 'File "x.py", line 1', "g@http://h/b.ts", "at h0 (c.js", "at h1 (c.js"]
    assert one(spark, T.stack_frames, None) == []


def test_identities(spark):
    args = ("server", "svc", "TypeError", "user 42 not found", None, "/users/42")
    want = hashlib.sha256("server svc TypeError user <n> not found /users/:id".encode()).hexdigest()[:32]
    assert one(spark, T.fingerprint, *args) == want
    assert one(spark, T.fingerprint, *args[:3], "user 7 not found", None, "/users/7") == want
    assert one(spark, T.fingerprint, "server", "svc", "RangeError", *args[3:]) != want

    def made(**change):
        d = {"org": "o", "repo": "r", "fp": want, "at": "2026-01-01 00:00:00.000", "trace": "trace-1", "session": None, "message": "m", "index": "0"} | change
        return one(spark, lambda o, r, f, a, t, s, m, i: T.occurrence_id(o, r, f, a.cast("timestamp"), t, s, m, i), *d.values())

    base = made()
    assert re.fullmatch("[0-9a-f]{32}", base) and made() == base
    assert base == hashlib.sha256("\0".join(["v1", "o", "r", want, "1767225600000", "trace-1", "", "m", "0"]).encode()).hexdigest()[:32]
    others = [made(index="1"), made(at="2026-01-01 00:00:00.001"), made(trace="t2"), made(org="o2")]
    assert len({base, *others}) == 5
