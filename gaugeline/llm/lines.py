"""Line dedup: an exact set-similarity join of lines.

A line is the set of its lower-cased words (runs of what is not ASCII white space), at least `least` of them; with 1, the
default, only blank lines are exempt. A line is removed if an earlier one (by document id, then line number) has a Jaccard similarity of
at least `threshold` with it, whether that one is itself removed or not.

Lines that are alike but for case form a class, found at its first place (told by 128 bits of SHA-256 of the
lower-cased line; of lines too short for another set to be similar enough, of their set); only classes are joined, and of these only
the ones with enough words (n / (n + 1) is the most that is possible: 4 words at 0.8). Hashes of words only propose. Words are ordered by rarity: all words of all documents are counted in TABLE
buckets of their hashes, at every size of the input, and a word comes by its bucket's logarithmic count before its hash.
A bucket tells words apart that make up more than a millionth of the input. Rarer ones share ranks, but a line has few of
them and they all come first; how long its prefix's lists are is decided by the more frequent words behind them.

Two sets that are similar enough share one of the first n - ceil(t n) + 1 words of the longer and of the first
n - ceil(2 t n / (1 + t)) + 1 of the shorter; pairs that do must also pass the
length filter, the positional filter and a count of differing bits of two 128-bit parities, and are then verified on the
words themselves. As one earlier match is enough, each class is first held against the earliest classes of each of its two
leading keys (of DRAWN of its words each, those with the least hashes and those with the greatest: two sets of similarity s draw the same with
about probability s ** DRAWN, whatever else is edited and however frequent the words have become), and of those that pass the filters verified
with the likeliest; only classes that this leaves unsettled are
joined with all earlier ones, so a large group of near copies does not give all its pairs. The join is by word, which
adaptive execution splits where a word is hot; the earliest classes are found by partial aggregates. What is broadcast are
the TABLE and, for verification, MARKS bits that tell which lines may be wanted, so that few others are shuffled.

All of it are DataFrame operations. The TABLE is written into the plan as a constant, as functions of array elements may not look
into a subquery.

Null texts have no line and stay null. Rows with a null id are unchanged. Rows that repeat an id count as one document
(its texts should be the same; a line number removed from one is removed from all). Very long lines and texts are read
whole. Other columns are kept; names that begin with __line_ or __n_ are this module's own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

THRESHOLD = 0.8
LEAST = 1
DRAWN, LEADERS, OFTEN = 3, 8, 8
TABLE, MARKS = 1 << 20, 1 << 23
_SPACE = "\t\r\f\x0b"


def _lowered(text: Column) -> Column:
    """Lower case code point by code point; Spark's own looks at neighbours of a capital sigma and takes a dotted capital I for two."""
    return F.lower(F.replace(F.replace(text, F.lit("\u03a3"), F.lit("\u03c3")), F.lit("\u0130"), F.lit("i")))


def _plain(text: Column) -> Column:
    """Lower case, with spaces for all other white space but line ends: splitting at one character takes no regular expression."""
    plain = _lowered(text)
    for c in _SPACE:
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    return plain


def rarity(texts: DataFrame) -> np.ndarray:
    """A number for each bucket of word hashes: 1 + 3.5 times the binary logarithm of the number of words, 0 if there are none. Words beside
    other white space than spaces and line ends are counted together with it: that only makes them rare."""
    words = texts.select(F.explode(F.split(F.replace(F.lower("text"), F.lit("\n"), F.lit(" ")), " ")).alias("w")).filter("w <> ''")
    got = words.groupBy(F.xxhash64("w").bitwiseAND(TABLE - 1).cast("int").alias("b")).agg(F.count("*").alias("n")).toArrow()  # TABLE rows at most
    out = np.zeros(TABLE, np.uint8)
    out[got.column("b").to_numpy()] = np.minimum(127, 1 + 3.5 * np.log2(got.column("n").to_numpy().astype(np.float64)))
    return out


def _table(ranks: np.ndarray) -> Column:
    """The ranks as a constant: what is done to each word of an array may look into no table of a query's own."""
    return F.split(F.lit(",".join(map(str, ranks.tolist()))), ",").cast("array<tinyint>")


def _sent(spark: SparkSession, numbers: np.ndarray) -> Column:
    """An array that every row can look into: the scalar of a table of one row."""
    return spark.createDataFrame(pa.table({"numbers": pa.array([numbers])})).scalar()


def _prefix_size(n: Column, t: float) -> Column:
    """How many of a set's n words are enough to share one with every similar set; 0 if only equal sets are similar."""
    return F.when(n >= t * (n + 1) - 1e-9, n - F.ceil(n * t - 1e-9) + 1).otherwise(0).cast("int")


def line_sets(texts: DataFrame, ranks: np.ndarray, threshold: float, least: int) -> DataFrame:
    """One row for each line of at least `least` words: place, number of words, class key, parity, prefix and leading keys."""
    table_ = _table(ranks)
    rank = lambda x: F.get(table_, x.bitwiseAND(TABLE - 1).cast("int")).cast("long")
    lines = texts.select("id", F.posexplode(F.split(_plain(F.col("text")), "\n")).alias("no", "line")).filter(F.trim("line") != "")
    words = F.transform(F.split("line", " "), lambda w: F.xxhash64(w))
    lines = lines.select("id", "no", "line", F.array_remove(F.array_distinct(words), F.xxhash64(F.lit(""))).alias("h"))
    # one number holds a word's rank and hash
    ranked = F.transform("h", lambda x: F.shiftleft(rank(x), 55).bitwiseOR(x.bitwiseAND((1 << 55) - 1)))
    # 128 bits, each the parity of the number of words that fall to it: one number for half of the words, one for the others
    half = lambda x: F.shiftrightunsigned(x, 57).bitwiseAND(1)
    bit = lambda on, x: F.call_function("shiftleft", on, F.shiftrightunsigned(x, 58).cast("int"))
    b1 = F.aggregate("h", F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(bit(half(x).bitwiseXOR(1), x)))
    b2 = F.aggregate("h", F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(bit(half(x), x)))
    size = _prefix_size(F.size("h"), threshold)
    words = F.when(size > 0, F.col("line")).otherwise(F.array_join(F.array_sort(F.array_distinct(F.array_remove(F.split("line", " "), ""))), " "))
    lines = lines.select("id", "no", F.unhex(F.sha2(words, 256)).alias("key"), F.size("h").alias("n"), size.alias("size"), b1.alias("b1"), b2.alias("b2"), F.sort_array("h").alias("h"), F.sort_array(ranked).alias("set"))
    lead = F.when(F.col("size") > 0, F.array(F.xxhash64(F.slice("h", 1, DRAWN)), F.xxhash64(F.lit(1), F.slice("h", -DRAWN, DRAWN)))).otherwise(F.array().cast("array<long>"))
    # 31 bits of each word: words that these take for the same only propose pairs
    prefix = F.transform(F.slice("set", F.lit(1), F.col("size")), lambda x: F.shiftright(x, 20).bitwiseAND((1 << 31) - 1).cast("int"))
    lines = lines.select("id", "no", "n", F.substring("key", 1, 8).alias("k1"), F.substring("key", 9, 8).alias("k2"), "b1", "b2", prefix.alias("prefix"), lead.alias("lead"))
    return lines.filter(F.col("n") >= least) if least > 1 else lines


def removed_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, least: int = LEAST) -> DataFrame:
    """id, and the numbers (from 0) of the lines to remove, for documents that have any."""
    return _removed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), threshold, least)


_POST = ("id", "no", "meta", "b1", "b2")


def _posts(classes: DataFrame, settled: Column, t: float, keys: Column | None = None) -> DataFrame:
    """One row for each word of each class's prefix, or for each of `keys`, which stand for words at the first place. meta: the set's size (from
    bit 33), the word's place (from bit 2), whether the shorter set of a pair needs this place (bit 1), whether the class is settled (bit 0)."""
    rows = classes.select("id", "no", "b1", "b2", "n", settled.cast("long").alias("settled"), F.posexplode("prefix" if keys is None else keys).alias("pos", "word"))
    rows = rows if keys is None else rows.withColumn("pos", F.lit(0))
    short = F.col("pos") <= F.col("n") - F.ceil(F.col("n") * (2 * t / (1 + t)) - 1e-9)
    meta = F.shiftleft(F.col("n").cast("long"), 33).bitwiseOR(F.shiftleft(F.col("pos").cast("long"), 2)).bitwiseOR(F.when(short, 2).otherwise(0).cast("long")).bitwiseOR(F.col("settled"))
    return rows.select("word", "id", "no", meta.alias("meta"), "b1", "b2")


def _size(side: str) -> Column:
    return F.shiftright(f"{side}_meta", 33)


def _later(side: str, other: str) -> Column:
    a, b = F.col(f"{side}_id"), F.col(f"{other}_id")
    return (a > b) | ((a == b) & (F.col(f"{side}_no") > F.col(f"{other}_no")))


def _differ() -> Column:
    """As many words as this at least are in one set only."""
    return F.bit_count(F.col("x_b1").bitwiseXOR(F.col("y_b1"))) + F.bit_count(F.col("x_b2").bitwiseXOR(F.col("y_b2")))


def _promising(t: float) -> Column:
    """The length, positional and parity filters of a pair that shares a prefix word."""
    place = lambda s: F.shiftright(f"{s}_meta", 2).bitwiseAND((1 << 31) - 1)
    x_n, y_n = _size("x"), _size("y")
    shared = F.ceil((x_n + y_n) * (t / (1 + t)) - 1e-9)
    left = F.least(x_n - place("x"), y_n - place("y"))
    return (F.least(x_n, y_n) >= t * F.greatest(x_n, y_n) - 1e-9) & (left >= shared) & (_differ() <= x_n + y_n - 2 * shared)


def _side(df: DataFrame, side: str, *columns: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{side}_{c}") for c in columns])


def _mark(id_: str, no: str) -> Column:
    """Which of MARKS bits stands for each line."""
    return F.xxhash64(id_, no).bitwiseAND(MARKS - 1)


def _marked(wanted: DataFrame) -> np.ndarray:
    """MARKS bits of which those of the wanted lines are set. It only spares work: a line that it lets through is joined."""
    at = _mark("id", "no")
    bit = F.call_function("shiftleft", F.lit(1), at.bitwiseAND(31).cast("int"))
    got = wanted.groupBy(F.shiftright(at, 5).cast("int").alias("w")).agg(F.bit_or(bit).alias("bits")).toArrow()  # MARKS / 32 rows at most
    out = np.zeros(MARKS // 32, np.int32)
    out[got.column("w").to_numpy()] = got.column("bits").to_numpy()
    return out


def _verified(sound: DataFrame, pairs: DataFrame, t: float) -> DataFrame:
    """The places (id, no) of the x lines of pairs whose sets of words are similar enough."""
    wanted = pairs.select(F.col("x_id").alias("id"), F.col("x_no").alias("no")).unionByName(pairs.select(F.col("y_id").alias("id"), F.col("y_no").alias("no")))
    marks, at = _sent(sound.sparkSession, _marked(wanted)), _mark("id", "no")
    own = sound.select("id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    own = own.filter(F.call_function("shiftright", F.get(marks, F.shiftright(at, 5).cast("int")), at.bitwiseAND(31).cast("int")).bitwiseAND(1) == 1)
    own = stored(own.select("id", "no", _plain(F.col("line")).alias("line")))
    whole = pairs.join(_side(own, "x", "id", "no", "line"), ["x_id", "x_no"]).join(_side(own, "y", "id", "no", "line"), ["y_id", "y_no"])
    whole = whole.select("x_id", "x_no", *[F.array_remove(F.split(f"{s}_line", " "), "").alias(s) for s in "xy"])
    similar = F.size(F.array_intersect("x", "y")) >= t * F.size(F.array_union("x", "y")) - 1e-9
    return stored(whole.filter(similar).select(F.col("x_id").alias("id"), F.col("x_no").alias("no")).distinct())


def _led(classes: DataFrame, t: float) -> DataFrame:
    """Of each class the likeliest of the LEADERS ones that have one of its leading keys: x and y places. The classes of a key are
    dealt into as many parts, and the earliest of each leads, so that a large group has several leaders to be near to. Keys that
    fewer than OFTEN classes have are left to the join: they give few rows for each class, however large the input is."""
    often = classes.select(F.explode("lead").alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN).select("word")
    posts = stored(_posts(classes, F.lit(0), t, F.col("lead")).join(often, "word", "left_semi"))
    part = F.pmod(F.xxhash64("id", "no"), F.lit(LEADERS)).cast("int")
    leaders = posts.groupBy("word", part.alias("part")).agg(F.min(F.struct(*_POST)).alias("y")).select("word", *[F.col(f"y.{c}").alias(f"y_{c}") for c in _POST])
    led = posts.select("word", *[F.col(c).alias(f"x_{c}") for c in _POST]).join(leaders, "word").filter(_later("x", "y") & _promising(t))
    best = led.groupBy("x_id", "x_no").agg(F.min(F.struct(_differ().alias("differ"), "y_id", "y_no")).alias("y"))
    return best.select("x_id", "x_no", "y.y_id", "y.y_no")


def _joined(classes: DataFrame, settled: DataFrame, t: float) -> DataFrame:
    """All pairs that pass the filters and of which the later class is not settled: places of the later (x) and earlier (y)."""
    own = classes.join(settled.withColumn("settled", F.lit(1)), ["id", "no"], "left")
    posts = _posts(own, F.coalesce("settled", F.lit(0)), t)
    x, y = (_side(posts, s, "word", *_POST) for s in "xy")
    # said across both sides, so that no filter is moved to one of them: they stay alike and share one shuffle
    needed = F.when(F.col("x_meta") < 0, F.lit(False)).otherwise(F.col("y_meta").bitwiseAND(2) != 0)
    shorter = (_size("x") > _size("y")) | ((_size("x") == _size("y")) & _later("x", "y"))
    open_ = F.when(_later("x", "y"), F.col("x_meta")).otherwise(F.col("y_meta")).bitwiseAND(1) == 0
    pairs = x.join(y, (F.col("x_word") == F.col("y_word")) & needed & shorter & _promising(t) & open_)
    places = [F.struct(F.col(f"{s}_id").alias("id"), F.col(f"{s}_no").alias("no")) for s in "xy"]
    pairs = pairs.select(F.greatest(*places).alias("x"), F.least(*places).alias("y"))
    return pairs.select(*[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "xy" for c in ("id", "no")]).distinct()


def _removed(texts: DataFrame, t: float, least: int) -> DataFrame:
    sound = texts.filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    lines = stored(line_sets(sound, rarity(sound.select("text")), t, least))
    firsts = lines.groupBy("k1", "k2").agg(F.min(F.struct("id", "no", "n", "b1", "b2", "prefix", "lead")).alias("s"), F.count("*").alias("copies"))
    firsts = stored(firsts.select("k1", "k2", "copies", "s.*"))
    classes = firsts.filter(F.size("prefix") > 0)  # smaller sets match equal ones only

    # first every class against the earliest ones that have its rarest words: that settles most members of a large group
    early = _verified(sound, stored(_led(classes, t)), t)
    # then the rest
    late = _verified(sound, stored(_joined(classes, early, t)), t)
    near = early.unionByName(late).distinct().select("id", "no", F.lit(True).alias("near"))

    # of a class all but the first place, and that as well if an earlier line is near
    firsts = firsts.join(near, ["id", "no"], "left").filter("near or copies > 1").select("k1", "k2", F.col("id").alias("first_id"), F.col("no").alias("first_no"), F.coalesce("near", F.lit(False)).alias("near"))
    gone = lines.select("id", "no", "k1", "k2").join(firsts, ["k1", "k2"]).filter(F.col("near") | (F.col("id") != F.col("first_id")) | (F.col("no") != F.col("first_no")))
    return gone.groupBy("id").agg(F.collect_set("no").alias("removed"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, least: int = LEAST) -> DataFrame:
    """All rows and columns with the remaining lines as text; and __n_lines, __n_removed."""
    gone = removed_lines(docs, id_col=id_col, text_col=text_col, threshold=threshold, least=least).withColumnRenamed("id", "__line_id").withColumnRenamed("removed", "__line_removed")
    joined = docs.join(gone.hint("merge"), docs[id_col].cast("long") == gone["__line_id"], "left")
    joined = joined.withColumn("__line_all", F.split(F.col(text_col).cast("string"), "\n"))
    lines = F.col("__line_all")  # a column of its own: a lambda would split anew for each line
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__line_removed"))
    kept = F.array_join(F.transform(rest, lambda i: F.get(lines, i)), "\n")
    text = F.when(F.col("__line_removed").isNull(), F.col(text_col)).otherwise(kept)
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long")
    count = F.coalesce(F.size("__line_removed"), F.lit(0))
    return joined.withColumn("__n_lines", n_lines).withColumn("__n_removed", F.when(F.col("__line_removed").isNull(), 0).otherwise(count).cast("long")).withColumn(text_col, text).drop("__line_id", "__line_removed", "__line_all")


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """The documents with their remaining lines; those of which no line remains are gone."""
    out = dedup_lines(docs, **options)
    return out.filter((F.col("__n_removed") == 0) | (F.col("__n_removed") < F.col("__n_lines"))).drop("__n_lines", "__n_removed")


def op2_lines(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS no FROM documents WHERE text IS NOT NULL),
t AS (SELECT *, list_distinct(regexp_extract_all(lower(line), '[^ \\t\\r\\f\\x0B\\n]+')) AS w FROM l),
s AS (SELECT doc_id, no, list_sort(w) AS w, len(w) AS n FROM t WHERE len(w) >= 1),
c AS (SELECT w, n, min({'d': doc_id, 'k': no}) AS spot FROM s GROUP BY w, n),
x AS (SELECT spot, n, unnest(w) AS word FROM c),
f AS (SELECT word, count(*) AS df FROM x GROUP BY word),
r AS (SELECT spot, n, word, row_number() OVER (PARTITION BY spot ORDER BY df, word) AS k FROM x JOIN f USING (word)),
p AS (SELECT spot, n, word FROM r WHERE k <= n - ceil(0.8 * n - 1e-9) + 1),
q AS (SELECT DISTINCT a.spot AS a, b.spot AS b FROM p a JOIN p b ON a.word = b.word AND a.spot > b.spot AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n),
v AS (SELECT DISTINCT a FROM (SELECT a, len(list_intersect(c1.w, c2.w)) AS m, c1.n + c2.n AS total FROM q JOIN c c1 ON c1.spot = q.a JOIN c c2 ON c2.spot = q.b) WHERE m >= 0.8 * (total - m) - 1e-9),
g AS (SELECT s.doc_id, s.no FROM s JOIN c USING (w) LEFT JOIN v ON v.a = c.spot WHERE v.a IS NOT NULL OR c.spot.d <> s.doc_id OR c.spot.k <> s.no),
o AS (SELECT l.doc_id, count(*) AS n_lines, count(g.no) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.no) FILTER (g.no IS NULL), '') AS kept
  FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.no = l.no GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN o USING (doc_id)
"""
