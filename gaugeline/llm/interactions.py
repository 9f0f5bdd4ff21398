"""Filter interaction audit: what each of five filters removes, in every order in which they can be applied.

Each document gets a mask of the filters that it fails. Documents of a part (a value of `source`) and a mask are one cell;
32 cells at most are all that the orders need, so texts are read once and a part's orders are worked out from its cells.
The orders are visited by adjacent transpositions: each differs from the one before by a swap of two neighbours, and only
the two steps concerned are computed anew. A filter's Shapley value is gathered along the walk.

Filters: A fewer than 200 words; B fewer than half of the words are distinct; C more than 2 in 100 characters are of A to Z;
D one of `#$%&*|` is there; E the text is identical to that of a smaller id (by SHA-256), wherever that is.

Null texts are empty: they fail A, and E where a smaller id's is null or empty too. Null parts are the empty part. Rows with
a null id fail no E. Rows that repeat the smallest id of a text don't fail E either; each row is counted. An id that has
several labels is good or toxic if one of them says so. An empty table gives no row. Columns other than those named are not
read, and no column of the result can meet one of the input's.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, table

FILTERS = "ABCDE"
_SPACE = "[\\x20\\x09-\\x0D]+"
_CELLS = 1 << len(FILTERS)


def failures(text: Column, words: Column) -> list[Column]:
    """The conditions A to D of a text and its words."""
    n, capitals = F.size(words), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 2 * F.length(text), text.rlike("[#$%&*|]")]


def cells(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: how many documents of a part fail exactly the filters of a mask (A is its lowest bit)."""
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = text.withColumn("words", F.filter(F.split("text", _SPACE), lambda w: w != ""))
    bits = lambda conditions: sum((F.when(c, 1 << k).otherwise(0) for k, c in conditions), F.lit(0))
    own = [*enumerate(failures(F.col("text"), F.col("words")))]
    # a few dozen bytes for each document: from here on no text is moved
    rows = stored(words.select("id", "part", bits(own).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")))
    said = labels.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # a text's copies are added up before they meet, by what is said of them: a hot text is a few rows of each task
    each = rows.join(said, "id", "left").groupBy("digest", "id", "part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    some = each.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"))
    smallest = F.min("first.id").over(W.partitionBy("digest"))
    own_first = F.when(F.col("first.id") == smallest, F.col("first.n")).otherwise(0)
    split = some.withColumn("sound", F.coalesce(own_first, F.lit(0)) + F.col("unnamed"))
    both = F.array(F.struct(F.col("sound").alias("n"), F.lit(0).alias("copy")), F.struct((F.col("n") - F.col("sound")).alias("n"), F.lit(1 << len(own)).alias("copy")))
    cell = split.select("part", "mask", "good", "toxic", F.explode(both).alias("x")).filter("x.n > 0").select("part", (F.col("mask") + F.col("x.copy")).alias("mask"), F.col("x.n").alias("n"), "good", "toxic")
    marked = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0))
    return cell.groupBy("part", "mask").agg(F.sum("n").alias("n"), marked("good").alias("good"), marked("toxic").alias("toxic"))


def swaps(n: int):
    """The places (k, k + 1) whose swaps lead through all orders of n things, each once: the largest thing that can still move
    on in its direction moves, and those larger than it turn round."""
    order, way = list(range(n)), [-1] * n
    while True:
        able = [x for x in range(n) if 0 <= (to := order.index(x) + way[x]) < n and order[to] < x]
        if not able:
            return
        x = max(able)
        k = order.index(x)
        to = k + way[x]
        order[k], order[to] = order[to], order[k]
        for y in range(x + 1, n):
            way[y] = -way[y]
        yield min(k, to)


def walk(counts: np.ndarray) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique, good, toxic, shapley) of all orders; counts: n, good, toxic by mask."""
    m, masks = len(FILTERS), np.arange(_CELLS)
    fails = [(masks >> f & 1).astype(bool) for f in range(m)]
    total, whole = counts.sum(0)[0], [int(counts[fails[f], 0].sum()) for f in range(m)]
    alone = [int(counts[1 << f, 0]) for f in range(m)]
    order, shapley, rows = list(range(m)), [0] * m, []

    def removed(k: int) -> np.ndarray:
        """What the filter at step k removes: cells that fail it and none before it."""
        before = sum(1 << f for f in order[:k])
        return counts[fails[order[k]] & (masks & before == 0)].sum(0)

    steps = [removed(k) for k in range(m)]

    def visit() -> None:
        left = total
        for k, f in enumerate(order):
            gone, good, toxic = (int(x) for x in steps[k])
            left -= gone
            shapley[f] += gone
            rows.append(("".join(FILTERS[x] for x in order), k + 1, int(left), gone, whole[f] - gone, alone[f], good, toxic, f))

    visit()
    for k in swaps(m):
        order[k], order[k + 1] = order[k + 1], order[k]
        steps[k], steps[k + 1] = removed(k), removed(k + 1)
        visit()
    return [(*row[:-1], shapley[row[-1]]) for row in rows]


_SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(found: DataFrame) -> DataFrame:
    """One row for each part, order and step, from cells."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((_CELLS, 3), np.int64)
        counts[frame["mask"]] = frame[["n", "good", "toxic"]]
        return pd.DataFrame([(frame["part"].iloc[0], *row) for row in walk(counts)], columns=[c.split()[0] for c in _SCHEMA.split(", ")])

    # a part has 32 rows at most
    return found.groupBy("part").applyInPandas(run, _SCHEMA)


def op12_interactions(spark, sf_dir: str) -> DataFrame:
    return audit(cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda v: v <> '') AS w FROM documents),
l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x), regexp_matches(x, '[#$%&*|]'),
  doc_id > min(doc_id) OVER (PARTITION BY x)] AS f, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM t LEFT JOIN l USING (doc_id)),
c AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, f),
i AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
p AS (SELECT part, n, good, toxic, f, o, coalesce(list_position(list_transform(o, lambda k: f[k]), true), 6) AS gone FROM c, o),
s AS (SELECT part, array_to_string(list_transform(o, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, i AS step, substr('ABCDE', o[i], 1) AS filter,
  sum(CASE WHEN gone > i THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = i THEN n ELSE 0 END) AS removed, sum(CASE WHEN f[o[i]] AND gone < i THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN f[o[i]] AND len(list_filter(f, lambda v: v)) = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN gone = i THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = i THEN toxic ELSE 0 END) AS toxic_lost
  FROM p, i GROUP BY part, o, i)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM s
"""
