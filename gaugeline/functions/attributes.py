"""Attribute bags: arrays of (key, value) in the order in which they were sent.

Keys are looked up in the keys and values of a bag, taken apart once for each row (`index`); the functions that take `attrs`
take that."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import trim_space

BAG = "array<struct<key:string,value:string>>"
_DECIMAL = "^[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def flatten(kv: Column) -> Column:
    """A bag of strings from typed values (string, bool, int, double; the first that is set)."""
    value = lambda v: F.coalesce(v["stringValue"], v["boolValue"].cast("string"), v["intValue"].cast("string"), _number_text(v["doubleValue"]))
    pairs = F.transform(F.coalesce(kv, F.array().cast("array<struct<key:string,value:struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double>>>")), lambda x: F.struct(x["key"].alias("key"), value(x["value"]).alias("value")))
    return F.filter(pairs, lambda x: x["key"].isNotNull() & x["value"].isNotNull())


def _number_text(c: Column) -> Column:
    """A double as ECMAScript writes it, where it is a whole number of common size."""
    return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("decimal(20,0)").cast("string")).otherwise(c.cast("string"))


def _let(value: Column, body) -> Column:
    """`body` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _once(bag: Column, repeated) -> Column:
    """The bag itself if no key is repeated in it, which is seen in linear time; else `repeated` of it."""
    keys = bag["key"]
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), bag).otherwise(repeated(bag))


def lookup(bag: Column) -> Column:
    """A map of the bag; of repeated keys the last counts. Entries without a key are left out."""
    last = lambda own: F.filter(own, lambda x, i: ~F.exists(F.slice(own, i + 2, F.size(own)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(_let(F.filter(bag, lambda x: x["key"].isNotNull()), lambda own: _once(own, last)))


def index(bag: Column) -> Column:
    """Keys and values of the bag, the last first. Unlike a map it takes no look at each entry, so that it is compiled."""
    own = F.reverse(bag)
    return F.when(bag.isNotNull(), F.struct(own["key"].alias("keys"), own["value"].alias("values")))


def with_lookup(df: DataFrame, **bags: Column) -> DataFrame:
    """Adds what is looked up in of bags under these names. Each comes out of a generator of one row, which nothing is moved
    across: it is made once however many keys are looked up behind it, and in whatever filters."""
    for name, bag in bags.items():
        df = df.select("*", F.explode(F.array(index(bag))).alias(name))
    return df


def get(attrs: Column, key: str) -> Column:
    """The value of a key, null if absent; of repeated keys the last counts."""
    return F.get(attrs["values"], (F.array_position(attrs["keys"], key) - 1).cast("int"))


def first_string(attrs: Column, *keys: str) -> Column:
    """The first value that is there and not empty."""
    return F.coalesce(*[F.nullif(get(attrs, k), F.lit("")) for k in keys])


def to_number(raw: Column) -> Column:
    """As ECMAScript's Number reads a string, null unless finite: blank is 0; 0x, 0o and 0b are read, signs before them aren't."""
    s = trim_space(raw)
    other = lambda digits, base: F.when(s.rlike(f"^0[{digits[0]}][{digits[1]}]+$"), F.conv(F.substring(s, 3, 64), base, 10).cast("double"))
    plain = F.when(s.rlike(_DECIMAL), s.try_cast("double"))
    n = F.when(s == "", F.lit(0.0)).otherwise(F.coalesce(plain, other(("xX", "0-9a-fA-F"), 16), other(("oO", "0-7"), 8), other(("bB", "01"), 2)))
    return F.when(F.abs(n) < float("inf"), n)


def first_number(attrs: Column, *keys: str) -> Column:
    """The first value that reads as a finite number. Each is read in a lambda: its expression stands in a plan once."""
    return F.get(F.filter(F.transform(F.array(*[get(attrs, k) for k in keys]), to_number), lambda n: n.isNotNull()), F.lit(0))


def subset(bag: Column, prefixes: tuple[str, ...], longest: int = 500, total: int | None = 4000) -> Column:
    """JSON of the attributes with these prefixes, in order, values cut with an ellipsis, up to the first that would exceed the
    total (None: all of them).

    A repeated key stands where it came first, with the value that came last. Attributes without a value are left out.
    """
    def last(own: Column) -> Column:
        value = lambda key: F.element_at(F.filter(own, lambda y: y["key"] == key), -1)["value"]
        return F.transform(F.array_distinct(own["key"]), lambda key: F.struct(key.alias("key"), value(key).alias("value")))

    def short(own: Column) -> Column:
        cut = lambda v: F.when(F.char_length(v) > longest, F.concat(F.substring(v, 1, longest), F.lit("…"))).otherwise(v)
        return F.transform(own, lambda x: F.struct(x["key"].alias("key"), cut(x["value"]).alias("value")))

    def fitting(own: Column) -> Column:
        def step(acc, x):
            size = acc["size"] + F.char_length(x["key"]) + F.char_length(x["value"])
            return F.struct(size.alias("size"), F.when(size > total, acc["n"]).otherwise(acc["n"] + 1).alias("n"))

        # sizes only grow: none fits behind the first that doesn't
        return F.slice(own, 1, F.aggregate(own, F.struct(F.lit(0).alias("size"), F.lit(0).alias("n")), step, lambda acc: acc["n"]))

    pattern = "^(?:" + "|".join(re.escape(p) for p in prefixes) + ")"
    named = F.filter(bag, lambda x: x["value"].isNotNull() & x["key"].rlike(pattern))
    # where no key of the whole bag is repeated, none of the named is, and nothing has to be kept by name to see it
    once = F.size(F.array_distinct(bag["key"])) == F.size(bag)
    own = F.when(once, short(named)).otherwise(short(_let(named, lambda n: _once(n, last))))
    return F.to_json(F.map_from_entries(own if total is None else _let(own, fitting)))
