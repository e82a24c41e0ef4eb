"""URL filters: block and allow rules in cascades of Bloom filters that are exact over all keys of the corpus. Native:
DataFrame functions only."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from math import ceil, log, log2, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import ascii_lower, checkpointed, unwrapped, wrapped

MADE = ("host", "path", "rule", "verdict")
#: Rules of a cascade; longer lists are cut by hash into several, each with a pass over the urls of its own. At 64 bits a
#: rule and level, and levels that halve, a cascade takes 16 MB at most.
RULES = 1 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first :// up to a slash, question mark, number sign or the end, A-Z lower-cased; and what follows that
    up to a question mark, number sign or the end. Both empty without a ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


@dataclass
class Level:
    """A Bloom filter: its number in the cascade, bits in words of 64, and how many bits a key sets."""

    number: int
    words: list[int]
    hashes: int

    def place(self, key: Column, k: Column) -> Column:
        """Of the k-th bit of a key: a hash of its own, as two hashes added up would repeat in a short filter."""
        return F.pmod(F.xxhash64(F.lit(self.number), k, key), F.lit(64 * len(self.words)))

    def has(self, key: Column) -> Column:
        words = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")  # a constant, folded once

        def bit(k: Column) -> Column:
            place = self.place(key, k)
            return F.getbit(F.get(words, F.call_function("div", place, F.lit(64)).cast("int")), (place % 64).cast("int")) == 1

        return F.forall(F.sequence(F.lit(0), F.lit(self.hashes - 1)), bit)


def _level(keys: DataFrame, n: int, number: int, share: float) -> Level:
    """The filter of n keys that takes `share` of all others for one of them. Its bits, set by Spark, are what is collected."""
    hashes = max(1, ceil(-log2(share)))
    level = Level(number, [0] * max(1, ceil(n * -log(share) / log(2) ** 2 / 64)), hashes)
    place = level.place(F.col("key"), F.col("k"))
    bits = keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(hashes - 1))).alias("k"))
    bits = bits.select(F.call_function("div", place, F.lit(64)).alias("word"), (place % 64).cast("int").alias("bit"))
    for r in bits.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits")).collect():
        level.words[r["word"]] = r["bits"]
    return level


def cascade(listed: DataFrame, universe: DataFrame, n_universe: int) -> list[Level]:
    """Filters that tell listed keys from all others of the universe (both: key; repeats do no harm).

    The first holds the listed keys, the second those other keys that the first takes for listed, the third those listed
    ones that the second has, and so on until none is left. The first lets so few others through that about as many are
    left as are listed, the rest half: so the size hangs on the list, and on the universe by its logarithm alone.
    """
    inside, outside = checkpointed(listed.select("key").distinct()), None
    n, levels = inside.count(), []
    share = min(0.5, n / sqrt(2) / max(1, n_universe))
    while n:
        level = _level(inside, n, len(levels), share if outside is None else 0.5)
        levels.append(level)
        if outside is None:
            passed = universe.where(level.has(F.col("key"))).select("key", F.lit(0).alias("own"))
            passed = passed.unionByName(inside.select("key", F.lit(1).alias("own"))).groupBy("key").agg(F.max("own").alias("own"))
            fresh = passed.where("own = 0").select("key")
        else:
            fresh = outside.where(level.has(F.col("key")))
        inside, outside = checkpointed(fresh), inside
        n = inside.count()
    return levels


def member(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed: the first filter that lacks it tells, or the last."""
    out = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        out = F.when(level.has(key), out).otherwise(F.lit(level.number % 2 == 1))
    return out


def url_filter(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", most: int = RULES) -> DataFrame:
    """Adds host, path, rule and verdict to pages (`url` is read, all columns stay; such with those names, in any case, are
    replaced). rules: host, path, action (block or allow).

    A rule fits its host and all subdomains if the url's path starts with the rule's; the longest wins, counted in
    characters of host and path together, of several as long the one with more labels. rule is its host and path, null
    where none fits; verdict its action, or `otherwise`: a url without a listed key. Null urls, and those without ://,
    have an empty host and path. A rule listed both ways blocks. Hosts of rules are lower-cased (A-Z); rules with a null,
    with a slash, question or number sign in the host, or a path that is not empty and doesn't begin with a slash, fit no
    url, nor do unknown actions. Repeated rules and pages do no harm, an empty list leaves `otherwise`, no pages no rows.

    A url's keys are its host's last labels with its path's first characters, for each number of labels and characters
    that some rule has. They are looked up in constants, so pages are neither shuffled nor joined: see cascade. Keys of
    the corpus are counted in one pass; a second finds those few that the first filter takes for listed, and these alone
    are shuffled.
    """
    host, path = host_and_path(F.col("url"))
    rows = wrapped(pages, MADE, url="string").select("row", host.alias("host"), path.alias("path")).withColumn("best", F.lit(None).cast("struct<n:int,labels:int,key:string,verdict:string>"))
    fit = F.col("action").isin("block", "allow") & ~F.col("host").rlike("[/?#]") & ((F.col("path") == "") | F.startswith("path", F.lit("/")))
    given = rules.select(ascii_lower(F.col("host")).alias("host"), "path", "action").where(fit)
    given = checkpointed(given.select(F.concat("host", "path").alias("key"), _labels(F.col("host")).alias("labels"), F.length("path").alias("chars"), "action").distinct())
    shards = max(1, -(-given.count() // most))
    for shard in range(shards):
        own = F.pmod(F.xxhash64("key"), F.lit(shards)) == shard
        some = given.where(own)
        shapes = sorted((r["labels"], r["chars"]) for r in some.select("labels", "chars").distinct().collect())
        if not shapes:
            continue
        keys = _keys(shapes)
        universe = rows.select(F.explode(keys).alias("k")).select("k.key").where(own)
        n = universe.count()
        blocked, allowed = (cascade(some.where(F.col("action") == a), universe, n) for a in ("block", "allow"))
        found = F.array_max(F.filter(F.transform(keys, _judge(blocked, allowed, shards, shard)), lambda k: k["verdict"].isNotNull()))
        rows = rows.withColumn("best", F.array_max(F.array("best", found)))
        if shard + 1 < shards:
            rows = checkpointed(rows)
    return unwrapped(rows.select("row", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict")), pages, MADE)


def _judge(blocked: list[Level], allowed: list[Level], shards: int, shard: int) -> Callable[[Column], Column]:
    """A key of this shard with its action, if it is listed."""

    def judged(k: Column) -> Column:
        action = F.when(member(blocked, k["key"]), "block").when(member(allowed, k["key"]), "allow")
        mine = F.pmod(F.xxhash64(k["key"]), F.lit(shards)) == shard
        return F.struct(k["n"].alias("n"), k["labels"].alias("labels"), k["key"].alias("key"), (F.when(mine, action) if shards > 1 else action).alias("verdict"))

    return judged


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _keys(shapes: list[tuple[int, int]]) -> Column:
    """The keys of a row's host and path in the shapes of rules, as structs: n (characters), labels, key."""
    kinds = F.from_json(F.lit(json.dumps([{"labels": d, "chars": n} for d, n in shapes])), "array<struct<labels:int,chars:int>>")
    here = F.filter(kinds, lambda s: (s["labels"] <= _labels(F.col("host"))) & (s["chars"] <= F.length("path")))

    def key(s: Column) -> Column:
        made = F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"]), F.left(F.col("path"), s["chars"]))
        return F.struct(F.length(made).alias("n"), s["labels"].alias("labels"), made.alias("key"))

    return F.transform(here, key)
