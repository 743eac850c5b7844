"""Allow and block rules over page urls, answered by Bloom filter cascades."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkshard.llm.common import ascii_lower, saved

BITS_PER_KEY, HASHES = 10, 7
#: A cascade is part of the plan; rule lists beyond this many bits (26 million keys) are refused.
MAX_BITS = 1 << 28
_WORD = 32


def host_and_path(url: Column) -> Column:
    """``struct(host, path)``: both empty for a null or an url without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.struct(ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)).alias("host"), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1).alias("path"))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``bits`` in words of 32."""

    seed: int
    bits: int
    words: tuple[int, ...]

    @staticmethod
    def positions(key: Column, seed: int, bits: int) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(seed * HASHES + i), key), F.lit(bits)) for i in range(HASHES)]

    @classmethod
    def of(cls, keys: DataFrame, n: int, seed: int) -> Level:
        """The filter of ``n`` keys; what comes to the driver is the filter, at most ``MAX_BITS``."""
        bits = max(1024, 1 << math.ceil(math.log2(n * BITS_PER_KEY)))
        if bits > MAX_BITS:
            raise ValueError(f"{n} keys need a filter of {bits} bits; split the rule list")
        at = keys.select(F.explode(F.array(*cls.positions(F.col("key"), seed, bits))).alias("at"))
        word = at.groupBy(F.floor(F.col("at") / _WORD).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % _WORD).cast("int"))).alias("bits"))
        words = [0] * (bits // _WORD)
        for r in word.collect():
            words[r["word"]] = r["bits"]
        return cls(seed, bits, tuple(words))

    def might_hold(self, key: Column) -> Column:
        words = F.expr("array(" + ",".join(f"{w}L" for w in self.words) + ")")
        at = F.array(*self.positions(key, self.seed, self.bits))
        return F.forall(at, lambda p: F.getbit(F.get(words, F.floor(p / _WORD).cast("int")), (p % _WORD).cast("int")) == 1)


@dataclass(frozen=True)
class Cascade:
    """Levels that in turn encode the listed keys and the keys the level before let through wrongly."""

    levels: tuple[Level, ...]

    @classmethod
    def of(cls, listed: DataFrame, universe: DataFrame, seed: int = 0) -> Cascade:
        """Exact over ``universe`` and the listed keys; both have a column ``key``.

        The universe is only shuffled as far as the first level lets it through.
        """
        held, others = saved(listed.select("key").distinct()), universe.select("key")
        levels: list[Level] = []
        while n := held.count():
            level = Level.of(held, n, seed + len(levels))
            others = others.filter(level.might_hold(F.col("key")))
            if not levels:
                others = others.join(held, "key", "left_anti").distinct()
            levels.append(level)
            held, others = saved(others), held
        return cls(tuple(levels))

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed: the parity of the first level that rejects it."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            answer = F.when(self.levels[i].might_hold(key), answer).otherwise(F.lit(i % 2 == 1))
        return answer


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` of each ``url``.

    ``rules`` has ``host, path, verdict`` (allow or block; where one rule is listed with both, block
    holds).  A rule fits its host and all its subdomains where the url's path starts with the
    rule's path; of the rules that fit the longest wins.  ``rule`` is its host and path in one
    string, null where none fits; ``verdict`` then is ``default``.

    The keys a url can match are its host's endings with as many labels as rules have, each with the
    beginnings of its path that are as long as rules have.  All keys of the corpus are the
    universe of a cascade over the rules, so membership is exact and the pages meet the
    rules without a join; a second cascade, over the rules, says which ones block.

    A null url, or one without ``://``, has an empty host and path and fits no rule with a
    host.  Rules with a null host or path are ignored; an empty list leaves the default.
    Columns of pages that bear the names of new ones are replaced, all others kept.  Only the url
    column is used: the operator also serves links ``(doc_id, url)`` taken from documents.
    """
    rules = saved(rules.filter("host IS NOT NULL AND path IS NOT NULL").select("host", "path", (F.col("verdict") == "block").alias("blocks")))
    shapes = rules.select(F.size(F.split("host", "\\.", -1)).alias("labels"), F.char_length("path").alias("length")).distinct().collect()
    place = host_and_path(F.col("url"))
    parts = F.split(place["host"], "\\.", -1)

    wanted = ", ".join(f"named_struct('labels', {r['labels']}, 'length', {r['length']})" for r in sorted(shapes))
    wanted = F.expr(f"array({wanted})") if shapes else F.array().cast("array<struct<labels:int,length:int>>")
    fitting = F.filter(wanted, lambda s: (F.size(parts) >= s["labels"]) & (F.char_length(place["path"]) >= s["length"]))
    keys = F.transform(fitting, lambda s: F.concat(F.array_join(F.slice(parts, -s["labels"], s["labels"]), "."), F.substring(place["path"], F.lit(1), s["length"])))
    keyed = rules.select(F.concat("host", "path").alias("key"), "blocks")
    cascade = Cascade.of(keyed, pages.select(F.explode(keys).alias("key")))
    blocking = Cascade.of(keyed.filter("blocks"), keyed, seed=1000)

    listed = F.filter(keys, cascade.holds)
    rule = F.array_max(F.transform(listed, lambda k: F.struct(F.char_length(k).alias("length"), k.alias("key"))))["key"]
    verdict = F.when(F.col("rule").isNull(), default).when(blocking.holds(F.col("rule")), "block").otherwise("allow")
    return pages.withColumns({"host": place["host"], "path": place["path"], "rule": rule}).withColumn("verdict", verdict)
