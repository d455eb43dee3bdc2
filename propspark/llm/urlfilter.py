"""URL filtering by Bloom filter cascades, with DataFrame operations only.

A URL's candidate keys are its host's suffixes joined to prefixes of its path. A cascade encodes the listed keys in its
first filter, the corpus's other keys that this filter wrongly accepts in the second, the listed keys that the second
wrongly accepts in the third, and so on until none is left. Over the corpus's own keys its answers are then exact, so
pages are judged by bit tests against small literals, without a join.

Defined results: a null URL or one without "://" has an empty host and path and is allowed, unless a rule or the list
says otherwise; repeated URLs and page ids each get a row; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from propspark.llm.common import ascii_lower, stored

# One level's filter may take this many bits (8 MB in the plan). More listed keys than that allows raise an error.
MAX_BITS = 1 << 26


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def candidate_keys(host: Column, path: Column, labels: int, lengths: Sequence[int]) -> Column:
    """Host suffixes of at most ``labels`` labels, each with the path's prefixes of the given lengths. Longer suffixes and
    other lengths cannot be listed, as no listed key has them."""
    parts = F.split(host, "\\.")
    sizes = F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels)))
    suffixes = F.transform(sizes, lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]),
                        lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


class Cascade:
    """Exact membership in a set of listed keys for every key of a universe."""

    def __init__(self, levels: list[tuple[bytes, int, int]]):
        self.levels = levels  # bits, number of bits, number of hashes

    def _in_level(self, key: Column, level: int) -> Column:
        data, bits, hashes = self.levels[level]
        found = F.lit(True)
        for i in range(hashes):
            at = F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits))
            byte = F.conv(F.hex(F.substring(F.lit(data), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
            found = found & (F.getbit(byte, (at % 8).cast("int")) == 1)
        return found

    def contains(self, key: Column) -> Column:
        """The first level that lacks the key decides: an even one (counted from 0) says no, an odd one yes."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            answer = F.when(~self._in_level(key, level), F.lit(level % 2 == 1)).otherwise(answer)
        return answer

    @classmethod
    def build(cls, universe: DataFrame, listed: DataFrame) -> Cascade:
        """``universe`` and ``listed`` have a column key, the universe without repeats. Only listed keys that the
        universe has are encoded."""
        keys = stored(universe.select("key").join(listed.select("key").distinct().withColumn("listed", F.lit(True)), "key", "left")
                      .select("key", F.coalesce("listed", F.lit(False)).alias("listed")))
        sides = [keys.where("listed"), keys.where("not listed")]
        sizes = [s.count() for s in sides]
        made = cls([])
        while sizes[0] and (sizes[1] or not made.levels):
            share = min(0.5, math.sqrt(0.5) * sizes[0] / max(1, sizes[1])) if not made.levels else 0.5
            hashes = max(1, round(-math.log2(share)))
            bits = max(64, math.ceil(sizes[0] * hashes / math.log(2) / 8) * 8)
            if bits > MAX_BITS:
                raise ValueError(f"{sizes[0]} keys need a filter of {bits} bits, more than MAX_BITS")
            level = len(made.levels)
            places = sides[0].select(F.explode(F.array(*[
                F.pmod(F.xxhash64("key", F.lit(level), F.lit(i)), F.lit(bits)) for i in range(hashes)])).alias("at"))
            data = bytearray(bits // 8)
            words = places.groupBy(F.floor(F.col("at") / 32).alias("word")).agg(
                F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("ones"))
            for row in words.collect():  # at most bits / 32 rows
                for k, byte in enumerate(row["ones"].to_bytes(4, "little")):
                    if byte:
                        data[row["word"] * 4 + k] = byte
            made.levels.append((bytes(data), bits, hashes))
            wrong = sides[1].where(made._in_level(F.col("key"), level))
            sides, sizes = [wrong, sides[0]], [wrong.count(), sizes[0]]
        return made


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], blocked: Sequence[str] = ()) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    ``rules`` are (verdict, host, path prefix); a rule fits its host and all subdomains, the longest rule string that
    fits wins. ``blocked`` are hosts whose pages, subdomains included, are blocked where no rule fits; all others are
    allowed. Both lists are bounded by ``MAX_BITS``.
    """
    spark = pages.sparkSession
    listed = {host + path: verdict for verdict, host, path in rules}
    lengths = sorted({len(path) for _, _, path in rules} | {0})
    labels = max([host.count(".") + 1 for host in [*(r[1] for r in rules), *blocked]], default=1)
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = parts.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    keyed = parts.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), labels, lengths))
    universe = stored(keyed.select(F.explode("keys").alias("key")).distinct())

    def cascade(keys: Sequence[str]) -> Cascade:
        return Cascade.build(universe, spark.createDataFrame([(k,) for k in keys], "key string"))

    allow = cascade([k for k, v in listed.items() if v == "allow"])
    block = cascade([k for k, v in listed.items() if v != "allow"])
    hosts = cascade(list(blocked))
    rules_only = F.filter("keys", lambda k: k.contains("/") & (allow.contains(k) | block.contains(k)))
    longest = F.array_max(F.transform(rules_only, lambda k: F.struct(F.length(k).alias("n"), k.alias("rule"))))["rule"]
    ruled = keyed.withColumn("rule", longest)
    verdict = (F.when(F.col("rule").isNotNull(), F.when(allow.contains(F.col("rule")), "allow").otherwise("block"))
               .when(F.exists("keys", lambda k: ~k.contains("/") & hosts.contains(k)), "block").otherwise("allow"))
    return ruled.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
