"""URL filters: path rules, and exact list membership by a Bloom filter cascade.

The universe of keys is every distinct host of the table. Level 1 of the
cascade is a Bloom filter of the listed keys; level 2 encodes the universe's
other keys that level 1 lets through, level 3 the listed keys that level 2
lets through, and so on until nothing passes wrongly. A key is judged by the
first level that rejects it, which is exact for every key of the universe, so
the table is filtered by an expression, without a join. All of it is DataFrame
functions; a level reaches the driver as its words. Where one cascade would
take more words than an expression should hold, keys and pages are dealt into
blocks by their host's hash, each with a cascade of its own, one after the other.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with
A-Z lower-cased; path: from there up to ``?``, ``#`` or the end.

Defined results: a null url, or one without ``://``, has an empty host and
path, fits no rule and is not listed; repeated rows are judged one by one; an
empty table gives no level, and nothing is listed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.textkit import cut

#: Fixed values: (rule's host, rule's path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: The list: domains that are blocked with all their subdomains.
LISTED = tuple(f"{name}.example.{top}" for name in ("adult-x", "casino-win", "cheap-pills", "free-bets") for top in ("com", "net", "org"))
#: Words of 64 bits, about, of a block's largest level, which its expression holds.
BLOCK_WORDS = 1 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its bits as words of 64, and how many hashes a key has."""

    number: int
    words: tuple[int, ...]
    hashes: int

    @property
    def bits(self) -> int:
        return 64 * len(self.words)


def positions(key: Column, number: int, hashes: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(number), F.lit(j)), F.lit(bits).cast("long")) for j in range(hashes)]


def word_of(position: Column) -> Column:
    return F.shiftrightunsigned(position, 6)


def passes(key: Column, level: Level) -> Column:
    """Whether a level's filter lets a key through."""
    words = F.split(F.lit(",".join(map(str, level.words))), ",").cast("array<bigint>")
    out = F.lit(True)
    for at in positions(key, level.number, level.hashes, level.bits):
        out &= F.getbit(F.get(words, word_of(at).cast("int")), at.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1
    return out


def words_for(many: float, rate: float) -> int:
    """Words of a filter of many keys, of the false-positive rate given."""
    return max(1, math.ceil(-many * math.log(rate) / math.log(2) ** 2 / 64))


def first_rate(listed: int, others: int) -> float:
    """Level 1's false-positive rate; later levels have a half."""
    return min(0.5, max(1e-6, math.sqrt(0.5) * listed / max(others, 1)))


def build_level(keys: DataFrame, number: int, many: int, rate: float) -> Level:
    """The filter of keys (a column key), of the false-positive rate given."""
    words = words_for(many, rate)
    hashes = max(1, round(64 * words / many * math.log(2)))
    at = F.explode(F.array(*positions(F.col("key"), number, hashes, 64 * words))).alias("at")
    rows = keys.select(at).groupBy(word_of(F.col("at")).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).collect()
    held = [0] * words
    for r in rows:
        held[r["word"]] = r["bits"]
    return Level(number, tuple(held), hashes)


def tally(universe: DataFrame) -> tuple[int, int]:
    """How many keys are listed, and how many aren't."""
    counts = {r["listed"]: r["n"] for r in universe.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    return counts.get(True, 0), counts.get(False, 0)


def build_cascade(universe: DataFrame, counts: tuple[int, int] | None = None) -> list[Level]:
    """Levels over the whole universe of (key, listed): alternately those that are listed and those that aren't."""
    listed, others = counts or tally(universe)
    levels: list[Level] = []
    rate, inside, outside, many = first_rate(listed, others), universe.where("listed"), universe.where("not listed"), listed
    while many:
        levels.append(build_level(inside.select("key"), len(levels) + 1, many, rate))
        inside, outside = outside.where(passes(F.col("key"), levels[-1])), inside
        many, rate = inside.count(), 0.5
    return levels


def is_listed(key: Column, levels: Sequence[Level]) -> Column:
    """Exact membership of a key of the universe."""
    out = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        out = F.when(~passes(key, level), F.lit(level.number % 2 == 0)).otherwise(out)
    return out


def parents(host: Column) -> Column:
    """A host and all domains above it."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def key_universe(hosts: DataFrame, listed: Sequence[str]) -> DataFrame:
    """(key, listed) of every distinct host."""
    spark = hosts.sparkSession
    keys = hosts.select(F.col("host").alias("key")).distinct()
    names = spark.createDataFrame([(d,) for d in sorted(set(listed))], "domain string")
    above = keys.select("key", F.explode(parents(F.col("key"))).alias("domain"))
    hit = above.join(names, "domain").select("key").distinct().withColumn("listed", F.lit(True))
    return keys.join(hit, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))


def rule_fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[0]) | F.endswith(host, F.lit("." + rule[0]))) & F.startswith(path, F.lit(rule[1]))


def filter_urls(pages: DataFrame, listed: Sequence[str] = LISTED, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: host, path, the longest rule that fits, and the verdict: the rule's, else block for a listed host."""
    split = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    universe = cut(key_universe(split, listed), pages.count())
    counts = tally(universe)
    rate = first_rate(*counts)
    blocks = -(-max(words_for(counts[0], rate), words_for(counts[1] * rate, 0.5)) // BLOCK_WORDS)
    if blocks == 1:
        return judged(split, build_cascade(universe, counts), rules)
    out = None
    for k in range(blocks):
        own = lambda key: F.pmod(F.xxhash64(key, F.lit(0)), F.lit(blocks)) == k  # noqa: B023, E731
        part = cut(judged(split.where(own("host")), build_cascade(universe.where(own("key"))), rules))
        out = part if out is None else out.unionByName(part)
    return out


def judged(split: DataFrame, levels: Sequence[Level], rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rows of (page_id, host, path) with rule, verdict and membership."""
    host, path = F.col("host"), F.col("path")
    member = is_listed(host, levels)
    rule, verdict = F.lit(None).cast("string"), F.when(member, F.lit("block")).otherwise(F.lit("allow"))
    for own in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = rule_fits(host, path, own)
        rule, verdict = F.when(fits, F.lit(own[0] + own[1])).otherwise(rule), F.when(fits, F.lit(own[2])).otherwise(verdict)
    return split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), member.alias("listed"))
