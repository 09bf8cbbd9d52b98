"""URL filter: exact rule lookup with Bloom filter cascades, in DataFrame functions only.

A rule is a key ``host + path`` with a verdict. For a url, the keys that could be listed are its host
suffixes joined with its path prefixes, for the (labels, path length) shapes that occur in the rules.
A cascade answers exactly, for every such key of the corpus, whether it is listed: level 1 encodes the
listed keys, level 2 the unlisted keys of the corpus that level 1 lets through, level 3 the listed keys
that level 2 lets through, and so on until no false positive is left. Judging then needs no join and no
shuffle: the levels are literals of the plan.

Size: level 1 takes about 1.44 * log2(universe / rules) bits a rule, all further levels about 3 bits a rule;
``MAX_WORDS`` bounds a level. ``judge_urls`` takes larger rule sets by an equi-join on the keys instead. Very long
urls are judged whole.

Edge cases: a null url or one without ``://`` has an empty host and path, no rule fits it, and its verdict is
the default. A key listed with both verdicts is blocked. Of equally long fitting rules the one with more host
labels wins. An empty rule table gives the default everywhere. Input columns named host, path, rule or verdict
are replaced. Repeated rows are judged alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: 64-bit words in one level (512 KB as a literal), shapes in a rule set, levels in a cascade.
MAX_WORDS, MAX_SHAPES, MAX_LEVELS = 65536, 512, 64


class TooLarge(ValueError):
    """A rule set is over the bounds of a cascade."""


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://``; host up to ``/ ? #`` with A-Z lower-cased, path up to ``? #``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(raw, UPPER, LOWER), F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)


def _with_parts(pages: DataFrame, url: str) -> DataFrame:
    host, path = url_parts(F.col(url))
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    return pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"))


def _rule_keys(rules: DataFrame) -> DataFrame:
    """One row per key: key, labels, path_len, blocked (block wins over allow)."""
    path = F.coalesce(F.col("path"), F.lit(""))
    host = F.translate(F.coalesce(F.col("host"), F.lit("")), UPPER, LOWER)
    return (
        rules.select(F.concat(host, path).alias("key"), F.size(F.split(host, r"\.")).alias("labels"), F.length(path).alias("path_len"), (F.col("verdict") == "block").alias("blocked"))
        .groupBy("key", "labels", "path_len").agg(F.max("blocked").alias("blocked"))
    )


def _candidates(shapes: list[tuple[int, int]]) -> Column:
    """Array of struct(len, labels, key) of the keys of a url that have one of the shapes."""
    parts = F.split(F.col("host"), r"\.")
    found = []
    for labels, path_len in shapes:
        key = F.concat(F.array_join(F.slice(parts, F.size(parts) - labels + 1, labels), "."), F.substring(F.col("path"), 1, path_len))
        fits = (F.size(parts) >= labels) & (F.length("path") >= path_len)
        found.append(F.when(fits, F.struct(F.length(key).alias("len"), F.lit(labels).alias("labels"), key.alias("key"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _bit(key: Column, seed: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(bits).cast("long"))


class Level:
    """One Bloom filter: ``words`` of 64 bits as a literal array, ``hashes`` bit positions a key."""

    def __init__(self, bits: int, hashes: int, seed: int, words: list[int]):
        self.bits, self.hashes, self.seed, self.words = bits, hashes, seed, words

    @classmethod
    def build(cls, keys: DataFrame, count: int, rate: float, seed: int) -> Level:
        hashes = max(1, round(math.log2(1 / rate)))
        bits = max(64, math.ceil(count * hashes / math.log(2)))
        size = -(-bits // 64)
        if size > MAX_WORDS:
            raise TooLarge(f"a level of {size} words is over the bound of {MAX_WORDS}")
        spots = keys.select(F.explode(F.array(*[_bit(F.col("key"), seed + i, bits) for i in range(hashes)])).alias("spot"))
        one = F.expr("shiftleft(1L, cast(spot % 64 as int))")
        rows = spots.groupBy(F.expr("spot div 64").alias("word")).agg(F.bit_or(one).alias("ones")).collect()  # at most MAX_WORDS rows
        words = [0] * size
        for r in rows:
            words[r["word"]] = r["ones"]
        return cls(bits, hashes, seed, words)

    def literal(self) -> Column:
        return F.expr("array(" + ",".join(f"{w}L" if w != -(2**63) else "(-9223372036854775807L - 1L)" for w in self.words) + ")")

    def has(self, key: Column) -> Column:
        words, all_set = self.literal(), F.lit(True)
        for i in range(self.hashes):
            spot = _bit(key, self.seed + i, self.bits)
            word = F.element_at(words, (F.floor(spot / 64) + 1).cast("int"))
            all_set = all_set & (F.getbit(word, F.pmod(spot, F.lit(64)).cast("int")) == 1)
        return all_set


class Cascade:
    """Alternating Bloom levels with exact answers for every key of the universe they were built over."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, seed: int) -> Cascade:
        """``listed`` (key) are distinct; ``universe`` (key) may repeat keys and hold listed ones."""
        n = listed.count()
        if not n:
            return cls([])
        s = universe.agg(F.approx_count_distinct("key")).first()[0]
        levels = [Level.build(listed, n, min(0.5, max(1e-9, n * math.sqrt(0.5) / max(s, 1))), seed)]
        inside = listed
        outside = written(universe.where(levels[0].has(F.col("key"))).distinct().join(listed, "key", "left_anti"), "cascade")
        while True:
            n = outside.count()
            if not n:
                return cls(levels)
            if len(levels) >= MAX_LEVELS:
                raise TooLarge(f"the cascade has more than {MAX_LEVELS} levels")
            seed += 101
            levels.append(Level.build(outside, n, 0.5, seed))
            inside, outside = outside, written(inside.where(levels[-1].has(F.col("key"))), "cascade")

    def has(self, key: Column) -> Column:
        """Listed or not: decided by the first level that lacks the key."""
        if not self.levels:
            return F.lit(False)
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            answer = F.when(~self.levels[i].has(key), F.lit(i % 2 == 1)).otherwise(answer)
        return answer


class UrlFilter:
    def __init__(self, shapes: list[tuple[int, int]], block: Cascade, allow: Cascade, default: str):
        self.shapes, self.block, self.allow, self.default = shapes, block, allow, default

    @classmethod
    def fit(cls, rules: DataFrame, pages: DataFrame, url: str = "url", default: str = "allow") -> UrlFilter:
        """``rules`` (host, path, verdict allow|block); ``pages`` gives the universe of keys."""
        keys = written(_rule_keys(rules), "rules")
        shapes = [(r[0], r[1]) for r in keys.select("labels", "path_len").distinct().limit(MAX_SHAPES + 1).collect()]
        if len(shapes) > MAX_SHAPES:
            raise TooLarge(f"more than {MAX_SHAPES} rule shapes")
        if not shapes:
            return cls([], Cascade([]), Cascade([]), default)
        universe = _with_parts(pages, url).select(F.explode(_candidates(sorted(shapes))).alias("c")).select("c.key")
        block = Cascade.build(keys.where("blocked").select("key"), universe, 11)
        return cls(sorted(shapes), block, Cascade.build(keys.where("not blocked").select("key"), universe, 50021), default)

    def judge(self, pages: DataFrame, url: str = "url") -> DataFrame:
        """``pages`` with host, path, rule (or null) and verdict."""
        split = _with_parts(pages, url)
        if not self.shapes:
            return split.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(self.default)})
        judged = F.transform(_candidates(self.shapes), lambda c: F.struct(c["len"].alias("len"), c["labels"].alias("labels"), c["key"].alias("key"), self.block.has(c["key"]).alias("b"), self.allow.has(c["key"]).alias("a")))
        best = split.withColumn("_best", F.array_max(F.filter(judged, lambda c: c["b"] | c["a"])))
        verdict = F.when(F.col("_best.b"), F.lit("block")).when(F.col("_best.a"), F.lit("allow")).otherwise(F.lit(self.default))
        return best.withColumns({"rule": F.col("_best.key"), "verdict": verdict}).drop("_best")


def judge_by_join(rules: DataFrame, pages: DataFrame, key: str, url: str = "url", default: str = "allow") -> DataFrame:
    """The same answers for rule sets beyond the bounds: equi-join of candidate keys with the rules.

    ``key`` is a unique column of ``pages``. Suffixes and prefixes of all lengths are candidates.
    """
    split = _with_parts(pages, url)
    parts = F.split(F.col("host"), r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("labels"), F.array_join(F.slice(parts, F.size(parts) - i + 1, i), ".").alias("s")))
    cands = split.select(F.col(key), "path", F.explode(suffix).alias("h")).select(key, F.col("h.labels").alias("labels"), "h.s", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n"), "path")
    cands = cands.select(key, "labels", F.concat("s", F.substring(F.col("path"), 1, F.col("n"))).alias("key_"), F.col("n").alias("path_len"))
    rule = _rule_keys(rules).withColumnRenamed("key", "key_")
    best = cands.join(rule, ["key_", "labels", "path_len"]).groupBy(key).agg(F.max(F.struct(F.length("key_"), "labels", F.col("key_").alias("rule"), "blocked")).alias("m"))
    out = split.join(best, key, "left")
    verdict = F.when(F.col("m.blocked"), "block").when(F.col("m.rule").isNotNull(), "allow").otherwise(default)
    return out.withColumns({"rule": F.col("m.rule"), "verdict": verdict}).drop("m")


def judge_urls(rules: DataFrame, pages: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict: by a cascade or, for rule sets over its bounds, by a join."""
    try:
        return UrlFilter.fit(rules, pages, url, default).judge(pages, url)
    except TooLarge:
        keyed = written(pages.withColumn("_key", F.monotonically_increasing_id()), "pages")
        return judge_by_join(rules, keyed, "_key", url, default).drop("_key")
