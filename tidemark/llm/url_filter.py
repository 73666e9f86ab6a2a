"""URL filters: host and path rules, and a Bloom filter cascade for exact list membership without joins."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table, written

#: (verdict, host, path): fits the host and its subdomains where the url's path starts with the path; the longest wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
# Names that the list blocks, with their subdomains, under each of ZONES.
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
ZONES = ("example.com", "example.net", "example.org")
#: The tables have no list of pages: one page of 16, by the first hexadecimal digit of its md5, stands for one.
LISTED_DIGIT = "0"
#: A cascade of more bits (256 MB) is not broadcast: membership is then a join on hashes.
MAX_BITS = 1 << 31
#: Key hashes that the driver may hold to finish a cascade (16 bytes each).
LOCAL_KEYS = 1 << 17

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    """(hashes x keys) bit positions; every level hashes anew."""
    with np.errstate(over="ignore"):
        a = _mix(h1 + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15))
        b = _mix(h2 ^ a) | np.uint64(1)
        return np.stack([(a + np.uint64(i) * b) % np.uint64(bits) for i in range(hashes)]).astype(np.int64)


@dataclass
class Level:
    bits: int
    hashes: int
    words: np.ndarray

    def has(self, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
        p = _positions(h1, h2, level, self.bits, self.hashes)
        return ((self.words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1)).all(axis=0)


def _shape(n: int, p: float) -> tuple[int, int]:
    bits = max(64, -(-math.ceil(n * math.log(1 / p) / math.log(2) ** 2) // 64) * 64)
    return bits, max(1, round(math.log2(1 / p)))


def _local_level(h1: np.ndarray, h2: np.ndarray, level: int, p: float) -> Level:
    bits, hashes = _shape(len(h1), p)
    at = _positions(h1, h2, level, bits, hashes).ravel()
    words = np.zeros(bits // 64, np.uint64)
    np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return Level(bits, hashes, words)


def _spread_level(keys: DataFrame, n: int, level: int, p: float) -> Level:
    """As _local_level, from a table of hashes: tasks emit their own words, which are united by position."""
    bits, hashes = _shape(n, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_positions(*_hashes(b), level, bits, hashes).ravel())
            if len(at):
                word, first = np.unique(at >> 6, return_index=True)
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], names=["word", "value"])

    got = keys.select("h1", "h2").mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toPandas()
    words = np.zeros(bits // 64, np.uint64)
    words[got["word"].to_numpy()] = got["value"].to_numpy(np.int64).view(np.uint64)
    return Level(bits, hashes, words)


def _hashes(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.asarray(b.column(b.schema.get_field_index(c))).astype(np.int64).view(np.uint64) for c in ("h1", "h2"))


class Cascade:
    """Exact membership of every key of the universe it was built over. Level 0 holds the listed keys, level 1 the
    unlisted keys that level 0 takes for listed, level 2 the listed keys that level 1 takes for those, and so on until
    a level has no false positive: a key is listed if the first level without it is odd."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @property
    def bits(self) -> int:
        return sum(x.bits for x in self.levels)

    def member(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), bool)
        live = np.arange(len(h1))
        for k, level in enumerate(self.levels):
            has = level.has(h1[live], h2[live], k)
            out[live[~has]] = k % 2 == 1
            live = live[has]
        out[live] = len(self.levels) % 2 == 1
        return out


def _hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key, F.lit(1)).alias("h1"), F.xxhash64(key, F.lit(2)).alias("h2")]


def build_cascade(universe: DataFrame, listed: DataFrame) -> Cascade | None:
    """The cascade of the keys of `listed` over those of `universe`, both as two 64-bit hashes (h1, h2); None if it would
    pass MAX_BITS.

    Nulls are left out of both; repeated keys count once; listed keys outside the universe are ignored, and an empty
    list or universe gives a cascade without members. Key sets beyond LOCAL_KEYS stay distributed; only the levels'
    bits come to the driver, and their number is checked before they do.
    """
    both = ["h1", "h2"]
    mark = listed.select(*both).dropna().distinct().withColumn("listed", F.lit(True))
    keys = universe.select(*both).dropna().distinct().join(mark, both, "left")
    keys = written(keys.select(*both, F.coalesce("listed", F.lit(False)).alias("listed")), "cascade-keys")
    count = {r["listed"]: r["n"] for r in keys.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    inside, outside = count.get(True, 0), count.get(False, 0)
    levels: list[Level] = []
    if not inside:
        return Cascade([])
    # the optimum of a cascade: the first level's rate brings the false positives near the listed keys, later ones halve
    rate = min(0.5, inside * math.sqrt(0.5) / max(outside, 1))
    holds, others = keys.where("listed"), keys.where("NOT listed")
    n, rest = inside, outside
    while n:
        k = len(levels)
        if n + rest <= LOCAL_KEYS:
            break
        if sum(x.bits for x in levels) + _shape(n, rate)[0] > MAX_BITS:
            return None
        levels.append(_spread_level(holds, n, k, rate))
        made = levels[-1]

        def passing(batches: Iterator[pa.RecordBatch], made: Level = made, k: int = k) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(made.has(*_hashes(b), k)))

        wrong = written(others.mapInArrow(passing, others.schema), "cascade-level")
        holds, others, n, rest, rate = wrong, holds, wrong.count(), n, 0.5
    if n:
        a, b = (tuple(x.select("h1", "h2").toPandas()[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2")) for x in (holds, others))
        while len(a[0]):
            k = len(levels)
            levels.append(_local_level(*a, k, rate))
            wrong = levels[-1].has(*b, k)
            a, b, rate = (b[0][wrong], b[1][wrong]), a, 0.5
    return Cascade(levels)


def is_listed(rows: DataFrame, keys: str, cascade: Cascade, out: str = "listed") -> DataFrame:
    """rows with the boolean column `out`: whether one of the array column `keys`, all of the cascade's universe, is
    listed. Null keys, null arrays and empty ones are not."""
    shared = rows.sparkSession.sparkContext.broadcast(cascade)
    keep = [c for c in rows.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [b.column(len(keep) + k) for k in range(2)]
            off = np.asarray(lists[0].offsets)
            h1, h2 = (np.asarray(x.values).astype(np.int64).view(np.uint64)[off[0] : off[-1]] for x in lists)
            total = np.concatenate([[0], np.cumsum(shared.value.member(h1, h2))])
            found = total[off[1:] - off[0]] > total[off[:-1] - off[0]]
            yield pa.RecordBatch.from_arrays(list(b.columns)[: len(keep)] + [pa.array(found)], names=keep + [out])

    schema = rows.select(*keep).schema.add(out, "boolean")
    some = F.filter(F.coalesce(F.col(keys), F.array().cast("array<string>")), lambda x: x.isNotNull())
    h1 = F.transform(some, lambda x: F.xxhash64(x, F.lit(1))).alias(free_name(rows.columns, "_h1"))
    h2 = F.transform(some, lambda x: F.xxhash64(x, F.lit(2))).alias(free_name(rows.columns, "_h2"))
    return rows.select(*keep, h1, h2).mapInArrow(run, schema)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Between the first :// and /, ?, # or the end, A-Z lower-cased; then up to ?, # or the end. Otherwise empty."""
    pattern = r"(?s)://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def url_keys(host: Column, path: Column) -> Column:
    """The keys by which a list may name a url: its host, the host's parents, and host and path together."""
    labels = F.split(host, r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host == "", F.array().cast("array<string>")).when(path == "", names).otherwise(F.array_append(names, F.concat(host, path)))


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of each url: the longest fitting rule's verdict, else block if `listed`
    (column key) has the host, one of its parents, or host and path together.

    Null urls and urls without :// have an empty host and path and no keys; rows are all kept, repeated ones too; null
    and repeated list entries count for nothing more; other columns are ignored; an empty table gives none. The universe
    of the cascade is every key of every url: hosts are made distinct before their parents are listed.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    key = F.col("key")
    hosts = rows.select("host").distinct().select(F.explode(url_keys(F.col("host"), F.lit(""))).alias("key"))
    whole = rows.where("host <> '' AND path <> ''").select(F.concat("host", "path").alias("key"))
    named = listed.select("key").where(key.isNotNull()).select(*_hashed(key))
    cascade = build_cascade(hosts.select(*_hashed(key)).union(whole.select(*_hashed(key))), named)
    keyed = rows.withColumn("keys", url_keys(F.col("host"), F.col("path")))
    if cascade is not None:
        marked = is_listed(keyed, "keys", cascade)
    else:  # beyond MAX_BITS: keys with the list's hashes, then their rows
        numbered = written(keyed.withColumn("row", F.monotonically_increasing_id()), "url-keys")
        hit = numbered.select("row", F.explode("keys").alias("key")).select("row", *_hashed(key)).join(named.distinct(), ["h1", "h2"], "left_semi").select("row").distinct()
        marked = numbered.join(hit.withColumn("listed", F.lit(True)), "row", "left")
    return marked.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
    )


def block_list(pages: DataFrame, url: str = "url") -> DataFrame:
    """The list (column key): LISTED_NAMES under ZONES, and the pages whose md5 of host and path begins with LISTED_DIGIT."""
    host, path = host_and_path(F.col(url))
    whole = pages.select(host.alias("host"), path.alias("path")).where("host <> '' AND path <> ''").select(F.concat("host", "path").alias("key"))
    names = pages.sparkSession.createDataFrame([(f"{name}.{zone}",) for name in LISTED_NAMES for zone in ZONES], "key string")
    return names.union(whole.where(F.md5("key").startswith(LISTED_DIGIT)).distinct())


def op8_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages by the rules, else by block_list. Null and odd urls, repeats and an empty table: see judge."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, block_list(pages))


OP8_SQL = r"""
WITH split AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM split)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host, '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)$') THEN 'block'
    WHEN host <> '' AND path <> '' AND starts_with(md5(host || path), '0') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
