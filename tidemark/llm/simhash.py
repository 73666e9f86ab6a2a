"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_parts, small, table, text_slices, tidy, whole_groups, written
from .components import components

SEGMENT = 32
#: Members of a group that are compared with each other as one block; larger groups are split by the other bits first.
BLOCK = 2048
#: Fingerprints that share a 32-bit segment from which its signatures are dealt to many tasks.
HOT = 100_000
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased words joined by single spaces, word starts, word ends, first word by document) of concatenated texts."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return b"", z, z, np.zeros(len(offsets), np.int64)
    blank = _BLANK[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    prior = np.empty(n, bool)  # the byte before is blank or another document's
    prior[0] = True
    prior[1:] = blank[:-1]
    prior |= edge[:-1]
    keep = ~blank | ~prior
    place = np.cumsum(keep) - keep
    starts = np.flatnonzero(~blank & prior)
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = blank[1:]
    after |= edge[1:]
    ends = np.flatnonzero(~blank & after)
    text = np.where(blank, np.uint8(32), _LOWER[raw])[keep].tobytes()
    return text, place[starts], place[ends] + 1, np.searchsorted(starts, offsets)


def shingle_spans(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first shingle by document): shingles of `width` words, or all words of a shorter document."""
    count = np.diff(first)
    n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    head = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], n)
    last = head + np.repeat(np.minimum(count, width) - 1, n)
    return starts[head], ends[last], at


def _majority(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of rows of hashes by document; documents without any are zero."""
    n = np.diff(at)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    bits = np.arange(64, dtype=np.uint64)
    for i in range(0, len(full), 256):
        part = full[i : i + 256]
        lo, hi = at[part[0]], at[part[-1] + 1]
        ones = np.unpackbits(h[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(ones, at[part] - lo, axis=0, dtype=np.int32)
        out[part] = ((2 * sums > n[part][:, None]).astype(np.uint64) << bits).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """doc_id and the 64-bit SimHash (long) of each whole text: XXH64 with seed 42 of every shingle, repeats included."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for rows, raw, offsets in text_slices(batch, "_t"):
                joined, s, e, first = words_of(raw, offsets)
                s, e, at = shingle_spans(s, e, first, width)
                h = np.fromiter((digest(joined[i:j], 42) for i, j in zip(s.tolist(), e.tolist())), np.uint64, len(s))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(_majority(h, at).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_t")).mapInArrow(run, "doc_id long, fp long")


def variants(fp: Column, segment: int) -> Column:
    """The signatures of one 32-bit segment: its value, and for each bit its value without that bit."""
    value = F.shiftrightunsigned(fp, 32 * segment).bitwiseAND(F.lit(0xFFFFFFFF)) if segment else fp.bitwiseAND(F.lit(0xFFFFFFFF))
    whole = F.lit(segment << 40).bitwiseOR(value)
    gone = [F.lit((segment << 40) | ((b + 1) << 32)).bitwiseOR(value.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << b)))) for b in range(SEGMENT)]
    return F.array(whole, *gone)


def _labels(x: np.ndarray, apart: np.ndarray | None, limit: int) -> np.ndarray:
    """The smallest place reachable by links of at most `limit` bits within x; with `apart`, only links across it count."""
    m = len(x)
    lab = np.arange(m)
    while True:
        new = lab.copy()
        for i in range(0, m, 256):
            near = np.bitwise_count(x[i : i + 256, None] ^ x[None, :]) <= limit
            if apart is not None:
                near &= apart[i : i + 256, None] != apart[None, :]
            new[i : i + 256] = np.minimum(new[i : i + 256], np.where(near, lab[None, :], m).min(axis=1))
        new = new[new]
        if np.array_equal(new, lab):
            return lab
        lab = new


def _forest(x: np.ndarray, apart: np.ndarray | None, limit: int, free: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join x, alike but in its `free` bits, as all its pairs within `limit` bits would. More than BLOCK members
    are parted again and again: of limit + 1 parts of the free bits one is alike in any such pair."""
    if len(x) < 2 or (apart is not None and (apart[0] == apart).all()):
        return
    if len(x) <= BLOCK or len(free) <= limit + 1:
        lab = _labels(x, apart, limit)
        own = lab != np.arange(len(x))
        yield x[own], x[lab[own]]
        return
    for part in np.array_split(np.array(free), limit + 1):
        value = sum(((x >> np.uint64(b)) & np.uint64(1)) << np.uint64(k) for k, b in enumerate(part))
        order = np.argsort(value, kind="stable")
        rest = [b for b in free if b not in set(part.tolist())]
        for members in np.split(order, np.flatnonzero(np.diff(value[order].view(np.int64))) + 1):
            yield from _forest(x[members], None if apart is None else apart[members], limit, rest)


def _group_edges(x: np.ndarray, key: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the members of one signature as all their pairs within `limit` bits would."""
    bit, segment = (key >> 32) & 0xFF, (key >> 40) & 1
    apart = (x >> np.uint64(32 * segment + bit - 1)) & np.uint64(1) if bit else None
    found = list(_forest(x, apart, limit, list(range(32 * (1 - segment), 32 * (2 - segment)))))
    return tuple(np.concatenate([f[k] for f in found] or [x[:0]]) for k in (0, 1))


def _parted(fp: Column, key: Column) -> Column:
    """The signature `key` once for each eighth of the fingerprint, in the other segment, with that byte beside it."""
    segment = F.shiftrightunsigned(key, 40).bitwiseAND(F.lit(1))
    other = F.when(segment == 1, fp.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(fp, 32))
    parts = [F.lit(p + 1 << 49).bitwiseOR(F.shiftleft(F.shiftrightunsigned(other, 8 * p).bitwiseAND(F.lit(255)), 41)).bitwiseOR(key) for p in range(4)]
    return F.array(*parts)


def _signatures(fps: DataFrame) -> DataFrame:
    """(key, fp): every signature of each fingerprint. Of a segment that more than HOT fingerprints share, signatures are
    parted by each byte of the other segment: in a pair within 3 bits one of its four bytes is alike."""
    keys = fps.select(F.explode(F.concat(variants(F.col("fp"), 0), variants(F.col("fp"), 1))).alias("key"), "fp")
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    whole = fps.select(F.explode(F.array(F.struct(F.lit(0).alias("s"), low.alias("v")), F.struct(F.lit(1).alias("s"), high.alias("v")))).alias("x")).select("x.s", "x.v")
    hot = written(whole.groupBy("s", "v").count().where(F.col("count") > HOT).select("s", "v"), "hot-segments")
    if hot.isEmpty():
        return keys
    of = F.when(F.col("s") == 0, variants(F.col("v"), 0)).otherwise(variants(F.shiftleft("v", 32), 1))
    # 33 signatures of each segment that more than HOT fingerprints share: 66 rows for HOT fingerprints at most
    marked = keys.join(small(written(hot.select(F.explode(of).alias("key")).distinct().withColumn("hot", F.lit(True)), "hot-signatures")), "key", "left")
    return marked.select(F.explode(F.when(F.col("hot"), _parted(F.col("fp"), F.col("key"))).otherwise(F.array("key"))).alias("key"), "fp")


def near_pairs(fps: DataFrame, limit: int = 3) -> DataFrame:
    """Pairs (a, b) of the distinct 64-bit fingerprints `fp` that connect all fingerprints within `limit` (0 to 3) bits.

    Of two segments one differs by at most one bit, so two such fingerprints share a signature: the segment, or the
    segment without that bit. Members of a signature are compared in the task that holds it, and a spanning forest of
    their verified links leaves it, never all pairs; a hot segment's signatures are dealt to many tasks.
    """
    if not 0 <= limit <= 3:
        raise ValueError("two segments find at most 3 bits")
    keys = _signatures(fps).repartition(shuffle_parts(fps.sparkSession), "key").sortWithinPartitions("key")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, x in whole_groups(batches, 200_000):
            x = x.view(np.uint64)
            start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.append(start, len(k)))
            two = start[size == 2]
            close = np.bitwise_count(x[two] ^ x[two + 1]) <= limit
            a, b = [x[two[close]]], [x[two[close] + 1]]
            for s, m in zip(start[size > 2].tolist(), size[size > 2].tolist()):
                p, q = _group_edges(x[s : s + m], int(k[s]), limit)
                a.append(p)
                b.append(q)
            a, b = np.concatenate(a), np.concatenate(b)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))], names=["a", "b"])

    return keys.mapInArrow(run, "a long, b long")


def classes(fps: DataFrame, limit: int = 3) -> DataFrame:
    """(doc_id, fp) with component_id, the smallest doc_id reachable over links of at most `limit` bits.

    Texts of one fingerprint are one node, so a group of exact copies of any size is one row before signatures are
    made. Rows with a null doc_id stay and have the component of their fingerprint, null if no doc_id reaches it.
    """
    docs = written(fps, "fingerprints")
    nodes = written(docs.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    by = nodes.where("node IS NOT NULL")
    pairs = written(near_pairs(by, limit).distinct(), "pairs")
    edges = pairs.join(by.withColumnsRenamed({"fp": "a", "node": "na"}), "a").join(by.withColumnsRenamed({"fp": "b", "node": "nb"}), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    roots = components(edges)
    labelled = written(nodes.join(roots, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "labels")
    return docs.join(labelled, "fp").select("doc_id", "fp", "component_id")


def op4_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every whole text of documents.

    Null texts and texts without words have the fingerprint zero and are linked like any others; a null doc_id has a row
    and its fingerprint's component, but names none; rows of one doc_id have a row each and are one node where their
    texts' fingerprints are one; other columns are ignored; an empty table gives none.
    """
    found = classes(fingerprints(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
