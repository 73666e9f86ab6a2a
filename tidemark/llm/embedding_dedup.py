"""Embedding near-duplicates by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_parts, table, tidy, written
from .components import components

BITS = 63
#: Passes that are ordered and compared in one job.
TOGETHER = 3
#: Blocks of a window: a task compares each with itself and the next, so one block of a window is sent twice.
WINDOW = 4
#: Vectors of which all links are found by brute force to measure the recall, and the bytes they have at most.
PROBES, PROBE_BYTES = 1024, 16 << 20
#: Cosines that are made at a time.
CELLS = 1 << 20


def _matrix(lists: pa.Array) -> list[np.ndarray]:
    flat, off = np.asarray(lists.values).astype(np.float64), np.asarray(lists.offsets)
    return [flat[i:j] for i, j in zip(off[:-1], off[1:])]


def _unit(rows: list[np.ndarray]) -> list[np.ndarray]:
    out = []
    for x in rows:
        x = x / np.abs(x).max()  # no overflow in the squares
        out.append(x / np.sqrt((x * x).sum()))
    return out


def _longs(lists: pa.Array, n: int) -> np.ndarray:
    """Lists of one length as a matrix of n rows."""
    off = np.asarray(lists.offsets)
    return np.asarray(lists.values)[off[0] : off[-1]].reshape(n, -1)


def _orders(nodes: DataFrame, numbers: range, block: int, seed: int) -> DataFrame:
    """(node, number, block) of each pass of `numbers`: nodes in the order of BITS concatenated signs of random
    projections, ties by node, cut every `block` rows. Range partitions sort; one row a partition and pass passes through
    one task to turn places within partitions into places of the pass."""
    parts = shuffle_parts(nodes.sparkSession)

    @tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            vectors = _matrix(b.column(1))
            dims = np.array([len(v) for v in vectors])
            for number in numbers:
                key = np.zeros(b.num_rows, np.int64)
                for dim in set(dims.tolist()):
                    if (number, dim) not in planes:
                        planes[number, dim] = np.random.default_rng([seed, number, dim]).standard_normal((dim, BITS))
                    at = np.flatnonzero(dims == dim)
                    up = np.stack([vectors[i] for i in at]) @ planes[number, dim] > 0
                    key[at] = up.astype(np.int64) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(b.num_rows, number, np.int32)), pa.array(key)], names=["node", "number", "key"])

    @tidy
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), {}
        for b in batches:
            number = np.asarray(b.column(1))
            idx = np.zeros(b.num_rows, np.int64)
            for k in np.unique(number).tolist():
                at = np.flatnonzero(number == k)
                idx[at] = done.get(k, 0) + np.arange(len(at))
                done[k] = done.get(k, 0) + len(at)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.full(b.num_rows, part, np.int32)), pa.array(idx)], names=["node", "number", "part", "idx"],
            )

    keys = written(nodes.select("node", "embedding").mapInArrow(sign, "node long, number int, key long"), "pass-keys")
    order = ["number", "key", "node"]
    placed = written(
        keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(place, "node long, number int, part int, idx long"), "pass-order",
    )
    counts = placed.groupBy("number", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("number").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("number", "part", F.coalesce(before, F.lit(0)).alias("first"))
    # TOGETHER rows a partition at most, so of a known small size
    return placed.join(F.broadcast(first), ["number", "part"]).select(
        "node", "number", F.floor((F.col("first") + F.col("idx")) / block).cast("long").alias("block"),
    )


class _Rows:
    """Rows (node, copies, embedding, blocks, runs) of one task's unit, ready to be compared."""

    def __init__(self, t: pa.Table, threshold: float):
        self.node, self.copies = t.column("node").to_numpy(), t.column("copies").to_numpy()
        n = len(self.node)
        self.blocks = _longs(t.column("blocks").combine_chunks(), n)
        self.runs = _longs(t.column("runs").combine_chunks(), n)
        self.threshold = threshold
        vectors = _unit(_matrix(t.column("embedding").combine_chunks()))
        dims = np.array([len(v) for v in vectors])
        self.of = [(d, np.flatnonzero(dims == d)) for d in sorted(set(dims.tolist()))]
        self.place = np.zeros(n, np.int64)
        self.x = {}
        for d, at in self.of:
            self.place[at] = np.arange(len(at))
            self.x[d] = np.stack([vectors[i] for i in at])
        self.dims = dims
        self.links, self.lab = np.zeros(n, np.int64), np.arange(n)
        self.some = np.zeros(n, bool)

    def near(self, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of `left` and `right` at the threshold, CELLS cosines at a time."""
        for d, _ in self.of:
            p, q = left[self.dims[left] == d], right[self.dims[right] == d]
            if not len(p) or not len(q):
                continue
            y = self.x[d][self.place[q]].T
            step = max(1, CELLS // len(q))
            for i in range(0, len(p), step):
                r, c = np.nonzero(self.x[d][self.place[p[i : i + step]]] @ y >= self.threshold)
                yield p[i + r], q[c]

    def link(self, a: np.ndarray, b: np.ndarray, within: int, runs: int) -> None:
        """Link the rows, and count the pairs that no window of the first `within` passes and no run of the first `runs` has."""
        self.some[a] = self.some[b] = True
        while True:
            la, lb = self.lab[a], self.lab[b]
            if (la == lb).all():
                break
            low = np.minimum(la, lb)
            np.minimum.at(self.lab, la, low)
            np.minimum.at(self.lab, lb, low)
            self.lab = self.lab[self.lab]
        for k in range(max(within, runs)):
            if not len(a):
                break
            seen = np.zeros(len(a), bool)
            if k < within:
                seen |= np.abs(self.blocks[a, k] - self.blocks[b, k]) <= 1
            if k < runs:
                seen |= self.runs[a, k] == self.runs[b, k]
            a, b = a[~seen], b[~seen]
        n = len(self.node)
        self.links += np.bincount(a, self.copies[b], n).astype(np.int64) + np.bincount(b, self.copies[a], n).astype(np.int64)

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        while not np.array_equal(self.lab, self.lab[self.lab]):
            self.lab = self.lab[self.lab]
        return self.node[self.some], self.links[self.some], self.node[self.lab[self.some]]


def _units(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The tables of rows alike in the first `keys` columns of batches ordered by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        marks = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in range(keys)], 1)
        cuts = np.flatnonzero((np.diff(marks, axis=0) != 0).any(axis=1)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if i == j:
                continue
            now = marks[i].tolist()
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            last = now
    if held:
        yield pa.Table.from_batches(held)


_FOUND = "node long, links long, root long, number int, full long"


def _found(number: int, node: np.ndarray, links: np.ndarray, root: np.ndarray, full: list[int]) -> pa.RecordBatch:
    """Linked nodes, and a row for each full block."""
    n, m = len(node), len(full)
    none = np.arange(n + m) < n
    cols = [np.concatenate([x, np.zeros(m, np.int64)]) for x in (node, links, root)]
    at = np.concatenate([np.zeros(n, np.int64), np.array(full, np.int64)])
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c, mask=~none) for c in cols), pa.array(np.full(n + m, number, np.int32)), pa.array(at, mask=none)],
        names=["node", "links", "root", "number", "full"],
    )


def _windows(state: DataFrame, numbers: range, threshold: float, parts: int) -> DataFrame:
    """Each block of the passes `numbers` compared with itself and the next. state: node, copies, embedding, blocks of all
    passes so far, runs of those before `numbers`. Returns linked nodes and full blocks: those of which a vector links
    with half of the next."""
    done = numbers.start

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _units(batches, 2):
            number, window = t.column("number")[0].as_py(), t.column("window")[0].as_py()
            rows = _Rows(t, threshold)
            block = rows.blocks[:, number]
            full = []
            for k in np.unique(block).tolist():
                if k // WINDOW != window:
                    continue
                own, following = np.flatnonzero(block == k), np.flatnonzero(block == k + 1)
                both = np.concatenate([own, following])
                across = np.zeros(len(rows.node), np.int64)
                for a, b in rows.near(own, both):
                    a, b = a[a < b], b[a < b]
                    rows.link(a, b, number, done)
                    across += np.bincount(a[block[b] == k + 1], minlength=len(across))
                if len(following) and (2 * across >= len(following)).any():
                    full.append(k)
            if rows.some.any():
                yield _found(number, *rows.result(), full)

    at = F.posexplode(F.slice("blocks", done + 1, len(numbers))).alias("pos", "at")
    spread = state.select("node", "copies", "embedding", "blocks", "runs", at)
    here = F.floor(F.col("at") / WINDOW).cast("long")
    windows = F.when((F.col("at") % WINDOW == 0) & (F.col("at") > 0), F.array(here, here - 1)).otherwise(F.array(here))
    sent = spread.select((F.col("pos") + done).cast("int").alias("number"), F.explode(windows).alias("window"), "node", "copies", "embedding", "blocks", "runs")
    ordered = sent.repartition(parts, "number", "window").sortWithinPartitions("number", "window", F.element_at("blocks", F.col("number") + 1), "node")
    return ordered.mapInArrow(run, _FOUND)


def _runs(found: DataFrame) -> DataFrame:
    """(number, run, low, high) of the runs of blocks to be compared throughout: full blocks at most two apart, and the two
    behind the last. There is at most one for three blocks."""
    order = Window.partitionBy("number").orderBy("full")
    marked = found.where("full IS NOT NULL").select("number", "full").distinct().withColumn(
        "new", F.coalesce(F.col("full") - F.lag("full").over(order) > 2, F.lit(True)).cast("int"),
    )
    islands = marked.withColumn("island", F.sum("new").over(order))
    return islands.groupBy("number", "island").agg(
        F.min("full").alias("low"), (F.max("full") + 2).alias("high"),
    ).select("number", F.col("low").alias("run"), "low", "high")


def _throughout(state: DataFrame, runs: DataFrame, numbers: range, threshold: float, parts: int) -> DataFrame:
    """The blocks of each run compared with all of its others but the next, which windows have. Tiles of WINDOW blocks meet
    in pairs, so all of a run goes on in one job whatever its length; runs of state include those of `numbers`."""
    last = numbers.stop

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _units(batches, 4):
            number = t.column("number")[0].as_py()
            ta, tb = t.column("ta")[0].as_py(), t.column("tb")[0].as_py()
            rows = _Rows(t, threshold)
            block = rows.blocks[:, number]
            tile = (block - t.column("run")[0].as_py()) // WINDOW
            for a, b in rows.near(np.flatnonzero(tile == ta), np.flatnonzero(tile == tb)):
                far = np.abs(block[a] - block[b]) > 1
                if ta == tb:
                    far &= a < b
                rows.link(a[far], b[far], last, number)
            if rows.some.any():
                yield _found(number, *rows.result(), [])

    spread = state.select(
        "node", "copies", "embedding", "blocks", "runs", F.posexplode(F.slice("blocks", numbers.start + 1, len(numbers))).alias("pos", "at"),
    ).withColumn("number", (F.col("pos") + numbers.start).cast("int"))
    tiles = runs.select(
        "number", "run", F.floor((F.col("high") - F.col("low")) / WINDOW).cast("int").alias("last"), F.explode(F.sequence("low", "high")).alias("at"),
    )
    members = spread.join(tiles, ["number", "at"]).withColumn("tile", F.floor((F.col("at") - F.col("run")) / WINDOW).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")
    sent = members.select("number", "run", "tile", other, "node", "copies", "embedding", "blocks", "runs")
    sent = sent.select(
        "number", "run", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), "node", "copies", "embedding", "blocks", "runs",
    )
    return sent.repartition(parts, "number", "run", "ta", "tb").sortWithinPartitions("number", "run", "ta", "tb", "node").mapInArrow(run, _FOUND)


def least_passes(n: int, threshold: float, block: int, recall: float) -> int:
    """Passes after which a pair just at the threshold has met with probability `recall`, where the other vectors are
    spread evenly: blocks are alike in their first log2(n / block) signs, each of which agrees with 1 - angle / pi."""
    agree = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    meet = agree ** max(0.0, math.log2(max(n, 1) / block))
    return 1 if meet >= recall else math.ceil(math.log(1 - recall) / math.log(1 - meet))


class _Probes:
    """Recall of the links of PROBES vectors, chosen by hash, against brute force over all vectors in blocks."""

    def __init__(self, nodes: DataFrame, threshold: float):
        spark = nodes.sparkSession
        ends = nodes.agg(F.max(F.size("embedding"))).first()[0] or 1
        some = nodes.orderBy(F.xxhash64("k1", F.lit(3)), "node").limit(max(16, min(PROBES, PROBE_BYTES // (8 * ends)))).select("node", "copies", "embedding")
        got = some.toArrow()
        ids = got.column(0).to_numpy()
        vectors = _unit(_matrix(got.column(2).combine_chunks()))
        shared = spark.sparkContext.broadcast((ids, vectors))

        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors = shared.value
            dims = np.array([len(v) for v in vectors])
            total = np.zeros(len(ids), np.int64)
            for b in batches:
                node, copies, x = np.asarray(b.column(0)), np.asarray(b.column(1)), _unit(_matrix(b.column(2)))
                own = np.array([len(v) for v in x])
                for d in set(own.tolist()) & set(dims.tolist()):
                    at, to = np.flatnonzero(own == d), np.flatnonzero(dims == d)
                    y = np.stack([vectors[i] for i in to]).T
                    for i in range(0, len(at), CELLS // PROBES):
                        here = at[i : i + CELLS // PROBES]
                        near = (np.stack([x[k] for k in here]) @ y >= threshold) & (node[here][:, None] != ids[to][None, :])
                        total[to] += copies[here] @ near
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["node", "links"])

        true = nodes.select("node", "copies", "embedding").mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links")).toArrow()
        self.true = dict(zip(true.column(0).to_pylist(), true.column(1).to_pylist()))
        self.frame = spark.createDataFrame(pa.table({"node": pa.array(list(self.true), pa.int64())}))

    def recall(self, found: DataFrame) -> float:
        """The lesser of the share of links found and the mean share of a vector's; 1 if the probes have none."""
        got = found.join(F.broadcast(self.frame), "node").groupBy("node").agg(F.sum("links").alias("links")).toArrow()
        have = dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist()))
        shares = [have.get(k, 0) / n for k, n in self.true.items() if n]
        total = sum(self.true.values())
        return min(sum(shares) / len(shares), sum(min(have.get(k, 0), n) for k, n in self.true.items()) / total) if total else 1.0


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.95,
    recall: float = 0.97,
    block: int = 1024,
    seed: int = 11,
    most: int = 96,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row: rows linked by a cosine of `threshold` or more.

    Equal vectors are one node with a number of copies. Each pass orders the nodes by concatenated random hashes and
    compares every block of `block` rows with itself and the next; where a vector links with half of the next block, the
    blocks of that run meet throughout. A pair that an earlier pass has compared is not counted again. Found links are
    verified in double precision; a pair that no pass brings together is missed, so passes grow with the rows (see
    least_passes) and go on until the links of PROBES vectors, known by brute force against all rows, are found at
    `recall` (or `most` passes are made): crowded regions, which few signs part, get more of them.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing; so do vectors of
    different lengths and rows without a vec_id. Every row stays; rows of one vec_id are vectors of their own, each with
    its links, and the least vec_id of a component names it. Other columns are ignored; an empty table gives none.
    """
    e = F.col("embedding")
    kind = vectors.select(F.col(embedding)).schema[0].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("embedding"))
    fit = F.coalesce(
        F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False),
    ) & F.col("vec_id").isNotNull()
    rows = rows.withColumn("fit", fit).withColumn(
        "k1", F.when(F.col("fit"), F.xxhash64("embedding", F.lit(1))),
    ).withColumn("k2", F.when(F.col("fit"), F.xxhash64("embedding", F.lit(2))))
    rows = written(rows, "vectors")
    nodes = rows.where("fit").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    # ids of their own: vec_ids may repeat; written once, so they stay as they are
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    spark = vectors.sparkSession
    parts, n = shuffle_parts(spark), nodes.count()
    none = F.array().cast("array<long>")
    state = nodes.select("node", "copies", "embedding", none.alias("blocks"), none.alias("runs"))
    probes = _Probes(nodes, threshold) if n else None
    found: list[DataFrame] = []
    done, wanted = 0, min(most, least_passes(n, threshold, block, recall)) if n else 0
    while done < wanted:
        numbers = range(done, min(wanted, done + TOGETHER))
        orders = _orders(nodes, numbers, block, seed).groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "block"))), lambda x: x["block"]).alias("now"))
        state = written(state.join(orders, "node").select("node", "copies", "embedding", F.concat("blocks", "now").alias("blocks"), "runs"), "passes")
        got = written(_windows(state, numbers, threshold, parts), "pass-links")
        found.append(got)
        runs = written(_runs(got), "pass-runs")
        # a block outside all runs is a run of its own
        alone = F.transform(F.slice("blocks", done + 1, len(numbers)), lambda x: -1 - x)
        if runs.isEmpty():
            state = state.withColumn("runs", F.concat("runs", alone))
        else:
            inside = state.select(
                "node", F.posexplode(F.slice("blocks", done + 1, len(numbers))).alias("pos", "at"),
            ).select("node", (F.col("pos") + done).cast("int").alias("number"), "at")
            inside = inside.join(runs.select("number", "run", F.explode(F.sequence("low", "high")).alias("at")), ["number", "at"], "left")
            inside = inside.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", F.coalesce("run", -1 - F.col("at")).alias("run")))), lambda x: x["run"]).alias("now"))
            state = written(state.join(inside, "node").select("node", "copies", "embedding", "blocks", F.concat("runs", "now").alias("runs")), "passes")
            found.append(written(_throughout(state, runs, numbers, threshold, parts), "run-links"))
        done = numbers.stop
        if done == wanted and wanted < most and probes.recall(_united(found)) < recall:
            wanted = min(most, wanted + TOGETHER)
    if found:
        links = _united(found)
        counts = links.groupBy("node").agg(F.sum("links").alias("links"))
        roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    else:
        counts = spark.createDataFrame([], "node long, links long")
        roots = spark.createDataFrame([], "node long, component long")
    known = nodes.select("node", "k1", "k2", "least", "copies").join(counts, "node", "left").join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = written(known, "vector-labels")
    names = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(names, "component").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    joined = rows.select("vec_id", "k1", "k2").join(known, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def _united(found: list[DataFrame]) -> DataFrame:
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.where("node IS NOT NULL")


def op6_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of embeddings at a cosine of 0.95.

    Vectors that are null, empty, zero or hold a null or non-finite component, and rows without a vec_id, link with
    nothing and are kept; rows of one vec_id and equal vectors have a row each; ties name the least vec_id; other columns,
    whatever their names, are ignored; an empty table gives none.
    """
    return near_duplicates(table(spark, sf_dir, "embeddings"))
