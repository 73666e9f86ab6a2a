"""A counterfactual-regularised toxicity classifier: swapping identity terms must not change a sentence's score."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_slices, tidy, written

# Groups of identity terms whose members are swapped for each other.
IDENTITY_GROUPS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"), ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"), ("immigrants", "citizens"), ("disabled", "able"), ("old", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
#: Labelled rows that a classifier is fitted on, about; the rows of the least hashes.
SAMPLE_ROWS = 20_000
#: Features that a classifier keeps if nothing else is said, by how far their rates differ between the labels.
MAX_FEATURES = 2048
THRESHOLD = 0.7
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?\n]+")
_NEXT = {a: g[(i + 1) % len(g)] for g in IDENTITY_GROUPS for i, a in enumerate(g)}
_PREFIXES = range(3, 8)


def features(words: set[str]) -> set[str]:
    """Of a text's distinct lower-case words: each word, and its first 3 to 7 letters."""
    return {"=" + w for w in words} | {"^" + w[:k] for w in words for k in _PREFIXES if len(w) > k}


@dataclass
class Classifier:
    weights: dict[str, float]
    bias: float

    def __post_init__(self):
        self.heads = {f[1:4] for f in self.weights}
        self.memo: dict[str, tuple[str, ...]] = {}

    def _of(self, word: str) -> tuple[str, ...]:
        got = self.memo.get(word)
        if got is None:
            got = tuple(f for f in ["=" + word, *("^" + word[:k] for k in _PREFIXES if len(word) > k)] if f in self.weights)
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[word] = got
        return got

    def score(self, text: str) -> float:
        heads = self.heads
        hit = {f for w in set(_WORD.findall(text.lower())) if w[:3] in heads for f in self._of(w)}
        z = self.bias + sum(self.weights[f] for f in sorted(hit))
        return 1 / (1 + np.exp(-max(-30.0, min(30.0, z))))


def _sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, rows: int) -> DataFrame:
    """(text, toxic) of about `rows` labelled rows at most; a doc_id's labels count as toxic if one is, labels other than 0
    and 1 are ignored, and a labelled doc_id gives a row for each of its documents."""
    known = labels.where("toxic IN (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    share = min(1.0, rows / max(n, 1))
    known = known.where(F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30)))
    # at most about `rows` rows of 12 bytes
    return docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t")).join(F.broadcast(known), "_id").select("_t", "toxic")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by, n = (Counter(), Counter()), [0, 0]
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n[toxic] += 1
            by[toxic].update(features(set(_WORD.findall(text.lower()))))
            if len(by[0]) + len(by[1]) > 400_000:
                yield _counted(by)
                by = (Counter(), Counter())
    yield _counted(by)
    yield _counted((Counter({"": n[0]}), Counter({"": n[1]})))


def _counted(by: tuple[Counter, Counter]) -> pa.RecordBatch:
    names = list(by[0] | by[1])
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array([by[0][f] for f in names], pa.int64()), pa.array([by[1][f] for f in names], pa.int64())],
        names=["feature", "clean", "toxic"],
    )


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, penalty: float = 1.0, ridge: float = 1e-4,
    least: int = 5, most: int = MAX_FEATURES,
) -> Classifier:
    """Logistic regression on words and word beginnings, with a penalty on counterfactual score changes.

    labels: doc_id, toxic (0/1). Feature counts are made by tasks over the sample's whole texts and summed; features
    in `least` rows or more whose rates differ most (by |z|, at least 4) are kept, `most` of them. Of each sentence that names an
    identity term, the swapped sentence's features are made too, and the squared change of its score is added to the
    loss; terms of a group are tied to each other even where the sample has none. Nothing but the chosen features'
    places by sampled row comes to the driver. Without labels, or with labels of one kind, only the bias is fitted.
    """
    sample = written(_sample(docs, labels, doc_id, text, rows), "labelled")
    counts = sample.mapInArrow(_count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("n0"), F.sum("toxic").alias("n1"))
    counts = written(counts, "feature-counts")
    total = counts.where("feature = ''").first()
    n0, n1 = (total["n0"], total["n1"]) if total else (0, 0)
    if not n0 or not n1:
        return Classifier({}, float(np.log((n1 + 0.5) / (n0 + 0.5))) * 1.0)
    p = (F.col("n0") + F.col("n1")) / (n0 + n1)
    z = (F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))
    best = counts.where((F.col("feature") != "") & (F.col("n0") + F.col("n1") >= least) & (F.col("n0") + F.col("n1") < n0 + n1)).withColumn("z", F.abs(z)).where("z >= 4").orderBy(F.desc("z"), "feature").limit(most)
    names = [r["feature"] for r in best.select("feature").collect()]
    names += sorted({"=" + t for t in _NEXT} - set(names))
    place = {f: i for i, f in enumerate(names)}

    @tidy
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = {f[1:4] for f in place}

        def ids(words: set[str]) -> list[int]:
            return sorted(place[f] for f in features({w for w in words if w[:3] in heads}) if f in place)

        for batch in batches:
            out, changes, kind = [], [], []
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = t.lower()
                words = set(_WORD.findall(t))
                out.append(np.array(ids(words), np.uint16).tobytes())
                kind.append(y)
                pairs = set()
                if words & _NEXT.keys():
                    for s in _SENTENCE.split(t):
                        w = set(_WORD.findall(s))
                        if w & _NEXT.keys():
                            a, b = set(ids(w)), set(ids({_NEXT.get(x, x) for x in w}))
                            pairs.add((tuple(sorted(a - b)), tuple(sorted(b - a))))
                changes.append(json.dumps(sorted(pairs)) if pairs else "")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(kind, pa.int32()), pa.array(changes)], names=["ids", "toxic", "changes"])

    got = sample.mapInArrow(encode, "ids binary, toxic int, changes string").toPandas()
    rows_ = [np.frombuffer(x, np.uint16) for x in got["ids"]]
    y = got["toxic"].to_numpy(float)
    swaps = Counter((tuple(a), tuple(b)) for x in got["changes"] if x for a, b in json.loads(x))
    for a, b in _NEXT.items():
        swaps[((place["=" + a],), (place["=" + b],))] += 1
    weights, bias = _solve(rows_, y, swaps, len(names), penalty, ridge)
    return Classifier({f: float(w) for f, w in zip(names, weights) if w}, bias)


def _solve(rows: list[np.ndarray], y: np.ndarray, swaps: Counter, k: int, penalty: float, ridge: float, rounds: int = 600) -> tuple[np.ndarray, float]:
    keys = sorted(range(len(rows)), key=lambda i: (rows[i].tobytes(), y[i]))  # one order of sums, whatever order the rows came in
    rows, y = [rows[i] for i in keys], y[keys]
    n = len(y)
    col = np.concatenate([*rows, np.zeros(0, np.uint16)]).astype(np.int64)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    pairs = sorted(swaps.items())
    scol = np.array([i for (a, b), _ in pairs for i in (*a, *b)], np.int64)
    sval = np.array([v for (a, b), _ in pairs for v in [-1.0] * len(a) + [1.0] * len(b)])
    srow = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for (a, b), _ in pairs])
    times = np.array([c for _, c in pairs], float)
    times *= penalty / max(times.sum(), 1)
    w, b = np.zeros(k), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, rounds + 1):
        r = (1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[col], n), -30, 30))) - y) / n
        change = np.bincount(srow, sval * w[scol], len(pairs))
        g = np.bincount(col, r[row], k) + 2 * np.bincount(scol, sval * (times * change)[srow], k) + ridge * w
        g = np.append(g, r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def score(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD, text: str = "text", out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from `threshold` on), named as in `out`, of each whole text; null is
    empty, and an empty text has the score of the bias. All rows and other columns stay; columns named like the outputs
    are replaced. The model, of its features' names and weights alone, is sent to every task."""
    keep = [c for c in docs.columns if c not in out]
    schema = docs.select(*keep).schema.add(out[0], "double").add(out[1], "integer")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, off in text_slices(batch, text):
                blob = raw.tobytes()
                s = np.array([model.score(blob[i:j].decode()) for i, j in zip(off[:-1].tolist(), off[1:].tolist())], float)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(rows.schema.get_field_index(c)) for c in keep] + [pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                    names=keep + list(out),
                )

    return docs.select(*keep).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def op2_toxicity_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every whole text of documents by a classifier fitted on the labels that are not held out.

    Null and empty texts have the score of the bias; a null doc_id is not held out and has no label; repeated doc_ids have
    a row each; labels other than 0 and 1 are ignored, a doc_id with both is toxic; without labels, or with one kind
    only, all have one score; other columns are never read; an empty table gives none.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = table(spark, sf_dir, "labels").where(~held_out())
    model = fit(docs, labels)
    return score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
