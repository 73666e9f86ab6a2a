"""The stages of the pipeline one by one against plain versions, and on odd rows."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tidemark.llm import mixing, toxicity  # noqa: E402
from tidemark.llm.common import written  # noqa: E402

SF = "/root/testdata/sf0.01"
STAGES = dict(corpus_pipeline.STAGES)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


@pytest.fixture(scope="module")
def tables(spark):
    """What goes into each stage and comes out of it."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = written(stage(spark, docs, SF), "test-stage")
        out[name] = (docs, made)
        docs = made
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_stay_until_the_last(tables):
    for name, (before, after) in tables.items():
        assert after.columns == before.columns or name == "encoding"


def test_toxicity(spark, tables):
    before, after = tables["toxicity"]
    model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet").where(~toxicity.held_out()))
    plain = lambda t: model.bias + sum(model.weights.get(f, 0.0) for f in toxicity.features(set(re.findall(r"\w+", (t or "").lower()))))
    clean = {i: t for i, t in texts(before).items() if plain(t) < 0.8472978603872034}  # the logit of 0.7
    assert texts(after) == clean and 0 < len(clean) < before.count()


def test_near_dedup(tables):
    before, after = (texts(x) for x in tables["near-dedup"])
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in before.items() for w in [words(t)]}
    sets = {i: s if s != {()} else set() for i, s in sets.items()}
    root = {i: i for i in before}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(before)
    for n, i in enumerate(order):
        for j in order[:n]:
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert after == {i: t for i, t in before.items() if find(i) == i} and len(after) < len(before)


def test_passage_dedup(tables):
    """Hardly a run of 50 words that a smaller doc_id had is left, a text that shares no five words in a row with
    smaller ones stays as it is, and n_chars fits the text."""
    before, after = (texts(x) for x in tables["passage-dedup"])
    first, lost, left, seen = {}, 0, 0, set()
    for i in sorted(before):
        w = words(before[i])
        runs = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        again = [r for r in runs if r in first]
        w2 = words(after[i])
        kept = {tuple(w2[k : k + 50]) for k in range(len(w2) - 49)}
        left, lost = left + sum(r in kept for r in again), lost + len(again)
        seeds = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        if not any(x in seen for x in seeds):
            assert after[i] == before[i]
        seen.update(seeds)
        for r in runs:
            first.setdefault(r, i)
    assert set(after) == set(before) and left <= 0.02 * max(lost, 1)
    assert tables["passage-dedup"][1].where(F.char_length("text") != F.col("n_chars")).count() == 0


def test_passage_dedup_meets_every_smaller_document(spark):
    """Runs of 40 words of a passage of 80 stand in smaller documents one by one; the one document that has all of it is met too."""
    text = lambda who, n: [f"{who}x{k}" for k in range(n)]
    rows = []
    for f in range(0, 1200, 100):
        p = text(f"p{f}", 80)
        rows += [(f + k, " ".join(text(f"a{f + k}", 40) + p[a : a + 40] + text(f"b{f + k}", 40))) for k, a in enumerate((0, 20, 40))]
        rows += [(f + k, " ".join(text(f"a{f + k}", 30) + p + text(f"b{f + k}", 30))) for k in (50, 60)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {i: len(words(t)) for i, t in texts(STAGES["passage-dedup"](spark, docs, SF)).items()}
    assert all(left[i] == (60 if i % 100 == 60 else len(words(t))) for i, t in rows)


def test_mixture(spark, tables):
    """Copies as the operator's SQL takes words, on this stage's own input."""
    before, after = tables["mixture"]
    con = duckdb.connect()
    con.register("documents", before.select("doc_id", "source", "text").toArrow())
    want = {i: taken // size for i, size, taken in con.sql(f"SELECT doc_id, size, taken FROM ({mixing.OP1_SQL}) WHERE size > 0").fetchall()}
    got = {r["doc_id"]: r["count"] for r in after.where(F.length("text") > 0).groupBy("doc_id").count().collect()}
    assert {i: got.get(i, 0) for i in want} == want


def test_encoding(tables):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    before, after = tables["encoding"]
    assert sorted((r["doc_id"], r["ids"]) for r in after.collect()) == sorted((r["doc_id"], sp.encode(r["text"] or "")) for r in before.collect())
    assert after.where("n_tokens <> size(ids)").count() == 0


LONG = " ".join(f"w{k}" for k in range(90))
OTHER = " ".join(f"v{k}" for k in range(90))
ROWS = [(1, LONG, "a"), (1, LONG, "a"), (1, OTHER, "b"), (2, OTHER + " tail", "b"), (None, LONG, "c"), (None, "x y z", "c"), (None, "x y z", "c"), (3, None, None), (4, "", "b"), (5, "q " * 3000, "a")]
EXTRA = ("copies", "_copies", "_copy", "n_words", "_n_words", "score", "_score", "predicted", "_id", "_hash", "ids", "node", "kept", "text_hash", "key", "_key", "size")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("odd")
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumns({c: F.lit(f"user {c}") for c in EXTRA}).write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 5), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    return str(root)


def rows_of(df):
    return sorted((r["doc_id"] or 0, r["text"] or "", r["source"] or "") for r in df.collect())


@pytest.mark.parametrize("name", [n for n in STAGES if n != "encoding"])
def test_odd_rows_and_columns(spark, odd, name):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = STAGES[name](spark, docs, odd)
    assert out.columns == docs.columns and all(r[c] == f"user {c}" for r in out.collect() for c in EXTRA)
    want = {
        "toxicity": rows_of(docs),
        "near-dedup": sorted([(1, LONG, "a"), (1, OTHER, "b"), (0, "x y z", "c"), (3, "", ""), (5, "q " * 3000, "a")]),
        "passage-dedup": None,
        "mixture": None,
    }[name]
    if want is not None:
        assert rows_of(out) == want
    if name == "passage-dedup":
        left = {(r["doc_id"], len(words(r["text"]))) for r in out.collect()}
        assert out.count() == len(ROWS) and {(1, 90), (2, 1), (None, 0), (None, 3), (3, 0), (4, 0)} <= left
    if name == "mixture":
        copies = {(r["doc_id"], r["source"], r["text"]): r["count"] for r in out.groupBy("doc_id", "source", "text").count().collect()}
        per = {k: ROWS.count(k) for k in set(ROWS)}
        assert all(copies.get((i, s, t), 0) % per[i, t, s] == 0 and copies.get((i, s, t), 0) <= 3 * per[i, t, s] for i, t, s in per) and any(k[0] is None for k in copies)


def test_run_on_odd_rows(spark, odd, tmp_path):
    out = corpus_pipeline.run(spark, odd)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids"] and out.count() > 0 and out.where("doc_id IS NULL").count() > 0
    docs = spark.read.parquet(f"{odd}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
