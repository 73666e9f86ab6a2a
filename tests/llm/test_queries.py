"""The registered queries of the ten operators on whole tables, every contract column against a plain version."""

import hashlib
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

tokenizers = pytest.importorskip("public_tokenizers")

from tidemark.llm import media_avi, queries, suffix_dedup, token_files, toxicity  # noqa: E402
from tidemark.llm.common import written  # noqa: E402

from .test_operators import brute_fingerprint, brute_removed, text_of  # noqa: E402

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: text_of(r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def by_id(df, key="doc_id"):
    rows = df.collect()
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
@pytest.mark.parametrize("sf", [SMALL, MORE])
def test_query_equals_its_sql(spark, name, sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = queries.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    con.execute(f"CREATE VIEW _wanted AS {queries.ORACLES[name]}")
    want = con.sql(f"SELECT {', '.join(cols)} FROM _wanted").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(repr, want))


def test_op2(spark):
    got = by_id(queries.QUERIES["op2_toxicity_counterfactual"](spark, MORE))
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{MORE}/labels.parquet").collect()}
    texts = {r["doc_id"]: text_of(r["text"]) for r in spark.read.parquet(f"{MORE}/documents.parquet").collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(got[i]["score"], y) for i, y in labels.items() if got[i]["held_out"] and y is not None]
    right = sum((s >= 0.7) == y for s, y in held) / len(held)
    pairs = [(a > b) + (a == b) / 2 for a, y in held for b, z in held if y > z]
    assert right >= 0.95 and sum(pairs) / len(pairs) >= 0.85, (right, sum(pairs) / len(pairs))


def test_scores_equal_the_plain_sum_of_weights(spark, docs):
    frame = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(frame, spark.read.parquet(f"{SMALL}/labels.parquet"), rows=300, most=500)
    got = by_id(toxicity.score(frame, model, out=("s", "p")))
    for i, t in docs.items():
        z = model.bias + sum(model.weights.get(f, 0.0) for f in toxicity.features(set(re.findall(r"\w+", t.lower()))))
        assert got[i]["s"] == pytest.approx(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))), abs=1e-9)


def test_fit_ignores_odd_labels(spark):
    frame = spark.createDataFrame([(i, "bad words here" if i % 2 else "kind words there") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, (i % 2) if i < 50 else 7) for i in range(60)] + [(3, None), (900, 1)], "doc_id long, toxic int")
    model = toxicity.fit(frame, labels)
    assert model.score("bad here") > 0.7 > model.score("kind there")


def test_op3_cuts_exact_repeats(spark):
    """Words in a run of 50 that a document of a smaller id has, by a dictionary of all runs: nearly all are cut."""
    frame = spark.read.parquet(f"{MORE}/documents.parquet")
    texts = sorted((r["doc_id"], text_of(r["text"])) for r in frame.select("doc_id", "text").collect())
    got, seen, want, cut = by_id(queries.QUERIES["op3_collinear_chains"](spark, MORE)), {}, 0, 0
    for i, t in texts:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        runs = [hash(tuple(w[k : k + 50])) for k in range(len(w) - 49)]
        gone = np.zeros(len(w), bool)
        for k, h in enumerate(runs):
            if h in seen:
                gone[k : k + 50] = True
        for h in runs:
            seen.setdefault(h, i)
        want, cut = want + int(gone.sum()), cut + min(int(gone.sum()), got[i]["n_removed"])
        assert got[i]["n_words"] == len(w) and (got[i]["n_removed"] > 0) == (got[i]["n_passages"] > 0)
        assert got[i]["n_removed"] > 0 or got[i]["kept_sha256"] == sha(t)
    assert want > 10_000 and cut >= 0.99 * want


def test_op4(spark, docs):
    got = by_id(queries.QUERIES["op4_simhash_variants"](spark, SMALL))
    prints = {i: brute_fingerprint(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in docs:
        for j in docs:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{prints[i]:016x}", find(i)) for i in docs}


def test_op5(spark, docs):
    got = by_id(queries.QUERIES["op5_avi_mjpeg"](spark, SMALL))
    for i, t in docs.items():
        raw, r = t.encode(), got[i]
        body = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        flat = np.zeros(-(-len(body) // media_avi.FRAME) * media_avi.FRAME, np.uint8)
        flat[: len(body)] = np.frombuffer(body, np.uint8)
        file = media_avi.write_avi(media_avi.encode_frames(flat.reshape(-1, media_avi.FRAME)), len(raw), len(body))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(body), sha(body), zlib.crc32(body[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(file), sha(file))
        frames, mean = len(flat) // media_avi.FRAME, flat.mean()
        assert r["feature"] == f"frames={frames} shots={len(r['clips'])} mean={mean:.3f}"
        assert sum(c["n_frames"] for c in r["clips"]) == frames and [c["clip"] for c in r["clips"]] == list(range(len(r["clips"])))
        assert all(a["first_frame"] + a["n_frames"] == b["first_frame"] for a, b in zip(r["clips"], r["clips"][1:]))


def test_op6(spark):
    got = by_id(queries.QUERIES["op6_sorted_projections"](spark, MORE), "vec_id")
    rows = spark.read.parquet(f"{MORE}/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    assert [got[r["vec_id"]]["n_links"] for r in rows] == near.sum(1).tolist()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_op7(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    got = by_id(queries.QUERIES["op7_sentencepiece"](spark, SMALL))
    for i, t in docs.items():
        ids = sp.encode(t)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))


def test_op9(spark, docs):
    got = by_id(queries.QUERIES["op9_suffix_refinement"](spark, SMALL))
    rows = sorted((i, t.encode()) for i, t in docs.items())
    assert [tuple(got[i])[1:] for i, _ in rows] == brute_removed(rows)


@pytest.mark.parametrize("length, hot", [(16, False), (33, True), (50, True), (150, False), (150, True)])
def test_strings_of_other_lengths(spark, monkeypatch, length, hot):
    """Also with every q-gram dealt out as a hot one."""
    rng = np.random.default_rng(length)
    shared = "".join(rng.choice(list("abcd "), 400))
    rows = [(i, "".join(rng.choice(list("abcd "), 60)) + shared[a : a + n]) for i, (a, n) in enumerate(zip(rng.integers(0, 200, 12).tolist(), rng.integers(10, 200, 12).tolist()))]
    if hot:
        cut = [suffix_dedup.pieces(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), length)[4] for _, t in rows if len(t) > length]
        monkeypatch.setattr(suffix_dedup, "hot_grams", lambda *_: np.unique(np.concatenate(cut)))
    got = by_id(suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), length=length))
    first = {}
    for i, t in rows:
        for k in range(len(t) - length + 1):
            first.setdefault(t[k : k + length], i)
    for i, t in rows:
        gone = set()
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone |= set(range(k, k + length))
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (len(gone), sha("".join(c for k, c in enumerate(t) if k not in gone))), (i, length)


def test_hot_grams(spark, monkeypatch):
    """A q-gram in most rows, between words that differ, is found hot; with it rows are dealt out and strings still found."""
    monkeypatch.setattr(suffix_dedup, "SAMPLED", 1)
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 60))
    rows = [(i, f"{word()}{word()}") for i in range(40)]
    cut = [suffix_dedup.pieces(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 50) for _, t in rows]
    least = min((int(h), t[g : g + 8]) for (_, t), c in zip(rows, cut) for h, g in zip(c[4], c[3]))[1]  # wins wherever it stands
    rows = [(i, t[:60] + least + t[60:]) for i, t in rows] + [(100, rows[3][1][30:60] + least + rows[3][1][60:90])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id AS key", "text AS _t")
    assert len(suffix_dedup.hot_grams(df, 50, 4)) >= 1 and len(suffix_dedup.hot_grams(df.limit(0), 50, 4)) == 0
    got = by_id(suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[100]["n_removed"] == 68 and sum(r["n_removed"] for r in got.values()) == 68


def test_op10(spark, docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    got, start = by_id(queries.QUERIES["op10_token_parquet"](spark, SMALL)), 0
    for i in sorted(docs):
        ids = tk.encode(docs[i], add_special_tokens=False).ids + [0]
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_rows_of_one_id_and_long_texts(spark):
    """Texts longer than the slices that kernels take at a time, repeated ids and empty ones, through operators 5, 9 and 10."""
    import tokenizers as library

    rng = np.random.default_rng(5)
    long = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 700_000))
    rows = [(1, long), (2, "é" * 40 + long[2_000_000:2_600_000]), (2, ""), (2, None), (None, long[100:400])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for r in media_avi.features(written(media_avi.to_media(df), "media")).collect():
        assert r["payload_sha256"] in {sha(t.encode() + b"\0" * (max(64, -(-len(t.encode()) // 64) * 64) - len(t.encode()))) for t in (text_of(t) for _, t in rows)} and r["clips"]
    gone = sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.deduplicate(df).collect())
    assert gone == sorted([(len(long), 0, 0), (80 + 600_000, 600_000, 1), (0, 0, 0), (0, 0, 0), (300, 300, 1)])
    path = written(df, "rows").inputFiles()[0].rsplit("/", 1)[0] + "-tokens"
    token_files.write_tokens(df, path, tokenizers.path("byte_bpe_50k.json"), encoding="delta")
    tk = library.Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    want = sorted(len(tk.encode(text_of(t), add_special_tokens=False).ids) + 1 for _, t in rows)
    back = token_files.read_tokens(spark, path).collect()
    assert sorted(r["n_tokens"] for r in back) == want and sorted(r["start"] for r in back)[0] == 0
    at = sorted((r["start"], r["n_tokens"]) for r in back)
    assert all(a + n == b for (a, n), (b, _) in zip(at, at[1:]))
