"""SentencePiece encoding and decoding of merge-type vocabularies by an agenda of adjacent symbol pairs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, text_slices, tidy
from .segments import SegmentCache, by_document, reach

_SPACE = "▁"
_CODERS: dict[str, "PieceCoder"] = {}


class PieceCoder:
    """Encoder and decoder of one model file, made once in a Python worker.

    The agenda holds the adjacent pairs of every word of a batch, one row of a matrix per word: each round takes each
    word's pair of the best score (the leftmost among equals), merges it and scores the two pairs beside it, until no
    pair is in the vocabulary. Characters outside the vocabulary become byte pieces. Every batch of unseen segments is
    compared with the sentencepiece library's own encoding; a difference raises.
    """

    def __init__(self, model: str, verify: bool = True):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.verify = verify
        n = self.sp.get_piece_size()
        kinds = [(self.sp.is_unknown(i), self.sp.is_control(i), self.sp.is_byte(i), self.sp.is_unused(i)) for i in range(n)]
        names = [self.sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not any(kinds[i])]
        self.id_of = {names[i]: i for i in plain}
        self.byte_id = np.zeros(256, np.int32)
        for i in range(n):
            if kinds[i][2]:
                self.byte_id[int(names[i][3:-1], 16)] = i
        self.reach = reach([names[i].replace(_SPACE, " ").encode() for i in plain])
        pairs = []
        for i in plain:
            p = names[i]
            for k in range(1, len(p)):
                a, b = self.id_of.get(p[:k]), self.id_of.get(p[k:])
                if a is not None and b is not None:
                    pairs.append((a * n + b, self.sp.get_score(i), i))
        # a character that is no piece by itself may still be merged: it gets an id beyond the vocabulary
        self.lone = {}
        for i in plain:
            for c in names[i]:
                if c not in self.id_of and c not in self.lone:
                    self.lone[c] = n + len(self.lone)
        if self.lone:
            wide = self.id_of | self.lone
            n2 = n + len(self.lone)
            pairs = [(wide[p[:k]] * n2 + wide[p[k:]], self.sp.get_score(self.id_of[p]), self.id_of[p]) for p in self.id_of for k in range(1, len(p)) if p[:k] in wide and p[k:] in wide]
            n = n2
        self.n = n
        self.wide = {ord(c): i for c, i in (self.id_of | self.lone).items() if len(c) == 1}
        self.symbol = np.full(0x10000, -1, np.int64)
        for c, i in self.wide.items():
            if c < 0x10000:
                self.symbol[c] = i
        order = sorted(range(len(pairs)), key=lambda i: pairs[i][0])
        self.pair = np.array([pairs[i][0] for i in order], np.int64)
        scores = np.array([-pairs[i][1] for i in order])
        self.rank = np.unique(scores, return_inverse=True)[1].astype(np.int32)  # 0 is the best; equal scores are equal
        self.made = np.array([pairs[i][2] for i in order], np.int32)
        self.cache = SegmentCache(self.encode_segments)

    def _score(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        none = np.int32(2**31 - 1)
        key = np.where((a >= 0) & (b >= 0), a.astype(np.int64) * self.n + b, -1)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        ok = self.pair[at] == key
        return np.where(ok, self.rank[at], none), np.where(ok, self.made[at], -1)

    def _agenda(self, rows: np.ndarray) -> np.ndarray:
        """rows: symbols by word, -1 beyond the end (and for characters that never merge, -2 - place)."""
        none = np.int32(2**31 - 1)
        m, width = rows.shape
        if width < 2:
            return rows
        out = rows.copy()
        live = np.arange(m)
        cur = rows.copy()
        rank, made = self._score(cur[:, :-1], cur[:, 1:])
        while len(live):
            best = rank.argmin(axis=1)
            r = np.arange(len(live))
            go = rank[r, best] != none
            if not go.all():
                out[live[~go], : cur.shape[1]] = cur[~go]
                out[live[~go], cur.shape[1] :] = -1
                live, cur, rank, made, best = live[go], cur[go], rank[go], made[go], best[go]
                if not len(live):
                    break
                r = np.arange(len(live))
            new = made[r, best]
            w = cur.shape[1]
            col = np.arange(w - 1)[None, :]
            take = col + (col > best[:, None])  # the right symbol of the pair goes
            cur = np.take_along_axis(cur, take, 1)
            cur[r, best] = new
            if w == 2:
                out[live, :1] = cur
                out[live, 1:] = -1
                break
            # the pair's own entry goes; the entries on either side are scored anew
            keep = np.arange(w - 2)[None, :]
            keep = keep + (keep >= best[:, None])
            rank, made = np.take_along_axis(rank, keep, 1), np.take_along_axis(made, keep, 1)
            for side, rows_ in ((best - 1, r[best > 0]), (best, r[best < w - 2])):
                p = side[rows_]
                rank[rows_, p], made[rows_, p] = self._score(cur[rows_, p], cur[rows_, p + 1])
        return out

    def encode_segments(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments in a row, number of ids of each)."""
        words = [s.decode().replace(" ", _SPACE) for s in segments]
        size = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        first = np.cumsum(size) - size
        known = self.symbol[np.minimum(chars, 0xFFFF)]
        known = np.where(chars < 0x10000, known, [self.wide.get(int(c), -1) for c in chars] if (chars > 0xFFFF).any() else -1)
        order = np.argsort(size, kind="stable")
        sizes = size[order]
        flats, counts = [], np.zeros(len(words), np.int64)
        i = 0
        while i < len(order):
            # words of like length share a matrix
            w = int(sizes[i])
            j = min(int(np.searchsorted(sizes, w + max(2, w // 4), "right")), i + max(1, 400_000 // max(w, 1)))
            part, width = order[i:j], int(sizes[j - 1])
            grid = np.arange(width)[None, :] < size[part][:, None]
            place = (first[part][:, None] + np.arange(width)[None, :])[grid]
            rows = np.full((len(part), width), -1, np.int64)
            rows[grid] = np.where(known[place] >= 0, known[place], -2 - place)
            done = self._agenda(rows)
            used = done != -1
            flat, n = done[used], used.sum(axis=1)
            odd = (flat < 0) | (flat >= self.n - len(self.lone))
            if odd.any():  # characters outside the vocabulary become their bytes
                owner = np.repeat(np.arange(len(part)), n)
                back = {v: ord(c) for c, v in self.lone.items()}
                pieces = [[y] if not o else self.byte_id[np.frombuffer(chr(back[y] if y >= 0 else int(chars[-2 - y])).encode(), np.uint8)].tolist() for y, o in zip(flat.tolist(), odd.tolist())]
                n = np.bincount(owner, [len(x) for x in pieces], len(part)).astype(np.int64)
                flat = np.fromiter((y for x in pieces for y in x), np.int64)
            flats.append(flat)
            counts[part] = n
            i = j
        flat = np.concatenate(flats).astype(np.int32)
        n = counts[order]
        at = np.empty(len(words), np.int64)
        at[order] = np.cumsum(n) - n
        take = np.arange(len(flat)) + np.repeat(at - (np.cumsum(counts) - counts), counts)
        ids = flat[take]
        if self.verify:
            lib = self._library(words)
            if not (np.array_equal(counts, [len(x) for x in lib]) and np.array_equal(ids, np.fromiter(chain.from_iterable(lib), np.int32))):
                raise AssertionError("the agenda and the sentencepiece library differ")
        return ids, counts

    def _library(self, words: list[str]) -> list[list[int]]:
        """The library's ids of each segment. It puts a space in front, so a leading one is left to it; other segments are read behind a line feed, which never merges."""
        lead = [len(w) > 1 and w[0] == _SPACE for w in words]
        got = self.sp.encode([w[1:] if a else "\n" + w for w, a in zip(words, lead)], num_threads=1)
        skip = len(self.sp.encode("\n"))
        return [g if a else g[skip:] for g, a in zip(got, lead)]

    def encode_slice(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, id offsets by document) of concatenated texts."""
        n = len(offsets) - 1
        size = np.diff(offsets)
        some = size > 0
        # one space in front of each text that is not empty
        put = np.cumsum(some) - some
        data = np.full(len(raw) + int(some.sum()), 32, np.uint8)
        data[np.arange(len(raw)) + np.repeat(put + some, size)] = raw
        at = offsets + np.append(put, some.sum())
        if data.size and (data == 0xE2).any():
            blob = data.tobytes()
            if _SPACE.encode() in blob:  # the library reads this character as a space
                parts = [blob[i:j].replace(_SPACE.encode(), b" ") for i, j in zip(at[:-1], at[1:])]
                data = np.frombuffer(b"".join(parts), np.uint8)
                at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        cut = np.empty(len(data), bool)
        cut[0] = True
        cut[1:] = ~self.reach[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)
        cut[at[:-1][some]] = True
        starts = np.flatnonzero(cut)
        ids, per = self.cache.ids(data, starts)
        return ids, by_document(per, starts, at)


def coder(model: str) -> PieceCoder:
    if model not in _CODERS:
        _CODERS[model] = PieceCoder(model)
    return _CODERS[model]


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with `ids` array<int>, the SentencePiece encoding of each whole text, and with `decoded`, the library's decoding.

    Null and empty texts give no ids and an empty decoding. Rows, ties and other columns stay as they are; columns
    named like the outputs are replaced. No shuffle; memory is bounded by a slice of texts and the segment cache.
    """
    outs = [ids] + [decoded] * (decoded is not None)
    keep = [c for c in docs.columns if c not in outs]
    schema = docs.select(*keep).schema
    for name, kind in zip(outs, (T.ArrayType(T.IntegerType()), T.StringType())):
        schema = schema.add(name, kind)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        for batch in batches:
            for rows, raw, offsets in text_slices(batch, text):
                got, at = c.encode_slice(raw, offsets)
                cols = list(rows.columns) + [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(got))]
                if decoded is not None:
                    cols.append(pa.array([c.sp.decode(got[i:j].tolist()) if j > i else "" for i, j in zip(at[:-1], at[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=keep + outs)

    return docs.select(*keep).mapInArrow(run, schema)


def digests(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row's encoding, without the ids themselves."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        digits = np.array([str(i) for i in range(c.sp.get_piece_size())], object)
        for batch in batches:
            for rows, raw, offsets in text_slices(batch, "_t"):
                got, at = c.encode_slice(raw, offsets)
                n, a, b = np.diff(at), [], []
                for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                    x = got[i:j]
                    a.append(hashlib.sha256(",".join(digits[x].tolist()).encode()).hexdigest())
                    b.append(hashlib.sha256(c.sp.decode(x.tolist()).encode() if j > i else b"").hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_t")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
