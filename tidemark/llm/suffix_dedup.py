"""Exact substring dedup by bucket-pointer refinement of the suffixes that start a repeated string."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_parts, table, text_slices, tidy, written

#: Bytes of a q-gram: it picks the task of a string, and its buckets are the first ones.
Q = 8
#: Bytes of piece text that are refined together; pieces of one q-gram stay together.
REFINE_BYTES = 3 << 20
SLICE = 4 << 20  # text bytes cut into pieces together
LEVEL = 6  # of zstd in blobs
SAMPLED = 16  # one row of so many is read for hot q-grams
NO_ID = np.int64(2**63 - 1)  # stands for a null doc_id, which removes nothing
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240913).integers(1, 1 << 63, 256, dtype=np.uint64)
_KINDS = (np.uint8, np.uint32, np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    parts = [struct.pack("<B", len(arrays))]
    for a in arrays:
        parts += [struct.pack("<BQ", _KINDS.index(a.dtype.type), a.size), a.tobytes()]
    return zstandard.compress(b"".join(parts), LEVEL)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    at, out = 1, []
    for _ in range(raw[0]):
        kind, n = struct.unpack_from("<BQ", raw, at)
        out.append(np.frombuffer(raw, _KINDS[kind], n, at + 9))
        at += 9 + n * out[-1].itemsize
    return out


def _code8(d: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number (fewer places than bytes by 7)."""
    c = d.astype(np.uint64)
    c = c[:-1] | (c[1:] << np.uint64(8))
    c = c[:-2] | (c[2:] << np.uint64(16))
    return c[:-4] | (c[4:] << np.uint64(32))


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[k], ..., start[k] + size[k] - 1 for each k in a row."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(max(n, 1), base)
    out[0] = 1
    return np.multiply.accumulate(out)


def pieces(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, place, size, q-gram's place, q-gram's hash) of pieces that hold every `length`-byte string once.

    A string's q-gram is its q-gram of the least hash, the leftmost among equals; strings in a row with the q-gram at
    one place are a piece. Equal strings have equal q-grams, so their pieces meet.
    """
    per = np.maximum(np.diff(offsets) - (length - 1), 0)
    total = int(per.sum())
    if not total:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(np.uint32)
    c = _code8(raw)
    c = c[: len(c) - (Q - 8)] * np.uint64(0xC2B2AE3D27D4EB4F) + c[Q - 8 :] * np.uint64(0x165667B19E3779F9)
    c ^= c >> np.uint64(29)
    c *= np.uint64(0xBF58476D1CE4E5B9)
    h = (c & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(c), dtype=np.uint64)
    span = length - Q + 1
    low, width = h, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    start = _spread(offsets[:-1], per)
    at = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (np.diff(start) != 1)]))
    n = np.diff(np.append(new, total))
    first = start[new]
    return np.searchsorted(offsets, first, "right") - 1, first, n + length - 1, at[new], (c[at[new]] >> np.uint64(32)).astype(np.uint32)


def _sided(place: np.ndarray, size: np.ndarray, mark: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces parted by whether a string has `side` bytes behind its q-gram: (piece, place, size, q-gram's offset, where the
    side + Q bytes begin, from the part's place, that all strings of the part hold around their q-gram)."""
    side = (length - Q) // 2
    last = size - length  # the last string's place
    first = np.maximum(mark - (length - Q - side), 0)  # from here on strings have the room behind
    behind = np.flatnonzero(first <= last)
    before = np.flatnonzero(first > 0)
    piece = np.concatenate([behind, before])
    shift = np.concatenate([first[behind], np.zeros(len(before), np.int64)])
    n = np.concatenate([(size - first)[behind], np.minimum(last, first - 1)[before] + length])
    at = mark[piece] - shift
    return piece, place[piece] + shift, n, at, at - np.where(np.arange(len(piece)) < len(behind), 0, side)


def _alike(raw: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The number of a piece with the same bytes, the same for all of these."""
    n = len(raw)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * _powers(n, _BASE))])
    h = (total[place + size] - total[place]) * _powers(n, _INVERSE)[place] + size.astype(np.uint64)
    order = np.argsort(h, kind="stable")
    s = h[order]
    head = np.concatenate([[True], s[1:] != s[:-1]])
    group = np.empty(len(h), np.int64)
    group[order] = order[np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))]
    other = np.flatnonzero(group != np.arange(len(h)))
    if len(other):  # hashes only suggest: the bytes decide
        lead = group[other]
        same = size[lead] == size[other]
        check, lead = other[same], lead[same]
        differ = raw[_spread(place[check], size[check])] != raw[_spread(place[lead], size[check])]
        bad = np.logical_or.reduceat(differ, np.cumsum(size[check]) - size[check]) if len(check) else np.zeros(0, bool)
        group[other[~same]] = other[~same]
        group[check[bad]] = check[bad]
    return group


def refine(text: np.ndarray, start: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, bucket) of every `length`-byte string within the pieces of text: equal buckets are equal strings.

    Buckets begin as 8-grams. A bucket of strings of d bytes is refined by the bucket identifier d bytes on, which
    gives buckets of 2d bytes; the new identifiers serve the next round, and the last takes the offset that ends at
    `length`. A string alone in its bucket is final and is not sorted again.
    """
    end = np.repeat(start + size, size)
    place = _spread(start, size)
    depth = 8
    room = place + depth <= end
    code = np.zeros(len(text), np.uint64)
    c = _code8(text)
    code[: len(c)] = c
    bucket = np.zeros(len(text), np.int64)
    _, back, count = np.unique(code[place[room]], return_inverse=True, return_counts=True)
    bucket[place[room]] = back
    alone = np.zeros(len(text), bool)
    alone[place[room]] = count[back] == 1
    used = len(count)
    while depth < length:
        step = min(depth, length - depth)
        room = place + depth + step <= end
        now = place[room]
        live = now[~alone[now]]
        if len(live):
            pair = bucket[live].astype(np.uint64) << np.uint64(32) | bucket[live + step].astype(np.uint64)
            _, back, count = np.unique(pair, return_inverse=True, return_counts=True)
            fresh = bucket.copy()
            fresh[live] = used + back
            used += len(count)
            alone[live] = count[back] == 1
            bucket = fresh
        depth += step
    now = place[place + length <= end]
    return now, bucket[now]


def _context(text: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """A number for the `size` bytes from each place; unlike bytes may share one, equal bytes always do."""
    code = np.zeros(len(first), np.uint64)
    for k in [*range(0, size - 8, 8), size - 8]:
        word = text[first[:, None] + np.arange(k, k + 8)].view(np.uint64)[:, 0]
        code = (code ^ word) * np.uint64(0xBF58476D1CE4E5B9)
        code ^= code >> np.uint64(29)
    return code


def _repeated(blobs: list[bytes], length: int) -> Iterator[bytes]:
    """Spans of the pieces in blobs whose strings also start in a document of a smaller id."""
    if not blobs:
        return
    rows = [_unpack(b) for b in blobs]
    base = np.cumsum([0] + [len(r[0]) for r in rows])
    key, ids = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    doc = np.concatenate([r[2].astype(np.int64) + b for r, b in zip(rows, base)])
    place, size, mark = (np.concatenate([r[k] for r in rows]).astype(np.int64) for k in (3, 4, 5))
    text = np.concatenate([r[6] for r in rows])
    del rows
    start = np.cumsum(size) - size
    one = _context(text, start + mark, Q)
    order = np.argsort(one, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(one[order].view(np.int64)) != 0) + 1, len(order))
    mass = np.cumsum(size[order])
    done = first = 0
    while done < len(ends):  # whole q-gram buckets, REFINE_BYTES at a time
        limit = (mass[first - 1] if first else 0) + REFINE_BYTES
        done = max(done + 1, int(np.searchsorted(mass[ends - 1], limit, "right")))
        part = order[first : ends[done - 1]]
        first = ends[done - 1]
        n = size[part]
        yield from _repeated_block(text[_spread(start[part], n)], key[doc[part]], ids[doc[part]], place[part], n, mark[part], length)


def _repeated_block(text: np.ndarray, key: np.ndarray, who: np.ndarray, place: np.ndarray, size: np.ndarray, mark: np.ndarray, length: int) -> Iterator[bytes]:
    """As _repeated, for the pieces of whole q-gram buckets, whose bytes follow each other in text."""
    start = np.cumsum(size) - size
    # pieces alike are refined once, with the smallest doc_id; all strings of the others also start there
    group = _alike(text, start, size)
    least = np.full(len(start), NO_ID)
    np.minimum.at(least, group, who)
    whole = who > least[group]
    if whole.any():
        yield _spans(key[whole], who[whole], place[whole], place[whole] + size[whole])
    left = np.flatnonzero(~whole)
    # a string of `length` bytes reaches SIDE bytes beyond its q-gram on one side at least: buckets of q-grams are
    # refined by what stands there, and pieces alone with their document on both sides are final
    at, side = start + mark, (length - Q) // 2
    keep = np.zeros(len(start), bool)
    for head, room in ((at - side, mark >= side), (at, mark + Q + side <= size)):
        x = left[room[left]]
        if len(x):
            code = _context(text, head[x], Q + side)
            by = np.argsort(code, kind="stable")
            heads = np.flatnonzero(np.concatenate([[True], np.diff(code[by].view(np.int64)) != 0]))
            w = who[x][by]
            keep[x[by]] |= np.repeat(np.minimum.reduceat(w, heads) != np.maximum.reduceat(w, heads), np.diff(np.append(heads, len(x))))
    part = np.flatnonzero(keep)
    if not len(part):
        return
    n = size[part]
    at, bucket = refine(text[_spread(start[part], n)], np.cumsum(n) - n, n, length)
    owner = np.repeat(np.arange(len(part)), n - (length - 1))
    own = who[part][owner]
    by = np.argsort(bucket, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], np.diff(bucket[by]) != 0]))
    least = np.empty(len(by), np.int64)
    least[by] = np.repeat(np.minimum.reduceat(own[by], heads), np.diff(np.append(heads, len(by))))
    gone = np.flatnonzero(least < own)
    if len(gone):
        cut = np.concatenate([[True], (np.diff(gone) != 1) | (np.diff(owner[gone]) != 0)])
        a, b = gone[cut], gone[np.concatenate([cut[1:], [True]])]
        p = part[owner[a]]
        off = place[p] - (np.cumsum(n) - n)[owner[a]]
        yield _spans(key[p], who[p], at[a] + off, at[b] + off + length)


def _spans(key: np.ndarray, who: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """Spans packed by row: its hash and doc_id, which together name it, and the number, places and sizes of its spans."""
    order = np.lexsort((start, who, key))
    key, who, start, end = key[order], who[order], start[order], end[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (who[1:] != who[:-1])])
    return _pack(
        key[new].astype(np.int64), who[new].astype(np.int64), np.diff(np.append(np.flatnonzero(new), len(key))).astype(np.uint32), start.astype(np.uint32),
        (end - start).astype(np.uint32),
    )


def _by_part(blob: bytes, parts: int) -> Iterator[tuple[int, bytes]]:
    """Packed spans dealt out by their rows' keys."""
    key, who, n, start, size = _unpack(blob)
    home = key.view(np.uint64) % np.uint64(parts)
    owner = np.repeat(home, n)
    for p in np.unique(home):
        yield int(p), _pack(key[home == p], who[home == p], n[home == p], start[owner == p], size[owner == p])


_ROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ROW)], schema=_ROW)


def hot_grams(rows: DataFrame, length: int, parts: int) -> np.ndarray:
    """Hashes of q-grams, in order, that hold over a quarter of a partition's mean share of all pieces, by one row in
    SAMPLED: at most 4 x parts. They only say how pieces are dealt out; any choice finds the same strings."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw, offsets in text_slices(batch, "_t", SLICE):
                _, place, size, _, h = pieces(raw, offsets, length)
                if len(h):
                    own = _alike(raw, place, size) == np.arange(len(h))  # as pieces alike leave a slice once
                    gram, n = np.unique(h[own], return_counts=True)
                    cols = [np.append(gram.astype(np.int64), -1), np.append(n, n.sum())]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["gram", "n"])

    counts = rows.where(F.pmod("key", F.lit(SAMPLED)) == 0).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = written(counts.where(F.col("n") > 1), "gram-counts")
    total = counts.where("gram = -1").first()
    if total is None:
        return np.zeros(0, np.uint32)
    found = counts.where((F.col("gram") >= 0) & (F.col("n") > total["n"] / (4 * parts))).select("gram").toArrow().column(0).to_numpy()
    return np.sort(found).astype(np.uint32)


def deduplicate(docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row, and with `with_text` kept (binary): each byte
    covered by a `length`-byte string (16 or more) that also starts in a document of a smaller doc_id is removed.

    Texts are UTF-8 bytes, null is empty; strings stay within a row and are judged on the input. Rows of one doc_id
    do not remove each other's bytes; a null doc_id counts as larger than all others. Every row is kept; an empty
    table gives none.

    Pieces of texts are dealt out by their q-grams in compressed blobs; those of hot q-grams by what stands on one side of
    them too, which all equal strings share. Pieces alike within a slice of texts leave it
    once, with the smallest doc_id, so a passage that a third of all rows share is one piece a slice. Buckets are
    refined within a task in blocks of REFINE_BYTES; spans and texts then meet by row.
    """
    if length < 2 * Q:
        raise ValueError(f"strings of at least {2 * Q} bytes are asked for")
    parts = shuffle_parts(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    rows = rows.select(F.xxhash64("id", "_t").alias("key"), "id", "_t")

    hot = hot_grams(rows, length, parts)
    small = np.uint8 if 2 * length - Q < 256 else np.uint32  # holds a piece's size

    def ids_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return np.asarray(batch.column(0)), np.asarray(batch.column(1).fill_null(int(NO_ID)))

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, raw, offsets in text_slices(batch, "_t", SLICE):
                key, ids = ids_of(some)
                doc, place, size, gram, h = pieces(raw, offsets, length)
                if not len(doc):
                    continue
                group = _alike(raw, place, size)
                least = np.full(len(doc), NO_ID)
                np.minimum.at(least, group, ids[doc])
                gone = ids[doc] > least[group]
                out = []
                if gone.any():
                    p = place[gone] - offsets[doc[gone]]
                    out += [(home, 2, b) for home, b in _by_part(_spans(key[doc[gone]], ids[doc[gone]], p, p + size[gone]), parts)]
                left = np.flatnonzero(~gone)
                doc, place, size, mark, h = doc[left], place[left], size[left], (gram - place)[left], h[left]
                wide = np.isin(h, hot)
                if wide.any():
                    piece, at, n, m, begin = _sided(place[wide], size[wide], mark[wide], length)
                    context = _context(raw, at + begin, Q + (length - Q) // 2)
                    doc, place, size, mark = (np.concatenate([x[~wide], y]) for x, y in ((doc, doc[wide][piece]), (place, at), (size, n), (mark, m)))
                    h = np.concatenate([h[~wide], (context >> np.uint64(32)).astype(np.uint32)])
                home = h % np.uint32(parts)
                left = np.argsort(home, kind="stable")
                home = home[left]
                heads = np.flatnonzero(np.concatenate([[True], np.diff(home) != 0]))
                for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(left)]):
                    x = left[a:b]
                    mine, back = np.unique(doc[x], return_inverse=True)
                    out.append((int(home[a]), 0, _pack(key[mine], ids[mine].astype(np.int64), back.astype(np.uint32), (place[x] - offsets[doc[x]]).astype(np.uint32), size[x].astype(small), mark[x].astype(small), raw[_spread(place[x], size[x])])))
                yield _batch(out)

    @tidy
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        for batch in batches:
            kind = np.asarray(batch.column(1))
            through = batch.filter(pa.array(kind == 2))
            if through.num_rows:
                yield through
            blobs += batch.column(2).filter(pa.array(kind == 0)).to_pylist()
        for blob in _repeated(blobs, length):
            yield _batch([(home, 2, b) for home, b in _by_part(blob, parts)])

    @tidy
    def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, raw, offsets in text_slices(batch, "_t", SLICE):
                key, ids = ids_of(some)
                here = np.asarray(some.column(1).is_valid()).astype(np.uint8)
                home = key.view(np.uint64) % np.uint64(parts)
                size = np.diff(offsets)
                out = []
                for p in np.unique(home):
                    x = np.flatnonzero(home == p)
                    out.append((int(p), 3, _pack(key[x], ids[x].astype(np.int64), here[x], size[x].astype(np.uint32), raw[_spread(offsets[:-1][x], size[x])])))
                yield _batch(out)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    @tidy
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[np.ndarray]] = []
        spans = None
        for batch in batches:
            for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if kind == 2:
                    found.append(_unpack(blob))
                    continue
                if spans is None:
                    spans = _sorted_spans(found)
                    found = []
                yield _removed(_unpack(blob), *spans)

    def _sorted_spans(found: list[list[np.ndarray]]) -> list[np.ndarray]:
        if not found:
            return [np.zeros(0, np.int64)] * 4
        key, who = (np.concatenate([np.repeat(f[k], f[2]) for f in found]) for k in (0, 1))
        order = np.argsort(key, kind="stable")
        return [key[order], who[order], *(np.concatenate([f[k] for f in found])[order] for k in (3, 4))]

    def _removed(texts: list[np.ndarray], span_key: np.ndarray, span_who: np.ndarray, span_start: np.ndarray, span_size: np.ndarray) -> pa.RecordBatch:
        key, ids, here, size, raw = texts
        size = size.astype(np.int64)
        off = np.cumsum(size) - size
        lo, hi = np.searchsorted(span_key, key, "left"), np.searchsorted(span_key, key, "right")
        take, row = _spread(lo, hi - lo), np.repeat(np.arange(len(key)), hi - lo)
        own = span_who[take] == ids[row]  # hashes of two rows may be alike, then their ids are not
        take, row = take[own], row[own]
        a = span_start[take] + off[row]
        delta = np.bincount(a, minlength=len(raw) + 1).astype(np.int32) - np.bincount(a + span_size[take], minlength=len(raw) + 1).astype(np.int32)
        gone = np.cumsum(delta[:-1]) > 0
        run = gone.copy()
        run[1:] &= ~gone[:-1]
        run[off[size > 0]] |= gone[off[size > 0]]
        n_gone, n_run = (np.diff(np.concatenate([[0], np.cumsum(x)])[np.append(off, len(raw))]) for x in (gone, run))
        kept = raw[~gone].tobytes()
        ends = np.cumsum(size - n_gone)
        texts = [kept[e - n : e] for e, n in zip(ends.tolist(), (size - n_gone).tolist())]
        cols = [
            pa.array(ids, mask=here == 0), pa.array(size), pa.array(n_gone, pa.int64()), pa.array(n_run, pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
        ]
        return pa.RecordBatch.from_arrays(cols + [pa.array(texts, pa.binary())] * with_text, names=names)

    row = "part int, kind int, blob binary"
    spans = rows.mapInArrow(cut, row).repartitionById(parts, "part").mapInArrow(find, row)
    met = spans.union(rows.mapInArrow(pack_texts, row)).repartitionById(parts, "part").sortWithinPartitions("kind")
    return met.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def op9_suffix_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents with strings of 50 bytes.

    Null and empty texts have no bytes; a null doc_id removes nothing and loses what any other document has; rows of one
    doc_id have a row each and leave each other alone; other columns of documents are ignored, so their names cannot
    clash; an empty table gives none.
    """
    return deduplicate(table(spark, sf_dir, "documents"))
