"""Token ids as Parquet list columns: dictionary or delta encoding, controlled row groups and page indexes."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_root, shuffle_parts, table, text_slices, tidy, written
from .segments import SegmentCache, by_document, reach

#: Files of which one row each is broadcast at most (12 bytes).
BROADCAST_FILES = 1_000_000
_ENCODERS: dict[str, "ByteEncoder"] = {}


def _byte_symbols() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from U+0100 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteEncoder:
    """Whole texts to ids as the tokenizers library gives them, by segments that it encodes once each.

    Texts are cut only where the byte-level pre-tokenizer always cuts (before a space that a visible character
    follows; around a single other blank; between letters and punctuation without apostrophes) or, within a
    run of Latin letters, between two bytes that stand side by side in no vocabulary entry.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        byte = _byte_symbols()
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.reach = reach([bytes(byte[c] for c in t) for t in vocab if all(c in byte for c in t)])
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = SegmentCache(self._encode, bound=900_000)
        upper = np.zeros(256, bool)
        upper[65:91] = upper[97:123] = True
        self.letter = upper
        self.mark = np.zeros(256, bool)
        self.mark[np.frombuffer(b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~', np.uint8)] = True
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 13]] = True
        #: bytes that surely start a character that is no white space
        self.visible = np.zeros(256, bool)
        self.visible[33:127] = True
        self.visible[[x for x in range(0xC3, 0xF5) if x not in (0xE1, 0xE2, 0xE3)]] = True

    def _encode(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast([s.decode() for s in segments], add_special_tokens=False)]
        return np.fromiter((i for x in got for i in x), np.int32), np.fromiter(map(len, got), np.int64, len(got))

    def _cuts(self, d: np.ndarray) -> np.ndarray:
        n = len(d)
        cut = np.zeros(n, bool)
        cut[0] = True
        a, b = d[:-1], d[1:]
        latin = (a == 0xC3) & (b >= 0x80) & (b < 0xC0) & (b != 0x97) & (b != 0xB7)  # U+00C0 to U+00FF but for the two signs
        starts = self.letter[d]
        starts[:-1] |= latin
        ends = self.letter[d]
        ends[1:] |= latin
        s, e, mb, ma = starts[1:], ends[:-1], self.mark[b], self.mark[a]
        seen = self.visible[b]
        c = (b == 32) & False
        c[:-1] = (b[:-1] == 32) & self.visible[d[2:]]  # before a space that goes with what follows
        lone = np.zeros(n - 1, bool)  # a single blank behind text
        lone[1:] = self.blank[a[1:]] & ((a[:-1] > 32) & (a[:-1] < 127) | ends[:-2])
        c |= lone & seen
        c |= (self.visible[a] | ends[:-1]) & (a != 32) & (a < 128) & self.blank[b]
        c |= e & mb
        c |= ma & s
        quote = d == 39
        near = np.zeros(n - 1, bool)
        near |= quote[:-1]
        near[1:] |= quote[:-2]
        near[2:] |= quote[:-3] if n > 3 else False
        c |= e & s & ~near & ~self.reach[a, b]
        cut[1:] = c
        return cut

    def encode_slice(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        blob = raw.tobytes()
        if any(t in blob for t in self.added):  # added tokens are found in whole texts
            ids, per = self._encode([blob[i:j] for i, j in zip(offsets[:-1], offsets[1:])])
            return ids, np.concatenate([[0], np.cumsum(per)])
        cut = self._cuts(raw) if len(raw) > 3 else np.arange(len(raw)) == 0
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(cut)
        ids, per = self.cache.ids(raw, starts)
        return ids, by_document(per, starts, offsets)


def encoder(path: str) -> ByteEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int | None = 0,
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_rows: int = 2000,
    doc_id: str = "doc_id",
    text: str = "text",
) -> None:
    """Encode whole texts and write them in ascending doc_id order to Parquet files at `path`.

    Columns: part (the file's place in the order), first (ids of the file before the row), doc_id, n_tokens, tokens
    (array<int>). `encoding` is "dictionary" (ids as bit-packed dictionary places) or "delta" (binary-packed deltas).
    Row groups have at most `row_group_bytes`, pages at most `page_rows` rows; both carry the statistics and page
    indexes by which a reader skips to a doc_id or reads n_tokens without any ids.

    Null texts are empty, null doc_ids come first, rows of equal doc_id are ordered by a hash of
    their texts and all kept, over several partitions if they are many. An empty
    table gives files without rows. A range partition holds whole rows; its ids are made slice by slice.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, enc = TaskContext.get().partitionId(), 0, encoder(vocabulary)
        for batch in batches:
            for rows, raw, offsets in text_slices(batch, "_t"):
                ids, at = enc.encode_slice(raw, offsets)
                if end_id is not None:
                    ids = np.insert(ids, at[1:], end_id)
                    at = at + np.arange(len(at))
                n, first = np.diff(at), done + at[:-1]
                done += int(at[-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), pa.array(first, pa.int64()), rows.column(0), pa.array(n, pa.int32()), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))],
                    names=["part", "first", "doc_id", "n_tokens", "tokens"],
                )

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("_h", F.xxhash64("_t"))
    ordered = narrow.repartitionByRange(shuffle_parts(docs.sparkSession), "doc_id", "_h").sortWithinPartitions("doc_id", "_h", "_t")
    out = ordered.mapInArrow(run, "part int, first long, doc_id long, n_tokens int, tokens array<int>").write
    options = {
        "compression": "zstd",
        "parquet.block.size": row_group_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.page.size": 256 << 10,
        "parquet.dictionary.page.size": 2 << 20,
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.writer.version": "PARQUET_2_0" if encoding == "delta" else "PARQUET_1_0",
    }
    for k, v in options.items():
        out = out.option(k, v)
    out.parquet(path)


SCHEMA = "part int, first long, doc_id long, n_tokens int, tokens array<int>"


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of write_tokens with start, the ids of all rows before. Offsets come from the metadata columns alone: one
    row a file passes through one task, is written, and is broadcast to the rows if a count of them is at most
    BROADCAST_FILES; ids are not shuffled then. An empty folder gives no rows."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = written(parts.select("part", before.alias("_base")), "token-bases")
    bases = F.broadcast(bases) if bases.count() <= BROADCAST_FILES else bases
    return rows.join(bases, "part").withColumn("start", F.col("_base") + F.col("first")).drop("_base")


def op10_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, written with production parameters and read back.

    Null and empty texts have the end id alone; null doc_ids come first; rows of one doc_id follow each other in the order
    of a hash of their texts; other columns of documents are ignored, so their names cannot clash; an empty table gives none.
    """
    import public_tokenizers

    path = f"{shared_root(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            off = np.asarray(lists.offsets)
            flat = np.ascontiguousarray(np.asarray(lists.values), "<u4")
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2).cast(pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", "tokens").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
