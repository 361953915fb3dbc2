"""Removal of lines that several documents hold, with two Bloom filters before anything exact is shuffled."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from plumbrow.llm.common import Batches, batches_of, cut, in_parts, share, utf8_of

SEGMENT_BITS = 18  # a segment of a filter has 2**18 bits: 32 kB
PROBES = 4
NO_ID = (1 << 63) - 1  # rows without an id are one document, after all others


def line_key(line: bytes, shortest: int) -> bytes | None:
    """The line stripped of white space (\\x20 \\x09-\\x0d), A-Z in lower case; None if under ``shortest`` code points."""
    key = line.strip().lower()
    if len(key) < shortest or len(key) < 4 * shortest and len(key.decode()) < shortest:
        return None
    return key


def _document_keys(utf8: bytes, shortest: int) -> set[bytes]:
    return {k for line in utf8.split(b"\n") if (k := line_key(line, shortest)) is not None}


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))


class _Place:
    """Where a hash lies in a filter of ``2**bits`` bits: a segment, and PROBES bits in it."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - max(0, bits - SEGMENT_BITS)) if bits > SEGMENT_BITS else None

    def segment(self, h: np.ndarray) -> np.ndarray:
        return np.zeros(len(h), np.int64) if self.shift is None else (h >> self.shift).astype(np.int64)

    @staticmethod
    def probes(h: np.ndarray) -> np.ndarray:
        h = h * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        step, mask = (h >> np.uint64(40)) | np.uint64(1), np.uint64((1 << SEGMENT_BITS) - 1)
        return np.stack([((h + np.uint64(i) * step) & mask).astype(np.int64) for i in range(PROBES)])


def _key_hashes(rows: DataFrame, shortest: int) -> DataFrame:
    """``hash, twice``: each key hash of a batch of documents once, with whether two of them hold it."""

    def hashed(batches: Batches) -> Batches:
        for batch in in_parts(batches):
            parts = [_hashes(list(_document_keys(t, shortest))) for t in batch.column(1).to_pylist()]
            h, n = np.unique(np.concatenate([np.empty(0, np.uint64), *parts]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n > 1)], ["hash", "twice"])

    return batches_of(rows, hashed, "hash bigint, twice boolean")


def twice_seen(hashes: DataFrame, bits: int) -> np.ndarray:
    """The filter of hashes seen twice, ``2**bits`` bits as bytes: (segments, 2**18 / 8).

    Each segment has two filters, for hashes seen once and for those seen again. A task meets all
    hashes of its segments, one batch after the other. Nothing seen twice is missed.
    """
    place, width = _Place(bits), 1 << SEGMENT_BITS

    def filled(batches: Batches) -> Batches:
        once: dict[int, np.ndarray] = {}
        again: dict[int, np.ndarray] = {}
        for batch in batches:
            h = batch.column(1).to_numpy().view(np.uint64)
            twice = batch.column(2).to_numpy(zero_copy_only=False)
            h, first, n = np.unique(h, return_index=True, return_counts=True)
            # A repeated hash may carry the mark in any of its rows; it is marked by its count anyway.
            marked = (n > 1) | twice[first]
            segment = place.segment(h)
            for s in np.unique(segment):
                of = segment == s
                if s not in once:
                    once[s], again[s] = np.zeros(width, bool), np.zeros(width, bool)
                probes = place.probes(h[of])
                seen = once[s][probes].all(axis=0) | marked[of]
                again[s][probes[:, seen]] = True
                once[s][probes] = True
        for s, bitmap in again.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(s)], pa.int64()), pa.array([np.packbits(bitmap).tobytes()], pa.binary())],
                ["segment", "bitmap"],
            )

    n = max(1, 1 << max(0, bits - SEGMENT_BITS))
    top = F.shiftrightunsigned("hash", 64 - (bits - SEGMENT_BITS)) if bits > SEGMENT_BITS else F.lit(0)
    dealt = hashes.select(top.cast("bigint").alias("segment"), "hash", "twice").repartition("segment")
    out = np.zeros((n, width // 8), np.uint8)
    for row in batches_of(dealt, filled, "segment bigint, bitmap binary").collect():
        out[row.segment] = np.frombuffer(bytes(row.bitmap), np.uint8)
    return out


def _suspects(rows: DataFrame, shortest: int, bits: int, seen: np.ndarray) -> DataFrame:
    """``id, key`` for each key of a document that the filter of repeated hashes holds."""
    place, filter_ = _Place(bits), share(rows.sparkSession, seen)

    def suspected(batches: Batches) -> Batches:
        for batch in in_parts(batches):
            ids, keys = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = list(_document_keys(t, shortest))
                ids += [i] * len(own)
                keys += own
            h = _hashes(keys)
            segment, hit = place.segment(h), np.ones(len(h), bool)
            for p in place.probes(h) if len(h) else ():
                hit &= (filter_.value[segment, p >> 3] >> (7 - (p & 7)) & 1).astype(bool)
            which = np.flatnonzero(hit)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in which], pa.int64()), pa.array([keys[i] for i in which], pa.binary())],
                ["id", "key"],
            )

    return batches_of(rows, suspected, "id bigint, key binary")


def repeated_lines(
    docs: DataFrame, shortest: int = 10, most_bits: int = 28, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``id, drop``: for each document that loses lines, the keys of these lines.

    The filter has 12 bits for each key hash, up to ``2**most_bits`` bits (32 MB), which bounds what is
    broadcast. Beyond that more keys are suspected; the result does not change, as each suspect is
    confirmed by its whole key. A key that many documents hold is reduced in each task before it moves.
    """
    rows = docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("id"), utf8_of(text).alias("utf8"))
    hashes = cut(_key_hashes(rows, shortest), "line-hashes")
    bits = min(most_bits, max(16, (12 * max(1, hashes.count()) - 1).bit_length()))
    bits = max(bits, SEGMENT_BITS)
    suspects = cut(_suspects(rows, shortest, bits, twice_seen(hashes, bits)), "suspected-lines")
    repeated = (
        suspects.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    )
    repeated = cut(repeated.select("key", "first"), "repeated-lines")
    # Nothing that needs the rows of a key together follows the join, so that a hot key can be split.
    lost = cut(suspects.join(repeated, "key").filter("id <> first").select("id", "key"), "lost-keys")
    return cut(lost.groupBy("id").agg(F.collect_set("key").alias("drop")), "lost-lines")


def dedup_lines(
    docs: DataFrame,
    shortest: int = 10,
    most_bits: int = 28,
    doc_id: str = "doc_id",
    text: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept, kept_sha256, carried`` for each row of ``docs``.

    ``carried`` is a struct of the columns named in ``carry``, or null.

    A line's key is the line without white space at its ends, A-Z in lower case. A key of ``shortest``
    code points or more that two documents hold loses all its lines, except in the smallest doc_id
    holding it; there repeated lines stay. The other lines stay as they are, joined by a line feed.
    A null or empty text is one empty line. Rows of one id are one document; rows without an id are
    one document that comes last. A text whose lines all go is empty and its row stays.
    """
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("id"),
        utf8_of(text).alias("utf8"),
        (F.struct(*carry) if carry else F.lit(None).cast("int")).alias("carried"),
    )
    lost = repeated_lines(docs, shortest, most_bits, doc_id, text)
    both = rows.join(lost, "id", "left").select("doc_id", "utf8", "drop", "carried")

    def kept(batches: Batches) -> Batches:
        for batch in in_parts(batches):
            n_lines, n_dropped, texts, sums = [], [], [], []
            for utf8, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines = utf8.split(b"\n")
                n_lines.append(len(lines))
                if drop:
                    gone = set(drop)
                    stay = [x for x in lines if x.strip().lower() not in gone]
                    utf8 = b"\n".join(stay)
                    n_dropped.append(len(lines) - len(stay))
                else:
                    n_dropped.append(0)
                texts.append(utf8)
                sums.append(hashlib.sha256(utf8).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_lines, pa.int64()),
                    pa.array(n_dropped, pa.int64()),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                    pa.array(sums, pa.string()),
                    batch.column(3),
                ],
                ["doc_id", "n_lines", "n_dropped", "kept", "kept_sha256", "carried"],
            )

    carried = both.schema["carried"].dataType.simpleString()
    return batches_of(
        both,
        kept,
        f"doc_id bigint, n_lines bigint, n_dropped bigint, kept string, kept_sha256 string, carried {carried}",
    )
