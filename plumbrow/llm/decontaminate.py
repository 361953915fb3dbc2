"""Benchmark passages in training texts: rare n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from plumbrow.llm import tokens
from plumbrow.llm.common import Batches, batches_of, cut, share, text_of

GRAM = 3  # words of a run
FREQUENT = 6  # one run of a chunk in so many, the most frequent ones, is no seed
CHUNK = 64  # words of a long item that are aligned together; items of less than twice as many are one chunk
MATCH, MISMATCH, GAP = 2, -1, -1
FILTER_BITS = 23  # 1 MB: what tasks get to tell words of no seed; growing with nothing
_PLAIN = bytes(32 if c in tokens.PUNCTUATION else c for c in range(256))
_BETWEEN = np.zeros(256, bool)
_BETWEEN[list(tokens.SPACES + tokens.PUNCTUATION)] = True
_VALUE = tokens.table()


class _Texts(NamedTuple):
    """Some texts in lower case, their words as places in ``data``, and the hashes of words."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray  # of each word: the number of its text
    hashes: np.ndarray

    def words(self, first: int, end: int) -> list[bytes]:
        return self.data[self.starts[first] : self.ends[end - 1]].translate(_PLAIN).split() if first < end else []


def _texts(column: pa.Array, hasher: tokens.Hasher) -> Iterator[tuple[int, int, _Texts]]:
    """All texts of a column, some at a time, with the number of the first and of the one after the last.

    Words are what stands between white space and ASCII punctuation.
    """
    lower = pc.utf8_lower(column).cast(pa.binary()).to_pylist()
    for first, end in tokens.chunks(lower):
        data, text_starts = tokens.joined(lower[first:end])
        starts, ends = tokens.bounds(_BETWEEN[data])
        number = np.searchsorted(text_starts, starts, "right") - 1
        yield first, end, _Texts(data.tobytes(), starts, ends, number, hasher(_VALUE[data], starts, ends))


def _grams(h: np.ndarray) -> np.ndarray:
    """Hash of each run of GRAM words."""
    if len(h) < GRAM:
        return h[:0]
    out = h[: len(h) - GRAM + 1].copy()
    for i in range(1, GRAM):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - GRAM + 1 + i]
        out ^= out >> np.uint64(31)
    return out


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def chunks_of(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``chunk, item_id, words, grams``: items, and of long ones pieces of CHUNK words that begin every half CHUNK and, the last
    one, at the end less CHUNK, with the hashes of their runs of words. So CHUNK words in a row are three quarters of a piece
    wherever they begin. Items of fewer than GRAM words have no runs and match nothing."""

    def cut_up(batches: Batches) -> Batches:
        hasher = tokens.Hasher()
        for batch in batches:
            ids, words, grams = [], [], []
            for first, end, found in _texts(batch.column(1), hasher):
                for i in range(end - first):
                    a, b = np.searchsorted(found.text, [i, i + 1]).tolist()
                    long = b - a >= 2 * CHUNK
                    for s in [*range(a, b - CHUNK, CHUNK // 2), b - CHUNK] if long else [a]:
                        stop = s + CHUNK if long else b
                        g = _grams(found.hashes[s:stop])
                        if len(g):
                            ids.append(batch.column(0)[first + i].as_py())
                            words.append(b" ".join(found.words(s, stop)))
                            grams.append(g.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(words, pa.binary()), pa.array(grams, pa.list_(pa.int64()))],
                ["item_id", "words", "grams"],
            )

    rows = items.select(F.col(item_id).cast("bigint").alias("item_id"), text_of(text).alias("text"))
    out = batches_of(rows, cut_up, "item_id bigint, words binary, grams array<bigint>")
    return out.withColumn("chunk", F.monotonically_increasing_id())


def _filter_of(grams: DataFrame) -> np.ndarray:
    """Bitmap over the slots of ``grams(gram)``. Slots are distinct, so no more than 2**FILTER_BITS rows come."""
    slots = grams.select(F.shiftrightunsigned("gram", 64 - FILTER_BITS).alias("slot"))
    places = slots.selectExpr("CAST(slot DIV 8 AS INT) AS byte", "shiftleft(1, CAST(slot % 8 AS INT)) AS bit")
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    got = places.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toPandas()
    out[got["byte"].to_numpy()] = got["bits"].to_numpy()
    return out


def _in(bitmap: np.ndarray, grams: np.ndarray) -> np.ndarray:
    slot = _slot(grams)
    return (bitmap[slot >> 3] >> (slot & 7)) & 1 == 1


def _met(column: pa.Array, hasher: tokens.Hasher, bitmap: np.ndarray) -> Iterator[tuple[int, _Texts, np.ndarray, np.ndarray]]:
    """Some texts at a time: the number of the first, the texts, the hashes of all runs, and the places of
    those that are in the bitmap and in one text."""
    for first, _, found in _texts(column, hasher):
        g = _grams(found.hashes)
        inside = found.text[: len(g)] == found.text[GRAM - 1 :]
        yield first, found, g, np.flatnonzero(_in(bitmap, g) & inside)


def grams_of(chunks: DataFrame) -> DataFrame:
    """``gram, chunk``: the distinct runs of words of each chunk."""
    return chunks.select(F.explode("grams").alias("gram"), "chunk").distinct()


def rare_seeds(grams: DataFrame, hits: DataFrame) -> DataFrame:
    """``gram, chunk``: of each chunk in ``grams`` the runs that are seeds, by how many rows of ``hits(gram)`` have them.

    Of n runs the floor(n / FREQUENT) most frequent ones are none (ties by hash). A passage with more than n / FREQUENT runs in common
    with the chunk has a seed among them, whichever are left out; so phrases that many items and documents share do
    not make them meet. Runs that no passage has count as the rarest and are left out as well, as they meet nothing.
    """
    counts = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("passages"))
    known = grams.join(counts, "gram", "left").withColumn("passages", F.coalesce("passages", F.lit(0)))
    of_chunk = Window.partitionBy("chunk")  # fewer than 2 * CHUNK runs
    place = F.row_number().over(of_chunk.orderBy(F.desc("passages"), "gram"))
    most = F.floor(F.count(F.lit(1)).over(of_chunk) / FREQUENT)
    ranked = known.select("gram", "chunk", "passages", (place > most).alias("rare"))
    return ranked.filter("rare AND passages > 0").select("gram", "chunk")


def _passages(rows: DataFrame, bitmap: np.ndarray, reach: int) -> DataFrame:
    """``doc_id, passage, words, grams``: stretches of documents around runs of items, ``reach`` words to each side.

    Runs closer than ``reach`` share a stretch, until it has 4 * ``reach`` words between its first and
    last one; then the next begins, with its own words and runs to the left.
    """
    shared = share(rows.sparkSession, bitmap)

    def found(batches: Batches) -> Batches:
        hasher = tokens.Hasher()
        for batch in batches:
            row_no, words, grams = [], [], []
            for first, found, g, at in _met(batch.column(1), hasher, shared.value):
                places, text = at.tolist(), found.text[at].tolist()
                start = 0
                for i in range(1, len(places) + 1):
                    if i < len(places) and text[i] == text[start]:
                        if places[i] - places[i - 1] <= reach and places[i] - places[start] <= 4 * reach:
                            continue
                    a, b = np.searchsorted(found.text, [text[start], text[start] + 1]).tolist()
                    row_no.append(first + text[start])
                    words.append(b" ".join(found.words(max(a, places[start] - reach), min(b, places[i - 1] + GRAM + reach))))
                    low = np.searchsorted(at, max(a, places[start] - reach))
                    grams.append(np.unique(g[at[low:i]]).view(np.int64))
                    start = i
            ids = batch.column(0).take(pa.array(row_no, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(words, pa.binary()), pa.array(grams, pa.list_(pa.int64()))], ["doc_id", "words", "grams"]
            )

    out = batches_of(rows, found, "doc_id bigint, words binary, grams array<bigint>")
    return out.withColumn("passage", F.monotonically_increasing_id())


def smith_waterman(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each pair of word-number sequences, all pairs at once, gaps linear."""
    m, n = max(map(len, a), default=0), max(map(len, b), default=0)
    left, right = np.full((len(a), m), -1), np.full((len(a), n), -2)
    for i, (x, y) in enumerate(zip(a, b)):
        left[i, : len(x)], right[i, : len(y)] = x, y
    slope = np.arange(n + 1, dtype=np.int32) * -GAP
    above, best = np.zeros((len(a), n + 1), np.int32), np.zeros(len(a), np.int32)
    for i in range(m):
        here = np.zeros_like(above)
        same = left[:, i, None] == right
        np.maximum(above[:, :-1] + np.where(same, MATCH, MISMATCH), above[:, 1:] + GAP, out=here[:, 1:])
        np.maximum(here, 0, out=here)
        here = np.maximum.accumulate(here + slope, axis=1) - slope
        best = np.maximum(best, here.max(axis=1, initial=0))
        above = here
    return best


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many words of ``a`` have one of their own in ``b``: no alignment matches more."""
    n = max(a.max(initial=-1), b.max(initial=-1)) + 1
    return int(np.minimum(np.bincount(a, minlength=n), np.bincount(b, minlength=n)).sum())


def _aligned(pairs: DataFrame, threshold: float) -> DataFrame:
    """``doc_id, item_id, score`` of pairs of a passage and a chunk; the score is that of the best local
    alignment by that of the chunk with itself. Pairs with too few words in common for the threshold are left out."""

    def scored(batches: Batches) -> Batches:
        for batch in batches:
            numbers: dict[bytes, int] = {}
            number = lambda w: np.fromiter((numbers.setdefault(x, len(numbers)) for x in w.split()), np.int32)
            a = [number(w) for w in batch.column(2).to_pylist()]
            b = [number(w) for w in batch.column(3).to_pylist()]
            able = np.array([_shared(x, y) >= threshold * len(x) for x, y in zip(a, b)], bool)
            order = np.argsort([len(y) for y in b], kind="stable")
            order = order[able[order]]
            score = np.zeros(len(a))
            for s in range(0, len(order), 256):  # of like length, so that little is padded
                part = order[s : s + 256]
                own = np.array([len(a[i]) * MATCH for i in part])
                score[part] = smith_waterman([a[i] for i in part], [b[i] for i in part]) / own
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["doc_id", "item_id", "score"])
            yield out.filter(pa.array(able))

    return batches_of(pairs, scored, "doc_id bigint, item_id bigint, score double")


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.5,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``doc_id, item_id, score``: documents that hold an item, or CHUNK words of it, whole, in part or edited.

    ``score`` is the best local alignment of a chunk of the item with the document, by that of the chunk
    with itself: 1 for a whole copy, ``threshold`` or more for all rows returned. Copies that keep more than one in FREQUENT
    of the chunk's runs of GRAM words are met for certain; those that keep fewer, if one of the kept is rare enough
    to be a seed; those without any are not found, whatever their score. One row for each pair
    of ids. Null and empty texts, and items of fewer than three words, match nothing; rows of one id are
    one document; rows with a null id have results under a null id. Either table may be empty.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    chunks = cut(chunks_of(items, item_id, item_text), "chunks")
    grams = cut(grams_of(chunks), "grams")
    reach = chunks.agg(F.max(F.size("grams"))).first()[0] or 0
    passages = cut(_passages(rows, _filter_of(grams), reach + GRAM), "passages")
    hits = passages.select("passage", F.explode("grams").alias("gram"))
    seeds = cut(rare_seeds(grams, hits), "seeds")
    met = cut(hits.join(seeds, "gram").select("passage", "chunk").distinct(), "met")
    pairs = (
        met.join(passages.select("passage", "doc_id", F.col("words").alias("passage_words")), "passage")
        .join(chunks.select("chunk", "item_id", "words"), "chunk")
        .select("doc_id", "item_id", "words", "passage_words")
    )
    best = _aligned(pairs, threshold).groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))
    return best.filter(F.col("score") >= threshold)
