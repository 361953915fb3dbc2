"""Fingerprints from Lempel-Ziv phrases: likeness of documents as a compressor would see it."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbrow.llm.common import Batches, batches_of, text_of

SIZE = 64  # smallest hashes that a fingerprint keeps
DIGITS = 8  # hexadecimal digits of each


_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def parse(codes: Sequence[int], shift: int, tree: dict[int, int], ends: list[int], start: int = 0) -> int:
    """Cut ``codes`` from ``start`` into phrases, each the longest known one and one more code; append their ends.

    ``tree`` leads from a phrase and the next code to the longer phrase; code numbers have ``shift`` bits.
    Returns the start of the last phrase, which the text's end may have cut short; it is not appended.
    """
    node, at, one = 0, start, 1 << shift
    last, number = start, (len(tree) + 1) << shift
    get, end = tree.get, ends.append
    for c in codes:
        at += 1
        longer = get(node + c)
        if longer is None:
            tree[node + c] = number
            number += one
            node = 0
            end(at)
            last = at
        else:
            node = longer
    return last


def _phrase_hashes(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """32-bit hashes of the stretches between ``bounds``: equal stretches have equal ones wherever they are."""
    powers = np.cumprod(np.r_[np.uint64(1), np.full(len(codes), _BASE)])
    inverse = np.cumprod(np.r_[np.uint64(1), np.full(len(codes), _INVERSE)])
    sums = np.r_[np.uint64(0), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[:-1])]
    h = (sums[bounds[1:]] - sums[bounds[:-1]]) * inverse[bounds[:-1]]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(32)).astype(np.uint32)


def smallest(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The ``size`` smallest distinct hashes in order."""
    if len(hashes) > 2 * size:
        # distinct phrases seldom share a hash, so twice the number is enough; if not, all are looked at
        few = np.unique(np.partition(hashes, 2 * size)[: 2 * size])
        if len(few) >= size:
            return few[:size]
    return np.unique(hashes)[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated share of common phrases: of the smallest hashes of both sets together, how many are in
    each. 1 for two empty sets."""
    union = np.union1d(a, b)[:size]
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(both, union[-1], "right") / len(union))


def as_text(print_: np.ndarray) -> str:
    return print_.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as many first characters of ``following``, or all."""
    tail = len(text) // 4
    return text[: len(text) - tail] + following[:tail]


def _print_of(codes: np.ndarray, ends: list[int], size: int = SIZE) -> np.ndarray:
    bounds = np.array([0, *ends, *([len(codes)] if (ends[-1] if ends else 0) < len(codes) else [])], np.int64)
    return smallest(_phrase_hashes(codes, bounds), size)


def fingerprint(text: str) -> np.ndarray:
    codes = codes_of(text)
    ends: list[int] = []
    parse(codes.tolist(), 21, {}, ends)
    return _print_of(codes, ends)


def both_fingerprints(text: str, other: str) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of ``text`` and of ``other``, its edited text; what both begin with is parsed once."""
    codes, changed = codes_of(text), codes_of(other)
    shift = max(1, int(max(codes.max(initial=0), changed.max(initial=0))).bit_length())
    cut = len(text) - len(text) // 4
    tree: dict[int, int] = {}
    common: list[int] = []
    at = parse(codes[:cut].tolist(), shift, tree, common)
    prints = []
    for whole, own in ((changed, tree.copy()), (codes, tree)):
        ends = common.copy()
        parse(whole[at:].tolist(), shift, own, ends, at)
        prints.append(_print_of(whole, ends))
    return prints[1], prints[0]


def _spread(rows: DataFrame, parts: int) -> DataFrame:
    """Rows in ascending order, cut into ranges, each followed by the row that comes after its last.

    ``part`` numbers the ranges, ``after`` marks that one more row; only the ends of the ranges, ``parts``
    numbers at most, pass through the driver. After the last row comes the first. Rows of one id stay
    in one range. Order: by id, nulls first, rows of one id by their text.
    """
    ids = rows.agg(
        F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 20 * parts).alias("cuts"),
        F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id"))).alias("first"),
    ).first()
    cuts = sorted(set(ids.cuts or ()))
    if ids.first is not None and ids.first.known:
        cuts = [c for c in cuts if c > ids.first.doc_id]
    ends = F.array(*[F.lit(c).cast("bigint") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    own = F.coalesce(F.aggregate(ends, F.lit(0), lambda n, c: n + (c <= F.col("doc_id")).cast("int")), F.lit(0))
    is_first = F.col("doc_id").eqNullSafe(F.lit(ids.first.doc_id if ids.first is not None else None).cast("bigint"))
    begins = F.array_contains(ends, F.col("doc_id"))
    here = F.struct(own.alias("part"), F.lit(False).alias("after"))
    before = F.struct((own - 1).alias("part"), F.lit(True).alias("after"))
    last = F.struct(F.lit(len(cuts)).alias("part"), F.lit(True).alias("after"))
    places = F.array_compact(F.array(here, F.when(begins, before), F.when(is_first, last)))
    spread = rows.select("doc_id", "text", F.explode(places).alias("place")).select("place.part", "place.after", "doc_id", "text")
    return spread.repartitionByRange(parts, "part").sortWithinPartitions("part", "after", "doc_id", "text")


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    A row for each row of ``docs``. The edited text has its last quarter (floor of the number of code
    points) replaced by as many first code points of the next document, ascending doc_id; after the last comes
    the first. Null texts are empty. ``fingerprint`` is the 64 smallest hashes of the text's phrases, in
    hexadecimal, empty for an empty text; ``near_edited`` and ``near_next`` compare it with that of the edited
    text and of the next document. Rows without an id come first, rows of one id by their text; a
    table of one row is its own next. Documents stream in order, so a task holds a batch of them.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def finished(pending: tuple, next_print: np.ndarray) -> tuple:
        id_, text, own, changed, new = pending
        sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        return id_, len(text), sha, as_text(own), as_text(changed), likeness(own, changed), likeness(own, next_print)

    def printed(batches: Batches) -> Batches:
        doc = pending = None  # the last document; the one before it, which waits for the last one's fingerprint
        for batch in batches:
            out = []
            for after, id_, text in zip(*(c.to_pylist() for c in batch.columns[1:])):
                if doc is not None:
                    new = edited(doc[1], text)
                    own, changed = both_fingerprints(doc[1], new)
                    if pending is not None:
                        out.append(finished(pending, own))
                    pending = (*doc, own, changed, new)
                    if after:
                        out.append(finished(pending, fingerprint(text)))
                        pending = None
                doc = None if after else (id_, text)
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    schema = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return batches_of(_spread(rows, parts), printed, schema)
