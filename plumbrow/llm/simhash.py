"""Near-duplicates by SimHash, found through deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from plumbrow.llm.common import Batches, batches_of, cut, in_parts, utf8_of
from plumbrow.llm.components import components

SEED = 42


class Segment(NamedTuple):
    """``width`` bits of lane ``lane`` from bit ``low``; ``wild``: one of them may differ."""

    lane: int
    low: int
    width: int
    wild: bool


def segments(lanes: int, per_lane: int, wild: int, width: int | None = None) -> list[Segment]:
    """Each 64-bit lane cut into ``per_lane`` pieces of about equal width, of which the lowest ``width`` bits
    are used; the first ``wild`` pieces of all take a wildcard. Fingerprints that differ in r bits agree in a
    piece, up to its wildcard, for certain if r is smaller than the number of pieces plus the number of
    wildcards."""
    cuts = [round(i * 64 / per_lane) for i in range(per_lane + 1)]
    pieces = [(lane, a, min(b - a, width or 64)) for lane in range(lanes) for a, b in zip(cuts, cuts[1:])]
    return [Segment(*p, wild=i < wild) for i, p in enumerate(pieces)]


def shingle_hashes(utf8: bytes, words: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of the whole sequence if it is shorter."""
    w = utf8.lower().split()  # of bytes: A-Z only, and cut at \x20 \x09-\x0d
    if not w:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    n = max(1, len(w) - words + 1)
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Another 64 bits for each hash (the finalizer of SplitMix64)."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit number; a bit is 1 if it is set in over half of the hashes; 0 for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def fingerprints(
    docs: DataFrame, words: int = 3, lanes: int = 1, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """``doc_id, f0, f1, ..., carried``: a row for each row of ``docs``, 64 bits in each lane; ``carried`` is a struct of the
    columns named in ``carry``, or null.

    A text without words, null or empty, has fingerprint zero. Texts are read whole.
    """
    names = [f"f{i}" for i in range(lanes)]

    def prints(batches: Batches) -> Batches:
        for batch in in_parts(batches):
            columns: list[list[int]] = [[] for _ in names]
            for utf8 in batch.column(1).to_pylist():
                h = shingle_hashes(utf8, words)
                for i, c in enumerate(columns):
                    c.append(majority(h))
                    if i + 1 < len(columns):
                        h = _mixed(h)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns), batch.column(2)], ["doc_id", *names, "carried"]
            )

    carried = (F.struct(*carry) if carry else F.lit(None).cast("int")).alias("carried")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), utf8_of(text).alias("utf8"), carried)
    kind = rows.schema["carried"].dataType.simpleString()
    return batches_of(rows, prints, "doc_id bigint, " + ", ".join(f"{n} bigint" for n in names) + f", carried {kind}")


def variants(pieces: list[Segment]) -> Column:
    """All signatures of a fingerprint: a piece with one of its bits cleared, for each bit of a piece
    with a wildcard; else the piece itself. The number of the variant is above the value."""
    keys: list[Column] = []
    for s in pieces:
        value = F.shiftrightunsigned(F.col(f"f{s.lane}"), s.low).bitwiseAND(F.lit((1 << s.width) - 1))
        for bit in range(s.width) if s.wild else [None]:
            kept = value if bit is None else value.bitwiseAND(F.lit(((1 << s.width) - 1) ^ (1 << bit)))
            keys.append(kept.bitwiseOR(F.lit(len(keys) << 32)))
    return F.array(*keys)


def _differing(lanes: int, a: str, b: str) -> Column:
    return reduce(
        Column.__add__,
        [F.bit_count(F.col(f"{a}.f{i}").bitwiseXOR(F.col(f"{b}.f{i}"))) for i in range(lanes)],
    )


def _linked(nodes: DataFrame, names: list[str], radius: int, pieces: list[Segment]) -> DataFrame:
    """``node, root`` of the nodes that share a signature of ``pieces`` with another within ``radius`` bits."""
    signed = nodes.select("node", F.explode(variants(pieces)).alias("key"))
    shared = signed.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n"))
    shared = cut(shared.filter("n > 1").select("key", "leader"), "shared-keys")
    members = cut(signed.join(shared, "key").select("key", "node", "leader"), "members")

    prints_of = nodes.select("node", *names)
    near = _differing(len(names), "x", "y") <= radius
    stars = members.filter("node <> leader").select("node", "leader").distinct()
    stars = (
        stars.join(prints_of.alias("x"), "node")
        .join(prints_of.withColumnRenamed("node", "leader").alias("y"), "leader")
        .filter(near)
        .select(F.col("node").alias("a"), F.col("leader").alias("b"))
    )
    stars = cut(stars, "stars")
    roots = cut(components(stars), "roots")

    of = lambda key: roots.select(F.col("node").alias(key), F.col("root").alias(f"{key}_root"))
    placed = members.join(of("node"), "node", "left").join(of("leader"), "leader", "left").select(
        "key",
        "node",
        "leader",
        F.coalesce("node_root", "node").alias("root"),
        F.coalesce("leader_root", "leader").alias("leader_root"),
    )
    placed = cut(placed, "placed")
    # A member of its leader's component meets only those that are not; these meet everyone but the
    # leader, whom they have met.
    apart = cut(placed.filter("root <> leader_root").join(prints_of, "node"), "apart")
    keys = apart.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    others = placed.filter("node <> leader").join(keys, "key", "left_semi").join(prints_of, "node")
    cross = (
        apart.alias("x")
        .join(
            cut(others, "others").alias("y"),
            (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & near,
        )
        .select(F.col("x.root").alias("a"), F.col("y.root").alias("b"))
        .distinct()
    )
    links = cut(cross, "cross")
    if links.isEmpty():
        return roots
    return cut(components(links.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))), "components")


def linked_classes(prints: DataFrame, radius: int, pieces: list[Segment], rounds: int = 1) -> DataFrame:
    """``f0, ..., component_id``: a row for each fingerprint of ``prints``, with the smallest doc_id of
    the fingerprints that links of ``radius`` differing bits or fewer lead to.

    Equal fingerprints are one node. Within a signature's nodes all are first compared with the
    smallest; then the pairs that these links leave in different components are compared. So a large
    group of near copies costs as many comparisons as it has members, and no link is lost that
    could join two components. With several ``rounds`` each takes its part of the pieces, for all nodes.
    """
    names = [c for c in prints.columns if c not in ("doc_id", "carried")]
    nodes = prints.groupBy(*names).agg(F.min("doc_id").alias("first_id"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    size = -(-len(pieces) // rounds)
    found = [
        _linked(nodes.select("node", *names), names, radius, pieces[first : first + size])
        for first in range(0, len(pieces), size)
    ]
    final = found[0]
    if len(found) > 1:
        links = reduce(DataFrame.union, found).select(F.col("node").alias("a"), F.col("root").alias("b"))
        final = cut(components(links), "classes-of-nodes")
    named = nodes.join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return cut(named.join(least, "root").select(*names, "component_id"), "classes")


def near_duplicates(
    docs: DataFrame,
    words: int = 3,
    lanes: int = 1,
    radius: int = 2,
    per_lane: int = 2,
    wild: int = 1,
    width: int | None = None,
    rounds: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """``doc_id, f0, ..., component_id``, with ``carry`` also ``carried``, for each row of ``docs``.

    Two fingerprints link if ``radius`` bits or fewer differ; ``component_id`` is the smallest doc_id
    that links lead to, its own included. With the defaults every such pair is found: of two halves,
    one differs by at most one bit, or the other not at all. A larger radius finds pairs by the chance that one
    of ``lanes * per_lane`` pieces differs in one bit or none. In a table of n fingerprints a signature has
    n / 2 ** (width - 1) unrelated ones, so ``width`` should be a little over log2(n). Rows with equal texts always meet. A null
    id is no candidate for the smallest; a component with null ids only has a null component_id.
    Repeated rows stay, each with the same result; an empty table gives an empty one.
    """
    prints = cut(fingerprints(docs, words, lanes, doc_id, text, carry), "fingerprints")
    names = [f"f{i}" for i in range(lanes)]
    classes = linked_classes(prints, radius, segments(lanes, per_lane, wild, width), rounds)
    return prints.join(classes, names).select("doc_id", *names, "component_id", *(["carried"] if carry else []))


def hex_of(column: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
