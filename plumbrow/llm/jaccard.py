"""Documents linked by the Jaccard similarity of their n-grams, exactly (after Wang et al., 2017: set relations)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbrow.llm.common import Batches, batches_of, cut, in_parts, utf8_of
from plumbrow.llm.components import components
from plumbrow.llm.simhash import shingle_hashes

STEP = 1.1  # each class of sizes is so much wider than the one before
MOST_BROADCAST = 400_000  # rows of three numbers: 10 MB; more are joined by a shuffle


def _least(size: Column, percent: int) -> Column:
    """Of a set of ``size`` so many elements at least are in a similar set."""
    return F.ceil(size * percent / 100.0 - 1e-9).cast("bigint")


def _common(a: Column, b: Column, percent: int) -> Column:
    """How many elements sets of sizes a and b have in common at least, if they are similar."""
    return F.ceil((a + b) * percent / (100.0 + percent) - 1e-9).cast("bigint")


def _part(percent: int) -> int:
    """Hashes below this are the part of a set that is looked at first: half as many again as similar sets may differ by."""
    return int(min(1.0, 1.5 * (1 - percent / 100) + 0.02) * ((1 << 64) - 1))


def _row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(doc_id, text)


def _elements(utf8: bytes, words: int) -> np.ndarray:
    """The distinct n-grams as 64-bit hashes, in the order of the hashes."""
    return np.unique(shingle_hashes(utf8, words))


def _digest(elements: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(elements.tobytes(), digest_size=16).digest(), np.int64).tolist())


def signed_sets(docs: DataFrame, words: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """``doc_id, row_key, size, d0, d1, part`` of each row: its set's size and digest, and its elements of the lowest hashes."""
    most = np.uint64(_part(percent))

    def signed(batches: Batches) -> Batches:
        for batch in in_parts(batches, 2):
            sizes, digests, parts = [], [], []
            for utf8 in batch.column(2).to_pylist():
                h = _elements(utf8, words)
                sizes.append(len(h))
                digests.append(_digest(h))
                parts.append(h[: np.searchsorted(h, most, "right")].view(np.int64))
            d0, d1 = zip(*digests)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(d0, pa.int64()), pa.array(d1, pa.int64()), pa.array(parts, pa.list_(pa.int64()))],
                ["doc_id", "row_key", "size", "d0", "d1", "part"],
            )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), _row_key(doc_id, text).alias("row_key"), utf8_of(text).alias("utf8"))
    return batches_of(rows, signed, "doc_id bigint, row_key bigint, size bigint, d0 bigint, d1 bigint, part array<bigint>")


class _Sets:
    """The distinct sets of a table as ``nodes(node, row_key, size, d0, d1)``, and their elements, made anew from the texts."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, words: int, doc_id: str, text: str):
        self.texts = docs.select(_row_key(doc_id, text).alias("row_key"), utf8_of(text).alias("utf8"))
        self.nodes, self.words = nodes, words

    def of(self, wanted: DataFrame) -> DataFrame:
        """``node, elements`` of the nodes in ``wanted(node)``, which are distinct."""
        words = self.words

        def made(batches: Batches) -> Batches:
            for batch in in_parts(batches, 3):
                nodes, sets = [], []
                for node, d0, d1, utf8 in zip(*(c.to_pylist() for c in batch.columns)):
                    h = _elements(utf8, words)
                    if _digest(h) == (d0, d1):  # else another text of the same key
                        nodes.append(node)
                        sets.append(h.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "elements"])

        keys = cut(self.nodes.join(wanted, "node", "left_semi").select("node", "row_key", "d0", "d1"), "wanted")
        if keys.count() <= MOST_BROADCAST:
            keys = F.broadcast(keys)
        rows = self.texts.join(keys, "row_key").select("node", "d0", "d1", "utf8")
        found = cut(batches_of(rows, made, "node bigint, elements array<bigint>"), "sets")
        n = found.agg(F.count("node"), F.count_distinct("node")).first()  # repeated rows share a key
        return found if n[0] == n[1] else cut(found.dropDuplicates(["node"]), "sets")


def _alone(elements: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """``node`` of those of ``sizes(node, size)`` that have more of ``elements(node, hash)`` to themselves than a similar set may lack.

    ``elements`` has of each set the hashes of the same range, so an element of two sets is there twice."""
    own = elements.groupBy("hash").agg(F.count(F.lit(1)).alias("df"), F.min("node").alias("node")).filter("df = 1")
    own = cut(own.groupBy("node").agg(F.count(F.lit(1)).alias("own")), "own-elements")
    size = F.col("size")
    return own.join(sizes, "node").filter(F.col("own") > size - _least(size, percent)).select("node")


def _candidates(nodes: DataFrame, parts: DataFrame, sets: _Sets, percent: int, hot_from: int) -> DataFrame:
    """``node, size, elements`` of the sets that may have a similar one: their elements that are in another of these sets.

    A set goes if it has too many elements that no other has, first by ``parts(node, hash)``, then by all elements of the sets left.
    The order of elements: those of no other set, which are not listed, then by hash, then those in ``hot_from`` sets or more,
    the rarer first.
    """
    sizes = nodes.select("node", "size")
    met = cut(nodes.select("node").join(_alone(parts, sizes, percent), "node", "left_anti"), "met")
    whole = sets.of(met)
    gone = cut(_alone(whole.select("node", F.explode("elements").alias("hash")), sizes, percent), "gone")
    elements = whole.join(gone, "node", "left_anti").select("node", F.explode("elements").alias("hash"))
    counts = cut(elements.groupBy("hash").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "shared-elements")
    place = F.struct(F.when(F.col("df") >= hot_from, F.col("df")).otherwise(0).alias("hot"), "hash")
    listed = elements.join(counts, "hash").groupBy("node").agg(F.sort_array(F.collect_list(place)).alias("places"))
    listed = listed.join(sizes, "node").select("node", "size", F.col("places.hash").alias("elements"))
    return cut(listed.filter(F.size("elements") >= _least(F.col("size"), percent)), "candidates")


class _Pairs:
    """Blocks of the prefix index, by element and class of sizes, and the sets that look into them.

    Of two similar sets, each has a common element in its prefix."""

    def __init__(self, sets: DataFrame, percent: int):
        """``sets(node, size, elements)``: the elements that are not listed are the first in the order."""
        self.sets, self.percent = sets, percent
        size, rank = F.col("size"), F.col("rank")
        own = size - F.size("elements")
        self.prefix = F.slice("elements", F.lit(1), (size - _least(size, percent) + 1 - own).cast("int"))
        entries = sets.select("node", "size", own.alias("own"), F.posexplode(self.prefix).alias("pos", "hash"))
        entries = cut(entries.select("hash", "node", "size", (F.col("own") + F.col("pos")).alias("rank")), "entries")
        of_size = lambda n: F.floor(F.log(n.cast("double")) / float(np.log(STEP)))
        self.index = entries.select("hash", of_size(size).alias("block"), F.col("node").alias("b"), size.alias("b_size"), rank.alias("b_rank"))
        # With the element at this rank as the first in common, sets of more elements have too few in common: blocks of these are skipped.
        most = F.least(size, F.floor((size - rank) * (100.0 + percent) / percent + 1e-9) - size)
        least = _least(size, percent)
        blocks = F.explode(F.sequence(of_size(least), of_size(most)))
        self.probes = entries.filter(most >= least).select(
            "hash", blocks.alias("block"), F.col("node").alias("a"), size.alias("a_size"), rank.alias("a_rank")
        )

    def fits(self) -> Column:
        """Whether sizes and ranks allow the pair to be similar, its first common element being this one; b is not larger."""
        a, b = F.col("a_size"), F.col("b_size")
        left = F.least(a - F.col("a_rank"), b - F.col("b_rank"))
        return (b <= a) & (b >= _least(a, self.percent)) & (left >= _common(a, b, self.percent)) & (F.col("a") != F.col("b"))

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs(a, b, a_size, b_size)`` whose prefixes have enough in common.

        A prefix is longer than one common element needs, the more so the more the sizes are alike: similar sets have one
        in common, and one for each place by which both prefixes are longer.
        """
        size = lambda n: F.col(f"{n}_size")
        need = _common(size("a"), size("b"), self.percent)
        spare = F.least(*(need - _least(size(n), self.percent) + 1 for n in ("a", "b")))
        of = lambda n: self.sets.select(F.col("node").alias(n), self.prefix.alias(f"{n}_prefix"))
        both = pairs.join(of("a"), "a").join(of("b"), "b")
        return both.filter(F.size(F.array_intersect("a_prefix", "b_prefix")) >= spare).select(*pairs.columns)

    def similar(self, pairs: DataFrame) -> DataFrame:
        """``a, b``: those of ``pairs(a, b, a_size, b_size)``, which may be repeated, that are similar."""
        pairs = cut(pairs.select("a", "b", "a_size", "b_size").distinct(), "pairs")
        pairs = cut(self.plausible(pairs), "plausible-pairs")
        of = lambda n: self.sets.select(F.col("node").alias(n), F.col("elements").alias(f"{n}_elements"))
        found = pairs.join(of("a"), "a").join(of("b"), "b")
        found = found.withColumn("both", F.size(F.array_intersect("a_elements", "b_elements")).cast("bigint"))
        near = 100 * F.col("both") >= self.percent * (F.col("a_size") + F.col("b_size") - F.col("both"))
        return cut(found.filter(near).select("a", "b"), "links")


def _with_roots(rows: DataFrame, roots: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        rows = rows.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left")
        rows = rows.withColumn(f"{c}_root", F.coalesce(f"{c}_root", c))
    return rows


def _one_of_each(index: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each block, as if drawn by lot."""
    drawn = F.struct(F.xxhash64("hash", "b").alias("lot"), *(c for c in index.columns if c not in keys))
    return index.groupBy(*keys).agg(F.min(drawn).alias("first")).select(*keys, "first.*").drop("lot")


def linked(candidates: DataFrame, percent: int) -> DataFrame:
    """``node, root`` of the nodes of ``candidates(node, size, elements)`` that are similar to another one; root is the smallest
    that links lead to."""
    pairs = _Pairs(candidates, percent)
    keys, columns = ["hash", "block"], ["a", "b", "a_size", "b_size"]

    def meet(probes: DataFrame, index: DataFrame, leaders: DataFrame, fit: Column) -> DataFrame:
        """Each block's leader with the sets that look into the block, and with the smaller ones in it."""
        looking = leaders.select(*keys, *(F.col(c).alias(f"a{c[1:]}") for c in leaders.columns if c not in keys))
        met = probes.join(leaders, keys).filter(fit).select(*columns)
        return met.union(index.join(looking, keys).filter(fit).select(*columns))

    # Each block's sets first meet one of them, in each block another: groups of near copies come together by as many comparisons as they
    # have entries, also where many members are not similar to one another.
    leaders = cut(_one_of_each(pairs.index, keys), "leaders")
    links = pairs.similar(meet(pairs.probes, pairs.index, leaders, pairs.fits()))
    roots = cut(components(links), "roots")

    # Pairs in one component need no more; of any other pair in a block, one set is not in the component of the block's first.
    apart = pairs.fits() & (F.col("a_root") != F.col("b_root"))

    def rooted(rows: DataFrame, n: str) -> DataFrame:
        block_roots = _with_roots(leaders.select(*keys, "b"), roots, "b").select(*keys, F.col("b_root").alias("first_root"))
        return cut(_with_roots(rows, roots, n).join(block_roots, keys), "rooted")

    # What is left of a block meets one of these.
    probes, index = rooted(pairs.probes, "a").drop("first_root"), rooted(pairs.index, "b")
    others = cut(_one_of_each(index.filter("b_root <> first_root").drop("first_root"), keys), "leaders")
    links = links.union(pairs.similar(meet(probes, index.drop("first_root"), others, apart)))
    roots = cut(components(links), "roots")
    probes, index = rooted(pairs.probes, "a"), rooted(pairs.index, "b")
    drop = lambda df: df.drop("first_root")
    one = drop(probes.filter("a_root <> first_root")).join(drop(index), keys)
    two = drop(probes.filter("a_root = first_root")).join(drop(index.filter("b_root <> first_root")), keys)
    found = pairs.similar(one.filter(apart).select(*columns).union(two.filter(apart).select(*columns)))
    return roots if found.isEmpty() else cut(components(links.union(found)), "roots")


def similar_documents(
    docs: DataFrame, words: int = 5, percent: int = 80, hot_from: int = 256, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``.

    A document's set has the distinct sequences of ``words`` words, A-Z in lower case, words being what stands between the six
    ASCII white-space characters; a shorter text is one sequence. Two link if 100 * intersection >= ``percent`` * union. ``component_id``
    is the smallest doc_id that links lead to, its own included. A text without words, or a null, has an empty set and
    links with nothing, not even another empty one. Rows of one id count one by one; null ids are no candidates for the smallest. Repeated rows stay;
    an empty table gives an empty one. N-grams are told apart by 64-bit hashes, whole sets by 128 bits.

    Equal sets are one node. Sets of which too many elements are in no other set go before any pair is met; of the others only the
    prefixes are indexed, frequent elements last in the order of elements. Lists are cut into blocks of like sizes; a set at its rank
    skips the blocks whose sets could have too little in common with it. Every pair that is met is settled by its intersection,
    unless links join the two already. ``hot_from`` is about the longest list that need be compared with itself; it changes the
    order, not the result.
    """
    signed = signed_sets(docs, words, percent, doc_id, text).withColumn("node", F.monotonically_increasing_id())
    signed = cut(signed, "signed")
    same = signed.filter("size > 0").groupBy("d0", "d1")
    nodes = same.agg(F.min("node").alias("node"), F.min(F.struct("node", "row_key", "size")).alias("of"), F.min("doc_id").alias("first_id"))
    nodes = cut(nodes.select("node", "d0", "d1", "of.row_key", "of.size", "first_id"), "nodes")
    kept = nodes.select("node")
    if nodes.count() <= MOST_BROADCAST:
        kept = F.broadcast(kept)
    parts = signed.select("node", "part").join(kept, "node", "left_semi").select("node", F.explode("part").alias("hash"))
    found = linked(_candidates(nodes, parts, _Sets(docs, nodes, words, doc_id, text), percent, hot_from), percent)
    named = nodes.select("node", "d0", "d1", "first_id").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = cut(named.join(least, "root").select("d0", "d1", "component_id"), "classes")
    rows = signed.select("doc_id", "size", "d0", "d1").join(classes, ["d0", "d1"], "left")
    component = F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"))
