"""Codes of vectors, four bytes each: codebooks of their parts, fitted over trees of balls (Moore, 2000)."""

from __future__ import annotations

import hashlib
import pickle
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbrow.llm.common import Batches, batches_of, cut

PARTS = 4
CHUNK = 4096  # vectors of a tree
LEAF = 16  # points of a ball that is not divided
LARGEST = 1 << 24  # of a component, so that sums of squares stay exact
PAIRS = 1 << 16  # of balls or points and entries whose distances are taken together


class Tree(NamedTuple):
    """Balls over distinct points; ball 0 is the root. ``order`` has the points of a ball side by side."""

    points: np.ndarray  # (points, width)
    weights: np.ndarray  # how often each occurs
    of_row: np.ndarray  # the point of each row
    order: np.ndarray
    first: np.ndarray  # of each ball: its range in ``order``
    end: np.ndarray
    child: np.ndarray  # (balls, 2): -1 for a leaf
    centre: np.ndarray
    radius: np.ndarray
    total: np.ndarray  # (balls, width): the sum of its points, by weight
    count: np.ndarray


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def anchors(points: np.ndarray, k: int) -> list[np.ndarray]:
    """``points`` dealt out to about ``k`` anchors, each to its nearest: the point furthest from its anchor becomes the
    next one and looks only at points that are further from their anchor than half way between the two anchors."""
    pivots = [0]
    distance = np.sqrt(_squares(points, points[:1]))
    owner = np.zeros(len(points), np.int64)
    while len(pivots) < k:
        new = int(distance.argmax())
        if distance[new] == 0:
            break
        between = np.sqrt(_squares(points[pivots], points[new : new + 1]))
        open_ = np.flatnonzero(distance * 2 >= between[owner])
        to_new = np.sqrt(_squares(points[open_], points[new : new + 1]))
        nearer = to_new < distance[open_]
        owner[open_[nearer]] = len(pivots)
        distance[open_[nearer]] = to_new[nearer]
        pivots.append(new)
    return [own for i in range(len(pivots)) if len(own := np.flatnonzero(owner == i))]


def _joined(balls: list[tuple], points: np.ndarray, weights: np.ndarray) -> tuple:
    """The balls joined two by two, those first that make the smallest ball, until there is one: (members, left, right)."""
    n = len(balls)
    mass = np.array([weights[b[0]].sum() for b in balls], float)
    centre = np.array([(points[b[0]] * weights[b[0], None]).sum(0) for b in balls]) / mass[:, None]
    radius = np.array([np.sqrt(_squares(points[b[0]], c[None]).max()) for b, c in zip(balls, centre)])

    def sizes(i: int) -> np.ndarray:
        apart = np.sqrt(_squares(centre, centre[i : i + 1]))
        share = mass / (mass + mass[i])
        return np.maximum(apart * share + radius[i], apart * (1 - share) + radius)

    table = np.array([sizes(i) for i in range(n)])
    np.fill_diagonal(table, np.inf)
    for _ in range(n - 1):
        i, j = divmod(int(table.argmin()), n)
        r = table[i, j]
        balls[i] = (np.concatenate([balls[i][0], balls[j][0]]), balls[i], balls[j])
        centre[i] = (centre[i] * mass[i] + centre[j] * mass[j]) / (mass[i] + mass[j])
        mass[i] += mass[j]
        radius[i] = r
        gone = np.isinf(table[i])
        row = sizes(i)
        row[gone] = np.inf
        row[[i, j]] = np.inf
        table[i] = table[:, i] = row
        table[j] = table[:, j] = np.inf
        top = i
    return balls[top] if n > 1 else balls[0]


def _ball(members: np.ndarray, points: np.ndarray, weights: np.ndarray) -> tuple:
    """Middle-out: about as many anchors as each will have members; balls of anchors are divided in the same way, then joined."""
    if len(members) <= LEAF:
        return members, None, None
    dealt = anchors(points[members].astype(float), int(np.sqrt(len(members))) + 1)
    return _joined([_ball(members[own], points, weights) for own in dealt], points, weights)


def tree_of(rows: np.ndarray) -> Tree:
    """The tree over ``rows`` of whole numbers. Equal rows are one point, so a common vector is one however often it occurs."""
    points, of_row, weights = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    order, first, end, child, todo = [], [], [], [], [(_ball(np.arange(len(points)), points, weights), -1, 0)]
    while todo:  # the left ball before the right one, so that a ball's points are side by side
        (members, left, right), above, side = todo.pop()
        me = len(first)
        if above >= 0:
            child[above][side] = me
        first.append(sum(map(len, order)) if left is None else -1)
        end.append(0)
        child.append([-1, -1])
        if left is None:
            order.append(members)
            end[me] = first[me] + len(members)
        else:
            todo += [(right, me, 1), (left, me, 0)]
    for me in range(len(first) - 1, -1, -1):  # children come after their ball
        if child[me][0] >= 0:
            first[me], end[me] = first[child[me][0]], end[child[me][1]]
    order = np.concatenate(order)
    total, centre, radius, count = [], [], [], []
    for a, b in zip(first, end):
        own, times = points[order[a:b]], weights[order[a:b]]
        total.append((own * times[:, None]).sum(0))
        count.append(times.sum())
        centre.append(total[-1] / count[-1])
        radius.append(np.sqrt(_squares(own, centre[-1][None]).max()))
    whole = [np.array(x) for x in (first, end, child, centre, radius, total, count)]
    return Tree(points, weights, of_row.reshape(-1), order, *whole)


def _ranges(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after the other, and which range each is of."""
    n = end - first
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[which], which


def _distances(a: np.ndarray, ai: np.ndarray, b: np.ndarray, bi: np.ndarray) -> np.ndarray:
    out = [_squares(a[ai[s : s + PAIRS]], b[bi[s : s + PAIRS]]) for s in range(0, len(ai), PAIRS)]
    return np.concatenate(out) if out else np.zeros(0, a.dtype)


def _nearest(distance: np.ndarray, entry: np.ndarray, starts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each group the least distance and the lowest entry that has it."""
    least = np.minimum.reduceat(distance, starts)
    return least, np.minimum.reduceat(np.where(distance == least[group], entry, np.iinfo(np.int64).max), starts)


def owners(tree: Tree, entries: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Which entry is nearest to each point, of equals the lowest: balls and the entries that own them whole, and
    the entry of each point.

    A ball inherits the entries that can be nearest to a point of the ball above it. An entry leaves the list if
    the ball lies wholly on the nearer side of the plane between it and the entry nearest to the centre. A ball with
    one entry left is owned; one that is not divided asks its points.
    """
    apart = np.sqrt(((entries[:, None] - entries[None]) ** 2).sum(2).astype(float))
    of_point = np.full(len(tree.points), -1)
    owned = []
    entry = np.sort(np.unique(entries, axis=0, return_index=True)[1])  # of equal entries the lowest wins everywhere
    balls, group = np.zeros(1, np.int64), np.zeros(len(entry), np.int64)
    while len(balls):
        starts = np.searchsorted(group, np.arange(len(balls)))
        distance = _distances(tree.centre, balls[group], entries.astype(float), entry)
        least, best = _nearest(distance, entry, starts, group)
        lead = distance - least[group]
        slack = 1e-9 * (distance + least[group]) + 1e-6  # rounding only ever keeps an entry
        stays = lead <= 2 * tree.radius[balls][group] * apart[entry, best[group]] * (1 + 1e-9) + slack
        entry, group = entry[stays], group[stays]
        left = np.bincount(group, minlength=len(balls))
        leaf = tree.child[balls, 0] < 0
        whole = left == 1
        owned.append((balls[whole], best[whole]))
        at, which = _ranges(tree.first[balls[whole]], tree.end[balls[whole]])
        of_point[tree.order[at]] = best[whole][which]

        starts = np.searchsorted(group, np.arange(len(balls)))
        ask = np.flatnonzero(leaf & ~whole)
        at, which = _ranges(tree.first[balls[ask]], tree.end[balls[ask]])
        if len(at):  # each point of these balls with each entry that is left
            point, lists = tree.order[at], ask[which]
            pair, of = _ranges(starts[lists], starts[lists] + left[lists])
            exact = _distances(tree.points, point[of], entries, entry[pair])
            of_point[point] = _nearest(exact, entry[pair], np.searchsorted(of, np.arange(len(point))), of)[1]

        go = np.flatnonzero(~leaf & ~whole)
        lists = np.repeat(go, 2)
        pair, group = _ranges(starts[lists], starts[lists] + left[lists])
        balls, entry = tree.child[balls[go]].reshape(-1), entry[pair]
    return owned, of_point


def _sums(tree: Tree, entries: np.ndarray, total: np.ndarray, count: np.ndarray) -> None:
    """Add to ``total`` and ``count`` of each entry what it owns: whole balls by what they hold, other points one by one."""
    owned, of_point = owners(tree, entries)
    rest = np.ones(len(tree.points), bool)
    for balls, entry in owned:
        np.add.at(total, entry, tree.total[balls])
        np.add.at(count, entry, tree.count[balls])
        rest[tree.order[_ranges(tree.first[balls], tree.end[balls])[0]]] = False
    np.add.at(total, of_point[rest], tree.points[rest] * tree.weights[rest, None])
    np.add.at(count, of_point[rest], tree.weights[rest])


def whole_numbers(vectors: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """``vec_id, label, v`` of the vectors without null or non-finite components, floor(scale * x) for each x."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    number = lambda x: F.floor(F.greatest(F.lit(-LARGEST * 1.0), F.least(F.lit(LARGEST * 1.0), x.cast("double") * scale)))
    kept = vectors.filter(F.col(vector).isNotNull() & ~bad & (F.size(vector) > 0) & (F.size(vector) % PARTS == 0))
    return kept.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).alias("label"), F.transform(vector, number).alias("v"))


def _trees(rows: DataFrame, width: int) -> DataFrame:
    """``vec_ids, labels, trees``: a row for each chunk of vectors, with the tree of each part."""
    kind = rows.schema["label"].dataType.simpleString()

    def built(batches: Batches) -> Batches:
        for batch in batches:
            for first in range(0, batch.num_rows, CHUNK):
                part = batch.slice(first, CHUNK)
                flat = part.column("v").flatten().to_numpy().reshape(part.num_rows, PARTS, width)
                trees = [pickle.dumps(tuple(tree_of(np.ascontiguousarray(flat[:, p])))) for p in range(PARTS)]
                whole = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
                columns = [whole(part.column("vec_id")), whole(part.column("label")), pa.array([trees], pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_ids", "labels", "trees"])

    return cut(batches_of(rows, built, f"vec_ids array<bigint>, labels array<{kind}>, trees array<binary>"), "trees")


def _round(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks whose entries are the rounded down means of what they own; those that own nothing stay."""

    def summed(batches: Batches) -> Batches:
        total = np.zeros(books.shape, np.int64)
        count = np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for chunk in batch.column(0):
                for p, tree in enumerate(chunk.as_py()):
                    _sums(Tree(*pickle.loads(tree)), books[p], total[p], count[p])
        at = np.flatnonzero(count.reshape(-1))
        listed = pa.array(total.reshape(-1, books.shape[2])[at].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count.reshape(-1)[at]), listed], ["entry", "n", "total"])

    sums = batches_of(trees.select("trees"), summed, "entry bigint, n bigint, total array<bigint>")
    sums = sums.select("entry", "n", F.posexplode("total")).groupBy("entry", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("total"))
    got = sums.toPandas()  # no more rows than the codebooks have numbers
    out = books.reshape(-1, books.shape[2]).copy()
    out[got["entry"].to_numpy(), got["pos"].to_numpy()] = got["total"].to_numpy() // got["n"].to_numpy()
    return out.reshape(books.shape)


def _coded(trees: DataFrame, books: np.ndarray) -> DataFrame:
    def coded(batches: Batches) -> Batches:
        for batch in batches:
            for i in range(batch.num_rows):
                codes, error = [], 0
                for p, stored in enumerate(batch.column("trees")[i].as_py()):
                    tree = Tree(*pickle.loads(stored))
                    own = owners(tree, books[p])[1]
                    codes.append(own[tree.of_row])
                    error = error + _squares(tree.points, books[p][own])[tree.of_row]
                text = np.stack(codes, 1).astype(np.uint8).tobytes().hex()
                code = [text[k : k + 2 * PARTS] for k in range(0, len(text), 2 * PARTS)]
                ids, labels = (batch.column(c).slice(i, 1).flatten() for c in ("vec_ids", "labels"))
                yield pa.RecordBatch.from_arrays([ids, pa.array(code), pa.array(error), labels], ["vec_id", "code", "error", "label"])

    kind = trees.schema["labels"].dataType.elementType.simpleString()
    return cut(batches_of(trees, coded, f"vec_id bigint, code string, error bigint, label {kind}"), "codes")


def encode(
    vectors: DataFrame,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` for each row that has a code.

    Rows with a null vector, or one with null or non-finite components, have none; nor have vectors of no component, of
    a number that does not divide into four parts, or of another number than the vector of the smallest vec_id has. Components
    become floor(scale * x), at most 2 ** 24 in size; each of four equal parts has a codebook of ``entries`` entries, 256 at most: at first
    those of the smallest vec_ids (null ids last, ties by the vector), then in each round the rounded down means of the parts nearest to them. With
    fewer vectors there are fewer entries. ``code``: two hex digits of the nearest entry for each part; ``error``: its squared distances summed;
    ``label_error``: their sum over equal labels, null labels together. Repeated rows stay. An empty table has no rows.

    Vectors are dealt into trees once, a chunk at a time; each round reads them and sends sums of entries only, as many numbers as the
    codebooks have. Nearest entries are exact, ties to the lower one.
    """
    rows = whole_numbers(vectors, vec_id, vector, label, scale)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    width = len(first[0].v) // PARTS if first else 1
    rows = rows.filter(F.size("v") == PARTS * width)
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(min(entries, 256)).collect()
    books = np.array([r.v for r in start], np.int64).reshape(len(start), PARTS, width).transpose(1, 0, 2)
    trees = _trees(rows, width)
    for _ in range(rounds if len(start) else 0):
        books = _round(trees, books)
    coded = _coded(trees, books)
    of_label = cut(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same"), "label-errors")
    sha = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    both = coded.join(of_label, F.col("label").eqNullSafe(F.col("same")))
    return both.select("vec_id", "label", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
