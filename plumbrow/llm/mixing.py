"""Mixing sources to target weights: soft memberships in domains, and rates fitted by projected gradients."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbrow.llm.common import Batches, batches_of, bounded_sample, cut, share, utf8_of
from plumbrow.llm.features import DIMENSIONS, Indicators

log = logging.getLogger(__name__)

CLOSE = 1e-3  # targets are met if the error is below this share of them
POWERS = 4  # passes that bound the largest eigenvalue more closely
SMALLEST = 0.01  # errors of targets below this share of all tokens are measured against it


class Domains(NamedTuple):
    names: list[str]
    at: np.ndarray  # features that count
    weights: np.ndarray  # (features that count, domains)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(initial=0.0))
    return e / e.sum()


def _descend(x: list[np.ndarray], y: np.ndarray, share: np.ndarray, domains: int, fewest: int, epochs: int) -> tuple:
    """Softmax regression by AdaGrad on indicators of length 1; rows weigh as many as they stand for, in moderation."""
    counts = np.zeros(DIMENSIONS, np.int64)
    for row in x:
        counts[row] += 1
    at = np.flatnonzero(counts >= fewest)
    place = np.full(DIMENSIONS, -1)
    place[at] = np.arange(len(at))
    rows = [(p := place[row])[p >= 0] for row in x]
    w, seen = np.zeros((len(at), domains)), np.full((len(at), domains), 1e-2)
    of_label = np.array([(1 / share[y == k]).sum() if (y == k).any() else 1.0 for k in range(domains)])
    # The prior is that of the corpus; each row weighs 1, and the logs of the label shares are put on top.
    prior = np.log(of_label / of_label.sum()) - np.log(np.maximum(1, np.bincount(y.astype(np.int64), minlength=domains)) / max(1, len(y)))
    random = np.random.default_rng(0)
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            r = rows[i]
            if not len(r):
                continue
            value = 1 / np.sqrt(len(r))
            error = _softmax(w[r].sum(axis=0) * value)
            error[y[i]] -= 1
            step = error * value
            seen[r] += step * step
            w[r] -= 0.3 * step / np.sqrt(seen[r])
    return at, w, prior


def fit_domains(
    docs: DataFrame,
    labels: DataFrame,
    most: int = 2500,
    fewest: int = 3,
    epochs: int = 8,
    label: str = "domain",
    doc_id: str = "doc_id",
    text: str = "text",
) -> tuple[Domains, np.ndarray]:
    """A classifier of domains from a table of labels: up to about ``most`` rows of each label, picked by a hash
    of the id, go to every task of ``docs``, and their features meet in one. Null labels do not count; without
    labels there are no domains."""
    known = labels.filter(F.col(label).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(label).cast("string").alias("label"))
    counts, chosen = bounded_sample(known, "label", "doc_id", most)
    names = sorted(counts)
    number = {x: i for i, x in enumerate(names)}
    texts = docs.select(F.col(doc_id).alias("doc_id"), utf8_of(text).alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "share", "text")

    def counted(batches: Batches) -> Batches:
        of = Indicators()
        for batch in batches:
            x = pa.array(of.lists(batch.column(3).to_pylist()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], x], ["doc_id", "label", "share", "x"])

    def fitted(batches: Batches) -> Batches:
        ids, y, share, x = [], [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            y += [number[v] for v in batch.column(1).to_pylist()]
            share += batch.column(2).to_pylist()
            x += [np.asarray(v, np.int64) for v in batch.column(3).to_pylist()]
        order = sorted(range(len(x)), key=lambda i: (ids[i] is None, ids[i] or 0, len(x[i])))
        at, w, prior = _descend(
            [x[i] for i in order], np.array(y)[order], np.array(share)[order], len(names), fewest, epochs
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array([at], pa.list_(pa.int64())), pa.array([w.ravel()], pa.list_(pa.float64())), pa.array([prior], pa.list_(pa.float64()))],
            ["at", "w", "prior"],
        )

    features = batches_of(sample, counted, "doc_id bigint, label string, share double, x array<bigint>")
    got = batches_of(features.repartition(1), fitted, "at array<bigint>, w array<double>, prior array<double>").first()
    if got is None or not got.w:  # no labelled text, or none with a feature that counts
        names = []
        return Domains(names, np.zeros(0, np.int64), np.zeros((0, 0), np.float32)), np.zeros(0)
    w = np.array(got.w, np.float32).reshape(-1, len(names))
    return Domains(names, np.array(got.at, np.int64), w), np.array(got.prior)


def memberships(
    docs: DataFrame,
    domains: tuple[Domains, np.ndarray],
    source: str = "source",
    doc_id: str = "doc_id",
    text: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """``doc_id, source, tokens, posteriors, carried`` for each row of ``docs``; ``tokens`` counts what stands
    between ASCII white space."""
    shared = share(docs.sparkSession, (*domains[0], domains[1]))  # plain values only

    def predicted(batches: Batches) -> Batches:
        names, at, w, prior = shared.value
        place = np.full(DIMENSIONS, len(at), np.int64)
        place[at] = np.arange(len(at))
        # One more row, of zeros, for features that do not count; one more column counts those that do.
        w = np.concatenate([w, np.ones((len(at), 1), np.float32)], axis=1)
        w = np.concatenate([w, np.zeros((1, len(names) + 1), np.float32)])
        of = Indicators(place < len(at))
        for batch in batches:
            counts, posteriors = [], []
            for x, starts, n in of(batch.column(2).to_pylist()):
                counts += n.tolist()
                sums = np.add.reduceat(w[place[x]], starts, axis=0, dtype=np.float64)
                z = sums[:, :-1] / np.sqrt(np.maximum(1, sums[:, -1:])) + prior
                e = np.exp(z - z.max(axis=1, initial=-1e9, keepdims=True))
                posteriors += list(e / e.sum(axis=1, keepdims=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(posteriors, pa.list_(pa.float64())), batch.column(3)],
                ["doc_id", "source", "tokens", "posteriors", "carried"],
            )

    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        utf8_of(text).alias("text"),
        (F.struct(*carry) if carry else F.lit(None).cast("int")).alias("carried"),
    )
    carried = rows.schema["carried"].dataType.simpleString()
    return batches_of(rows, predicted, f"doc_id bigint, source string, tokens bigint, posteriors array<double>, carried {carried}")


def tempered(totals: Mapping[str, float], power: float = 0.5) -> dict[str, float]:
    """Shares in proportion to a power of the totals: under 1 it lifts small sources."""
    raised = {k: max(v, 0.0) ** power for k, v in totals.items()}
    whole = sum(raised.values()) or 1.0
    return {k: v / whole for k, v in raised.items()}


class Fit(NamedTuple):
    names: list[str]  # of the targets
    targets: np.ndarray
    reached: np.ndarray
    gradients: np.ndarray  # of each round; a document's rate follows from them and its memberships
    step: float
    ridge: float
    everything: float  # tokens of all documents


def missed(fit: Fit, close: float = CLOSE) -> dict[str, tuple[float, float]]:
    """Target and what the rates reach, in tokens, of the targets that the fit does not meet to ``close``."""
    scale = np.maximum(fit.targets, SMALLEST * max(fit.everything, 1.0))
    off = np.flatnonzero(np.abs(fit.reached - fit.targets) >= close * scale)
    return {fit.names[i]: (float(fit.targets[i]), float(fit.reached[i])) for i in off}


class _Members:
    """Rows of a matrix of memberships: posteriors of domains, then 1 under the row's source. Sources are kept as
    numbers, so a row takes no more memory however many there are."""

    def __init__(self, batch: pa.RecordBatch, sources: dict[str, int], domains: int):
        self.posteriors = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, domains)
        self.source = np.array([sources.get(s, -1) for s in batch.column(0).to_pylist()], np.int64)
        self.tokens = batch.column(1).to_numpy().astype(float)
        self._known = self.source >= 0
        self._sources, self._domains = len(sources), domains

    def along(self, x: np.ndarray) -> np.ndarray:
        """The matrix times ``x``, a number for each target."""
        out = self.posteriors @ x[: self._domains]
        out[self._known] += x[self._domains :][self.source[self._known]]
        return out

    def summed(self, x: np.ndarray) -> np.ndarray:
        """``x``, a number for each row, times the matrix."""
        of_sources = np.bincount(self.source[self._known], x[self._known], self._sources)
        return np.concatenate([x @ self.posteriors, of_sources])


def _replayed(m: _Members, gradients: np.ndarray, step: float, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates of documents, and where the next gradient is taken, after the rounds of ``gradients``."""
    rate = np.ones(len(m.tokens))
    ahead, t = rate, 1.0
    for pull in map(m.along, gradients):
        new = np.maximum(0.0, ahead - step * (pull + ridge * (ahead - 1.0)))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, rate, t = new + (t - 1) / t_new * (new - rate), new, t_new
    return rate, ahead


def fit_rates(
    members: DataFrame,
    domain_names: Sequence[str],
    domain_shares: Mapping[str, float],
    source_shares: Mapping[str, float],
    ridge: float = 1e-3,
    rounds: int = 40,
    close: float = CLOSE,
) -> Fit:
    """Nonnegative rates whose expected tokens come close to shares of all tokens, by domain and by source.

    Shares of sources are of the tokens of these sources. Least squares on the errors relative to the
    targets (to SMALLEST of all tokens, for smaller targets), plus ``ridge`` times the squared distance of rates from 1, by
    accelerated projected gradients: a round sums tokens * memberships * rates over all documents
    and sends one number per target to the driver. Rates are not stored: each task recomputes them
    from the gradients so far. Ends after ``rounds``, or when all targets are met to ``close``; ``missed`` tells which are not.

    The step follows from a bound of the largest eigenvalue of the least squares: their matrix has no negative entries, so
    for positive y no eigenvalue is above the greatest ratio of (matrix * y) to y (Collatz and Wielandt). POWERS products with a
    vector, each a sum over documents, bring the two together; the matrix itself is never built.
    """
    domains, sources = len(domain_names), {s: i for i, s in enumerate(source_shares)}
    k = domains + len(sources)
    rows = members.select("source", "tokens", "posteriors")

    def summed(f: Callable[[_Members], np.ndarray], size: int = k) -> np.ndarray:
        """The sum over all documents of f(memberships), an array of ``size`` numbers."""

        def partial(batches: Batches) -> Batches:
            total = np.zeros(size)
            for batch in batches:
                total += f(_Members(batch, sources, domains))
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], ["at", "x"])

        sums = batches_of(rows, partial, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(size)
        for r in sums:
            out[r.at] = r.x
        return out

    def first(m: _Members) -> np.ndarray:
        return np.concatenate([[m.tokens.sum()], m.summed(m.tokens), m.summed(m.tokens * m.along(np.ones(k)))])

    found = summed(first, 1 + 2 * k)
    everything, plain, product = found[0], found[1 : 1 + k], found[1 + k :]
    of_domains = sum(domain_shares.get(n, 0.0) for n in domain_names) or 1.0
    wanted = np.array([domain_shares.get(n, 0.0) for n in domain_names]) / of_domains * everything
    targets = np.concatenate([wanted, np.array(list(source_shares.values())) * plain[domains:].sum()])
    scale = np.maximum(targets, SMALLEST * max(everything, 1.0))
    y, largest = np.ones(k), 1.0
    if everything and k:
        largest = (product / scale).max()
        for _ in range(POWERS):
            y = np.maximum(product / scale / (product / scale).max(), 1e-9)
            product = summed(lambda m: m.summed(m.tokens * m.along(y)))
            largest = min(largest, (product / scale / y).max())
    step = 1.0 / (largest + ridge)
    gradients: list[np.ndarray] = []
    at = plain
    for _ in range(rounds if everything and k else 0):
        error = (at - targets) / scale
        if np.abs(error).max() < close:
            break
        gradients.append(error)
        so_far = np.array(gradients)
        at = summed(lambda m: m.summed(m.tokens * _replayed(m, so_far, step, ridge)[1]))
    history = np.array(gradients).reshape(len(gradients), k)
    reached = summed(lambda m: m.summed(m.tokens * _replayed(m, history, step, ridge)[0]))
    names = [*(f"domain:{n}" for n in domain_names), *(f"source:{s}" for s in source_shares)]
    return Fit(names, targets, reached, history, step, ridge, everything)


def rated(members: DataFrame, domain_names: Sequence[str], source_shares: Mapping[str, float], fit: Fit) -> DataFrame:
    """``members`` with ``rate``: how often a document is to be seen."""
    domains, sources = len(domain_names), {s: i for i, s in enumerate(source_shares)}
    names = members.columns

    def with_rates(batches: Batches) -> Batches:
        for batch in batches:
            m = _Members(batch.select(["source", "tokens", "posteriors"]), sources, domains)
            rate, _ = _replayed(m, fit.gradients, fit.step, fit.ridge)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], [*names, "rate"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema) + ", rate double"
    return batches_of(members, with_rates, schema)


def mix(
    docs: DataFrame,
    labels: DataFrame,
    domain_shares: Mapping[str, float],
    source_shares: Mapping[str, float] | None = None,
    power: float = 0.5,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    label: str = "domain",
    carry: Sequence[str] = (),
) -> DataFrame:
    """``doc_id, source, tokens, posteriors, carried, rate, copies`` for each row of ``docs``.

    ``labels`` has an id and a domain for some documents; the classifier of these gives each document
    ``posteriors``, in the order of the domains' names. ``domain_shares`` and ``source_shares`` (by default the
    shares of tokens to the power ``power``) are the wanted shares of all tokens; labelled domains without one
    are wanted at 0, and shares of domains that no row is labelled with are spread over the others. ``rate`` is 0 or more; ``copies`` is the rate rounded up or down by a hash of the id so
    that it is right on average. Targets that the rates miss are logged. Null and empty texts have no tokens and keep a rate by their
    memberships; a null source belongs to no source's total. An empty table gives an empty one.
    """
    domains = fit_domains(docs, labels, label=label, doc_id=doc_id, text=text)
    members = cut(memberships(docs, domains, source, doc_id, text, carry), "memberships")
    if source_shares is None:
        totals = members.filter(F.col("source").isNotNull()).groupBy("source").agg(F.sum("tokens").alias("n")).collect()
        source_shares = tempered({r.source: float(r.n) for r in sorted(totals)}, power)
    names = domains[0].names
    fit = fit_rates(members, names, domain_shares, source_shares)
    if off := missed(fit):
        log.warning("targets missed (tokens wanted, reached): %s", off)
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    whole = F.floor("rate")
    copies = whole + (place < F.col("rate") - whole).cast("int")
    return rated(members, names, source_shares, fit).withColumn("copies", copies.cast("int"))
