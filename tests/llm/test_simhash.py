import random

import xxhash

from plumbrow.llm import simhash
from plumbrow.llm.components import components
from plumbrow.llm.queries import QUERIES


def brute_print(text, words=3):
    w = [x for x in _split(text or "") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _split(text):
    out = [[]]
    for c in text:
        if c in " \t\n\x0b\x0c\r":
            out.append([])
        else:
            out[-1].append(chr(ord(c) + 32) if "A" <= c <= "Z" else c)
    return ["".join(w) for w in out]


def brute_components(prints, radius=2):
    """``prints``: rows of (id, fingerprint); the smallest id that links lead to, for each row."""
    least = {}
    values = sorted({p for _, p in prints})
    root = {p: p for p in values}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return [(i, p, least.get(find(p))) for i, p in prints]


def test_query_against_brute_force(spark, sf_dir, texts):
    got = QUERIES["op1_simhash_near_dedup"](spark, sf_dir).collect()
    want = brute_components([(i, brute_print(t)) for i, t in texts.items()])
    assert sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got) == sorted(want)
    assert len({c for _, _, c in want}) < len(want)


def test_odd_texts(make_docs):
    rows = [None, "", " \n\t", "one", "One", "a b", "a  b", "ÄB äb", "x " * 30_000, "x " * 30_000, (7, "again"), (7, "again"), (None, "z z z z"), (None, "q")]
    rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
    got = simhash.near_duplicates(make_docs(rows)).collect()
    want = brute_components([(i, brute_print(t)) for i, t in rows])
    assert sorted(map(str, [(r.doc_id, r.f0 % (1 << 64), r.component_id) for r in got])) == sorted(map(str, want))
    assert simhash.near_duplicates(make_docs([])).count() == 0


def test_all_links_are_found(spark):
    """Chains and clouds of fingerprints, with a hot group, against all pairs."""
    rnd = random.Random(5)
    prints = [rnd.getrandbits(64) for _ in range(150)]
    for _ in range(250):
        p = rnd.choice(prints)
        for _ in range(rnd.choice([1, 2, 2, 3])):
            p ^= 1 << rnd.randrange(64)
        prints.append(p)
    hot = rnd.getrandbits(64)
    prints += [hot ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(300)] + [0, 1, (1 << 64) - 1]
    rows = [(i, p) for i, p in enumerate(prints)]
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in rows]
    df = spark.createDataFrame(signed, "doc_id bigint, f0 bigint")
    got = {r.f0 % (1 << 64): r.component_id for r in simhash.linked_classes(df, 2, simhash.segments(1, 2, 1)).collect()}
    assert all(got[p] == c for _, p, c in brute_components(rows))


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(100, 300)] + [(5, 5), (1, 2), (2, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 100 for i in range(100, 301)}, 1: 1, 2: 1}


def test_wider_fingerprints_find_near_copies(make_docs):
    rnd = random.Random(1)
    base = [[f"w{rnd.randrange(10**6)}" for _ in range(200)] for _ in range(30)]
    texts = [" ".join(w) for w in base]
    for w in base:  # two of 200 words edited: 0.9 of the 5-word shingles stay
        w = list(w)
        w[50], w[120] = "new", "words"
        texts.append(" ".join(w))
    got = simhash.near_duplicates(make_docs(texts), lanes=5, radius=55, per_lane=2, wild=10, width=26, rounds=5)
    found = {r.doc_id: r.component_id for r in got.collect()}
    assert sum(found[i + 30] == i for i in range(30)) >= 29
    assert [found[i] for i in range(30)] == list(range(30))


def test_rounds_lose_no_link(spark):
    """Whichever of 0 and ``y`` is the other's root after the first round, one text is near the other only."""
    y, z, w = 0b111 << 32, (0b111 << 32) + 0b111, 0b111000
    df = spark.createDataFrame(list(enumerate([0, y, z, w])), "doc_id bigint, f0 bigint")
    pieces = simhash.segments(1, 2, 0)
    got = {r.f0: r.component_id for r in simhash.linked_classes(df, 4, pieces, rounds=2).collect()}
    assert got == {0: 0, y: 0, z: 0, w: 0}
