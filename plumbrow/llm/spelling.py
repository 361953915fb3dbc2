"""Spelling variants: words one edit apart, found by grams of variable length (after Li, Wang and Yang, 2007)."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbrow.llm.common import Batches, batches_of, cut, in_parts, utf8_of

RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")  # of UTF-8: A-Z, a-z, U+00C0 to U+00FF
MOST_COUNTED = 100_000  # words that a task counts before it hands them on
FIRST, LAST = "\x02", "\x03"  # stand before and after a word
SHORT, LONG = 2, 4  # lengths of grams


def word_counts(
    docs: DataFrame, shortest: int = 5, least: int = 3, spoil: int | None = 97, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``word, n``: the words of ``shortest`` code points or more that occur ``least`` times in all texts.

    Words are the longest runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case. With ``spoil`` a word
    loses a letter where that divides h, the crc32 of ``<doc_id>:<word>``: the one at h modulo its length.
    Null texts have no words; a null id is an empty text. Repeated rows count again. An empty table has no rows.
    """

    def counted(batches: Batches) -> Batches:
        seen: dict[bytes, int] = {}

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"]
            )
            seen.clear()
            return out

        for batch in in_parts(batches):
            for name, utf8 in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                before = zlib.crc32(f"{name}:".encode())
                for run, n in Counter(RUN.findall(utf8.lower())).items():  # of bytes: A-Z only
                    if spoil and (h := zlib.crc32(run, before)) % spoil == 0:
                        letters = run.decode()
                        at = h % len(letters)
                        run = (letters[:at] + letters[at + 1 :]).encode()
                    if len(run) >= shortest:
                        seen[run] = seen.get(run, 0) + n
                if len(seen) > MOST_COUNTED:
                    yield told()
        yield told()

    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc_id"), utf8_of(text).alias("utf8"))
    counts = batches_of(rows, counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter((F.col("n") >= least) & (F.length("word") >= shortest))


def grams_of(word: str, counts: dict[tuple[int, int], int], frequent: int) -> list[tuple[int, int]]:
    """Places and lengths of the grams that ``word``, ends marked, decomposes into.

    The gram of a place is the longest one of the dictionary there, LONG at most: a gram is in it if it has SHORT
    characters or is one longer than a gram that occurs over ``frequent`` times; what prolongs a rarer gram is pruned.
    Grams within another one do not count. ``counts`` has the occurrences of the gram of each place and length.
    """
    n, end, out = len(word), 0, []
    for p in range(n - SHORT + 1):
        size = SHORT
        while size < LONG and p + size < n and counts[p, size] > frequent:
            size += 1
        if p + size > end:
            end = p + size
            out.append((p, size))
    return out


def affected(word: str, grams: list[tuple[int, int]], counts: dict[tuple[int, int], int], frequent: int) -> int:
    """How many grams one edit of ``word`` can change, at most, wherever it is.

    An edit at place i changes grams that reach over it. It leaves those before it, and those after it as well unless
    a new gram that begins at i or before holds them: such a gram ends LONG places after i at the latest, and is in the dictionary
    only if the part of it from i + 1 to its last but one character is frequent, where that part can tell.
    An insertion before i changes no more than the loss of the character before it.
    """
    at = [0] * len(word)
    for p, size in grams:
        for i in range(p, p + size):
            at[i] += 1
        for i in range(max(0, p + size - LONG), p):
            part = p + size - 2 - i
            if part < SHORT or counts[i + 1, part] > frequent:
                at[i] += 1
    return max(at[:-1])


def _decomposed(words: DataFrame, frequent: int) -> DataFrame:
    """``word, n, mask, loose, grams``: of each word the letters as bits, whether its bound is nothing, and the grams of which
    a near word has at least one among its own: (place, gram)."""
    marked = F.concat(F.lit(FIRST), "word", F.lit(LAST))
    places = "explode(sequence(0, length(marked) - size)) AS place"
    parts = words.select("id", marked.alias("marked")).withColumn("size", F.explode(F.array(*map(F.lit, range(SHORT, LONG + 1)))))
    parts = parts.filter(F.length("marked") >= F.col("size")).selectExpr("id", "marked", "size", places)
    parts = parts.selectExpr("id", "place * 16 + size AS at", "xxhash64(substring(marked, place + 1, size)) AS gram")
    # Counts of equal hashes are shared, in every word alike: that changes the dictionary, not the result.
    counts = cut(parts.groupBy("gram").agg(F.count(F.lit(1)).alias("count")), "gram-counts")
    known = parts.join(counts, "gram").groupBy("id").agg(F.collect_list(F.struct("at", "count")).alias("counts"))

    def decompose(batches: Batches) -> Batches:
        for batch in batches:
            masks, loose, grams = [], [], []
            for word, listed in zip(batch.column("word").to_pylist(), batch.column("counts").to_pylist()):
                counts = {divmod(x["at"], 16): x["count"] for x in listed}
                marked = FIRST + word + LAST
                own = grams_of(marked, counts, frequent)
                bound = len(own) - affected(marked, own, counts, frequent)
                # The rarest first: of two words that share ``bound`` grams each has one of them among so many.
                own.sort(key=lambda g: (counts[g], marked[g[0] : g[0] + g[1]], g[0]))
                grams.append([{"place": p, "gram": marked[p : p + s]} for p, s in own[: len(own) - max(bound, 1) + 1]])
                masks.append(sum(1 << b for b in {ord(c) % 63 for c in word}))
                loose.append(bound < 1)
            listed = pa.array(grams, pa.list_(pa.struct([("place", pa.int32()), ("gram", pa.string())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n"), pa.array(masks, pa.int64()), pa.array(loose), listed],
                ["word", "n", "mask", "loose", "grams"],
            )

    schema = "word string, n bigint, mask bigint, loose boolean, grams array<struct<place:int,gram:string>>"
    return cut(batches_of(words.join(known, "id").select("word", "n", "counts"), decompose, schema), "grams")


def near_pairs(words: DataFrame, frequent: int = 256) -> DataFrame:
    """``a, b``, each pair once: words of ``words(word, n)`` that differ by one inserted, deleted or replaced code point.

    A word decomposes into grams; all but a bounded number of them, each word's own, are in a near word too, at the
    same place or one further. So lists of the rarest grams, by length and place, are merged only as far as the bounds
    require. Words whose grams one edit may all change meet each other by the word and the word less a letter.
    Pairs that meet are verified by their edit distance. Nothing is left out and no list is cut.
    """
    own = _decomposed(cut(words.withColumn("id", F.monotonically_increasing_id()), "words"), frequent)
    length = F.length("word")
    listed = own.select("word", "mask", length.alias("length"), F.inline("grams"))

    def key(size: Column, place: Column) -> Column:
        return F.xxhash64("gram", size, place)

    shorter = listed.select(F.col("word").alias("a"), F.col("mask").alias("a_mask"), key(F.col("length"), F.col("place")).alias("key"))
    place, size = F.col("place"), F.col("length")
    keys = F.array(key(size, place), key(size - 1, place), key(size - 1, place - 1))
    other = listed.select(F.col("word").alias("b"), F.col("mask").alias("b_mask"), F.explode(keys).alias("key"))
    ordered = F.struct(F.length("a"), "a") < F.struct(F.length("b"), "b")
    alike = F.bit_count(F.col("a_mask").bitwiseXOR(F.col("b_mask"))) <= 2
    near = F.levenshtein("a", "b", 1) == 1
    met = shorter.join(other, "key").filter(F.when(alike & ordered, near)).select("a", "b")
    loose = own.filter("loose").select("word")
    less = "transform(sequence(1, length(word)), i -> concat(left(word, i - 1), substring(word, i + 1)))"
    forms = loose.selectExpr("word", f"explode(array_distinct(array_append({less}, word))) AS form")
    left, right = forms.withColumnRenamed("word", "a"), forms.withColumnRenamed("word", "b")
    among = left.join(right, "form").filter(F.when(ordered, near)).select("a", "b")
    return cut(met.union(among).distinct(), "near-words")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of all words with a form: where their forms lead. Each round doubles the way; forms at least double
    the count, so ways are short and end."""
    way = cut(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        further = way.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = cut(way.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further"), "ways")
        if step.filter("further IS NOT NULL").isEmpty():
            return way
        way = step.drop("further")


def variants(words: DataFrame, ratio: int = 2, frequent: int = 256) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of ``words(word, n)``, whose words are distinct.

    ``n_near``: how many words are near, by one edit. ``form``: the near word of largest n, of equals the smallest in code
    point order, if its n is ``ratio`` times the word's; else null, as is its n. ``root``: where forms lead, the word itself without one.
    Rows with a null word have nothing near. ``ratio`` is over 1; else forms could lead round in circles.
    """
    words = cut(words.select("word", "n"), "counted-words")
    pairs = near_pairs(words.filter("word IS NOT NULL"), frequent)
    both = pairs.union(pairs.select("b", "a")).toDF("word", "near")
    with_n = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = with_n.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    best = best.select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))
    found = words.join(best, "word", "left")
    enough = F.col("form_n") >= F.col("n") * ratio
    found = found.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(enough, F.col("form")).alias("form"),
        F.when(enough, F.col("form_n")).alias("form_n"),
    )
    found = cut(found, "forms")
    out = found.join(_roots(found.filter("form IS NOT NULL").select("word", "form")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
