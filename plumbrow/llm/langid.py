"""Language of texts: scripts narrow the candidates, then Viterbi over word scores labels spans."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from plumbrow.llm.common import Batches, batches_of, bounded_sample, in_parts, share, text_of

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
BUCKETS = 1 << 16
SWITCH = 6.0  # what a change of language costs, in nats
SHARPNESS = 0.5  # trigrams overlap, so their evidence counts half
OUT_OF_SCRIPT = -30.0
CACHE_BYTES = 32 << 20  # of the words whose scores a task keeps
WORD_BYTES = 200  # of a word in it, besides its scores

# First code points of ranges of letters, and their scripts; ranges end where the next begins.
SCRIPT_RANGES = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "other"), (0x0750, "Arabic"), (0x0780, "other"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Odia"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x13A0, "other"), (0x1780, "Khmer"), (0x1800, "other"), (0x1C80, "Cyrillic"),
    (0x1C90, "Georgian"), (0x1CC0, "other"), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"),
    (0x2C60, "Latin"), (0x2C80, "other"), (0x3040, "Kana"), (0x3100, "other"), (0x3130, "Hangul"),
    (0x3190, "other"), (0x31F0, "Kana"), (0x3200, "other"), (0x3400, "Han"), (0xA000, "other"), (0xA720, "Latin"),
    (0xA800, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB10, "other"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "other"), (0xFE70, "Arabic"), (0xFF00, "Latin"),
    (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "other"), (0x20000, "Han"),
)
STARTS = np.array([s for s, _ in SCRIPT_RANGES])
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
SCRIPT_OF_RANGE = np.array([SCRIPTS.index(name) for _, name in SCRIPT_RANGES])


class Model(NamedTuple):
    langs: list[str]
    weights: np.ndarray  # (BUCKETS, langs): log-probability less the mean over languages
    scripts: np.ndarray  # (SCRIPTS, langs): whether the language is written so


def words_of(text: str) -> list[str]:
    """Runs of letters and their marks, in lower case."""
    return WORD.findall(text.lower())


def _trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the character trigrams of all words (ends count as a character), the word of each, and
    the script of each word's first letter."""
    joined = "\0" + "\0".join(words) + "\0"
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1]) * np.uint64(0x85EBCA77) + c[2:]
    h = (h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(48)
    whole = c[1:-1] != 0
    word = np.cumsum(c == 0)[:-2] - 1
    first = np.flatnonzero(c == 0)[:-1] + 1
    script = SCRIPT_OF_RANGE[np.searchsorted(STARTS, c[first].astype(np.int64), "right") - 1]
    return h[whole].astype(np.int64), word[whole], script


def _counts(rows: DataFrame, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams by (bucket, language) and words by (script, language), summed in each task, then by Spark."""
    place = {x: i for i, x in enumerate(langs)}

    def counted(batches: Batches) -> Batches:
        grams = np.zeros((BUCKETS, len(langs)), np.int64)
        scripts = np.zeros((len(SCRIPTS), len(langs)), np.int64)
        for batch in in_parts(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if w := words_of(text):
                    h, _, script = _trigrams(w)
                    grams[:, place[lang]] += np.bincount(h, minlength=BUCKETS)
                    scripts[:, place[lang]] += np.bincount(script, minlength=len(SCRIPTS))
        both = np.concatenate([grams, scripts])
        at, lang = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(lang), pa.array(both[at, lang])], ["at", "lang", "n"])

    sums = batches_of(rows, counted, "at bigint, lang bigint, n bigint").groupBy("at", "lang").agg(F.sum("n").alias("n"))
    out = np.zeros((BUCKETS + len(SCRIPTS), len(langs)))
    got = sums.toPandas()
    out[got["at"].to_numpy(), got["lang"].to_numpy()] = got["n"].to_numpy()
    return out[:BUCKETS], out[BUCKETS:]


def fit(labelled: DataFrame, most: int = 4000, lang: str = "lang", doc_id: str = "doc_id", text: str = "text") -> Model:
    """Learn from up to about ``most`` documents of each language, picked by a hash of the id.

    Rows without a text or a language do not count. The model's size depends on the languages only.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(doc_id).alias("doc_id"), text_of(text).alias("text")
    )
    counts, sample = bounded_sample(rows, "lang", "doc_id", most)
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPTS), 0), bool))
    grams, scripts = _counts(sample.select("lang", "text"), langs)
    # Smoothed as if each bucket had been seen as often as in a language of average mix, 1/50 per bucket at least.
    prior = (grams.sum(axis=1, keepdims=True) + 1) / (grams.sum() + BUCKETS)
    logs = np.log((grams + 50 * prior) / (grams.sum(axis=0) + 50))
    share = scripts / np.maximum(1, scripts.sum(axis=0))
    return Model(langs, logs - logs.mean(axis=1, keepdims=True), share >= 0.01)


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """(words, languages): evidence for each language; languages of another script are out; words of a
    script that no learned language uses say nothing."""
    grams, word, script = _trigrams(words)
    scores = np.zeros((len(words), len(model.langs)))
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    scores[word[starts]] = np.add.reduceat(model.weights[grams], starts) * SHARPNESS
    allowed = model.scripts[script]
    scores[~allowed] = OUT_OF_SCRIPT
    scores[~allowed.any(axis=1)] = 0.0
    return scores


class _Scores(dict):
    """Row numbers of words; new words get the next ones."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def viterbi(scores: np.ndarray, ids: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word, for documents that lie one after the other in ``ids``.

    All documents advance together: step t serves those of more than t words.
    """
    langs = scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    n, starts = lengths[order], (np.cumsum(lengths) - lengths)[order]
    active = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), "left")  # documents longer than t
    back = np.empty((len(ids), langs), np.int8 if langs < 128 else np.int32)
    best = np.zeros((len(n), langs))
    stay = np.arange(langs)
    for t, k in enumerate(active):
        at, b = starts[:k] + t, best[:k]
        if t:
            top = b.argmax(axis=1)
            change = b[np.arange(k), top][:, None] - switch
            back[at] = np.where(b >= change, stay, top[:, None])
            np.maximum(b, change, out=b)
        b += scores[ids[at]]
    path = np.empty(len(ids), np.int64)
    state = best.argmax(axis=1) if langs else np.zeros(len(n), np.int64)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        path[at] = state[:k]
        if t:
            state[:k] = back[at, state[:k]]
    return path


def label_spans(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, spans, carried`` for each row of ``docs``; texts are read whole.

    ``spans``: runs of words of one language as (first_word, words, letters, lang). ``lang_pred`` is the
    language of most letters, of equals the first by name; ``score`` its share of all letters, words
    of unlearned scripts counting for no language. Null, empty and letterless texts are ``und`` with
    score 0 and no spans, as is every text if no language was learned. Repeated rows stay, each with
    the same result; other columns of ``docs`` come as the struct ``carried``.
    """
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text"), F.struct(*docs.columns).alias("carried")
    )
    return _labelled(rows, model)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``label_spans`` without the other columns."""
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text"), F.lit(None).cast("int").alias("carried")
    )
    return _labelled(rows, model).drop("carried")


def _labelled(rows: DataFrame, model: Model) -> DataFrame:
    shared = share(rows.sparkSession, tuple(model))  # plain values only
    span = pa.struct([("first_word", pa.int32()), ("words", pa.int32()), ("letters", pa.int64()), ("lang", pa.string())])

    def labelled(batches: Batches) -> Batches:
        model = Model(*shared.value)
        langs = model.langs
        known, scores, letters = _Scores(), np.zeros((0, len(langs))), np.zeros(0, np.int64)
        usable = np.zeros(0, bool)
        most = CACHE_BYTES // (WORD_BYTES + 8 * len(langs))
        for batch in in_parts(batches):
            if len(known) > most:
                known, scores, letters, usable = _Scores(), scores[:0], letters[:0], usable[:0]
            per_doc = [np.fromiter(map(known.__getitem__, w := words_of(t)), np.int64, len(w)) for t in batch.column(1).to_pylist()]
            if fresh := list(known)[len(scores) :]:
                new = word_scores(fresh, model)
                scores = np.concatenate([scores, new])
                letters = np.concatenate([letters, np.fromiter(map(len, fresh), np.int64, len(fresh))])
                usable = np.concatenate([usable, model.scripts[_trigrams(fresh)[2]].any(axis=1)])
            lengths = np.array([len(w) for w in per_doc], np.int64)
            ids = np.concatenate([np.empty(0, np.int64), *per_doc])
            path = viterbi(scores, ids, lengths) if langs else np.zeros(len(ids), np.int64)
            names, shares, spans, start = [], [], [], 0
            for n in lengths.tolist():
                own, at = path[start : start + n], ids[start : start + n]
                start += n
                if not n or not langs:
                    names.append("und")
                    shares.append(0.0)
                    spans.append([])
                    continue
                size = letters[at]
                per_lang = np.bincount(own, size * usable[at], len(langs))
                top = int(per_lang.argmax())
                names.append(langs[top])
                shares.append(float(per_lang[top] / size.sum()))
                cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                spans.append(
                    [
                        {"first_word": int(a), "words": int(m), "letters": int(s), "lang": langs[own[a]]}
                        for a, m, s in zip(cuts, np.diff(np.r_[cuts, n]), np.add.reduceat(size, cuts))
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, pa.list_(span)), batch.column(2)],
                ["doc_id", "lang_pred", "score", "spans", "carried"],
            )

    schema = (
        "doc_id bigint, lang_pred string, score double, "
        "spans array<struct<first_word:int,words:int,letters:bigint,lang:string>>, carried "
    )
    return batches_of(rows, labelled, schema + rows.schema["carried"].dataType.simpleString())
