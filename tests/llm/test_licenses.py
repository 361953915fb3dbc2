import math
import re
from collections import Counter

from plumbrow.llm import licenses
from plumbrow.llm.queries import QUERIES


def words(text):
    return [w for w in re.split(r"(?:[^\w.+-]|_|[.](?![0-9])|(?<![^\W_])[.+-]+)+", text.lower()) if w]


def brute(files):
    """``files``: texts by path."""
    templates = [(name, Counter(words(t))) for name, t in licenses.TEMPLATES]
    vocabulary = {t for _, c in templates for t in c}
    df = Counter(w for t in files.values() for w in set(words(t or "")) & vocabulary)
    idf = {t: math.log((len(files) + 1) / (df[t] + 1)) + 1 for t in vocabulary}
    other = sum(idf.values()) / len(idf)
    own = {}
    for path, text in files.items():
        found, inside = [], 0
        for sentence in re.split(r"\n|(?<=[.!?])\s+", text or ""):
            c = Counter(words(sentence))
            length = math.sqrt(sum((n * idf.get(t, other)) ** 2 for t, n in c.items()))
            scores = []
            for name, t in templates:
                norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in t.items()))
                if length:
                    scores.append((-round(sum(c[w] * idf[w] * n * idf[w] for w, n in t.items()) / norm / length, 6), name))
            if scores and -min(scores)[0] >= licenses.THRESHOLD:
                found.append(min(scores))
                inside += sum(c.values())
        own[path] = (min(found) if found else None, bool(found) and inside >= licenses.FILE_SHARE * len(words(text or "")))
    folder = lambda p: p.rpartition("/")[0]
    given = {}
    for path, (best, is_file) in own.items():
        if is_file:
            given.setdefault(folder(path), []).append((best[0], path, best[1]))
    out = set()
    for path, (best, is_file) in own.items():
        if best:
            out.add((path, best[1], "file" if is_file else "header", None))
            continue
        at = folder(path)
        while at not in given and at:
            at = folder(at)
        out.add((path, min(given[at])[2], "folder", at) if at in given else (path, None, "none", None))
    return out


def rows_of(df):
    return {(r.path, r.licence, r.via, r.folder) for r in df.collect()}


FILES = {
    "a/LICENSE": "Released under the MIT License.", "a/b/c/x.py": "import x", "a/b/LICENSE": "Licensed under CC BY-NC 4.0.\n",
    "a/b/c/d/y.py": "# Licensed under the Apache License, Version 2.0.\n" + "code and more code " * 20, "z.py": "print(1)", "q/r/s.py": "x",
    "a/two": "This work is licensed under the GNU General Public License, version 3. And prose that goes on and on for long.",
    "a/empty": "", "a/null": None, "a/long": "word " * 50_000, "a/mit": "mit der mit und mit license", "q/UPPER": "ALL RIGHTS RESERVED",
    "q/deep/er/f": "All of the rights that are not reserved here are in some other text of the public",
}


def test_small_tree(spark):
    df = spark.createDataFrame([(p, t, 1) for p, t in FILES.items()], "path string, text string, score int")
    got = rows_of(licenses.scan(df))
    assert got == brute(FILES)
    assert ("a/b/c/x.py", "CC-BY-NC-4.0", "folder", "a/b") in got and ("a/empty", "MIT", "folder", "a") in got
    assert ("a/b/c/d/y.py", "Apache-2.0", "header", None) in got and ("q/deep/er/f", "proprietary", "folder", "q") in got
    odd = spark.createDataFrame([(None, "All rights reserved."), (None, "x"), ("b", "x"), ("b", "x")], "path string, text string")
    assert rows_of(licenses.scan(odd)) >= {("b", None, "none", None)}
    assert licenses.scan(odd.filter("false")).count() == 0


def test_query_against_brute_force(spark, sf_dir, texts, documents):
    paths = {}
    for r in documents.collect():
        folder = f"{r.source}/{r.lang}" + ("" if len(r.text) < 100 else f"/{r.doc_id // 1000}")
        paths[f"{folder}/{r.doc_id}"] = r.text
    got = QUERIES["op7_license_scan"](spark, sf_dir)
    assert rows_of(got) == brute(paths)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
