"""Periodic runs against a plain search of all stretches."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from ragloom.llm import periodic_runs
from ragloom.llm.queries import op12_periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_by_force(w, least=6, exponent=4):
    """For every period, maximal stretches of equal pairs; of one stretch the smallest period."""
    found = {}
    for p in range(1, len(w)):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            k = i
            while k + p < len(w) and w[k] == w[k + p]:
                k += 1
            if k + p - i >= 2 * p:
                found.setdefault((i, k + p), p)
            i = k
    return sorted((s, e - s, p) for (s, e), p in found.items() if e - s >= max(least, exponent * p))


def edited(doc, w):
    h = zlib.crc32(str(doc).encode())
    g, n = h // 10, len(w)
    if doc is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def row_by_force(doc, text):
    w = edited(doc, WORD.findall(text or ""))
    runs = runs_by_force(w)
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *top, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def odd_words(seed, n):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        piece = [rng.choice("abcé") for _ in range(rng.randint(1, 6))]
        out += piece * rng.choice([1, 1, 2, 5, 9]) + piece[: rng.randint(0, len(piece))]
    return out[:n]


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_all_stretches(seed):
    rng = random.Random(seed)
    docs = [odd_words(seed * 100 + k, rng.choice([0, 1, 5, 6, 7, 30, 200])) for k in range(30)] + [["a"] * 6, ["a"] * 5, [], list("ab") * 40, fibonacci(300), list("aab" * 7 + "ab" * 20)]
    ids = {w: i for i, w in enumerate(sorted({w for d in docs for w in d}))}
    firsts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    keys = np.array([ids[w] + 1000 * k for k, d in enumerate(docs) for w in d], np.int64)
    for settings in (periodic_runs.Settings(), periodic_runs.Settings(least=2, exponent=2), periodic_runs.Settings(least=9, exponent=3)):
        start, end, period = periodic_runs.find_runs(keys, firsts, settings)
        found = sorted(zip(start.tolist(), end.tolist(), period.tolist()))
        expected = [(f + s, f + s + n, p) for f, d in zip(firsts.tolist(), docs) for s, n, p in runs_by_force(d, settings.least, settings.exponent)]
        assert found == sorted(expected)


def test_common_prefixes_equal_comparison():
    rng = random.Random(3)
    for n in (1, 2, 17, 300):
        keys = np.array([rng.choice([1, 2, 3]) for _ in range(n)])
        suffixes = periodic_runs.Suffixes(keys)
        if n == 1:
            continue
        i, k = (np.array(x) for x in zip(*[rng.sample(range(n), 2) for _ in range(500)]))

        def length(a, b):
            m = 0
            while max(a, b) + m < n and keys[a + m] == keys[b + m]:
                m += 1
            return m

        assert suffixes.common(i, k).tolist() == [length(a, b) for a, b in zip(i, k)]


def table():
    rng = random.Random(9)
    rows = [(d, " ".join(odd_words(d, rng.choice([3, 20, 100]))), "clash") for d in range(120)]
    rows += [(None, "x " * 9, "c"), (None, None, None), (200, "", "c"), (201, " \t\n ", "c"), (202, None, "c"), (7, "z\x0bz\x0cz  z\rz\tz z", "c"), rows[0], rows[0]]
    rows += [(203, "a b " * 8, "c"), (204, "  " * 7, "c"), (205, "ab c " * 3000, "c"), (206, "one" * 4000, "c"), (-5, "d e " * 10, "c")]
    return rows


def test_rows_equal_force(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "PAIRS", 50)
    rows = table()
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    found = periodic_runs.digests(periodic_runs.with_repeated_tails(docs))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted((row_by_force(*r[:2]) for r in rows), key=key)


def test_collapsed_texts_and_other_columns(spark):
    docs = spark.createDataFrame([("go " * 9 + "on", "k", 1)], "body string, runs string, n int")
    row = periodic_runs.collapse_runs(docs, "body").collect()
    assert [r.asDict(True) for r in row] == [{"body": "go " * 9 + "on", "n": 1, "n_words": 10, "runs": [{"start": 0, "length": 9, "period": 1}], "collapsed": "go on"}]


def test_empty_table(spark):
    assert periodic_runs.digests(periodic_runs.with_repeated_tails(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_query_equals_force_on_given_table(spark):
    folder = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in given if len(r["text"] or "") < 20_000]
    found = {r["doc_id"]: tuple(r) for r in op12_periodic_runs(spark, folder).collect()}
    assert len(found) == len(given)
    assert all(found[r["doc_id"]] == row_by_force(r["doc_id"], r["text"]) for r in short)
