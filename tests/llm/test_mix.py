"""Weighted fair queueing against plain queues, its SQL and odd tables."""

import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

import duckdb
import pyarrow as pa
import pytest

from ragloom.llm import fair_mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, size string, target string, rank string, before int"


def targets_by_force(sizes, times=3):
    """Share, cut at the bounds and reshare by weight, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    left, bound, out = Fraction(sum(sizes.values())), {s: times * sizes[s] for s in order}, {}
    open_ = [s for s in order if sizes[s]]
    out.update({s: Fraction(0) for s in order if not sizes[s]})
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > bound[s]]
        if not over:
            out.update({s: float(left / total) * weight[s] for s in open_})  # the level is rounded once, as doubles are
            break
        for s in over:
            out[s] = Fraction(bound[s])
        left -= sum(bound[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def mix_by_force(rows, times=3):
    sized = [(doc, source, len(WORD.findall(text or ""))) for doc, text, source in rows]
    sizes = defaultdict(int)
    for _, source, size in sized:
        sizes[source] += size
    goal, order = targets_by_force(sizes, times), sorted(sizes, key=lambda s: (s is None, s or ""))
    copies = []
    for rank, source in enumerate(order):
        own = [i for i, r in enumerate(sized) if r[1] == source]
        own.sort(key=lambda i: (hashlib.md5(str("" if sized[i][0] is None else sized[i][0]).encode()).hexdigest(), sized[i][0] is not None, sized[i][0] or 0, sized[i][2]))
        end = 0
        for _ in range(times):
            for i in own:
                end += sized[i][2]
                if sized[i][2]:
                    copies.append((end / float(goal[source]), rank, end, i))
    taken, so_far, budget = defaultdict(int), 0, sum(sizes.values())
    for *_, i in sorted(copies):
        so_far += sized[i][2]
        if so_far > budget:
            break
        taken[i] += sized[i][2]
    return [(doc, size, sizes[source], float(goal[source]), taken[i]) for i, (doc, source, size) in enumerate(sized)]


def near(found, expected):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:3], r[4], round(r[3], 6))
    found, expected = sorted(map(tuple, found), key=key), sorted(expected, key=key)
    assert len(found) == len(expected)
    for a, b in zip(found, expected):
        assert (a[:3], a[4]) == (b[:3], b[4]) and a[3] == pytest.approx(b[3], rel=1e-12)


def made(seed, n=300):
    rng = random.Random(seed)
    sources = ["b", "a", "é", None, "", "tiny"]
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 3, 10, 40]))), rng.choices(sources, [40, 10, 5, 20, 5, 1])[0]) for i in range(n)]
    rows += [(5, "same words here", "b")] * 7 + [(None, "no id", "a")] * 40 + [(None, "no id", None)] * 3
    rows += [(900, None, "a"), (901, "  \t\x0b ", "é"), (902, "x " * 5000, "tiny"), (903, "", "only empty")]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_plain_queues(spark, seed, monkeypatch):
    monkeypatch.setattr(fair_mix, "BLOCK", 4)
    monkeypatch.setattr(fair_mix, "LEAST_RANGE", 8)
    rows = made(seed)
    docs = spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], SCHEMA).repartition(3)
    found = fair_mix.shares(docs)
    assert found.columns == ["doc_id", "size", "source_size", "target", "taken"]
    near(found.collect(), mix_by_force(rows))


def test_sql_equals_plain_queues():
    rows = made(4)
    db = duckdb.connect()
    documents = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": [r[2] for r in rows]})  # noqa: F841
    near(db.execute(fair_mix.oracle()).fetchall(), mix_by_force(rows))


def test_many_sources_and_a_hot_one_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(fair_mix, "MOST_SENT", 0)
    rows = [(i, "w " * (i % 7), f"s{i}" if i % 3 else "hot") for i in range(400)]
    near(fair_mix.shares(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect(), mix_by_force(rows))


def test_mixture_is_what_shares_count(spark):
    rows = made(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = fair_mix.mixture(docs).collect()
    shares = fair_mix.shares(docs).collect()
    budget = sum(r["size"] for r in shares)
    assert sum(r["size"] for r in mixed) == sum(r["taken"] for r in shares) <= budget
    assert budget - sum(r["size"] for r in mixed) <= max(r["size"] for r in shares)
    by_id = defaultdict(int)
    for r in mixed:
        by_id[r["doc_id"]] += r["size"]
    for r in shares:
        by_id[r["doc_id"]] -= r["taken"]
        assert r["taken"] <= 3 * r["size"]
    assert not any(by_id.values())


def test_any_start_of_the_mix_has_the_shares(spark):
    rows = [(i, "w " * (1 + i * i % 9), "abc"[i % 3]) for i in range(900)]
    mixed = sorted(fair_mix.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect(), key=lambda r: (r["finish"], r["rank"], r["end"]))
    so_far, total = defaultdict(int), 0
    for i, r in enumerate(mixed):
        so_far[r["rank"]] += r["size"]
        total += r["size"]
        if i > 100:
            assert all(abs(so_far[k] - total * (k + 1) / 6) <= 20 for k in range(3))


def test_tables_without_rows_or_words(spark):
    schema = "doc_id long, text string, source string"
    assert fair_mix.shares(spark.createDataFrame([], schema)).collect() == []
    assert fair_mix.mixture(spark.createDataFrame([], schema)).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None), (None, "", None)], schema)
    assert sorted(tuple(r)[1:] for r in fair_mix.shares(blank).collect()) == [(0, 0, 0.0, 0)] * 3


def test_plan_has_no_python(spark):
    plan = fair_mix.shares(spark.createDataFrame(made(6), "doc_id long, text string, source string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
