"""Revisit resolution: repeated rows, null ids, times that tie, and a plain loop beside it."""

import collections
import random

from ragloom.llm import warc_revisits

SCHEMA = "id long, url string, ts long, kind string, status int, headers map<string,string>, canon string, base string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def found_rows(spark, rows, stretch=3600):
    found = warc_revisits.resolve(table(spark, rows), stretch).collect()
    return collections.Counter((r.id, r.base_id, r.status, None if r.headers is None else tuple(sorted(r.headers.items()))) for r in found)


def by_loop(rows):
    """Hosts stand for themselves here, so that no URL needs canonical form."""
    out = collections.Counter()
    for id, url, ts, kind, _, headers in rows:
        if kind != "revisit":
            continue
        own = {k.lower(): v for k, v in (headers or {}).items()}
        best = None
        for other in rows:
            if other[3] == "response" and other[4] == 200 and url and other[1] == url and None not in (ts, other[2]) and other[2] < ts:
                theirs = {k.lower(): v for k, v in (other[5] or {}).items()}
                rank = (other[2], other[0] is not None, other[0] or 0, theirs.get("etag") or "")
                best = max(best, (rank, other[0], theirs), key=lambda b: b[0]) if best else (rank, other[0], theirs)
        if best is None:
            out[id, None, "no_base", None] += 1
            continue
        stored = best[2]
        if "etag" in own:
            status = "matched" if own["etag"].removeprefix("W/") == stored.get("etag", "").removeprefix("W/") else "mismatch"
        elif "last-modified" in own:
            status = "matched" if own["last-modified"] == stored.get("last-modified") else "mismatch"
        else:
            status = "unvalidated"
        merged = stored | {k: v for k, v in own.items() if k in warc_revisits.PERMITTED}
        out[id, best[1], status, tuple(sorted(merged.items())) if status in ("matched", "unvalidated") else None] += 1
    return out


def test_repeated_rows_and_null_ids_give_a_row_each(spark):
    response = (1, "a.com", 100, "response", 200, {"ETag": '"1"'})
    rows = [response, response, (2, "a.com", 200, "revisit", 304, {"ETag": '"1"'}), (2, "a.com", 200, "revisit", 304, {"ETag": '"1"'}), (None, "a.com", 300, "revisit", 304, {"ETag": '"1"', "Date": "d"})]
    assert found_rows(spark, rows) == {(2, 1, "matched", (("etag", '"1"'),)): 2, (None, 1, "matched", (("date", "d"), ("etag", '"1"'))): 1}


def test_only_earlier_full_responses_serve(spark):
    rows = [
        (1, "a.com", 100, "response", 200, {"ETag": '"1"'}), (9, "a.com", 200, "response", 200, {"ETag": '"9"'}), (5, "a.com", 150, "response", 404, {"ETag": '"5"'}),
        (2, "a.com", 200, "revisit", 304, {"ETag": '"9"'}), (3, "a.com", 201, "revisit", 304, {"ETag": '"9"'}), (7, "a.com", 200, "response", 200, {"ETag": '"7"'}), (4, "a.com", 100, "revisit", 304, None),
        (6, "a.com", 300, None, 200, None), (8, "", 300, "revisit", 304, None), (8, "", 200, "response", 200, None),
    ]
    for stretch in (3600, 1):
        assert {(i, b, s) for i, b, s, _ in found_rows(spark, rows, stretch)} == {(2, 1, "mismatch"), (3, 9, "matched"), (4, None, "no_base"), (8, None, "no_base")}


def test_equals_a_plain_loop(spark):
    draw = random.Random(3)
    rows = []
    for _ in range(400):
        tag = draw.choice([{"ETag": f'"{draw.randint(0, 2)}"'}, {"etag": f'W/"{draw.randint(0, 2)}"'}, {"Last-Modified": draw.choice("ab")}, {}, None])
        headers = tag if tag is None else tag | {"Date": str(draw.randint(0, 3)), "Content-Type": "x"}
        rows.append((draw.choice([None, *range(500)]), draw.choice(["a.com", "b.com", None, "", "hot.com", "hot.com"]), draw.choice([None, *range(0, 90)]), draw.choice(["response", "revisit"]), draw.choice([200, 200, 404]), headers))
    rows = list({r[:5]: r for r in rows}.values())
    keys = collections.Counter((r[0], r[1], r[2]) for r in rows)
    rows = [r for r in rows if keys[r[0], r[1], r[2]] == 1]
    for stretch in (3600, 7, 1):
        assert found_rows(spark, rows, stretch) == by_loop(rows)
