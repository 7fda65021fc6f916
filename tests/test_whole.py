"""Queries over whole sections, held against plain loops over tables with many runs."""

from __future__ import annotations

import random
from itertools import groupby

import pytest

from corridor import plans

QUERIES = plans.queries()
STEP = 0.05


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Three sections of 160 samples and one of four; most have far more than 12 runs, the later ones wider."""
    rng, rows, at = random.Random(3), [], 0
    for user, n in ((1, 160), (2, 160), (3, 160), (14, 4)):
        label, left = None, 0
        for i in range(n):
            if not left:
                label = rng.choice([x for x in ("click", "view", "purchase", "signup") if x != label])
                left = rng.randint(1, 3 + i // 20)
            left -= 1
            at += 1
            rows.append((at, user, i, label, 1.0 + i))
    path = str(tmp_path_factory.mktemp("whole"))
    df = spark.createDataFrame(rows, "event_id long, user_id long, s long, event_type string, value double")
    df.selectExpr("event_id", "user_id", "timestamp_seconds(s) AS ts", "event_type", "value").write.parquet(f"{path}/events.parquet")
    return path, rows


def plain_runs(rows):
    """{section: [(start, end, label, label in shadow)]} from (event_id, section, i, label, value) rows."""
    out = {}
    for section, own in groupby(rows, lambda r: r[1]):
        out[section] = []
        for label, part in groupby(own, lambda r: r[3]):
            part = list(part)
            dark = sum(r[0] % 5 == 0 for r in part) / len(part) >= 0.75
            out[section].append((part[0][2] * STEP, part[-1][2] * STEP, label, "unknown (shadow)" if dark else label))
    return out


def compose(gap, runs):
    if gap <= 0:
        return "contiguous"
    if not runs:
        return "abutting"
    if any(r[3] == "unknown (shadow)" for r in runs):
        return "unknown (shadow)"
    return min(runs, key=lambda r: (r[0] - r[1], r[0]))[3]


def test_compositions_see_every_run(spark, events):
    path, rows = events
    runs = plain_runs(rows)
    assert min(len(runs[s]) for s in (1, 2, 3)) > 24
    widest, pixel, osm = {}, {}, {}
    for s, own in runs.items():
        lo, hi = own[0][0], own[-1][1]
        a, b = lo + (hi - lo) * 0.25, lo + (hi - lo) * 0.75
        widest[s] = compose(b - a, [r for r in own if r[1] > a and r[0] < b])
        pixel[s] = compose(b - a, [r for r in own if r[0] >= a and r[1] <= b])
        lane = s % 10 / 10
        name = compose(lane - 0.4, [r for r in own if r[1] > 0.4 and r[0] < lane and r[0] != lo])
        osm[name] = osm.get(name, 0) + 1
    got = lambda name: {r[0]: r[1] for r in QUERIES[name](spark, path).collect()}
    assert got("widest_run_between") == widest
    assert got("composition_case_pixel") == pixel
    assert got("composition_case_osm") == osm


def test_run_containing_asks_whole_sections(spark, events):
    path, rows = events
    want = set()
    for s, own in plain_runs(rows).items():
        count = sum(r[1] == s for r in rows)
        for i in range(count):
            at = i * STEP * 2
            k = next((k for k, r in enumerate(own) if r[0] <= at <= r[1]), None)
            if k is not None:
                want.add((s, round(at, 6), k + 1, own[k][2]))
    got = [tuple(r) for r in QUERIES["run_containing"](spark, path).collect()]
    assert len(got) == len(set(got)) and set(got) == want and max(r[1] for r in got) > 7
