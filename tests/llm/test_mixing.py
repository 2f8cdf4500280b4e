"""Mixing against a plain sort of every source, and the properties that the contract states."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from freightspark.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, Key int"


def plain_targets(sizes, weights=(1, 2, 3)):
    """Shares of the whole, and again of what is beyond the limits, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        above = {s for s in free if share[s] > 3 * sizes[s]}
        if not above:
            return {s: float(share.get(s, 3 * sizes[s])) for s in order}
        capped |= above


def brute(rows, quality=lambda t: 1.0):
    docs = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest(), max(quality(t), 0.05)) for i, t, s in rows]
    sizes = {}
    for d in docs:
        sizes[d[1]] = sizes.get(d[1], 0) + d[2]
    target, out = plain_targets(sizes), []
    for s, size in sizes.items():
        epochs = min(3, math.floor(target[s] / size + 1e-6)) if size else 0
        rest, upto = max(target[s] - epochs * size, 0), 0
        own = sorted((d for d in docs if d[1] == s), key=lambda d: (-math.log((int(d[3][:13], 16) + 0.5) / 2**52) / d[4], d[3]))
        for i, _, n, _, _ in own:
            upto += n
            out.append((i, s, n, size, round(target[s], 6), n * (epochs + (upto - n / 2 <= rest))))
    return sorted(out, key=repr)


def run(spark, rows, quality=None):
    df = spark.createDataFrame([(i, t, "en", s, 1, "big", 2) for i, t, s in rows], SCHEMA).repartition(5)
    got = mixing.mix(df, quality).withColumn("target", F.round("target", 6)).collect()
    return sorted((tuple(r) for r in got), key=repr)


def texts(n, seed, sources, longest=40):
    r = random.Random(seed)
    return [(i, " ".join("w%d" % r.randrange(99) for _ in range(r.randrange(longest))), r.choice(sources)) for i in range(n)]


def test_equal_to_a_plain_sort(spark):
    rows = texts(400, 1, ["a"] * 12 + ["b", "c", "é", "z\U0001f600", "", None])
    got = run(spark, rows)
    assert got == brute(rows)
    by = {}
    for _, s, size, whole, target, taken in got:
        assert taken <= 3 * size and target <= 3 * whole + 1e-6
        by.setdefault(s, [target, 0, 0])
        by[s][1] += taken
        by[s][2] = max(by[s][2], size)
    assert all(abs(target - taken) <= most for target, taken, most in by.values())
    assert abs(sum(x[0] for x in by.values()) - sum(r[2] for r in got)) < 1e-3


def test_quality_moves_documents_forward(spark):
    rows = [(i, ("word " if i % 2 else "12345 ") * 10, "ab"[i % 7 == 0]) for i in range(500)]
    share = lambda t: 0.05 + sum(c.isalpha() for c in t) / len(t)
    got = run(spark, rows, mixing.letter_share())
    assert got == brute(rows, share)
    taken = lambda odd: sum(r[5] > 0 for r in got if r[0] % 2 == odd and r[1] == "a")
    assert taken(1) > 2 * taken(0)


def test_copies_are_taken_as_often_as_they_fit(spark):
    copies = [(7, "one two three", "a")] * 300
    rows = copies + [(8, "four five", "b"), (None, "six", "b"), (None, "six", "b"), (None, None, "b"), (9, " \t\n\x0b\x0c\r ", None), (10, "x y z\x1f", None)]
    assert run(spark, rows) == brute(rows)


def test_nothing_to_mix(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, "a"), (2, "  ", "b")]) == [(1, "a", 0, 0, 0.0, 0), (2, "b", 0, 0, 0.0, 0)]
    assert run(spark, [(1, "one two", None)]) == [(1, None, 2, 2, 2.0, 2)]


def test_odd_quality_counts_as_the_least(spark):
    rows = texts(60, 4, ["a", "b"])
    for odd in (None, -1.0, float("nan"), float("inf")):
        assert run(spark, rows, F.lit(odd)) == brute(rows, lambda t: 0.05)


def test_boundary_is_found_in_any_cell(spark, monkeypatch):
    """With two cells a level the budget ends among many keys of one cell; with many cells, among few."""
    rows = texts(300, 2, ["a"] * 9 + ["b", "c"])
    for cells in (2, 7):
        monkeypatch.setattr(mixing, "CELLS", cells)
        assert run(spark, rows) == brute(rows)


def test_targets_of_many_sources(spark):
    r = random.Random(9)
    sizes = {f"s{i}" if i else None: r.choice([0, 1, 5, 40, 900]) for i in range(200)}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(6)
    got = {s: t for s, _, t in mixing.targets(df).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s], abs=1e-6) for s in want)


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    plan = mixing.mix(df, mixing.letter_share())._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
