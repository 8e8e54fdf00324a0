"""Mixing of sources against a plain form."""

import hashlib
from fractions import Fraction

import pytest

from tallyrank.llm.mixing import mixed, served

SCHEMA = "doc_id long, text string, source string, size string, key int"


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, budget, free = {}, Fraction(sum(sizes.values())), set(order)
    while free:
        level = budget / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = Fraction(3 * sizes[s])
            budget -= target[s]
        free -= over
    return target


def plain(rows):
    docs = [(i, s, len((t or "").split())) for i, t, s, *_ in rows]
    sizes = {}
    for _, s, n in docs:
        sizes[s] = sizes.get(s, 0) + n
    target, out = plain_targets(sizes), []
    for s in sizes:
        own = sorted((hashlib.md5(("mix" + ("" if i is None else str(i))).encode()).hexdigest(),
                      -1 if i is None else i, n) for i, x, n in docs if x == s)
        at = 0
        for _, i, n in own:
            taken = sum(max(0, min(n, int(target[s]) - at - e * sizes[s])) for e in range(3))
            out.append((None if i < 0 else i, n, sizes[s], round(float(target[s]), 6), taken))
            at += n
    return sorted(out, key=str)


@pytest.mark.parametrize("case", ["usual", "hot", "odd", "one", "silent"])
def test_equals_the_plain_form(spark, case):
    rows = {
        "usual": [(i, "w " * (i % 7 + 1), f"s{i % 4}", "x", 1) for i in range(200)],
        "hot": [(i, "w " * 3, "big" if i % 3 else f"s{i % 11}", "x", 1) for i in range(300)],
        "odd": [(None, "a b", None, "x", 1), (1, None, "s", "x", 1), (1, "", "s", "x", 1), (2, "a " * 3000, "t", "x", 1),
                (3, "a b c", None, "x", 1), (3, "a b c", None, "x", 1), (4, "a b\x85c d", "", "x", 1)],
        "one": [(5, "a b c d", "s", "x", 1)],
        "silent": [(1, None, "s", "x", 1), (2, " \t ", "t", "x", 1)],
    }[case]
    if case == "odd":  # one word here by the rule, three by Python's
        expected = plain([(i, (t or "").replace(" ", "_").replace("\x85", "_"), s) for i, t, s, *_ in rows])
    else:
        expected = plain(rows)
    got = served(spark.createDataFrame(rows, SCHEMA))
    got = [(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got.collect()]
    assert sorted(got, key=str) == expected


def test_takes_come_near_their_targets_and_the_mix_is_sorted(spark):
    rows = [(i, "w " * (i % 9 + 1), f"s{i % 5}", "x", 1) for i in range(2000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    done = served(docs).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) < 1 for r in done)
    out = mixed(docs).collect()
    assert [r.finish for r in out] == sorted(r.finish for r in out)
    assert max(r["copy"] for r in out) <= 2 and max(r.finish for r in out) < 1.01


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert served(empty).collect() == [] and mixed(empty).collect() == []
