"""Best paths against a plain table, chains of neighbours against a whole matrix, rows zipped by place, time by type."""

import random
import time
from collections import namedtuple

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnframe.operators import scoring as sc
from turnframe.operators.alignment import align, lone_score, pair_score
from turnframe.operators.online import agglomerate, unit
from turnframe.plans.replay import numbered, zipped

Word = namedtuple("Word", "word wtype s e")


def plain_align(refs, syss, gap, most_behind=np.inf):
    """Cell by cell, in whole tenths."""
    tenth = lambda x: round(x * 10)
    n, m = len(refs), len(syss)
    left = [0]
    for s in syss:
        left.append(left[-1] + tenth(lone_score(s)))
    total, step = [left], [[2] * (m + 1)]
    for r in refs:
        before, cost = total[-1], tenth(lone_score(r))
        floor = max(b - x for b, x in zip(before, left)) - most_behind * 10
        row, how = [before[0] + cost], [1]
        for j, s in enumerate(syss, 1):
            drop, add = before[j] + cost, row[-1] + left[j] - left[j - 1]
            best, k = (drop, 1) if drop >= add else (add, 2)
            if before[j - 1] - left[j - 1] >= floor and min(r.e, s.e) - max(r.s, s.s) + gap > 0 and (pair := before[j - 1] + tenth(pair_score(r, s))) > best:
                best, k = pair, 3
            row.append(best)
            how.append(k)
        total.append(row)
        step.append(how)
    out, i, j = [], n, m
    while i or j:
        k = step[i][j]
        out.append((i - 1 if k != 2 else None, j - 1 if k != 1 else None))
        i, j = i - (k != 2), j - (k != 1)
    return out[::-1], total[-1][-1]


def words(r, n):
    t, out = 0, []
    for _ in range(n):
        t += r.choice([0, 1, 3, 20])
        out.append(Word(r.choice(["a", "b", "ab", "a-b", "uh-huh", "b-"]), r.choice(["lex", "lex", "lex", "frag", "fp", "non-lex"]), t, t + r.randrange(1, 9)))
        t += r.randrange(3)
    return out


@pytest.mark.parametrize("most_behind", [np.inf, 3.0])
def test_best_path_is_that_of_a_plain_table(most_behind):
    r = random.Random(6)
    for _ in range(150):
        refs, syss = words(r, r.randrange(14)), words(r, r.randrange(14))
        for gap in (0, 2, 1000):
            assert align(refs, syss, gap, most_behind=most_behind) == plain_align(refs, syss, gap, most_behind)[0]


def test_a_long_island_is_quick():
    r = random.Random(7)
    refs = words(r, 3000)
    syss = [w._replace(s=w.s + 1, e=w.e + 1) for w in refs if r.random() > 0.1]
    began = time.perf_counter()
    found = align(refs, syss, 3)
    assert time.perf_counter() - began < 20
    assert [i for i, _ in found if i is not None] == list(range(3000)) and [j for _, j in found if j is not None] == list(range(len(syss)))


def by_matrix(vectors, threshold, linkage):
    """The least of the whole matrix merged, again and again."""
    rows = np.stack([unit(np.asarray(v, float)) for v in vectors])
    d = 1 - rows @ rows.T
    groups = [[i] for i in range(len(rows))]
    how = {"average": np.mean, "complete": np.max, "single": np.min}[linkage]
    while len(groups) > 1:
        least, i, j = min((how(d[np.ix_(a, b)]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if not least < 1 - threshold:
            break
        groups[i] = groups[i] + groups.pop(j)
    label = {x: k for k, g in enumerate(groups) for x in g}
    first = {}
    return [first.setdefault(label[i], len(first)) for i in range(len(rows))]


@pytest.mark.parametrize("linkage", ["average", "complete", "single"])
def test_chains_give_the_labels_of_the_whole_matrix(linkage):
    r = np.random.default_rng(8)
    for n, threshold in ((2, 0.5), (15, 0.3), (40, 0.5), (60, 0.1), (60, -0.5), (50, 0.8)):
        v = r.normal(size=(n, 4)) + 2 * np.eye(4)[r.integers(0, 4, n)]
        assert agglomerate(v, threshold, linkage) == by_matrix(v, threshold, linkage)
    assert agglomerate(np.zeros((3, 2)), 0.5, linkage) == [0, 1, 2] and agglomerate(np.ones((3, 2)), 0.5, linkage) == [0, 0, 0]


def test_ten_thousand_observations():
    r = np.random.default_rng(9)
    true = r.integers(0, 12, 10_000)
    v = np.eye(32)[true] + 0.05 * r.normal(size=(10_000, 32))
    began = time.perf_counter()
    got = agglomerate(v, 0.6)
    assert time.perf_counter() - began < 120
    assert len(set(zip(got, true.tolist()))) == 12


def test_rows_are_zipped_by_place(spark):
    a = spark.range(1000).repartition(7).orderBy(F.desc("id"))
    b = spark.range(1000).select((F.col("id") * 2).alias("x")).repartition(3).orderBy(F.desc("x"))
    got = zipped(a, b).collect()
    assert len(got) == 1000 and all(r.x == 2 * r.id for r in got)
    assert [r.id for r in numbered(a).orderBy("_at").collect()] == list(range(999, -1, -1))
    with pytest.raises(ValueError, match="1000 rows on one side and 999"):
        zipped(a, b.limit(999))
    assert zipped(a.limit(0), b.limit(0)).collect() == []


def test_time_and_counts_by_type(spark):
    ref = spark.createDataFrame([("r", 0, "m", 0, 10), ("r", 1, "f", 5, 10), ("r", 2, "m", 8, 12)], "uri string, spk long, type string, s long, e long")
    sys = spark.createDataFrame([("r", 7, "m", 0, 6), ("r", 8, "f", 9, 20)], "uri string, spk long, type string, s long, e long")
    got = {(x.ref_type, x.sys_type): x.time for x in sc.type_time(ref.drop("spk"), sys.drop("spk"), ["m", "f"], 3).collect()}
    # 0-5 m | m; 5-6 m f | m; 6-8 m f |; 8-9 m m f |; 9-10 m m f | f; 10-12 m | f; 12-20 | f
    assert got == {("m", "m"): 6, ("f", "m"): 1, ("m", "f"): 3, ("f", "f"): 1, ("m", "MISS"): 2 + 2 + 1, ("f", "MISS"): 2 + 1, ("FALSE ALARM", "f"): 8}
    mapping = spark.createDataFrame([("r", 0, 7)], "uri string, ref long, sys long")
    got = {(x.ref_type, x.sys_type): x.speakers for x in sc.type_counts(ref, sys, mapping).collect()}
    assert got == {("m", "m"): 1, ("f", "MISS"): 1, ("m", "MISS"): 1, ("FALSE ALARM", "f"): 1}


def test_a_long_island_needs_a_band_of_the_table_only():
    import tracemalloc
    from types import SimpleNamespace as W

    refs = [W(word=f"w{i % 7}", wtype="lex", s=i * 900, e=i * 900 + 700) for i in range(12_000)]
    syss = [W(word=w.word, wtype="lex", s=w.s + 60, e=w.e + 60) for i, w in enumerate(refs) if i % 9]
    tracemalloc.start()
    found = align(refs, syss, 500)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [i for i, j in found if i is not None] == list(range(len(refs))) and [j for i, j in found if j is not None] == list(range(len(syss)))
    assert peak < 60_000_000  # the whole table has 128 million cells


def test_small_islands_are_no_groups_of_their_own(spark, capsys):
    from turnframe.operators.alignment import aligned_words

    words = spark.createDataFrame([("u", i, "w", i * 900, i * 900 + 700) for i in range(5)], "uri string, idx long, word string, s long, e long")
    aligned = aligned_words(words, words.where("idx <> 3"), gap=100)
    aligned.explain()
    assert "FlatMapGroups" not in capsys.readouterr().out
    assert sorted(r.kind for r in aligned.collect()) == ["cor"] * 4 + ["del"]
