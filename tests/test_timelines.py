"""Hand-made cases and properties of turns, windows, intervals and scoring."""

import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnframe.functions.matching import assign
from turnframe.operators import intervals as iv
from turnframe.operators import regions as rg
from turnframe.operators import scoring as sc
from turnframe.operators import turns as tn
from turnframe.operators import windows as wn

TURN = "uri string, spk long, s long, e long"


def frame(spark, rows, schema=TURN):
    return spark.createDataFrame(rows, schema)


def out(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_gap_merge_by_hand(spark):
    t = frame(spark, [("a", 0, 0, 1000), ("a", 0, 1200, 2000), ("a", 0, 2300, 3000)])
    assert out(tn.gap_merge(t, 250), "s", "e") == [(0, 2000), (2300, 3000)]
    assert out(tn.gap_merge(t, 300), "s", "e") == [(0, 3000)]
    t = frame(spark, [("a", 0, 0, 200), ("a", 0, 300, 500), ("a", 0, 5000, 5200)])
    assert out(tn.min_duration(tn.gap_merge(t, 250), 300), "s", "e") == [(0, 500)]


def test_gap_merge_keeps_turns_apart(spark):
    random.seed(1)
    rows = []
    for _ in range(300):
        s = random.randrange(10_000)
        rows.append((random.choice("ab"), random.randrange(3), s, s + random.randrange(1, 300)))
    got = tn.gap_merge(frame(spark, rows), 20).collect()
    for key in {(r.uri, r.spk) for r in got}:
        own = sorted((r.s, r.e) for r in got if (r.uri, r.spk) == key)
        assert all(b[0] - a[1] > 20 for a, b in zip(own, own[1:]))
    assert sum(r.n for r in got) == 300


@pytest.mark.parametrize("total,want", [(18, [(0, 7.5), (7.5, 12.5), (12.5, 17.5), (17.5, 18)]), (17, [(0, 7.5), (7.5, 12.5), (12.5, 17)]), (3, [(0, 3)]), (0, [])])
def test_commit_regions(spark, total, want):
    rec = spark.createDataFrame([("a", total * 2)], "uri string, total long")
    assert out(wn.chunk_schedule(rec, 20, 10), "commit_start", "commit_end") == [(2 * a, 2 * b) for a, b in want]


def test_commit_regions_tile(spark):
    rec = spark.createDataFrame([(str(n), n) for n in range(1, 120)], "uri string, total long")
    rows = wn.chunk_schedule(rec, 20, 10).collect()
    for n in range(1, 120):
        own = sorted((r.commit_start, r.commit_end) for r in rows if r.uri == str(n))
        assert own[0][0] == 0 and own[-1][1] == n and all(a[1] == b[0] for a, b in zip(own, own[1:]))


def test_capped_selection_by_hand(spark):
    r = spark.createDataFrame([("a", 0, 0, a, b) for a, b in [(0, 3), (4, 6), (7, 9)]], "uri string, chunk long, slot long, f0 long, f1 long")
    assert out(rg.capped_latest(r, 4), "f0", "f1") == [(4, 6), (7, 9)]
    assert out(rg.capped_latest(r, 5), "f0", "f1") == [(0, 1), (4, 6), (7, 9)]


def test_regions_of_runs(spark):
    f = spark.createDataFrame([("a", 0, i, 0, int(x)) for i, x in enumerate("110111001")], "uri string, chunk long, frame long, slot long, act int")
    assert out(rg.connected_regions(f), "f0", "f1") == [(0, 2), (3, 6), (8, 9)]


def test_overlap_join_is_exact(spark):
    random.seed(2)
    make = lambda: [("u", k, s := random.randrange(2000), s + random.choice([1, 5, 900])) for k in range(80)]  # noqa: E731, F841
    a, b = make(), make()
    got = out(iv.overlap_join(frame(spark, a), frame(spark, b), ["uri"], 37), "a_spk", "b_spk")
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[2] < y[3] and y[2] < x[3])


def brute_error(ref, sys, lo, hi):
    refs, syss = sorted({r[0] for r in ref}), sorted({r[0] for r in sys})
    at = lambda rows, t: {k for k, s, e in rows if s <= t < e}
    ticks = [(at(ref, t), at(sys, t)) for t in range(lo, hi)]
    shared = {(r, s): sum(r in a and s in b for a, b in ticks) for r in refs for s in syss}
    best = 0
    for size in range(min(len(refs), len(syss)) + 1):
        for rs in permutations(refs, size):
            for ss in permutations(syss, size):
                best = max(best, sum(shared[p] for p in zip(rs, ss)))
    scored = sum(len(a) for a, _ in ticks)
    miss = sum(max(len(a) - len(b), 0) for a, b in ticks)
    fa = sum(max(len(b) - len(a), 0) for a, b in ticks)
    return scored, miss, fa, sum(min(len(a), len(b)) for a, b in ticks) - best


def test_error_components_against_ticks(spark):
    random.seed(3)
    ref, sys, want = [], [], {}
    for u in range(12):
        own = []
        for n in (3, 2):
            rows = []
            for k in range(n):
                t = random.randrange(20)
                for _ in range(4):
                    e = t + random.randrange(1, 12)
                    rows.append((k, t, e))
                    t = e + random.randrange(1, 10)
            own.append(rows)
        lo, hi = min(r[1] for r in own[0]), max(r[2] for r in own[0])
        want[str(u)] = brute_error(*own, lo, hi)
        ref += [(str(u), *r) for r in own[0]]
        sys += [(str(u), *r) for r in own[1]]
    got = {r.uri: (r.scored, r.miss, r.fa, r.err) for r in sc.der_components(frame(spark, ref), frame(spark, sys), 10).collect()}
    assert got == want
    same = sc.with_rates(sc.der_components(frame(spark, ref), frame(spark, [(u, k + 7, s, e) for u, k, s, e in ref]), 10)).collect()
    assert {r.der for r in same} == {0.0}


def test_der_by_hand(spark):
    ref, sys = frame(spark, [("f", 0, 0, 10)]), frame(spark, [("f", 0, 0, 6), ("f", 1, 6, 12), ("only", 0, 0, 5)])
    r = sc.with_rates(sc.der_components(ref, sys, 5)).collect()
    assert [(x.uri, x.scored, x.miss, x.fa, x.err, x.der) for x in r] == [("f", 10, 0, 0, 4, 40.0)]
    comps = spark.createDataFrame([("1", 10, 0, 0, 1), ("2", 2, 0, 0, 1)], "uri string, scored long, miss long, fa long, err long")
    p = sc.pooled_and_macro(comps).first()
    assert (round(p.global_der, 2), p.avg_der) == (16.67, 30.0)
    none = sc.with_rates(spark.createDataFrame([("1", 0, 0, 0, 0), ("2", 0, 0, 3, 0)], "uri string, scored long, miss long, fa long, err long")).collect()
    assert [x.der for x in sorted(none, key=lambda x: x.uri)] == [0.0, float("inf")]


def test_no_reference_segments_and_empty(spark):
    empty = frame(spark, [])
    assert sc.der_components(empty, frame(spark, [("a", 0, 0, 5)]), 10).collect() == []
    r = sc.der_components(frame(spark, [("a", 0, 0, 5)]), empty, 10).first()
    assert (r.scored, r.miss, r.fa, r.err) == (5, 5, 0, 0)


def test_collars(spark):
    ref = frame(spark, [("a", 0, 10, 20)])
    uem = spark.createDataFrame([("a", 0, 30)], "uri string, s long, e long")
    assert out(iv.collared(uem, ref, 2), "s", "e") == [(0, 8), (12, 18), (22, 30)]
    two = frame(spark, [("a", 0, 0, 20), ("a", 1, 5, 8)])
    assert out(iv.without_overlap(uem, two), "s", "e") == [(0, 5), (8, 30)]


def test_extended_zones(spark):
    z = lambda *rows: spark.createDataFrame([("a", *r) for r in rows], "uri string, s long, e long") if rows else spark.createDataFrame([], "uri string, s long, e long")
    got = lambda ex, lex, seg, most=10: out(iv.extended_zones(z(*ex), z(*lex), z(*seg), most), "s", "e")
    assert got([(100, 110)], [], []) == [(90, 120)]
    assert got([(100, 110)], [(80, 95), (113, 118)], []) == [(95, 113)]
    assert got([(100, 110)], [(98, 105)], [(0, 112)]) == [(100, 112)]
    assert got([(100, 110), (125, 130)], [], []) == [(90, 140)]
    assert got([(100, 110), (125, 130)], [(115, 116)], []) == [(90, 115), (116, 140)]
    assert got([(100, 110), (140, 150)], [], []) == [(90, 120), (130, 160)]
    uem = spark.createDataFrame([("a", 0, 200)], "uri string, s long, e long")
    assert out(iv.without_zones(uem, z((90, 120))), "s", "e") == [(0, 90), (120, 200)]


def test_assignment_is_optimal():
    rng = np.random.default_rng(4)
    for _ in range(150):
        n, m = map(int, rng.integers(1, 6, 2))
        cost = rng.integers(0, 20, (n, m)).astype(float) if rng.random() < 0.5 else rng.normal(size=(n, m))
        pairs = assign(cost)
        k = min(n, m)
        assert len(pairs) == k == len({r for r, _ in pairs}) == len({c for _, c in pairs})
        best = min(sum(cost[r, c] for r, c in zip(rs, cs)) for rs in permutations(range(n), k) for cs in permutations(range(m), k))
        assert abs(sum(cost[r, c] for r, c in pairs) - best) < 1e-9
    assert assign(np.zeros((0, 3))) == []


def test_grouping_sets(spark):
    comps = spark.createDataFrame([("1", 1, 10, 0, 0, 1)], "uri string, channel int, scored long, miss long, fa long, err long")
    rows = {r.label: (r.scored, r.der) for r in sc.rolled_up(comps, ["uri", "channel"]).collect()}
    assert rows == {k: (10, 10.0) for k in ("ALL", "u=1", "c=1", "u=1 c=1")}


def test_early_close(spark):
    t = frame(spark, [("a", 0, 0, 10), ("a", 1, 40, 50)])
    c = spark.createDataFrame([("a", 12), ("a", 16), ("a", 55)], "uri string, commit_end long")
    assert out(tn.early_closed(t, c, 5).fillna(-1), "spk", "closed_at") == [(0, 16), (1, -1)]


def test_flags_of_own_turns(spark):
    t = frame(spark, [(1, "a", 0, 0, 5), (2, "a", 0, 3, 8), (3, "a", 1, 8, 9)], "id long, uri string, spk long, s long, e long")
    assert {r.id: r.overlapped for r in iv.overlap_flags(t, 4).collect()} == {1: False, 2: False, 3: False}


def test_text_windows():
    assert wn.text_windows(50, 20, 5) == [(0, 15), (10, 30), (25, 45), (40, 50)]
    with pytest.raises(ValueError):
        wn.text_windows(10, 5, 5)


def test_confusion_unknown(spark):
    ov = spark.createDataFrame([("a", 0, 5, 10)], "uri string, ref long, sys long, overlap long")
    ty = spark.createDataFrame([(0, "m")], "spk long, type string")
    assert out(sc.type_confusion(ov, ty)) == [("m", "unknown", 1, 10)]


def test_plans_push_down(spark):
    from turnframe.plans import queries as own

    plan = own.tumbling_counts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in plan
    assert F is not None


def test_a_turn_without_length_cuts_the_stretch_that_it_lies_in(spark):
    from turnframe.operators import intervals as iv

    turns = spark.createDataFrame([("u", 1, 0, 10), ("u", 2, 4, 4), ("u", 3, 20, 20)], "uri string, spk long, s long, e long")
    assert sorted((r.a, r.b, r.speakers) for r in iv.speaker_segments(turns, 5).collect()) == [(0, 4, [1]), (4, 10, [1])]
    assert [(r.a, r.b) for r in iv.active_segments(turns).collect()] == [(0, 10)]
