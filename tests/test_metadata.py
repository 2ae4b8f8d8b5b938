"""Metadata events: ranges, tags, alignment and errors against plain Python over all pairings."""

import random
from collections import Counter
from functools import cache

import pytest

from turnframe.operators import metadata as md
from turnframe.operators import scans

EVENT = "uri string, id long, type string, subtype string, s long, e long"
WORD = "uri string, idx long, s long, e long, scoreable boolean"


def planted(seed=3):
    rng = random.Random(seed)
    words, ref, sys = [], [], []
    for u in ("a", "b"):
        words += [(u, 10 * i, 100 * i, 100 * i + 80, rng.random() < 0.8) for i in range(60)]
        for k in range(40):
            kind = ("SU", "FILLER", "EDIT", "IP")[k % 4]
            s = 100 * rng.randrange(60) + rng.randrange(100)
            e = s if kind == "IP" else s + rng.randrange(20, 400)
            ref.append((u, k, kind, rng.choice("xyz"), s, e))
            if k % 7:
                move = rng.choice((0, 0, -90, 60, 120))
                sys.append((u, k, kind, rng.choice("xxyz"), s + move, e + move))
        sys += [(u, 100 + k, "IP", "x", 100 * k, 100 * k) for k in range(0, 60, 20)]
    return words, ref, sys


def plain_range(event, words):
    u, _, _, _, s, e = event
    mids = sorted(((w[2] + w[3]) // 2, w[4], w[1]) for w in words if w[0] == u)
    first, last = sum(m < s for m, *_ in mids), sum(m <= e for m, *_ in mids) - 1
    return first, last, sum(x[1] for x in mids[:first]), sum(x[1] for x in mids[: last + 1]), mids[last][2] if last >= 0 else None


@pytest.mark.parametrize("small", [scans.SMALL, -1])
def test_ranges_are_counts_of_midpoints(spark, monkeypatch, small):
    monkeypatch.setattr(scans, "SMALL", small)
    words, ref, _ = planted()
    got = md.word_ranges(spark.createDataFrame([*ref, ("a", 900, "SU", None, None, 5)], EVENT), spark.createDataFrame(words, WORD), 700).collect()
    assert {(r.uri, r.id): (r["first"], r["last"], r.before, r.until, r.last_idx) for r in got} == {e[:2]: plain_range(e, words) for e in ref}


def test_words_carry_the_latest_event_of_a_type(spark):
    words, ref, _ = planted(4)
    want = {}
    for e in sorted(ref, key=lambda e: (e[4], e[5], e[1])):
        inside = [w[1] for w in words if w[0] == e[0] and e[4] <= (w[2] + w[3]) // 2 <= e[5]]
        last = plain_range(e, words)[4]
        for idx in inside if e[2] in md.SPANS else [] if last is None else [last]:
            want[e[0], idx, e[2]] = (e[4:] + e[1:2], e[3])
    # of ends at one word the latest start wins, as for spans
    got = {(r.uri, r.idx, r.type): r.subtype for r in md.tagged_words(spark.createDataFrame(ref, EVENT), spark.createDataFrame(words, WORD), 700).collect()}
    assert got == {k: v[1] for k, v in want.items()}


def _ranged(spark, words, events):
    return md.word_ranges(spark.createDataFrame(events, EVENT), spark.createDataFrame(words, WORD), 700)


def _extent(event, words):
    first, last, *_ = plain_range(event, words)
    return (max(first, last - 1) if event[2] == "SU" else first), last + 1


def plain_best(refs, syss, words):
    """The best total over all order-preserving pairings."""

    def pair(r, s):
        (a, b), (x, y) = _extent(r, words), _extent(s, words)
        shared = min(b, y) - max(a, x)
        if shared + 0.1 <= 0:
            return None
        total = (shared + 0.1 + (1e-8 if r[2] == "IP" else 0)) * (1.1 if r[3] == s[3] else 1) * (1.001 if b == y else 1)
        return total * max(b - a, 1e-8) / (b - a + 0.1)

    @cache
    def best(i, j):
        if i == len(refs) or j == len(syss):
            return 0.0
        x = pair(refs[i], syss[j])
        return max(best(i + 1, j), best(i, j + 1), 0 if x is None else x + best(i + 1, j + 1))

    return best(0, 0), pair


def test_path_is_the_best_of_all(spark):
    words, ref, sys = planted(5)
    rows = md.aligned_events(_ranged(spark, words, ref), _ranged(spark, words, sys)).collect()
    of = {0: {e[:2]: e for e in ref}, 1: {e[:2]: e for e in sys}}
    assert Counter((r.uri, r.ref_id) for r in rows if r.ref_id is not None) == Counter(list(of[0])) and len(rows) > len(ref)
    assert Counter((r.uri, r.sys_id) for r in rows if r.sys_id is not None) == Counter(list(of[1]))
    for u in "ab":
        for kind in ("SU", "FILLER", "EDIT", "IP"):
            order = lambda es: sorted((e for e in es if e[0] == u and e[2] == kind), key=lambda e: (*_extent(e, words), e[1]))
            total, pair = plain_best(order(ref), order(sys), words)
            mine = [r for r in rows if r.uri == u and r.type == kind and r.ref_id is not None and r.sys_id is not None]
            assert sum(pair(of[0][u, r.ref_id], of[1][u, r.sys_id]) for r in mine) == pytest.approx(total, rel=1e-6, abs=1e-9)
            for r in mine:
                x, y = plain_range(of[0][u, r.ref_id], words), plain_range(of[1][u, r.sys_id], words)
                assert (r.dbeg, r.dend) == (y[2] - x[2], y[3] - x[3])
                assert r.kind == ("cor" if of[0][u, r.ref_id][3] == of[1][u, r.sys_id][3] else "sub")
            assert mine


def test_counts_are_those_of_the_rows(spark):
    words, ref, sys = planted(6)
    aligned = md.aligned_events(_ranged(spark, words, ref), _ranged(spark, words, sys)).cache()
    rows = aligned.collect()
    want = Counter((r.uri, r.type, r.ref_subtype if r.ref_id is not None else r.sys_subtype, r.kind) for r in rows)
    for r in md.event_errors(aligned).collect():
        assert [r.cor, r["sub"], r.dele, r.ins] == [want[r.uri, r.type, r.subtype, k] for k in ("cor", "sub", "del", "ins")]
        assert r.rate is None if not r.refs else r.rate == pytest.approx(100 * (r["sub"] + r.dele + r.ins) / r.refs)
    both = [r for r in rows if r.kind in ("cor", "sub")]
    assert {(r.type, r.ref_subtype, r.sys_subtype): r.n for r in md.event_confusion(aligned).collect()} == Counter((r.type, r.ref_subtype, r.sys_subtype) for r in both)
    assert {(r.type, r.side, r.words): r.n for r in md.event_offsets(aligned).collect()} == Counter((r.type, k, x) for r in both for k, x in (("BEG", r.dbeg), ("END", r.dend)))
    unscored = {("a", 4), ("a", 30), ("b", 17)}
    at = {}
    for r in rows:
        for side, key, sub, first, last in (("r", r.ref_id, r.ref_subtype, r.ref_first, r.ref_last), ("s", r.sys_id, r.sys_subtype, r.sys_first, r.sys_last)):
            if key is None:
                continue
            if r.type in md.SPANS:
                for p in range(max(first, 0), last + 1):
                    if (r.uri, p) not in unscored:
                        at.setdefault((r.uri, r.type, p), Counter())[side, sub, True] += 1
            else:
                at.setdefault((r.uri, r.type, max(last, 0)), Counter())[side, sub, r.kind in ("cor", "sub")] += 1
    sums = {}
    for (u, kind, _), c in at.items():
        n = lambda side, mapped, sub=None: sum(x for (a, b, m), x in c.items() if a == side and m == mapped and sub in (None, b))
        r, s, i = n("r", True) + n("r", False), n("s", True), n("s", False)
        same = sum(min(n("r", True, x), n("s", True, x)) for x in "xyz")
        old = sums.get((u, kind), (0, 0, 0, 0))
        sums[u, kind] = tuple(map(sum, zip(old, (r, max(r - s, 0), max(s - r, 0) + i, min(r, s) - same))))
    got = md.marked_word_errors(aligned, spark.createDataFrame(sorted(unscored), "uri string, pos long")).collect()
    assert {(r.uri, r.type): (r.refs, r.dele, r.ins, r["sub"]) for r in got} == sums


def test_empty_tables_and_bounds(spark):
    none, words = spark.createDataFrame([], EVENT), spark.createDataFrame([], WORD)
    some = spark.createDataFrame([("a", 1, "IP", None, 5, 5)], EVENT)
    ranges = md.word_ranges(none, words)
    assert md.aligned_events(ranges, ranges).collect() == [] and md.tagged_words(some, words).collect() == []
    [r] = md.aligned_events(md.word_ranges(some, words), ranges).collect()
    assert (r.kind, r.ref_id, r.sys_id) == ("del", 1, None)
    with pytest.raises(ValueError):
        md.aligned_events(ranges, ranges, gap=0)
