"""Word alignment: a best path by dynamic programming inside stretches of speech, and what is counted from it.

Words that are further apart than the gap never pair, so a silence longer than it cuts a recording into islands that are
aligned on their own. A group holds a run of islands, not a recording.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import namedtuple
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

#: Islands of a group.
ISLANDS = 512
#: Costs of a pair of one kind other than lex and of a lone word other than lex, the sounds that count for no
#: word, hyphenated words that count for one, and the score above which a pair is no error.
SAME_KIND, LONE = 0.1, 0.2
SOUNDS = ("non-lex", "misc")
SINGLE = ("mm-hmm", "uh-huh", "um-hmm")
RIGHT = -0.5
#: Scores are counted in whole millionths, so that equal paths are equal; and the score of what can't be.
UNITS, NEVER = 1_000_000, -(1 << 60)
#: Words with more near ones than this, on the mean, are aligned row by row in arrays.
WIDE = 64
#: Scores of pairs of words that a task keeps.
KNOWN = 200_000
Word = namedtuple("Word", "idx word wtype s e more")


def word_count(word: str, wtype: str) -> int:
    """How many words a token stands for: none for a sound, two for a hyphenated word."""
    bare = word.strip("-")
    return 0 if wtype in SOUNDS else 1 if bare in SINGLE or bare and "-" not in bare else 2


def _holds(whole, part) -> bool:
    bare = part.word.strip("-")
    return whole.wtype == "lex" and part.wtype == "frag" and bool(bare) and bare in whole.word


def pair_score(r, s) -> float:
    """What a pair of words (word, wtype) adds to a path: 0 if they are the same, or both fragments or filled pauses, or one is a fragment of the other; else less."""
    same = r.wtype == s.wtype
    if same and (r.word == s.word or r.wtype in ("fp", "frag")) or _holds(r, s) or _holds(s, r):
        return 0.0
    if same and r.wtype != "lex":
        return -SAME_KIND * max(1, word_count(r.word, r.wtype))
    return -float(max(1, word_count(r.word, r.wtype), word_count(s.word, s.wtype)))


def lone_score(w) -> float:
    """What a word without a partner adds."""
    n = word_count(w.word, w.wtype)
    return -float(n) if w.wtype == "lex" else -LONE * max(1, n)


def _near(refs: Sequence, syss: Sequence, gap: float) -> list[list[int]]:
    """For each of refs the places of syss that overlap it, or come within gap; a word without times is near to none."""
    starts, reach, most = [], [], -inf
    for w in syss:
        starts.append(-inf if w.s is None else w.s)
        most = most if w.e is None else max(most, w.e)
        reach.append(most)
    found = []
    for r in refs:
        if r.s is None or r.e is None:
            found.append([])
            continue
        lo, hi = bisect_right(reach, r.s - gap), bisect_left(starts, r.e + gap)
        found.append([j for j in range(lo, hi) if (w := syss[j]).s is not None and w.e is not None and min(w.e, r.e) - max(w.s, r.s) + gap > 0])
    return found


def _banded(refs: Sequence, syss: Sequence, near: list[list[int]], score: Callable, lone: Callable) -> list[tuple[int | None, int | None]]:
    """align() without pruning, over the cells of the table that decide: a row needs no column before the first that it or a later row can pair with, and none after the last that it or an earlier one could."""
    n, m = len(refs), len(syss)
    left = [0]
    for w in syss:
        left.append(left[-1] + int(round(lone(w) * UNITS)))
    first, least = [m] * (n + 1), m  # first[i]: columns before it pair with no row after i
    for i in range(n - 1, -1, -1):
        least = min(least, near[i][0]) if near[i] else least
        first[i] = least
    steps, lo, before, last = [], first[0], [left[first[0]]], first[0]
    for i, r in enumerate(refs):
        hi = max(last, near[i][-1] + 1) if near[i] else last
        while len(before) <= hi - lo:  # columns that no earlier row reaches: left alone from the last one
            before.append(before[-1] + left[lo + len(before)] - left[lo + len(before) - 1])
        cost = int(round(lone(r) * UNITS))
        row, step, at, k = [before[0] + cost], [1], near[i], 0
        for j in range(lo + 1, hi + 1):
            drop, add = before[j - lo] + cost, row[-1] + left[j] - left[j - 1]
            while k < len(at) and at[k] < j - 1:
                k += 1
            if k < len(at) and at[k] == j - 1 and (pair := before[j - 1 - lo] + int(round(score(r, syss[j - 1]) * UNITS))) > drop and pair > add:
                row.append(pair)
                step.append(3)
            else:
                row.append(max(drop, add))
                step.append(1 if drop >= add else 2)
        steps.append((lo, hi, step))
        new = first[i + 1]
        last = max(hi, new)
        while len(row) <= last - lo:
            row.append(row[-1] + left[lo + len(row)] - left[lo + len(row) - 1])
        before, lo = row[new - lo :], new
    pairs, i, j = [], n, m
    while i and j:
        lo, hi, step = steps[i - 1]
        j = min(j, hi)
        k = step[j - lo] if j >= lo else 1
        if k == 3:
            pairs.append((i - 1, j - 1))
        i, j = i - (k != 2), j - (k != 1)
    # between two pairs come the words of the other side, then those of the reference
    out, i, j = [], 0, 0
    for p, q in [*pairs[::-1], (n, m)]:
        out += [(None, x) for x in range(j, q)]
        out += [(x, None) for x in range(i, p)]
        if p < n:
            out.append((p, q))
        i, j = p + 1, q + 1
    return out


def align(refs: Sequence, syss: Sequence, gap: float, score: Callable = pair_score, lone: Callable = lone_score, most_behind: float = np.inf) -> list[tuple[int | None, int | None]]:
    """The order-preserving pairing of two sorted lists with the highest total score; a word without a partner is paired with None.

    Only words that overlap, or come within gap, can pair. most_behind prunes: a path whose score, with the rest of the
    other side left alone, lies that far behind the best of its row is not extended by a pair. A pair has to be better than
    leaving both alone. Without pruning only a band of the table is made, and rows of narrow bands are plain steps. Else a row is a few array operations over
    all columns; either way pairs are scored in the band of time of their word.
    """
    n, m = len(refs), len(syss)
    if np.isinf(most_behind):
        if not n or not m:
            return [(None, j) for j in range(m)] + [(i, None) for i in range(n)]
        near = _near(refs, syss, gap)
        if sum(map(len, near)) <= WIDE * n:
            return _banded(refs, syss, near, score, lone)
    whole = lambda x: int(round(x * UNITS))
    known: dict = {}
    left = np.concatenate([[0], np.cumsum([whole(lone(s)) for s in syss], dtype=np.int64)]).astype(np.int64)
    starts, ends = np.array([s.s for s in syss], float), np.array([s.e for s in syss], float)
    reach = np.maximum.accumulate(ends) if m else ends
    step = np.full((n + 1, m + 1), 2, np.int8)
    before, step[1:, 0] = left, 1
    behind = None if np.isinf(most_behind) else whole(most_behind)
    for i, r in enumerate(refs, 1):
        cost = whole(lone(r))
        drop, pair = before + cost, np.full(m + 1, NEVER)
        # only the words of a band of time can pair
        lo, hi = int(np.searchsorted(reach, r.s - gap, side="right")), int(np.searchsorted(starts, r.e + gap, side="left"))
        near = lo + np.flatnonzero(np.minimum(ends[lo:hi], r.e) - np.maximum(starts[lo:hi], r.s) + gap > 0)
        if behind is not None:
            ahead = before - left
            near = near[ahead[near] >= ahead.max() - behind]
        for j in near:
            kind = (r.word, r.wtype, syss[j].word, syss[j].wtype) if score is pair_score else None
            if kind is None:
                x = whole(score(r, syss[j]))
            elif (x := known.get(kind)) is None:
                x = known[kind] = whole(score(r, syss[j]))
            pair[j + 1] = before[j] + x
        # leaving words of the other side alone, from the best place before, is a running maximum
        row = left + np.maximum.accumulate(np.maximum(drop, pair) - left)
        add = np.concatenate([[NEVER], row[:-1] + np.diff(left)])
        step[i] = np.where(pair > np.maximum(drop, add), 3, np.where(drop >= add, 1, 2))
        step[i, 0] = 1
        before = row
    out, i, j = [], n, m
    while i or j:
        k = step[i, j]
        out.append((i - 1 if k != 2 else None, j - 1 if k != 1 else None))
        i, j = i - (k != 2), j - (k != 1)
    return out[::-1]


ALIGNED = "uri string, ref_idx long, sys_idx long, ref_word string, sys_word string, kind string, ds double, de double"


def islands(ref: DataFrame, sys: DataFrame, gap: float, *more: str) -> DataFrame:
    """(uri, island, side, idx, word, wtype, s, e and more columns): the words of both sides (ref 0, sys 1), numbered by the stretch without a silence of gap or more."""

    def side(df, k):
        wtype = F.col("wtype") if "wtype" in df.columns else F.lit("lex")
        return df.select(F.col("uri").cast("string").alias("uri"), F.lit(k).alias("side"), F.col("idx").cast("long").alias("idx"), "word", wtype.alias("wtype"), "s", "e", *more)

    order = Window.partitionBy("uri").orderBy("s", "e", "side", "idx")
    until = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = side(ref, 0).union(side(sys, 1)).withColumn("opens", F.when(F.col("s") < until + gap, 0).otherwise(1))
    return opens.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def in_islands(rows: DataFrame, run: Callable[[str, list[Word], list[Word]], list[tuple]], schema: str, more: str | None = None) -> DataFrame:
    """run(uri, words of side 0, words of side 1) of every island of rows (see islands), whose tuples are rows of the schema.

    Runs of islands are dealt to tasks and sorted there; a task reads them as one stream and holds one island, so small islands cost no group each.
    """
    columns = ["uri", "island", "side", "idx", "word", "wtype", "s", "e", *([more] if more else [])]
    kind = to_arrow_schema(DataType.fromDDL(schema))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            yield from zip(*(cols if more else [*cols, [None] * b.num_rows]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (uri, _), part in groupby(stream(batches), key=lambda w: w[:2]):
            both: tuple[list, list] = ([], [])
            for w in part:
                both[w[2]].append(Word._make(w[3:]))
            out += run(uri, *both)
            if len(out) >= 10_000:
                yield _batch(out, kind)
                out = []
        if out:
            yield _batch(out, kind)

    dealt = rows.select(*columns).withColumn("_run", F.floor(F.col("island") / ISLANDS)).repartition("uri", "_run")
    return dealt.sortWithinPartitions("uri", "island", "side", "s", "e", "idx").select(*columns).mapInArrow(each, schema)


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)


def aligned_words(ref: DataFrame, sys: DataFrame, gap: float = 0.5, score: Callable = pair_score, lone: Callable = lone_score, most_behind: float = np.inf) -> DataFrame:
    """(uri, ref_idx, sys_idx, ref_word, sys_word, kind, ds, de): words (uri, idx, word, s, e and, if there, wtype) aligned; kind is cor, sub, del or ins, ds and de are boundary offsets.

    Time grows with the product of both sides of an island.
    """

    known: dict = {}

    def scored(r, s) -> float:
        kind = (r.word, r.wtype, s.word, s.wtype)
        if (x := known.get(kind)) is None:
            if len(known) >= KNOWN:
                known.clear()
            x = known[kind] = score(r, s)
        return x

    each = scored if score is pair_score else score

    def row(uri, r, s):
        if r is None:
            return (uri, None, s.idx, None, s.word, "ins", None, None)
        if s is None:
            return (uri, r.idx, None, r.word, None, "del", None, None)
        return (uri, r.idx, s.idx, r.word, s.word, "cor" if each(r, s) > RIGHT else "sub", float(s.s - r.s), float(s.e - r.e))

    def run(uri, r, s):
        s.sort(key=_place)
        r.sort(key=_place)
        return [row(uri, None if i is None else r[i], None if j is None else s[j]) for i, j in align(r, s, gap, each, lone, most_behind)]

    return in_islands(islands(ref, sys, gap), run, ALIGNED)


def _place(w: Word) -> tuple:
    """Words in order of start and idx; those without a start last."""
    return (w.s is None, 0 if w.s is None else w.s, w.idx)


def word_errors(aligned: DataFrame) -> DataFrame:
    """(uri, words, cor, sub, dele, ins, wer): counts and the error rate in percent."""
    kinds = {k: F.count_if(F.col("kind") == k) for k in ("cor", "sub", "del", "ins")}
    found = aligned.groupBy("uri").agg(F.count("ref_idx").alias("words"), kinds["cor"].alias("cor"), kinds["sub"].alias("sub"), kinds["del"].alias("dele"), kinds["ins"].alias("ins"))
    wrong = F.col("sub") + F.col("dele") + F.col("ins")
    return found.withColumn("wer", F.when(F.col("words") > 0, wrong * 100.0 / F.col("words")).when(wrong == 0, 0.0).otherwise(F.lit(float("inf"))))
