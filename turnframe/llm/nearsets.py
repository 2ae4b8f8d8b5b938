"""Near-duplicates by the Jaccard similarity of word shingles: fingerprints of op 1 first, then an exact join of sets by prefixes.

A row's fingerprint is the majority of the bits of its set. Those that the grid of segment popcounts links are compared set by
set, and the pairs of the similarity join their groups. Sets of a similarity of 0.8 have fingerprints up to some 11 bits apart,
where no grid rules out much; the join finds these, and compares nothing again that lies in one group already.

A row's set holds 64-bit hashes of its word shingles, of which only the prefix is stored, in one global order: shingles that are frequent in a sample of the
rows last, else by hash. Two sets of similarity t or more share an element within their first n - ceil(t n) + 1, so they
meet in the bucket of such an element. Lengths, places in the order and sketches rule out most that meet by chance, and the
rest are compared set by set. A sketch has SKETCH bits, each the parity of the elements that fall on it; two sketches differ in
no more bits than their sets differ in elements, so it never rules out a pair of the similarity. Folded to 128 bits it goes with
every row of a bucket, whole only with those that are left after the first comparison. The sample tells frequent shingles only; it settles how fast the join is, not what it finds.

Groups are wanted, not pairs: every set is compared with the first of its bucket. Buckets that hold several groups then name
another set as pivot, and every set of another group is compared with it, round after round, while that joins groups: time in
proportion to the rows of a round. Pairs of groups that are left are compared pair by pair, each in the first bucket it shares,
as far as the last BEFORE elements of both prefixes tell. How many rounds there are settles the time, not the result.

Rows: a null or wordless text has the empty set, and those are alike. Texts shorter than a shingle are one shingle. Rows
with equal sets, or of one doc_id, are one node. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnframe.llm.common import dropped, labelled, written
from turnframe.llm.components import components
from turnframe.llm.shipping import hand_back, take_over
from turnframe.llm.simhash import links, majority

#: One row in SAMPLE is looked at for frequent shingles; those in OFTEN sampled rows or more are, at most MOST of them.
SAMPLE, OFTEN, MOST = 16, 4, 65_536
#: Bits of a sketch, in columns of 64; and the two columns it is folded to: the parities by 128.
SKETCH = 512
WHOLE = [f"k{i}" for i in range(SKETCH // 64)]
FOLDED = ["k0", "k1"]
#: Rounds of pivots end where the pairs of groups left are PAIRS times the rows, or fewer, or a round leaves more than STILL of them.
PAIRS, STILL = 4, 0.5
#: Whole sets are compared in shares of SHARE pairs a set, so that what a share ships is in proportion to the sets; or of so many
#: pairs as ship SHIPPED bytes, where that is more.
SHARE, SHIPPED = 2, 1 << 26
#: Elements before a place that a row of a bucket knows.
BEFORE = 4
ROW = f"node long, n int, fp long, {', '.join(f'{k} long' for k in WHOLE)}, shingles array<long>"


def shingles_of(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """The distinct hashes of the word shingles, sorted."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # as in fingerprint_of
    if not words:
        return np.empty(0, np.int64)
    digest = xxhash.xxh64_intdigest
    each = np.array([digest(w, seed) for w in words], dtype=np.uint64)
    k = min(width, len(words))
    mixed = np.full(len(words) - k + 1, np.uint64(k))
    for i in range(k):
        mixed = (mixed ^ each[i : i + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def prefix_size(n: int, similarity: float) -> int:
    return n - int(np.ceil(n * similarity - 1e-9)) + 1 if n else 0


def _rows(width: int, late: np.ndarray | None = None, similarity: float | None = None) -> Callable:
    """text to (node, n, fp, the sketch, shingles); `late` holds the frequent shingles, the most frequent one last. With a similarity, shingles are only the set's prefix for it."""
    place = None if late is None or not len(late) else (np.sort(late), np.argsort(late, kind="stable"))

    def made(texts: pd.Series) -> pd.DataFrame:
        nodes, sets, sizes, marks, sketches = [], [], [], [], []
        for text in texts:
            s = shingles_of(text, width)
            nodes.append(xxhash.xxh64_intdigest(s.tobytes(), 7) - (1 << 63))
            marks.append(majority(s.view(np.uint64)))
            sketches.append(np.packbits(np.bincount(s & (SKETCH - 1), minlength=SKETCH) & 1).view(np.int64))
            if place is not None and len(s):
                at = np.minimum(np.searchsorted(place[0], s), len(place[0]) - 1)
                s = s[np.lexsort((s, np.where(place[0][at] == s, place[1][at] + 1, 0)))]
            sizes.append(len(s))
            sets.append(s if similarity is None else s[: prefix_size(len(s), similarity)].copy())
        return pd.DataFrame({"node": np.array(nodes, np.int64), "n": np.array(sizes, np.int32), "fp": np.array(marks, np.int64), **{c: [k[i] for k in sketches] for i, c in enumerate(WHOLE)}, "shingles": pd.Series(sets, dtype=object)})

    @F.pandas_udf(ROW)
    def rows(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        take_over("nearsets")
        for texts in parts:
            yield made(texts)
            hand_back()

    return rows


def prefixes(documents: DataFrame, width: int, similarity: float) -> DataFrame:
    """(doc_id, node, n, fp, the sketch, shingles) for every row, a written table; shingles are the prefix of the set, so the table is small beside the texts."""
    some = documents.where(F.rand(42) < 1 / SAMPLE)
    seen = some.select(F.explode(_rows(width)("text")["shingles"]).alias("h")).groupBy("h").count().where(F.col("count") >= OFTEN)
    late = seen.orderBy(F.desc("count"), "h").limit(MOST).select("h").toPandas()["h"].to_numpy(np.int64)[::-1]
    return written(documents.select("doc_id", _rows(width, late, similarity)("text").alias("r")).select("doc_id", "r.*"), "prefixes")


def _may(similarity: float, a: str, b: str, sketch: list[str]) -> Column:
    """Sets that meet at places pos (from 0) of a and b can have the similarity, if nothing before is shared; and by their sketches, too."""
    both = F.col(f"{a}n") + F.col(f"{b}n")
    need = F.ceil(both * (similarity / (1 + similarity)) - 1e-9)
    apart = sum((F.bit_count(F.col(a + k).bitwiseXOR(F.col(b + k))) for k in sketch), F.lit(0))
    return (apart <= both * ((1 - similarity) / (1 + similarity)) + 1e-9) & (F.least(F.col(f"{a}n") - F.col(f"{a}pos"), F.col(f"{b}n") - F.col(f"{b}pos")) >= need)


def fingerprint_pairs(once: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of nodes of once (node, n, fp, the sketch) by their fingerprints, as far as sizes and sketches allow the similarity: a written table.

    The first node of a fingerprint meets the others that have it, and the first nodes of fingerprints linked to it.
    """
    first = written(once.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    same = once.select("fp", "node").join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    a, b = (first.select(F.col("fp").alias(c), F.col("first").alias(x)) for c, x in (("u", "a"), ("v", "b")))
    met = same.union(links(first.select("fp")).join(a, "u").join(b, "v").select("a", "b")).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    a, b = (once.select(F.col("node").alias(c), F.lit(0).alias(f"{x}pos"), *[F.col(k).alias(x + k) for k in ("n", *WHOLE)]) for c, x in (("u", "a_"), ("v", "b_")))
    return written(met.join(a, "u").join(b, "v").where(_may(similarity, "a_", "b_", WHOLE)).select("u", "v"), "near")


def _between(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (u, v) that don't lie in one of the groups (node, component)."""
    u, v = (groups.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part")) for c in "uv")
    apart = F.coalesce("u_part", "u") != F.coalesce("v_part", "v")
    return pairs.join(u, "u", "left").join(v, "v", "left").where(apart).select("u", "v")


def whole_sets(documents: DataFrame, nodes: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the nodes asked for, made from the texts of one doc_id each; nodes has (node, least)."""
    ids = written(asked.join(nodes, "node").select(F.col("least").alias("_id")).distinct(), "asked")
    some = documents.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    made = _rows(width).asNondeterministic()  # else the join's test for null nodes is pushed to the scan, and makes the sets of all documents
    return some.select(made("text").alias("r")).select("r.node", "r.shingles").join(asked, "node", "left_semi").dropDuplicates(["node"])


def shares_of(pairs: int, sets: int, elements: int) -> int:
    """In how many shares pairs of these sets are compared; a pair ships two sets of the mean size."""
    sets = max(1, sets)
    return max(1, int(np.ceil(pairs / max(SHARE * sets, SHIPPED * sets / (16 * max(1, elements))))))


def _alike(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets have the similarity: a written table."""
    asked = written(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "pairs")
    known = written(sets_of(asked), "compared")
    a, b = known.select(F.col("node").alias("u"), F.col("shingles").alias("a")), known.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    n, elements = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()
    shares, found = shares_of(pairs.count(), n, elements), []
    for k in range(shares):
        some = pairs.where(F.pmod(F.xxhash64("u", "v"), F.lit(shares)) == k)
        met = some.join(a, "u").join(b, "v").select("u", "v", F.size("a").alias("na"), F.size("b").alias("nb"), F.size(F.array_intersect("a", "b")).alias("both"))
        found.append(written(met.where(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")) >= similarity).select("u", "v"), "alike"))
    for done in (asked, known):
        dropped(done)
    return reduce(DataFrame.union, found)


def _folded(sketch: list[str], into: int) -> list[Column]:
    return [reduce(lambda x, y: x.bitwiseXOR(y), [F.col(k) for k in sketch[i::into]]).alias(f"k{i}") for i in range(into)]


def _with(row: list[str], of: str) -> list[Column]:
    return [F.col(f"{of}.{c}").alias(f"f_{c}") for c in row]


def _apart(shared: DataFrame, once: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of buckets that hold several groups, with their group, whole sketch and the elements before: a written table."""
    groups = written(components(edges), "groups")
    own = shared.select("h", "node", "pos").join(groups, "node", "left").withColumn("part", F.coalesce("component", "node"))
    mixed = own.groupBy("h").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("h")
    before = F.slice("shingles", F.greatest(F.col("pos") - (BEFORE - 1), F.lit(1)), F.least("pos", F.lit(BEFORE))).alias("before")
    return written(own.join(mixed, "h", "left_semi").join(once, "node").select("h", "node", "n", "pos", "part", before, *WHOLE), "apart")


def pairs_left(own: DataFrame) -> tuple[int, int]:
    """Rows of buckets, and pairs of rows of different groups that meet in one; pairs are counted, not made."""
    alike = own.groupBy("h", "part").agg(F.count(F.lit(1)).cast("decimal(20,0)").alias("n"))
    each = alike.groupBy("h").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("same"))
    rows, pairs = each.agg(F.sum("rows"), F.sum((F.col("rows") * F.col("rows") - F.col("same")) / 2)).first()
    return int(rows or 0), int(pairs or 0)


def set_links(sets: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """Edges (u, v) between nodes of prefixes (node, n, fp, sketch, shingles) that connect exactly those linked by chains of pairs of the similarity. sets_of gives the whole sets of nodes."""
    once = written(sets.where("n > 0").dropDuplicates(["node"]).select("node", "n", "fp", *WHOLE, "shingles"), "once")  # copies of a set meet as one node
    near = fingerprint_pairs(once, similarity)
    edges = _alike(near, sets_of, similarity)
    groups = written(components(edges), "groups")
    row, ends = ["n", "node", "pos", *FOLDED], [F.least("node", "f_node").alias("u"), F.greatest("node", "f_node").alias("v")]
    dealt = once.select("node", "n", *_folded(WHOLE, len(FOLDED)), F.posexplode("shingles").alias("pos", "h")).repartition("h")
    buckets = dealt.groupBy("h").agg(F.min(F.struct(*row)).alias("first"), F.max(F.struct(*row)).alias("last")).where("first.node <> last.node").select("h", "first")
    shared = written(dealt.join(buckets, "h").select("h", *row, *_with(row, "first")), "shared")
    firsts = shared.where(F.col("node") != F.col("f_node")).where(_may(similarity, "", "f_", FOLDED)).select(*ends).distinct()
    firsts = written(_between(firsts, groups).join(near, ["u", "v"], "left_anti"), "firsts")
    met, edges = near.union(firsts), written(edges.union(_alike(firsts, sets_of, similarity)), "edges")
    # what is left: pairs that meet in a bucket and lie in different groups
    own, before, turn, row = _apart(shared, once, edges), None, 0, ["node", "n", "pos", "part", *WHOLE]
    while True:
        rows, pairs = pairs_left(own)
        if pairs <= PAIRS * rows or before is not None and pairs > STILL * before:
            break
        before, turn = pairs, turn + 1
        pivots = own.groupBy("h").agg(F.min(F.struct(F.xxhash64("node", "h", F.lit(turn)).alias("at"), *row)).alias("pivot"))
        faced = own.join(pivots, "h").select(*row, *_with(row, "pivot")).where(F.col("part") != F.col("f_part")).where(_may(similarity, "", "f_", WHOLE))
        new = written(faced.select(*ends).distinct().join(met, ["u", "v"], "left_anti"), "faced")
        met, edges = met.union(new), written(edges.union(_alike(new, sets_of, similarity)), "edges")
        dropped(own)
        own = _apart(shared, once, edges)
    a, b = (own.select("h", *[F.col(c).alias(f"{x}_{c}") for c in (*row, "before")]) for x in "ab")
    seen = F.arrays_overlap("a_before", "b_before")  # they have met in a bucket before this one
    last = a.join(b, (a.h == b.h) & (F.col("a_part") < F.col("b_part")) & _may(similarity, "a_", "b_", WHOLE) & ~seen)
    rest = last.select(F.least("a_node", "b_node").alias("u"), F.greatest("a_node", "b_node").alias("v")).distinct()
    rest = written(rest.join(met, ["u", "v"], "left_anti"), "rest")
    for done in (once, shared, own):  # what is left of the work is small beside them
        dropped(done)
    return edges.union(_alike(rest, sets_of, similarity))


def alike_documents(documents: DataFrame, width: int, similarity: float) -> DataFrame:
    """(doc_id, node, component_id) for every row; component_id is the smallest doc_id reachable over sets of the similarity."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    sets = prefixes(documents, width, similarity)
    ids = written(sets.select("doc_id", "node"), "ids")
    least = written(ids.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    # rows of one doc_id are one node: a star over their sets
    several = ids.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("last")).where("u <> last")
    same = ids.join(written(several.select("doc_id", "u"), "several"), "doc_id").where("node <> u").select("u", F.col("node").alias("v")).distinct()
    sets_of = lambda asked: whole_sets(documents, least, asked, width)
    links = set_links(sets, sets_of, similarity)
    dropped(sets)
    grouped = components(links.union(same)).join(least, "node")
    first = grouped.groupBy("component").agg(F.min("least").alias("first"))
    known = least.join(grouped.join(first, "component").select("node", "first"), "node", "left").select("node", F.coalesce("first", "least").alias("component_id"), "n")
    return labelled(ids, written(known, "known"), "node", "component_id")
