import random

import pytest
import xxhash

from turnframe.llm.simhash import cell_masks, fingerprint_of, links, manhattan, near_duplicates, one_of_each, op1_simhash, popcounts


def plain_fingerprint(text):
    words = []
    for ch in text or "":
        pass
    words = (text or "").translate({i: i + 32 for i in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """fps: doc_id to fingerprint; brute force over all pairs."""
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_fingerprint_is_the_majority():
    for text in (None, "", " \t\n", "One", "ONE two", "a b c d e a b c", "É É é x y z", "x\x1cy z w"):
        assert fingerprint_of(text) % (1 << 64) == plain_fingerprint(text)


def test_manhattan_is_a_lower_bound(spark):
    random.seed(1)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = []
    for _ in range(300):
        a = random.getrandbits(64)
        b = a
        for _ in range(random.randrange(4)):
            b ^= 1 << random.randrange(64)
        rows.append((signed(a), signed(b)))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "a long, b long")
    got = df.select("a", "b", manhattan(popcounts(F.col("a")), popcounts(F.col("b"))).alias("d")).collect()
    for r in got:
        fields = lambda x: [(x >> (2 * i) & 3).bit_count() for i in range(32)]
        want = sum(abs(x - y) for x, y in zip(fields(r.a % (1 << 64)), fields(r.b % (1 << 64))))
        assert r.d == want <= ((r.a ^ r.b) % (1 << 64)).bit_count()
    assert len(cell_masks(2)) == 6


@pytest.mark.parametrize("cell", [1, 3, 256])
def test_links_join_what_brute_force_joins(spark, cell):
    random.seed(2)
    base = [random.getrandbits(64) for _ in range(12)]
    fps = set(base)
    for b in base[:4]:
        for _ in range(25):
            x = b
            for _ in range(random.randrange(1, 5)):
                x ^= 1 << random.randrange(64)
            fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), cell=cell).collect()
    from collections import defaultdict

    seen = defaultdict(set)
    for r in got:
        assert (r.u ^ r.v) % (1 << 64) and ((r.u ^ r.v) % (1 << 64)).bit_count() <= 2
        seen[r.u % (1 << 64)].add(r.v % (1 << 64))
        seen[r.v % (1 << 64)].add(r.u % (1 << 64))
    want = plain_components({x: x for x in fps})

    def reach(x):
        todo, found = [x], {x}
        while todo:
            for y in seen[todo.pop()] - found:
                found.add(y)
                todo.append(y)
        return min(found)

    assert {x: reach(x) for x in fps} == want


def test_documents_with_nulls_ties_copies_and_clashing_columns(spark):
    random.seed(3)
    words = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, "   "), (4, "solo"), (5, "Solo"), (5, "Solo"), (None, "solo")]
    for i in range(10, 40):
        text = " ".join(random.choices(words, k=300))
        rows.append((i, text))
        if i % 3 == 0:
            rows.append((i + 100, text.upper()))
        if i % 4 == 0:
            rows.append((i + 200, text + " tail"))
    rows.append((999, "long " * 200_000))
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, fp int, component_id string")
    got = op1_simhash(df).collect()
    assert len(got) == len(rows)
    fps = {i: plain_fingerprint(t) for i, t in rows if i is not None}
    want = plain_components(fps)
    for r in got:
        if r.doc_id is not None:
            assert int(r.fingerprint, 16) == fps[r.doc_id] and r.component_id == want[r.doc_id]
        else:
            assert r.component_id == 4
    kept = sorted(r.doc_id for r in one_of_each(df).collect() if r.doc_id is not None)
    assert kept == sorted(set(want.values()))


def test_rows_of_one_doc_id_are_one_node(spark):
    random.seed(8)
    a, b = (" ".join(random.choices([f"w{i}" for i in range(300)], k=80)) for _ in range(2))
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (9, b), (7, "else"), (None, "lone"), (None, a)], "doc_id long, text string")
    for settings in ({}, {"width": 5, "similarity": 0.8}):
        got = {(r.doc_id, r.component_id) for r in near_duplicates(df, **settings).collect()}
        assert got == {(3, 3), (5, 3), (9, 3), (7, 7), (None, None), (None, 3)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).collect() == [] and one_of_each(df).collect() == []
