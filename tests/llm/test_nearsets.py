import random

import pytest

import corpus_pipeline
from turnframe.llm import nearsets
from turnframe.llm.nearsets import alike_documents
from turnframe.llm.simhash import near_duplicates


def plain_groups(texts, width=5, least=0.8):
    """texts: doc_id to text; brute force over all pairs."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if (not x and not y) or (x | y and len(x & y) / len(x | y) >= least):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: root(i) for i in ids}


def planted():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = {1: None, 2: "", 3: " \t", 4: "solo", 5: "Solo", 6: "a b c", 7: "a b d"}
    line = " ".join(rng.choices(vocabulary, k=12))
    for i in range(10, 50):
        words = rng.choices(vocabulary, k=rng.choice((8, 30, 120, 300)))
        texts[i] = " ".join(words) + (" " + line if i % 2 else "")
        for k in range(3):
            changed = texts[i].split()
            for _ in range(rng.randrange(1, 2 + len(changed) // 25)):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            texts[i * 100 + k] = " ".join(changed)
    for k in range(60):  # one large group whose chains are longer than a pair
        changed = texts[11].split()
        changed[rng.randrange(len(changed))] = "other"
        texts[9000 + k] = " ".join(changed)
    # 9 shingles of 11 and 8 of 10 lie at and above the bound, 7 of 9 below it
    for base, n in ((20000, 13), (20010, 12), (20020, 11)):
        texts[base] = " ".join(f"b{base}x{k}" for k in range(n))
        texts[base + 1] = texts[base].rsplit(" ", 1)[0] + " end"
        texts[base + 2] = "start " + texts[base].split(" ", 1)[1]
    return texts


@pytest.mark.parametrize("often", [2, 4])
def test_groups_are_those_of_brute_force(spark, monkeypatch, often):
    monkeypatch.setattr(nearsets, "OFTEN", often)
    texts = planted()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in alike_documents(df, 5, 0.8).collect()}
    assert got == plain_groups(texts)
    assert len(set(got.values())) < len(texts) - 60


def test_stage_drops_near_copies_with_changed_words(spark):
    texts = planted()
    df = spark.createDataFrame([*texts.items(), (None, "solo"), (5, "Solo")], "doc_id long, text string")
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()]
    want = set(plain_groups(texts).values())
    assert sorted(x for x in kept if x is not None) == sorted(want) and kept.count(None) == 1


def test_empty_table_and_bounds(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df, width=5, similarity=0.8).collect() == []
    with pytest.raises(ValueError):
        near_duplicates(df, width=5, similarity=0.0)


@pytest.mark.parametrize("pairs", [0, 4])
def test_rounds_of_pivots_and_pairs_left_are_brute_force(spark, monkeypatch, pairs):
    """Copies of one text, each changed in other places: similarities lie on both sides of the bound and most pairs meet in many buckets."""
    rng = random.Random(8)
    base, texts, counted = [f"v{k}" for k in range(100)], {}, []
    for i in range(90):
        words = list(base)
        for _ in range(rng.choice((1, 2, 3, 5, 8))):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        texts[i] = " ".join(words)
    count = nearsets.pairs_left
    monkeypatch.setattr(nearsets, "PAIRS", pairs)
    monkeypatch.setattr(nearsets, "pairs_left", lambda own: counted.append(count(own)) or counted[-1])
    got = {r.doc_id: r.component_id for r in alike_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 5, 0.8).collect()}
    assert got == plain_groups(texts) and 1 < len(set(got.values())) < len(texts)
    if pairs == 0:
        assert len(counted) > 1 and counted[1][1] < counted[0][1]


def test_working_tables_and_shuffles_do_not_pile_up(spark, monkeypatch):
    """After the join, what it wrote on the way is gone but for small tables; sets are compared in shares of their number."""
    import pathlib

    rng, texts = random.Random(3), {}
    for i in range(12):
        words = [f"g{i}w{k}" for k in range(200)]
        for k in range(6):
            changed = list(words)
            changed[rng.randrange(200)] = "other"
            texts[i * 100 + k] = " ".join(changed)
    monkeypatch.setattr(nearsets, "SHARE", 0.4)
    monkeypatch.setattr(nearsets, "PAIRS", 10**9)  # all pairs that are left in one comparison
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.rglob("*.parquet"))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in alike_documents(df, 5, 0.8).collect()}
    assert got == {i: i // 100 * 100 for i in texts}
    left = {p.parent.name for p in set(shared.rglob("*.parquet")) - before}
    assert not left & {"prefixes", "once", "shared", "apart", "compared"}


def test_written_removes_its_shuffle_files_and_keeps_the_setting(spark):
    from turnframe.llm.common import CLEANUP, written

    before, was = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), spark.conf.get(CLEANUP)
    files = lambda: {f for f in _every(before) if f.startswith("shuffle_")}
    held = files()
    assert written(spark.range(1000).repartition(7, "id").groupBy("id").count()).count() == 1000
    made = {int(f.split("_")[1]) for f in files() - held}
    assert len(made) <= 1 and spark.conf.get(CLEANUP) == was  # at most that of count() itself


def _every(manager):
    import os

    return [f for d in manager.localDirs() for _, _, names in os.walk(d.getPath()) for f in names]


def test_whole_sets_are_made_of_the_texts_asked_for_alone(spark, tmp_path):
    """The sets are made once, after the join with the ids asked for, and not for every document at the scan."""
    spark.createDataFrame(list(planted().items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents")
    df = spark.read.parquet(f"{tmp_path}/documents")
    nodes = nearsets.written(nearsets.prefixes(df, 5, 0.8).groupBy("node").agg({"doc_id": "min"}).toDF("node", "least"))
    asked = nearsets.written(nodes.where("least < 20").select("node"))
    sets = nearsets.whole_sets(df, nodes, asked, 5)
    plan = sets._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Join LeftSemi" in plan[plan.index("ArrowEvalPython") :]
    assert {r.node for r in sets.collect()} == {r.node for r in asked.collect()}


def test_fingerprints_of_op_1_link_first_and_the_join_adds_the_rest(spark, monkeypatch):
    from turnframe.llm.simhash import majority

    texts, asked, linked = planted(), [], []
    alike, links = nearsets._alike, nearsets.links
    monkeypatch.setattr(nearsets, "_alike", lambda pairs, *a: asked.append([(r.u, r.v) for r in pairs.collect()]) or alike(pairs, *a))
    monkeypatch.setattr(nearsets, "links", lambda fps: linked.append(links(fps)) or linked[-1])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.node, r.component_id) for r in alike_documents(df, 5, 0.8).collect()}
    assert {i: c for i, (_, c) in got.items()} == plain_groups(texts)
    sets = {got[i][0]: nearsets.shingles_of(t, 5) for i, t in texts.items()}
    marks = {node: majority(s.view("uint64")) % (1 << 64) for node, s in sets.items()}
    apart = lambda u, v: (marks[u] ^ marks[v]).bit_count()
    near, *later = asked
    assert len(linked) == 1 and near and max(apart(u, v) for u, v in near) <= 2
    assert later and not set(near) & {p for pairs in later for p in pairs}
    # pairs of the similarity that fingerprints don't link are there: the join is not a plainer path beside them
    similarity = lambda u, v: len(set(sets[u]) & set(sets[v])) / len(set(sets[u]) | set(sets[v]))
    assert any(apart(u, v) > 2 and similarity(u, v) >= 0.8 for pairs in later for u, v in pairs)


def test_majority_of_the_bits():
    from turnframe.llm.simhash import majority

    assert majority([]) == 0 and majority([1, 3, 1 << 63]) == 1 and majority([1 << 63]) == -(1 << 63)


def test_shares_follow_what_is_shipped():
    from turnframe.llm.nearsets import SHARE, SHIPPED, shares_of

    assert shares_of(0, 0, 0) == 1
    assert shares_of(41_095, 1600, 1600 * 60) == 1  # 39 MB in all: was a job for each two pairs a set, 13 here
    sets, mean = 200_000, 400
    for pairs in (2 * sets, 20 * sets):  # large: still in proportion to the sets
        assert shares_of(pairs, sets, sets * mean) == pairs // (SHARE * sets)
    assert shares_of(10_000_000, 1000, 1000 * 64) == -(-10_000_000 * 16 * 64 // SHIPPED)


def test_several_shares_find_the_same_pairs(spark, monkeypatch):
    sets = {i: list(range(i % 7, 20 + i % 3)) for i in range(40)}
    known = spark.createDataFrame(list(sets.items()), "node long, shingles array<long>")
    pairs = spark.createDataFrame([(u, v) for u in sets for v in sets if u < v], "u long, v long")
    want = {(u, v) for u in sets for v in sets if u < v and len({*sets[u]} & {*sets[v]}) / len({*sets[u]} | {*sets[v]}) >= 0.8}
    for shipped in (0, 1 << 26):
        monkeypatch.setattr(nearsets, "SHIPPED", shipped)
        assert nearsets.shares_of(len(sets) * 39 // 2, 40, 800) == (1 if shipped else 10)
        assert {(r.u, r.v) for r in nearsets._alike(pairs, lambda asked: known.join(asked, "node"), 0.8).collect()} == want
