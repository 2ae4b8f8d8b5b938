"""The pipeline and each of its stages against plain Python on a small table."""

import random
from collections import Counter

import plain
from test_nearsets import plain_groups
from tokenizers import Tokenizer

import corpus_pipeline
from turnframe.llm.tokenfile import vocabulary_path

COMMON = "the and of to in is that for it with as was on be by this have from or one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def tables(spark, tmp_path):
    random.seed(31)
    words = [*COMMON, *(f"{a}{b}" for a in ("hous", "gard", "riv", "mount", "wint", "summ", "bridg", "stat") for b in ("e", "en", "er", "ain", "ing", "ion", "ed", "es"))]
    rows, labels, toxic = [], [], set()
    item = " ".join(random.choices(words, k=14))
    for i in range(300):
        text = random.choices(words, k=60)
        if i % 6 == 5:
            text[10:14] = ["scum", "moron", "trash", "idiot"]
            toxic.add(i)
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(i % 6 == 5)))
    for i in range(20):  # near copies: one word of sixty changed
        changed = rows[i][1].split()
        changed[0] = "other"
        rows.append((1000 + i, " ".join(changed)))
    rows += [(2000, None), (2001, "12 345 !!"), (2002, rows[3][1]), (2003, " ".join(random.choices(words, k=40)) + " " + item.upper() + " end"), (2004, item)]
    rows += [(2005, rows[7][1]), (2005, rows[7][1])]
    docs = [(i, t, "en", "web", len(t or ""), i % 3) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("q1", item), ("q2", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return dict(reversed(rows)), item, toxic


def test_stages_keep_columns_whose_names_clash(spark, tmp_path):
    from turnframe.llm.linededup import without_frequent_lines

    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id between 0 and 20")
    extra = ("_key", "score", "lang_pred", "_copies", "_lines", "p", "fp", "node", "line")
    for c in extra:
        docs = docs.withColumn(c, docs.doc_id * 10)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        assert all(r[c] == r.doc_id * 10 for r in got.collect() for c in extra)
    assert all(r[c] == r.doc_id * 10 for r in without_frequent_lines(docs).collect() for c in extra)


def test_stages_and_run(spark, tmp_path):
    texts, item, toxic = tables(spark, tmp_path)
    sf, now = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = now.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == columns
        now.write.parquet(f"{tmp_path}/after_{name}")
        now = spark.read.parquet(f"{tmp_path}/after_{name}")
        kept[name] = [(r.doc_id, r.text) for r in now.collect()]
    ids = {name: {i for i, _ in rows} for name, rows in kept.items()}
    assert ids["language"] == {i for i, t in texts.items() if t and any(c.isalpha() for c in t)} == set(texts) - {2000, 2001}
    groups = plain_groups({i: texts[i] for i in ids["language"]})
    assert ids["near_dedup"] == set(groups.values()) and len(ids["near_dedup"]) < len(ids["language"]) - 20
    order = sorted(ids["near_dedup"])
    hit = {i for i, r in zip(order, plain.contamination([texts[i] for i in order], [("q1", item)])) if r[-1]}
    assert hit and ids["decontamination"] == ids["near_dedup"] - hit
    clean = ids["decontamination"] - toxic
    assert not ids["mixing"] & toxic and ids["mixing"] >= clean
    want = plain.tokens(sorted(kept["mixing"]), Tokenizer.from_file(vocabulary_path()))
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect()]
    assert sorted(got) == sorted(want)
    assert max(Counter(i for i, _ in kept["near_dedup"]).values()) == 1
