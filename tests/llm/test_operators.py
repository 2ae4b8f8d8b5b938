import random
from math import log2

import numpy as np
import plain
import pytest

DOC = "doc_id long, text string, lang string, n_words int, items int, _x int"
EMPTY = (None, "", " ", "\n", " \n\t\n ", "é", "\x00", "a")


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", 1, 2, 3) for i, t in zip(ids or range(len(texts)), texts)], DOC)


def values(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=repr)


def test_decontamination(spark):
    from turnframe.llm.decontaminate import contamination, decontaminated, item_words, op2_decontaminate, postings, proximity_matches
    from turnframe.llm.common import ascii_lower  # noqa: F401

    random.seed(4)
    vocab = ["the", "of", "and", "É", "straße", "x9"] + [f"w{i}" for i in range(60)]
    make = lambda n: " ".join(random.choices(vocab, k=n))
    items = [(i, make(random.choice([1, 3, 9, 10, 11, 40]))) for i in range(25)] + [(100, None), (101, ""), (102, "..."), (103, "the"), (None, make(12))]
    items += [(200, items[3][1]), (201, items[3][1].upper())]
    texts = list(EMPTY)
    for k in range(60):
        t = make(random.randrange(0, 120))
        if k % 3 == 0:
            t += " " + (items[k % 25][1] or "").replace(" ", ", ") + " " + make(5)
        if k % 7 == 0:
            t = t.upper()
        texts.append(t)
    texts += ["the " * 3000, items[5][1], items[5][1]]
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int")
    ids = [None if i == 20 else 7 if i in (21, 22) else i for i in range(len(texts))]
    df = docs(spark, texts, ids)
    got = values(op2_decontaminate(df, bench).collect(), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(((i, *x) for i, x in zip(ids, plain.contamination(texts, items))), key=repr)
    kept = decontaminated(df, bench)
    assert kept.columns == df.columns
    assert kept.count() == sum(not x[4] for x in plain.contamination(texts, items))
    none = bench.limit(0)
    assert contamination(df, none).where("n_hit > 0").count() == 0
    assert op2_decontaminate(df.limit(0), bench).collect() == []
    # proximity: all words of the item within reach of its rarest one, in any order
    ask = item_words(spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"))
    near = docs(spark, ["gamma x x beta alpha", "alpha " + "x " * 30 + "beta gamma", "beta alpha"])
    from pyspark.sql import functions as F

    found = proximity_matches(postings(near, ask.select(F.explode("words").alias("term"))), ask, slop=5).collect()
    assert {r.doc_id for r in found} == {0}


def test_line_dedup(spark):
    from turnframe.llm.linededup import first_seen_lines, op3_line_dedup, without_frequent_lines

    random.seed(5)
    common = ["Terms of USE", " terms of use\t", "© é", "x" * 5000]
    texts = list(EMPTY)
    for k in range(40):
        lines = [random.choice(common) if random.random() < 0.5 else f"line {random.randrange(60)}" for _ in range(random.randrange(1, 12))]
        texts.append("\n".join(lines))
    texts.append("\n" * 3000 + "end")
    df = docs(spark, texts)
    got = values(op3_line_dedup(df).collect(), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert got == sorted(((i, *x) for i, x in enumerate(plain.line_dedup(texts))), key=repr)
    full = without_frequent_lines(df)
    assert set(df.columns) <= set(full.columns)
    assert op3_line_dedup(df.limit(0)).collect() == []
    new = first_seen_lines(df, batches=5).collect()
    keys = {x.strip(plain.SPACES).translate(plain.LOWER) for t in texts for x in (t or "").split("\n")} - {""}
    assert len(new) == len({(r.h1, r.h2) for r in new}) == len(keys)


def test_repeated_rows_are_one_document_for_lines(spark):
    from turnframe.llm.linededup import op3_line_dedup

    df = docs(spark, ["same line"] * 12, [1] * 12)
    assert {r.n_dropped for r in op3_line_dedup(df).collect()} == {0}
    assert {r.n_dropped for r in op3_line_dedup(docs(spark, ["same line"] * 12)).collect()} == {1}


def test_lines_of_repeated_rows_in_spark_and_sql(spark):
    import duckdb
    import pandas as pd

    from turnframe.llm.linededup import OP3_SQL, op3_line_dedup

    texts, ids = ["same line"] * 12 + ["other\nlast"] * 10 + ["other"] * 9, [1] * 12 + list(range(10, 20)) + [30] * 4 + [None] * 5
    documents = pd.DataFrame({"doc_id": pd.Series(ids, dtype="Int64"), "text": texts})  # noqa: F841  read by the SQL
    want = duckdb.sql(OP3_SQL).fetchall()
    assert values(op3_line_dedup(docs(spark, texts, ids)).collect(), "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(want, key=repr)


def test_runs_compact(spark):
    from turnframe.llm.linededup import LineRuns, lines

    runs = LineRuns(fanout=2)
    for k in range(5):
        runs.add(lines(docs(spark, [f"only {k}", "shared"], [2 * k, 2 * k + 1])))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert runs.frequent(5).count() == 1 and runs.frequent(1).count() == 6
    assert runs.unseen(lines(docs(spark, ["shared\nnew"], [99]))).count() == 1
    # settled hashes leave the counting, and later batches drop them
    runs = LineRuns(fanout=2, settle=4)
    for k in range(5):
        runs.add(lines(docs(spark, [f"only {k}", "shared"], [2 * k, 2 * k + 1]).union(docs(spark, ["shared"], [100 + k]))))
    assert [r.count() for r in runs.settled] == [1, 0, 0]
    assert sum(r.count() for r in runs.runs()) == 5
    assert runs.frequent(4).count() == 1
    with pytest.raises(ValueError):
        runs.frequent(5)


def test_quality(spark):
    from turnframe.llm.quality import host_verdicts, op4_quality, with_counts

    random.seed(6)
    texts = [*EMPTY, "a b c d e f g h", "a b c d e f g h a b c d e f g h", "z " * 500, "#*$%&|<> é\n\né\né"]
    for _ in range(40):
        t = " ".join(random.choices([f"w{i}" for i in range(50)], k=random.randrange(0, 200)))
        texts.append(t + " " + " ".join(t.split()[:15]) * random.randrange(3))
    rows = [(i, t, None if i % 4 == 0 else f"h{i % 3}", True) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, host_kept boolean")
    got = op4_quality(df).collect()
    assert values(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(((i, *plain.quality(t)) for i, t in enumerate(texts)), key=repr)
    assert all(not (r.kept and r.base_failed) for r in got)
    assert op4_quality(df.limit(0)).collect() == []
    # a host of failures goes with its few good documents, an unknown small one does not
    good, bad = " ".join(f"w{i}" for i in range(40)), "x"
    hosts = [(f"ok{h}", good if k else bad) for h in range(20) for k in range(10)] + [("junk", bad)] * 200 + [("junk", good)] * 5 + [("tiny", bad), ("tiny", good)]
    df = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(hosts)], "doc_id long, text string, source string")
    verdict = {r.source: r for r in host_verdicts(with_counts(df)).collect()}
    assert not verdict["junk"].host_kept and verdict["tiny"].host_kept and verdict["ok3"].host_kept
    assert verdict["tiny"].rate < 0.5 < verdict["junk"].rate


def test_secrets(spark):
    from turnframe.llm.secrets import CLASSES, KINDS, op5_secrets, secret_spans

    random.seed(7)
    parts = ["token", "secret=", "PassWord: ", "api_key='", "ApiKey = ", "é", "\n", " ", "AKIA", "AKIA" + "Z9" * 9, "abcdef" * 5, "0" * 24, "f" * 23, "=", "x/y.z-", '"', "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"", "secret=token: abcdefgh"]
    texts = [*EMPTY, "𝄞 token=abcdef", "token=abc"] + ["".join(random.choices(parts, k=random.randrange(1, 20))) for _ in range(120)]
    texts.append("deadbeef" * 5000 + " token: " + "q" * 5000)
    got = op5_secrets(docs(spark, texts)).collect()
    assert values(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(((i, *plain.secrets(t)[0]) for i, t in enumerate(texts)), key=repr)
    assert op5_secrets(docs(spark, texts).limit(0)).collect() == []
    # the method's spans: incremental entropy against a plain count
    alphabet = CLASSES["entropy_base64"][1]
    strings = ["".join(random.choices(alphabet, k=random.randrange(24, 60))) for _ in range(30)] + ["aA1" * 12, "f81d4fae-7dec-11d0-A765-00a0c91e6bf6", "Example" + "aB3xK9" * 5]
    spans = {r.doc_id: [s for s in r.spans if s.kind >= len(KINDS)] for r in secret_spans(docs(spark, [f"see {s} there" for s in strings])).collect()}

    def plain_span(s):
        hot = [i for i in range(len(s) - 23) if sum(-c / 24 * log2(c / 24) for c in __import__("collections").Counter(s[i : i + 24]).values()) >= 3.8 - 1e-9]
        return [(4 + hot[0], 4 + hot[-1] + 24)] if hot else []

    import re

    from turnframe.llm.secrets import ALLOWED

    for i, s in enumerate(strings):
        wanted = all(re.search(h, s) for h in CLASSES["entropy_base64"][4]) and not any(re.search(a, s) for a in ALLOWED)
        named = plain.secrets(f"see {s} there")[1]
        want = [x for x in (plain_span(s) if wanted else []) if not any(a < x[1] and x[0] < b for a, _, b, _ in named)]
        assert [(x.start, x.end) for x in spans[i]] == want
    assert sum(map(bool, spans.values())) > 10


def test_warc(spark, tmp_path):
    from turnframe.llm.warc import op6_warc, read_archives, write_archives

    random.seed(8)
    bodies = [None, "", "a", "<p>é\r\n\r\nWARC/1.1\r\n</p>", "x" * 300_000, "\r\n\r\n", "\n"]
    pages = [(i, random.choice(bodies) if i % 2 else f"<html>{i}</html>\r\n") for i in range(60)]
    df = spark.createDataFrame([(i, f"http://a/{i}\nb" if i % 5 else None, t, 1) for i, t in pages], "page_id long, url string, html string, digest int")
    assert values(op6_warc(df).collect(), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(plain.warc(pages), key=repr)
    assert op6_warc(df.limit(0)).collect() == []
    write_archives(df, str(tmp_path / "w"), file_bytes=100_000)
    assert {r.page_id: r.html for r in read_archives(spark, str(tmp_path / "w"), with_html=True).collect()} == {i: t or "" for i, t in pages}
    again = op6_warc(df.union(df)).collect()
    assert len(again) == 120 and sum(r.record_type == "response" for r in again) == len({x[2] for x in plain.warc(pages)})


def test_pages_without_id_revisit_like_others(spark):
    from turnframe.llm.warc import op6_warc

    df = spark.createDataFrame([(None, "u", "one"), (None, "v", "one"), (None, "u", "two"), (4, "u", "two"), (None, "w", "three")], "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in op6_warc(df).collect())
    assert got == [("4", 3, "response", "None"), ("None", 3, "response", "None"), ("None", 3, "revisit", "4"), ("None", 3, "revisit", "None"), ("None", 5, "response", "None")]


def test_archives_are_warc_files(spark, tmp_path):
    import glob
    import gzip

    from turnframe.llm.warc import parse, write_archives

    df = spark.createDataFrame([(1, "u", "one"), (2, "u", "one")], "page_id long, url string, html string")
    write_archives(df, str(tmp_path / "w"), date="2024-05-05T00:00:00Z")
    found = [r for f in glob.glob(str(tmp_path / "w" / "*.gz")) for r in parse(gzip.open(f).read())]
    assert sorted((f["WARC-Type"], f["WARC-Record-ID"], b) for f, b in found) == [("response", "<urn:page:2>", b"one"), ("revisit", "<urn:page:1>", b"")]
    with pytest.raises(ValueError):
        list(parse(b"WARC/1.1\r\nContent-Length: 1\r\n\r\nabc"))


def test_language(spark):
    from turnframe.llm.langid import LETTERS, Forward, accepted, identified, op7_langid

    random.seed(9)
    stems = {"aa": ["bla", "kor", "tin", "mel"], "bb": ["sch", "ung", "eit", "ver"], "cc": ["eaux", "oire", "tion", "que"]}
    rows = []
    for i in range(240):
        lang = random.choice(list(stems))
        rows.append((i, " ".join("".join(random.choices(stems[lang], k=random.randrange(1, 4))) for _ in range(60)), lang, 0.5))
    rows += [(1000, None, "aa", 0.0), (1001, "123 !!", "aa", 0.0), (1002, "", None, 0.0), (1003, "blakor " * 20_000, None, 0.0), (1004, "blakor" * 2000, None, 0.0), (1005, "日本", None, 0.0), (1006, "²", None, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in op7_langid(df).collect()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    right = [got[i].lang_pred == lang for i, _, lang, _ in rows[:240] if got[i].held_out]
    assert len(right) > 30 and sum(right) / len(right) > 0.98
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1006)] == ["und"] * 4
    assert got[1003].lang_pred == got[1004].lang_pred == "aa" and got[1005].lang_pred != "und"
    kept = accepted(df)
    assert kept.columns == df.columns and {1000, 1001, 1002, 1006}.isdisjoint(r.doc_id for r in kept.collect())
    assert op7_langid(df.limit(0)).collect() == []
    assert {r.lang_pred for r in identified(df.where("lang is null")).collect()} == {"und"}
    assert LETTERS.findall("aé_1b") == ["aé", "b"]

    # all segmentations, by hand
    pieces, probs = ["▁", "a", "b", "▁a", "ab", "▁ab"], np.array([[0.2], [0.1], [0.3], [0.15], [0.05], [0.2]])
    want = 0.2 + 0.15 * 0.3 + 0.2 * 0.05 + 0.2 * 0.1 * 0.3
    f = Forward(pieces, probs)
    f.scores = np.zeros((0, 1))
    assert np.allclose(f.of([["ab"]]), np.log(want))


def test_tokens(spark):
    from tokenizers import Tokenizer

    from turnframe.llm.tokenfile import op8_tokens, read_tokens, vocabulary_path, write_tokens
    from turnframe.llm.common import shared_folder

    random.seed(10)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", " x", "1", "!", "<|endoftext|>", "▁", "\x00", " the", "ing", "'s", "日", "　"]
    texts = [*EMPTY] + ["".join(random.choices(parts, k=random.randrange(60))) for _ in range(150)] + ["word " * 30_000]
    ids = [i * 3 % 158 - 50 for i in range(len(texts))]
    tok = Tokenizer.from_file(vocabulary_path())
    df = docs(spark, texts, ids)
    rows = sorted(zip(ids, texts), key=lambda r: (r[0], r[1] or ""))
    assert values(op8_tokens(df).collect(), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(plain.tokens(rows, tok), key=repr)
    assert op8_tokens(df.limit(0)).collect() == []
    folder = f"{shared_folder(spark)}/t"
    write_tokens(docs(spark, ["a b", "a b", None], [1, 1, None]), folder)
    got = sorted((r.start, r.ids) for r in read_tokens(spark, folder, with_ids=True).collect())
    ab = tok.encode("a b", add_special_tokens=False).ids
    assert got == [(0, [0]), (1, [*ab, 0]), (1 + len(ab) + 1, [*ab, 0])]


def test_coder_round_trips_and_checks():
    from turnframe.llm import mixcoder

    rng = np.random.default_rng(1)
    for n_ids, ids in [(65536, rng.integers(0, 65536, 9000)), (50257, np.zeros(5000, int)), (300, rng.zipf(1.5, 30_000) % 300), (7, np.array([6])), (10, np.array([], int)), (50257, np.tile([5, 50256, 0, 7], 3000))]:
        ids = ids.astype(np.uint32)
        data = mixcoder.encode(ids, n_ids)
        assert (mixcoder.decode(data, n_ids) == ids).all()
    ids = (rng.zipf(1.3, 20_000) % 5000).astype(np.uint32)
    data = bytearray(mixcoder.encode(ids, 5000))
    assert len(data) < 2 * len(ids) * 0.95
    data[len(data) // 2] ^= 1
    with pytest.raises(ValueError):
        mixcoder.decode(bytes(data), 5000)
    with pytest.raises(ValueError):
        mixcoder.encode(np.array([5000], np.uint32), 5000)


def test_coder_beats_order_0_and_zlib():
    """Fewer bits an id than adaptive order-0 counts with the same resets, and than zlib without any."""
    import zlib

    import pyarrow.parquet as pq

    from turnframe.llm import mixcoder
    from turnframe.llm.chunks import encode_byte_level
    from turnframe.llm.tokenfile import vocabulary_path

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").combine_chunks()
    ids = encode_byte_level(texts, vocabulary_path())[0]
    ids = ids[: len(ids) // mixcoder.BLOCK * mixcoder.BLOCK]
    bits, plain_bits = 8 * len(mixcoder.encode(ids, 50257)) / len(ids), 0.0
    for block in ids.reshape(-1, mixcoder.BLOCK):
        counts, new = {}, 0
        for t, x in enumerate(block.tolist()):
            n = counts.get(x, 0)  # an escape for each id that was new, then one of all ids
            plain_bits -= np.log2(n / (t + new + 1)) if n else np.log2((new + 1) / (t + new + 1) / 50257)
            counts[x], new = n + 1, new + (not n)
    assert bits < 0.97 * plain_bits / len(ids) and bits < 8 * len(zlib.compress(ids.astype("<u2").tobytes(), 9)) / len(ids)


def test_token_counts(spark):
    import public_tokenizers
    import sentencepiece

    from turnframe.llm.tokencounts import op10_token_counts

    random.seed(11)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", " x", "1", "!", "<s>", "▁", "\x00", " the", "ing", "日", "　", "①", " hello"]
    texts = [*EMPTY, "  ", "a ", " a", "a  ", "▁"] + ["".join(random.choices(parts, k=random.randrange(40))) for _ in range(300)] + ["word " * 30_000]
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in enumerate(texts)]
    df = docs(spark, texts)
    assert values(op10_token_counts(df).collect(), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert op10_token_counts(df.limit(0)).collect() == []


def test_mixing(spark):
    from turnframe.llm.mixing import DOMAINS, drawn, fitted_rates, mixed, op9_mixing

    random.seed(12)
    common = [f"w{i}" for i in range(80)]
    rows, labels = [(5000, None, "x"), (5001, "", "x"), (None, "w1 w2", "x")], [(5000, None, 0), (77777, 1, 0)]
    truth = {}
    for i in range(400):
        kind = random.choices([0, 1, 2], [6, 2, 1])[0]
        words = random.choices(common, k=40)
        if kind == 1:
            words = [w.upper() + "!!" for w in words]
        if kind == 2:
            words[5:8] = random.choices(["scum", "moron", "trash"], k=3)
        rows.append((i, " ".join(words), "x"))
        truth[i] = kind
        if i % 2:
            labels.append((i, int(kind != 1), int(kind == 2)))
    df = spark.createDataFrame(rows, "doc_id long, text string, p string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = mixed(df, lab).collect()
    assert len(found) == len(rows)
    held = [r for r in found if r.doc_id in truth and r.doc_id % 2 == 0]
    assert sum(max(range(3), key=lambda k: r.p[k]) == truth[r.doc_id] for r in held) / len(held) > 0.95
    sums = [sum(r.rate * r.n_tokens * r.p[k] for r in found) for k in range(3)]
    total = sum(sums)
    assert all(r.rate >= 0 for r in found)
    for k, share in enumerate((0.9, 0.1, 0.0)):
        assert abs(sums[k] / total - share) < 0.03
    out = drawn(df, lab)
    assert out.columns == df.columns
    got = out.collect()
    from collections import Counter

    n = Counter(r.doc_id for r in got)
    assert sum(n[i] for i, k in truth.items() if k == 2) <= 3 and all(n[i] >= 1 for i, k in truth.items() if k == 0)
    assert op9_mixing(df.limit(0), lab).collect() == []
    assert {round(r.p_high, 3) for r in op9_mixing(df, lab.limit(0)).collect()} == {round(1 / len(DOMAINS), 3)}
    members = spark.createDataFrame([(1, 10, [1.0, 0.0, 0.0]), (2, 30, [0.0, 1.0, 0.0]), (3, 20, [0.5, 0.5, 0.0])], "doc_id long, n_tokens long, p array<double>")
    rates = {r.doc_id: r.rate for r in fitted_rates(members, {"high": 0.5, "low": 0.5}, total=80).collect()}
    assert abs(10 * rates[1] + 10 * rates[3] - 40) < 0.1 and abs(30 * rates[2] + 10 * rates[3] - 40) < 0.1


def test_language_against_plain_forward_sums(spark):
    import math
    import zlib
    from collections import Counter

    from turnframe.llm.langid import LETTERS, LONGEST, SMOOTH, UNKNOWN, _pieces, op7_langid, vocabulary_path

    random.seed(21)
    stems = {"en": ["the", "with", "house", "running"], "fr": ["maison", "être", "avec", "été"], "ja": ["日本語", "の", "文章です", "言語"]}
    rows = [(i, " ".join(random.choices(stems[lang], k=random.randrange(1, 9))), lang) for i in range(120) for lang in [random.choice(list(stems))]]
    rows += [(200, "日本語の文章です" * 20, "ja"), (201, "maison" * 30, None), (202, None, "en"), (203, "12 — !", "fr"), (204, "é́tat कि", "fr"), (5, rows[5][1], rows[5][2]), (None, "the house", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, pieces = _pieces(vocabulary_path())
    known = {p: i for i, p in enumerate(pieces) if 0 < len(p) <= LONGEST and not (len(p) > 2 and p[0] == "<" and p[-1] == ">")}
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    counts = {}
    for i, text, lang in rows:
        if text is not None and lang is not None and not out(i):
            counts.setdefault(lang, Counter()).update(model.encode(" ".join(LETTERS.findall(text.lower()))))
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) + SMOOTH * len(pieces) for x in langs}

    def log_sum(word, lang):
        a = [0.0]
        for end in range(1, len(word) + 1):
            ways = []
            for k in range(1, min(LONGEST, end) + 1):
                piece = word[end - k : end]
                if piece in known:
                    ways.append(a[end - k] + math.log((counts[lang][known[piece]] + SMOOTH) / total[lang]))
                elif k == 1:
                    ways.append(a[end - 1] + math.log(UNKNOWN))
            top = max(ways)
            a.append(top + math.log(sum(math.exp(w - top) for w in ways)))
        return a[-1]

    want = []
    for i, text, _ in rows:
        words = LETTERS.findall((text or "").lower())
        sums = [sum(log_sum("▁" + w, x) for w in words) for x in langs]
        best = max(range(len(langs)), key=lambda k: sums[k])
        want.append((i, out(i), langs[best] if words else "und", 1 / sum(math.exp(s - sums[best]) for s in sums) if words else 0.0))
    got = [(r.doc_id, r.held_out, r.lang_pred, r.score) for r in op7_langid(df).collect()]
    order = lambda r: (str(r[0]), r[2], r[3])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=order), sorted(want, key=order)):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6


def test_language_of_documents_held_out(spark):
    from turnframe.llm.langid import op7_langid

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.where("lang is not null").select("doc_id", "lang").collect()}
    said = [r.lang_pred == truth[r.doc_id] for r in op7_langid(docs).where("held_out").collect() if r.doc_id in truth]
    assert len(said) > 200 and sum(said) / len(said) > 0.98


@pytest.mark.filterwarnings("ignore:the targets")
def test_rates_are_those_of_a_plain_projected_gradient(spark):
    """Document by document, off the grid, and run until nothing moves."""
    from turnframe.llm.mixing import FIRM, RIDGE, fitted_rates

    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.6, 0.4, 0.3], 200)
    p[:60] = [1.0, 0.0, 0.0]  # a third of the rows in one cell
    n = rng.integers(0, 500, 200)
    members = spark.createDataFrame([(i, int(k), row.tolist()) for i, (k, row) in enumerate(zip(n, p))], "doc_id long, n_tokens long, p array<double>")
    have = n @ p
    for targets, total in (({"high": 0.7, "low": 0.3, "toxic": 0.0}, 20_000.0), ({"high": 0.2, "low": 0.5, "toxic": 0.3}, 30_000.0), ({"high": 1.0}, 90_000.0)):
        got = np.array([r.rate for r in fitted_rates(members, targets, total).orderBy("doc_id").collect()])
        want, rate = total * np.array([targets.get(d, 0.0) for d in ("high", "low", "toxic")]), np.ones(200)
        heavy = np.where(want > 0, FIRM, 1.0)
        for _ in range(60_000):
            rate = np.maximum(rate - (p @ (heavy * ((rate * n) @ p - want) / have) + RIDGE * (rate - 1)) / (FIRM + RIDGE), 0)
        assert np.abs(got - rate).max() < 1e-3
        # and that is an optimum: no rate's pull is left, but for those held at zero
        pull = p @ (heavy * ((rate * n) @ p - want) / have) + RIDGE * (rate - 1)
        assert np.abs(pull[rate > 1e-9]).max() < 1e-6 and (pull[rate == 0] > -1e-9).all()


def test_targets_out_of_reach_are_told(spark):
    from turnframe.llm.mixing import fitted_rates

    members = spark.createDataFrame([(1, 10, [0.5, 0.5, 0.0])], "doc_id long, n_tokens long, p array<double>")
    with pytest.warns(UserWarning, match="not met"):
        assert fitted_rates(members, {"high": 1.0}, total=10).first().rate > 0


def test_classifier_chooses_at_the_optimum_of_all_terms(monkeypatch):
    from turnframe.llm import mixing
    from turnframe.llm.mixing import PENALTY, learn, softmax

    monkeypatch.setattr(mixing, "RELAXED", 1.0)
    rng = np.random.default_rng(4)
    x = rng.random((300, 40)) < rng.random(40)
    y = np.where(x[:, 0], 2, np.where(x[:, 1] & x[:, 2], 1, 0))
    doc, term = np.nonzero(x)
    w, b = learn(y, doc, term, 40, 3)
    g, penalty = x.T @ (softmax(x @ w + b) - np.eye(3)[y]) / np.sqrt(x.mean(0) * (1 - x.mean(0)))[:, None], PENALTY * 300**0.5
    assert np.abs(g[w == 0]).max() <= 1.2 * penalty + 1e-3 and np.abs(g + penalty * np.sign(w))[w != 0].max() <= 0.25 * penalty


def test_components(spark):
    from turnframe.llm.components import components

    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 7), (9, 9), (200, 150), (None, 4)] + [(1000, 2000 + i) for i in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 200: 100, 3: 3, 7: 3, 1000: 1000, **{2000 + i: 1000 for i in range(50)}}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
