import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    return a, b, of


def plain(rows, libraries):
    """The contract word by word, over spans of bytes."""
    a, b, of = libraries
    out, linked = [], []
    for _, text in rows:
        want = (" " + (text or "")).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(of[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            out.append(None)
            linked.append([])
            continue
        span = lambda parts: [(e - len(p), e) for p, e in zip(parts, [sum(map(len, parts[: k + 1])) for k in range(len(parts))])]
        at_a, at_b = span(bytes_a), span(bytes_b)
        cuts = sorted({e for _, e in at_a} & {e for _, e in at_b})
        groups, low = [], 0
        for cut in cuts:
            groups.append(",".join(str(i) for i, (_, e) in zip(ids_a, at_a) if low < e <= cut) + "|" + ",".join(str(i) for i, (_, e) in zip(ids_b, at_b) if low < e <= cut))
            low = cut
        linked.append([(i, j) for i, (s, e) in zip(ids_a, at_a) for j, (t, f) in zip(ids_b, at_b) if s < f and t < e])
        out.append((len(ids_a), len(ids_b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    n = Counter(p for own in linked for p in set(own))
    most = {}
    for (i, _), c in n.items():
        most[i] = max(most.get(i, 0), c)
    return sorted(((d, 0, 0, 0, 0, 0, 0, "") if x is None else (d, *x[:3], len(own), sum(n[p] == most[p[0]] for p in own), sum(n[p] for p in own), x[3]) for (d, _), x, own in zip(rows, out, linked)), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2, True) for d, t in rows], "doc_id long, text string, pair int, _row int, valid boolean")


def of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


ODD = [None, "", " ", "  ", "a ", " a", "a  b", "   a\n\n  b   ", "\n", "\t", "▁", "x▁y", "<|endoftext|>", "a <|endoftext|> b", "<s>", "</s> <unk>", "<0x41>", "é", "straße ", "日本語 テキスト", "😀😀 x", "\x00", "a\x1fb", "é", " x", "don't won't", "1234567 89", "a" * 300, "ab " * 200, "\r\n x", "​", "http://a.b/c?d=e&f=g", "a" + " " * 3000 + "b", "\n " * 1000]


@pytest.mark.parametrize("most", [1 << 21, 3])
def test_odd_texts(spark, libraries, most):
    from turnframe.llm.tokenalign import aligned

    rows = list(enumerate(ODD)) + [(3, "ab cd"), (3, "ab cd"), (None, "the of and"), (None, None)]
    assert of(aligned(frame(spark, rows).repartition(3), most=most)) == plain(rows, libraries)
    assert of(aligned(frame(spark, []), most=most)) == []
    assert of(aligned(frame(spark, [(1, None), (2, "▁")]), most=most)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_documents(spark, libraries):
    from turnframe.llm.tokenalign import op11_token_align

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pairs = [(r.doc_id, r.text) for r in rows.collect()]
    short = [(d, t) for d, t in pairs if len(t or "") < 2500]
    got = of(op11_token_align(frame(spark, short)))
    assert got == plain(short, libraries)
    assert len(of(op11_token_align(rows))) == len(pairs)


def test_small_batches_and_rare_pairs(spark, libraries, monkeypatch):
    from turnframe.llm import tokenalign

    rows = [(k, f"{t or ''} word{k} {t}") for k, t in enumerate(ODD)] * 2
    whole = of(tokenalign.aligned(frame(spark, rows)))
    assert of(tokenalign.aligned(frame(spark, rows).repartition(5), most=1)) == whole == plain(rows, libraries)
    assert [*tokenalign.parts(__import__("numpy").array([5, 5, 50, 1, 1]), 10)] == [(0, 2), (2, 3), (3, 5)]
