"""Alignment of two tokenizers over the same bytes.

A batch of documents is one run of bytes, in which each document begins at the offset where the one before ends. The ends of
all A tokens and all B tokens are counted over that run once (bincount); where both end, the texts are cut into groups; and
between two neighbouring ends of either kind lies exactly one linked pair of occurrences, the A and the B token that cover
it. Prefix sums of the marks, read at the documents' offsets, give each document its own figures.

The ids are computed once and kept as a table. The documents that hold each id pair are counted from it, summed over
whole tasks before the shuffle. A document's links are then looked up in the counts: those of the commonest pairs, at most
HEAD of them, are sent to every worker, and rarer pairs (in fewer documents each) go through a join.

Rows: null and empty texts, and texts that either tokenizer can't give back byte by byte (such as those with U+2581), have no
tokens: zeros and an empty digest. Repeated rows each count as a document and each get a row. Extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnframe.llm.chunks import MARK, RUNS, TokenTable, ranges
from turnframe.llm.common import dropped, written
from turnframe.llm.shipping import hand_back

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are aligned at once, unless a single text is longer.
BATCH = 1 << 21
#: Pairs whose counts every worker holds (13 bytes each), and pairs that a task counts before it hands them on.
HEAD, HELD = 1 << 21, 1 << 21
ENCODED = "doc_id {}, valid boolean, a binary, b binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


# --- the two tokenizers ---------------------------------------------------------------------------------------------


class Vocabulary:
    """The bytes of every id, one after another, and the decimal digits of every id as five bytes."""

    def __init__(self, entries: list[bytes]):
        self.sizes = np.array([len(e) for e in entries], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(entries), np.uint8)
        self.digits = np.frombuffer(b"".join(b"%5d" % i for i in range(len(entries))), np.uint8).reshape(-1, 5)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ranges(self.starts[ids], self.sizes[ids])]


@cache
def byte_level(path: str) -> Vocabulary:
    """Of a byte-level vocabulary: printable characters stand for themselves, the other bytes for characters from U+0100 on, in order."""
    from tokenizers import Tokenizer

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    bytes_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    vocab = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
    entries = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        entries[i] = bytes(map(bytes_of.__getitem__, piece)) if all(c in bytes_of for c in piece) else piece.encode()
    return Vocabulary(entries)


@cache
def piece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@cache
def pieces(path: str) -> Vocabulary:
    model = piece_model(path)
    named = [(model.id_to_piece(i), model.is_byte(i)) for i in range(model.get_piece_size())]
    if any(MARK in p.lstrip(MARK) for p, _ in named):
        raise ValueError("a piece of this vocabulary spans a space: its texts can't be cut at spaces")
    return Vocabulary([bytes([int(p[3:5], 16)]) if byte else p.replace(MARK, " ").encode() for p, byte in named])


@cache
def piece_table(path: str) -> TokenTable:
    """chunk (without its first space): its ids; a last space alone is the mark."""
    model = piece_model(path)

    def encode(new: list[str]) -> Iterable:
        for at in range(0, len(new), 5000):
            part = new[at : at + 5000]
            for chunk, ids in zip(part, model.encode(part, num_threads=1)):
                yield np.array(ids if chunk else [model.piece_to_id(MARK)], np.uint32).tobytes()

    return TokenTable(encode)


def encode_pieces(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, how many each has) as sentencepiece gives them, for texts that are not empty and don't hold the mark."""
    table = piece_table(path)
    table.trim()
    uneven = pc.match_substring_regex(texts, "^ | $|  ").to_numpy(zero_copy_only=False)
    cut = pc.split_pattern(texts.filter(pa.array(~uneven)), " ")
    words, ends = cut.values.dictionary_encode(), cut.offsets.to_numpy()
    rows, each = table.rows_of(words.dictionary.to_pylist())[words.indices.to_numpy()], np.diff(ends)
    if uneven.any():
        parts = [[c[1:] for c in RUNS.findall(" " + t)] for t in texts.filter(pa.array(uneven)).to_pylist()]
        more = table.rows_of([c for p in parts for c in p])
        own, n = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        n[~uneven], n[uneven] = each, list(map(len, parts))
        own[~uneven], own[uneven] = ends[:-1], len(rows) + np.cumsum(n[uneven]) - n[uneven]
        rows, each = np.concatenate([rows, more])[ranges(own, n)], n
    sizes = table.sizes[rows]
    upto = np.concatenate([[0], np.cumsum(sizes)])
    return table.ids[ranges(table.starts[rows], sizes)], np.diff(upto[np.concatenate([[0], np.cumsum(each)])])


#: The pre-tokenizer's pattern in byte-level files that name none (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: In arrow's syntax: white space so long that that pattern may run out of stack in tiktoken.
LONG_SPACE = r"[\s\p{Z}\p{C}]{500}"


@cache
def plain_tokenizer(path: str):
    """(the tokenizers library's, which takes special tokens' strings as plain text; tiktoken's over the same vocabulary, if it says the same)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, before = told["model"], told["pre_tokenizer"] or {}
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model.get("merges", [])]
    same = (
        told["normalizer"] is None
        and (before.get("type"), before.get("use_regex", True), before.get("add_prefix_space")) == ("ByteLevel", True, False)
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and merged == list(range(256, 256 + len(merged)))  # ids in the order of the merges, as tiktoken takes them
        and len(model["vocab"]) == 256 + len(merged)
    )
    if not same:
        return tok, None
    of = byte_level(path)
    ranks = {of.data[at : at + n].tobytes(): i for i, (at, n) in enumerate(zip(of.starts, of.sizes)) if i < len(model["vocab"])}
    return tok, tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def encode_plain(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, how many each has) as the tokenizers library gives them, with the strings of special tokens as plain text.

    tiktoken encodes with the same vocabulary in a third of the time; texts with a very long run of white space go through
    the library itself.
    """
    tok, fast = plain_tokenizer(path)
    slow = pc.match_substring_regex(texts, LONG_SPACE).to_pylist() if fast else [True] * len(texts)
    ids = [tok.encode(t, add_special_tokens=False).ids if s else fast.encode_ordinary(t) for t, s in zip(texts.to_pylist(), slow)]
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum())), n


# --- alignment of a batch -------------------------------------------------------------------------------------------


class Aligned:
    """Two token streams over the same bytes. a, b: ids; n_a, n_b: how many each document has; groups and links of all."""

    def __init__(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, of_a: Vocabulary, of_b: Vocabulary):
        self.a, self.b, self.n_a, self.n_b = a, b, n_a, n_b
        self.end_a, self.end_b = np.cumsum(of_a.sizes[a]), np.cumsum(of_b.sizes[b])
        total = int(self.end_a[-1]) if len(a) else 0
        marks_a, marks_b = np.bincount(self.end_a, minlength=total + 1), np.bincount(self.end_b, minlength=total + 1)
        self.ends = np.concatenate([[0], self.end_a[np.cumsum(n_a) - 1]]) if len(n_a) else np.zeros(1, np.int64)  # documents' offsets
        self.cuts = (marks_a > 0) & (marks_b > 0)
        self.cuts_upto = np.cumsum(self.cuts)
        self.links = np.flatnonzero(marks_a + marks_b)  # each end closes one link
        self.link_a, self.link_b = a[np.cumsum(marks_a)[self.links] - marks_a[self.links]], b[np.cumsum(marks_b)[self.links] - marks_b[self.links]]
        self.of_doc = np.searchsorted(self.links, self.ends, side="right")  # links up to each document's end

    @property
    def n_groups(self) -> np.ndarray:
        return np.diff(self.cuts_upto[self.ends])

    @property
    def n_links(self) -> np.ndarray:
        return np.diff(self.of_doc)

    def pairs(self) -> np.ndarray:
        return self.link_a.astype(np.uint64) << np.uint64(16) | self.link_b.astype(np.uint64)

    def digests(self, of_a: Vocabulary, of_b: Vocabulary) -> list[str]:
        """sha256 of each document's groups, `a1,a2|b1;a3|b2,b3`."""
        group_a, group_b = self.cuts_upto[self.end_a - 1], self.cuts_upto[self.end_b - 1]  # each token's group: the cuts before its end
        groups = int(self.cuts_upto[-1]) if len(self.cuts_upto) else 0
        before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=groups))])
        before_a = np.concatenate([[0], np.cumsum(np.bincount(group_a, minlength=groups))])
        text = np.zeros((len(self.a) + len(self.b), 6), np.uint8)
        for own, group, before, ids, vocabulary, last in ((np.arange(len(self.a)), group_a, before_b[group_a], self.a, of_a, b"|"), (np.arange(len(self.b)), group_b, before_a[group_b + 1], self.b, of_b, b";")):
            mark = np.where(np.diff(group, append=-1) != 0, last[0], b","[0])
            text[own + before, :5], text[own + before, 5] = vocabulary.digits[ids], mark
        used = text != 32
        data = text[used].tobytes()
        upto = np.concatenate([[0], np.cumsum(used.sum(axis=1))])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        return [hashlib.sha256(data[x : y - 1]).hexdigest() for x, y in zip(upto, upto[1:])]


def parts(sizes: np.ndarray, most: int = BATCH) -> Iterator[tuple[int, int]]:
    """Runs of rows with about so many bytes, each of one row at least."""
    at, upto = 0, np.cumsum(sizes)
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
        yield at, end
        at = end


def _same_bytes(a, n_a, b, n_b, texts: pa.Array, of_a: Vocabulary, of_b: Vocabulary) -> np.ndarray:
    """Which texts both streams give back byte by byte."""
    want = np.frombuffer(texts.buffers()[2], np.uint8)
    starts = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    length, ok = np.diff(starts), np.ones(len(texts), bool)
    for ids, n, of in ((a, n_a, of_a), (b, n_b, of_b)):
        total = np.concatenate([[0], np.cumsum(of.sizes[ids])])[np.concatenate([[0], np.cumsum(n)])]
        fits = np.diff(total) == length
        ok &= fits
        if fits.all():
            wrong = np.flatnonzero(of.joined(ids) != want[starts[0] : starts[-1]])
            ok[np.searchsorted(total[1:], wrong, side="right")] = False
            continue
        joined = of.joined(ids)
        for k in np.flatnonzero(fits):
            ok[k] &= bool((joined[total[k] : total[k + 1]] == want[starts[k] : starts[k + 1]]).all())
    return ok


def _of(ids: np.ndarray, n: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return ids[np.repeat(rows, n)]


def encoded(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each document: its ids in both vocabularies (packed, 16 bits each), its counts and the digest of its groups."""
    kind = ENCODED.format(documents.schema["doc_id"].dataType.simpleString())
    names = [c.split()[0] for c in kind.split(", ")]

    def some(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        spaced = pc.binary_join_element_wise(" ", pc.fill_null(texts, ""), "")
        usable = pc.and_(pc.greater(pc.binary_length(spaced), 1), pc.invert(pc.match_substring(spaced, MARK))).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(usable)
        put = {c: np.zeros(len(texts), np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
        valid, digest = np.zeros(len(texts), bool), np.full(len(texts), "", object)
        a = b = np.zeros(0, np.uint32)
        if len(rows):
            a, b = fill(rows, texts, spaced, put, valid, digest)
        packed = []
        for stream, n in ((a, put["n_a"]), (b, put["n_b"])):
            at = np.concatenate([[0], np.cumsum(2 * n)]).astype(np.int32)
            packed.append(pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(stream.astype("<u2").tobytes())]))
        return pa.RecordBatch.from_arrays([ids, pa.array(valid), *packed, *map(pa.array, put.values()), pa.array(digest, pa.string())], names)

    def fill(rows, texts, spaced, put, valid, digest) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts at rows, whose figures are put in their places."""
        of_a, of_b = byte_level(a_path), pieces(b_path)
        text = pc.fill_null(texts, "").take(pa.array(rows))
        spaced = spaced.take(pa.array(rows))
        (a, n_a), (b, n_b) = encode_plain(spaced, a_path), encode_pieces(text, b_path)
        ok = _same_bytes(a, n_a, b, n_b, spaced, of_a, of_b)
        if not ok.all():
            a, b, n_a, n_b, rows = _of(a, n_a, ok), _of(b, n_b, ok), n_a[ok], n_b[ok], rows[ok]
        found = Aligned(a, n_a, b, n_b, of_a, of_b)
        for c in put:
            put[c][rows] = getattr(found, c)
        valid[rows], digest[rows] = True, found.digests(of_a, of_b)
        return a, b

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if max(len(byte_level(a_path).sizes), len(pieces(b_path).sizes)) > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        for batch in batches:
            texts = batch.column("text")
            for at, end in parts(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False)).astype(np.int64)):
                yield some(batch.column("doc_id").slice(at, end - at), texts.slice(at, end - at))
        hand_back()

    return documents.select("doc_id", "text").mapInArrow(encode, kind)


def _aligned(batch: pa.RecordBatch, a_path: str, b_path: str) -> Iterator[tuple[int, int, Aligned]]:
    """(first row, row after the last, alignment) for parts of a batch of encoded documents."""
    n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
    for at, end in parts(3 * (n_a + n_b)):
        ids = [np.frombuffer(b"".join(batch.column(c).slice(at, end - at).to_pylist()), "<u2") for c in ("a", "b")]
        yield at, end, Aligned(ids[0], n_a[at:end], ids[1], n_b[at:end], byte_level(a_path), pieces(b_path))


def pair_counts(rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(pair, n): in how many encoded documents each id pair is linked. pair is 65,536 times the A id plus the B id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            pairs, n = np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held])
            pairs, at = np.unique(pairs, return_inverse=True)
            return pairs, np.bincount(at, n, len(pairs)).astype(np.int64)

        for batch in batches:
            for _, _, found in _aligned(batch, a_path, b_path):
                doc = np.repeat(np.arange(len(found.n_a), dtype=np.uint64), found.n_links)
                distinct = np.unique(doc << np.uint64(32) | found.pairs()) & np.uint64(0xFFFFFFFF)
                held.append(np.unique(distinct, return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    held = [summed()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0].astype(np.int64)), pa.array(held[0][1])], ["pair", "n"])
                        held, size = [], 0
        if held:
            pairs, n = summed()
            yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n)], ["pair", "n"])
        hand_back()

    return rows.where("valid").select("a", "b", "n_a", "n_b").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def with_best(counts: DataFrame) -> DataFrame:
    """counts (pair, n) and whether n is the highest of the pair's A id; there is one highest count for each id of the vocabulary."""
    of = F.shiftright("pair", 16)
    most = counts.groupBy(of.alias("of")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), of == F.col("of")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def common_from(counts: DataFrame, most: int = HEAD) -> int:
    """The smallest power of two such that at most so many pairs have counts from there on."""
    sums = counts.agg(*[F.sum((F.col("n") >= 1 << k).cast("long")).alias(f"k{k}") for k in range(62)]).first()
    return next(1 << k for k in range(62) if (sums[k] or 0) <= most)


def link_sums(rows: DataFrame, counts: DataFrame, a_path: str, b_path: str, most: int = HEAD) -> DataFrame:
    """(_row, n_best, count_sum) of encoded rows that have a _row, from counts (pair, n, best)."""
    least = common_from(counts, most)
    head = counts.where(F.col("n") >= least).toArrow().sort_by("pair")
    sent = rows.sparkSession.sparkContext.broadcast(tuple(head.column(c).to_numpy() for c in ("pair", "n", "best")))
    kind = "_row long, n_best long, count_sum long, pairs array<long>, times array<long>"

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = sent.value
        pairs, n, best = np.append(pairs, -1), np.append(n, 0), np.append(best, False)  # the last stands for pairs not here
        for batch in batches:
            for at, end, found in _aligned(batch, a_path, b_path):
                links = found.pairs().astype(np.int64)
                here = np.minimum(np.searchsorted(pairs[:-1], links), len(pairs) - 1)
                here[pairs[here] != links] = len(pairs) - 1
                sums = [np.diff(np.concatenate([[0], np.cumsum(x[here])])[found.of_doc]) for x in (best.astype(np.int64), n)]
                rare = np.flatnonzero(here == len(pairs) - 1)
                doc = np.searchsorted(found.of_doc[1:], rare, side="right")
                order = np.lexsort((links[rare], doc))
                doc, own = doc[order], links[rare][order]
                first = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(own) != 0)])) if len(own) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(own)))
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=end - at))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("_row").slice(at, end - at), *map(pa.array, sums), pa.ListArray.from_arrays(ends, pa.array(own[first])), pa.ListArray.from_arrays(ends, pa.array(times))], ["_row", "n_best", "count_sum", "pairs", "times"])
        hand_back()

    seen = rows.where("valid").select("_row", "a", "b", "n_a", "n_b").mapInArrow(look_up, kind)
    if least == 1:
        return seen.drop("pairs", "times")
    seen = written(seen, "links")
    rare = seen.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("_row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rare = rare.join(counts.where(F.col("n") < least), "pair").select("_row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("n") * F.col("times")).alias("count_sum"))
    return seen.select("_row", "n_best", "count_sum").unionByName(rare).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def aligned(documents: DataFrame, a_path: str | None = None, b_path: str | None = None, most: int = HEAD) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row."""
    import public_tokenizers

    a_path, b_path = a_path or public_tokenizers.path(BYTE_LEVEL), b_path or public_tokenizers.path(PIECES)
    rows = written(encoded(documents, a_path, b_path).withColumn("_row", F.monotonically_increasing_id()), "encoded", compression="zstd")
    counts = written(pair_counts(rows, a_path, b_path), "pairs")
    counts, plain = written(with_best(counts), "best"), counts
    dropped(plain)
    sums = link_sums(rows, counts, a_path, b_path, most)
    return rows.join(sums, "_row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0).cast("long")).alias("n_best"), F.coalesce("count_sum", F.lit(0).cast("long")).alias("count_sum"), "groups_sha256")


def op11_token_align(documents: DataFrame) -> DataFrame:
    return aligned(documents)
