"""Cutting texts into chunks that a tokenizer treats independently, so that each distinct chunk is encoded once.

A cache of encoded chunks lives in each Python worker and is emptied when it holds CACHE entries.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE, TABLE = 500_000, 200_000


class Memo(dict):
    """chunk: what `encode` makes of it, for lists of new chunks at a time."""

    def __init__(self, encode: Callable[[list[str]], Iterable], fixed: dict | None = None):
        super().__init__(fixed or {})
        self.encode, self.fixed = encode, fixed or {}

    def learn(self, chunks: set[str]) -> None:
        """Afterwards every one of chunks is here."""
        if len(self) > CACHE + len(self.fixed):
            self.clear()
            self.update(self.fixed)
        self.add(chunks.difference(self))

    def add(self, new: set[str]) -> None:
        if new:
            new = sorted(new)
            self.update(zip(new, self.encode(new)))


# --- byte-level BPE -------------------------------------------------------------------------------------------------
# The pre-tokenizer takes a space into the word after it, and nothing else crosses from one non-space character over a
# single space to the next; so a text may be cut before each such space. A run of several white-space characters is left whole.

SINGLE = re.compile(r"(?<=\S)(?= \S)")
#: In arrow's syntax: a space at an end of the text or beside other white space (or a control character), where a text can't be cut at every space.
UNEVEN = r"(?:^|[\s\p{Z}\p{C}]) | (?:$|[\s\p{Z}\p{C}])"
#: Between a letter and ASCII that is none, white space apart, the pre-tokenizer always cuts, but for a letter after an
#: apostrophe; and around a line end that stands between two other characters. (Patterns of arrow.)
CUTS = (r"(\p{L})([!-@\[-`{-~])", r"([!-&(-@\[-`{-~])(\p{L})", r"([!-~\p{L}])(\n)([!-~\p{L}])")
CUT = "\x1f"


def byte_chunks(text: str) -> list[str]:
    """The pieces of text between single spaces that stand between two other characters; the space belongs to the piece after it."""
    return SINGLE.split(text)


def byte_encoder(path: str) -> Callable[[list[str]], Iterable]:
    """A function of a list of chunks, giving the ids of each, packed."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    vocab = tok.get_vocab()
    opens = np.zeros(max(vocab.values()) + 1, bool)  # ids whose bytes begin with a space
    for piece, i in vocab.items():
        opens[i] = piece.startswith("Ġ")

    line_end = vocab["Ċ"]

    def joined(part: list[str], glue: str) -> list[bytes] | None:
        """The ids of part, joined by glue, of which each piece but the first must begin a new run of ids."""
        ids = np.array(tok.encode_batch_fast([glue.join(part)], add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(ids == line_end if glue else opens[ids])
        if len(at) != len(part) - bool(glue):
            return None
        data, skip = ids.tobytes(), 4 * len(glue)
        cuts = [-skip, *(at * 4).tolist(), 4 * len(ids)] if glue else [*(at * 4).tolist(), 4 * len(ids)]
        return [data[a + skip : b] for a, b in zip(cuts, cuts[1:])]

    def chunks(new: list[str], most: int = 2000) -> Iterable:
        """Chunks whose only space is their first character come apart again, once joined, at the ids that begin with a space; those without white space, at line ends between them."""
        found = {}
        spaced = [c for c in new if c[:1] == " " and c[1:].isprintable() and c.count(" ") == 1]
        solid = [c for c in new if c and c.isprintable() and " " not in c]
        for group, glue in ((spaced, ""), (solid, "\n")):
            for i in range(0, len(group), most):
                part = group[i : i + most]
                found.update(zip(part, joined(part, glue) or ()))
        rest = [c for c in new if c not in found]
        for i in range(0, len(rest), most):
            part = rest[i : i + most]
            found.update(zip(part, (np.array(e.ids, np.uint32).tobytes() for e in tok.encode_batch_fast(part, add_special_tokens=False))))
        return map(found.__getitem__, new)

    return chunks


class TokenTable:
    """The ids of chunks met so far, one after another, and where each chunk's begin; `uses` counts the calls that asked for a chunk."""

    def __init__(self, encode: Callable[[list[str]], Iterable]):
        self.encode = encode
        self._empty()

    def _empty(self) -> None:
        self.rows: dict[str, int] = {}
        self.starts, self.sizes = np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.ids, self.uses = np.zeros(0, np.uint32), np.zeros(0, np.int32)

    def trim(self) -> None:
        """A full table keeps the chunks that were asked for again since it was full last, if they take half of it at most."""
        if len(self.rows) <= TABLE:
            return
        kept = np.flatnonzero(self.uses > 1)
        if 2 * len(kept) > TABLE:
            return self._empty()
        names = list(self.rows)
        sizes = self.sizes[kept]
        self.ids = self.ids[ranges(self.starts[kept], sizes)]
        self.starts, self.sizes, self.uses = np.concatenate([[0], np.cumsum(sizes)]), sizes, np.ones(len(kept), np.int32)
        self.rows = {names[k]: i for i, k in enumerate(kept.tolist())}

    def rows_of(self, chunks: list[str]) -> np.ndarray:
        """The number of each chunk in starts and sizes."""
        new = [c for c in dict.fromkeys(chunks) if c not in self.rows]
        if new:
            packed = list(self.encode(new))
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            sizes = np.array([len(p) // 4 for p in packed], np.int64)
            self.sizes = np.concatenate([self.sizes, sizes])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(packed), np.uint32)])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int32)])
        rows = np.fromiter(map(self.rows.__getitem__, chunks), np.int64, len(chunks))
        self.uses[rows] += 1
        return rows


@cache
def token_table(path: str) -> TokenTable:
    return TokenTable(byte_encoder(path))


@cache
def uncuttable(path: str) -> str:
    """A pattern of texts that may not be cut everywhere: with uneven spaces, special tokens or the mark of cuts."""
    import json
    import re as plain

    with open(path, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f).get("added_tokens") or []]
    return "|".join([UNEVEN, CUT, *map(plain.escape, special)])


def _encoded(chunks: pa.Array, table: TokenTable) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many each chunk has) of chunks of cuttable texts: cut further, each distinct piece looked up once."""
    for pattern in CUTS:
        chunks = pc.replace_substring_regex(chunks, pattern, CUT.join(rf"\{k + 1}" for k in range(pattern.count(")"))))
    cut = pc.split_pattern(chunks, CUT)
    pieces = cut.values.dictionary_encode()
    rows = table.rows_of(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()]
    sizes = table.sizes[rows]
    upto = np.concatenate([[0], np.cumsum(sizes)])
    return table.ids[ranges(table.starts[rows], sizes)], np.diff(upto[cut.offsets.to_numpy()])


def encode_byte_level(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, one after another; how many each text has) as the tokenizers library gives them. A null text has none.

    Arrow cuts the texts at single spaces and finds the distinct words, and cuts those further, so that Python handles
    each distinct piece once.
    """
    table = token_table(path)
    table.trim()
    texts = pc.fill_null(texts, "")
    plain = pc.invert(pc.match_substring_regex(texts, uncuttable(path))).to_numpy(zero_copy_only=False)
    even = texts.filter(pa.array(plain))
    cut = pc.split_pattern(even, " ")
    words, ends = cut.values.dictionary_encode(), cut.offsets.to_numpy().astype(np.int64)
    spaced = pc.binary_join_element_wise("", words.dictionary, " ")
    # the first word of a text has no space before it
    ids, sizes = _encoded(pa.concat_arrays([spaced, cut.values.take(pa.array(ends[:-1]))]), table)
    rows = words.indices.to_numpy().astype(np.int64)
    rows[ends[:-1]] = len(spaced) + np.arange(len(even))
    each = np.diff(ends)
    if not plain.all():
        parts = list(map(byte_chunks, texts.filter(pa.array(~plain)).to_pylist()))
        more = table.rows_of([c for p in parts for c in p])
        own, n = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        n[plain], n[~plain] = each, list(map(len, parts))
        own[plain], own[~plain] = ends[:-1], len(rows) + np.cumsum(n[~plain]) - n[~plain]
        rows, each = np.concatenate([rows, len(sizes) + np.arange(len(more))])[ranges(own, n)], n
        ids = np.concatenate([ids, table.ids[ranges(table.starts[more], table.sizes[more])]])
        sizes = np.concatenate([sizes, table.sizes[more]])
    starts, sizes = (np.cumsum(sizes) - sizes)[rows], sizes[rows]
    upto = np.concatenate([[0], np.cumsum(sizes)])
    return ids[ranges(starts, sizes)], np.diff(upto[np.concatenate([[0], np.cumsum(each)])])


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0] to starts[0] + sizes[0] - 1, then those of the next."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


# --- pieces with a mark for each space ------------------------------------------------------------------------------
# No piece of the vocabulary holds the mark after another character (checked when the model is loaded), so no merge crosses
# from a character to a following space: a text may be cut before every run of spaces.

MARK = "▁"
RUNS = re.compile(r" *[^ ]+| +$")


@cache
def piece_memo(path: str) -> Memo:
    """chunk (without its first space): number of tokens. The fixed entries are the whole-token shortcut: the strings of the vocabulary that encode alone as one token."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece of this vocabulary spans a space: its texts can't be cut at spaces")
    words = [p[1:] for p in pieces if p.startswith(MARK) and MARK not in p[1:] and p[1:]]
    proven = {w: 1 for w, ids in zip(words, model.encode(words, num_threads=1)) if len(ids) == 1}
    proven[""] = 1  # a last space alone

    def count(new: list[str]) -> list[int]:
        out = []
        for i in range(0, len(new), 5000):
            out += [len(x) for x in model.encode(new[i : i + 5000], num_threads=1)]
        return out

    memo = Memo(count, proven)
    memo.whole = lambda text: len(model.encode(text))
    return memo


def piece_counts(texts: list[str], path: str) -> list[int]:
    """Number of tokens of each text as the sentencepiece library gives them."""
    memo, parts = piece_memo(path), []
    for t in texts:
        if MARK in t:
            parts.append(None)  # the mark itself is a space to the model
        elif "  " in t or t[:1] == " " or t[-1:] == " ":
            parts.append([c[1:] for c in RUNS.findall(" " + t)])
        else:
            parts.append(t.split(" "))
    memo.learn({c for p in parts if p for c in p} - {""})
    get = memo.__getitem__
    return [memo.whole(t) if p is None else 0 if not t else sum(map(get, p)) for t, p in zip(texts, parts)]
