"""Language ID by unigram pieces summed over all segmentations.

The pieces are a fixed public vocabulary. For each language, a piece's probability comes from how often the vocabulary's
own segmentation of the training texts uses it. A word's probability is the sum, over all ways to cut it into pieces, of the
product of their probabilities: a forward pass, run in numpy for all new words of a batch together. A text's languages are
compared by the sums of its words' log probabilities.

Training uses at most SAMPLE labelled rows (in expectation; a hash of doc_id chooses, so the choice does not depend on the
partitions). Everything else covers all rows and whole texts.

Rows: a null text, or one without a letter, is `und` with score 0. A null lang never trains. Words are runs of letters with
their combining marks, of any length: the pass keeps the last LONGEST columns only, rescaled as it goes. Repeated rows each get a result; extra columns are ignored; an empty
table gives an empty result, and a table with nothing to learn from is `und` throughout.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnframe.llm.shipping import hand_back, ship, take_over

VOCABULARY = "piece_bpe_32k.model"
SAMPLE = 20_000
LONGEST = 16  # pieces of the vocabulary have no more characters
MARK = "▁"


def _letters() -> re.Pattern:
    """Runs of letters with their combining marks."""
    marks = [c for c in range(0x300, sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "M"]
    starts = [c for k, c in enumerate(marks) if not k or marks[k - 1] != c - 1]
    stops = [c for k, c in enumerate(marks) if k + 1 == len(marks) or marks[k + 1] != c + 1]
    some = "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, stops))
    return re.compile(rf"[^\W\d_]+(?:[{some}]+[^\W\d_]*)*")


LETTERS = _letters()
#: For a character that no piece covers, and added to every count.
UNKNOWN, SMOOTH = 1e-9, 0.5
CACHE, TEXTS, SLOT_BITS = 200_000, 500, 19


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def words_of(text: str) -> list[str]:
    words = LETTERS.findall(text.lower())
    return words if any(c.isalpha() for w in words for c in w) else []  # other numerals count as word characters too


@cache
def _pieces(path: str) -> tuple[object, list[str]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, [model.id_to_piece(i) for i in range(model.get_piece_size())]


def _counts(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, pieces = _pieces(path)
        by_lang: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                total = by_lang.setdefault(lang, np.zeros(len(pieces), np.int64))
                for t in texts:
                    for ids in model.encode([" ".join(words_of(t))], num_threads=1):
                        total += np.bincount(ids, minlength=len(pieces))
        for lang, total in by_lang.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "piece": at, "n": total[at]})

    return run


def train(labelled: DataFrame, path: str | None = None, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, piece probabilities: pieces x languages) from labelled (doc_id, text, lang).

    What comes to the driver is bounded by the vocabulary times the languages.
    """
    path = path or vocabulary_path()
    usable = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    n = usable.select("doc_id").count()
    if n > sample:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    found = usable.mapInPandas(_counts(path), "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.full((len(_pieces(path)[1]), len(langs)), SMOOTH)
    counts[found["piece"].to_numpy(), np.searchsorted(langs, found["lang"]) if langs else []] += found["n"].to_numpy()
    return langs, counts / counts.sum(0)


class Forward:
    """Log probabilities of words under every language, with a memo of the words seen."""

    def __init__(self, pieces: list[str], probs: np.ndarray):
        self.probs = probs
        self.powers = np.cumprod(np.full(LONGEST, self.BASE, np.uint64))
        keys, ids = [], []
        for i, p in enumerate(pieces):
            if 0 < len(p) <= LONGEST and not (p.startswith("<") and p.endswith(">") and len(p) > 2):
                keys.append(self._hash_one(p))
                ids.append(i)
        self.keys, self.ids = np.array(keys, np.uint64), np.array(ids)
        # a key stands in the first free slot from its own on
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)
        for k, at in enumerate(self._slot(self.keys).tolist()):
            while self.slots[at] >= 0:
                at = (at + 1) % len(self.slots)
            self.slots[at] = k
        self.memo: dict[str, int] = {}
        self.scores = np.zeros((0, probs.shape[1]))

    BASE = np.uint64(0x9E3779B97F4A7C15)

    @classmethod
    def _hash_one(cls, s: str) -> int:
        h = 0
        for c in s:
            h = (h * int(cls.BASE) + ord(c) + 1) & (1 << 64) - 1
        return h

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash in keys, or -1."""
        flat = h.reshape(-1)
        at = self._slot(flat)
        found = self.slots[at]
        todo = np.flatnonzero(found >= 0)
        todo = todo[self.keys[found[todo]] != flat[todo]]
        while len(todo):
            at[todo] = (at[todo] + 1) % len(self.slots)
            found[todo] = self.slots[at[todo]]
            todo = todo[found[todo] >= 0]
            todo = todo[self.keys[found[todo]] != flat[todo]]
        return found.reshape(h.shape)

    def _score(self, words: list[str]) -> np.ndarray:
        """words of about equal length, mark included: words x languages."""
        n, width, langs = len(words), max(map(len, words)), self.probs.shape[1]
        sizes = np.array([len(w) for w in words])
        chars = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, width).astype(np.uint64)
        # hashes[:, i] is that of the first i characters; last[:, k] the sum over segmentations of all but k characters
        hashes, last = np.zeros((n, width + 1), np.uint64), np.zeros((n, LONGEST, langs))
        last[:, 0], scale, out = 1.0, np.zeros(n), np.zeros((n, langs))
        with np.errstate(over="ignore", divide="ignore"):
            for end in range(1, width + 1):
                hashes[:, end] = hashes[:, end - 1] * self.BASE + chars[:, end - 1] + np.uint64(1)
                k = min(end, LONGEST)
                h = hashes[:, end, None] - hashes[:, end - k : end][:, ::-1] * self.powers[:k]  # of the last 1, 2, … characters
                at = self._find(h)
                rows, sizes_hit = np.nonzero(at >= 0)
                now = np.zeros((n, langs))
                terms = last[rows, sizes_hit] * self.probs[self.ids[at[rows, sizes_hit]]]
                for lang in range(langs):
                    now[:, lang] = np.bincount(rows, terms[:, lang], n)
                alone = np.flatnonzero(at[:, 0] < 0)
                now[alone] += last[alone, 0] * UNKNOWN
                last[:, 1:] = last[:, :-1].copy()
                last[:, 0] = now
                done = np.flatnonzero(sizes == end)
                out[done] = np.log(now[done]) + scale[done, None]
                if end % 8 == 0:
                    most = last.max(axis=(1, 2))
                    last /= most[:, None, None]
                    scale += np.log(most)
        return out

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.memo)
        if len(self.memo) + len(new) > CACHE:
            self.memo.clear()
            self.scores, new = self.scores[:0], words
        if not new:
            return
        ordered = sorted(new, key=len)
        added, first = [], 0
        while first < len(ordered):
            # about as many characters at a time, so that long words stand with few others
            upto = first + 1
            while upto < len(ordered) and upto - first < 4096 and (upto - first) * (len(ordered[upto]) + 1) < 100_000:
                upto += 1
            added.append(self._score([MARK + w for w in ordered[first:upto]]))
            first = upto
        order = {w: len(self.scores) + i for i, w in enumerate(ordered)}
        self.memo.update(order)
        self.scores = np.vstack([self.scores, *added])

    def of(self, texts: list[list[str]]) -> np.ndarray:
        """texts (as words) x languages: sums of log probabilities."""
        self.learn({w for t in texts for w in t})
        get, out = self.memo.__getitem__, np.zeros((len(texts), self.scores.shape[1]))
        for i, t in enumerate(texts):
            if t:
                out[i] = self.scores[np.fromiter(map(get, t), np.int64, len(t))].sum(0)
        return out


_READY: dict[int, Forward] = {}


def _forward(path: str, key: int, probs: np.ndarray) -> Forward:
    if key not in _READY:
        _READY.clear()
        _READY[key] = Forward(_pieces(path)[1], probs)
    return _READY[key]


def _release() -> None:
    _READY.clear()
    _pieces.cache_clear()


def identify(documents: DataFrame, langs: list[str], probs: np.ndarray, path: str | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """documents with lang_pred and score, the posterior of lang_pred under equal priors; names are theirs, and columns so named are replaced."""
    import zlib

    ship(documents.sparkSession)
    path = path or vocabulary_path()
    broad = documents.sparkSession.sparkContext.broadcast(probs.astype(np.float64))  # vocabulary times languages
    key = zlib.crc32(probs.tobytes())

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        take_over("langid", _release)
        model = _forward(path, key, broad.value) if langs else None
        for s in parts:
            preds, scores = [], []
            for i in range(0, len(s), TEXTS):
                texts = [words_of(t) if t else [] for t in s.iloc[i : i + TEXTS]]
                sums = model.of(texts) if langs else None
                for k, t in enumerate(texts):
                    if not t or not langs:
                        preds.append("und")
                        scores.append(0.0)
                        continue
                    best = int(np.argmax(sums[k]))
                    preds.append(langs[best])
                    scores.append(float(1 / np.exp(sums[k] - sums[k][best]).sum()))
            yield pd.DataFrame({"lang_pred": preds, "score": scores})
            texts = sums = None
            hand_back()

    kept = [c for c in documents.columns if c not in names]
    return documents.withColumn("_said", predict("text")).select(*kept, F.col("_said.lang_pred").alias(names[0]), F.col("_said.score").alias(names[1]))


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def identified(documents: DataFrame, sample: int = SAMPLE, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """documents, each with lang_pred and score, by a model learnt from those that are not held out."""
    langs, probs = train(documents.where(~F.coalesce(held_out(), F.lit(False))), sample=sample)
    return identify(documents, langs, probs, names=names)


def accepted(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """documents without those that are `und` or whose language's posterior is below least."""
    found = identified(documents, names=("_lang_pred", "_score"))
    return found.where((F.col("_lang_pred") != "und") & (F.col("_score") >= least)).select(*documents.columns)


def op7_langid(documents: DataFrame) -> DataFrame:
    return identified(documents.select("doc_id", "text", "lang")).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
