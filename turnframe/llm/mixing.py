"""Mixing documents to target weights with soft domain membership.

A classifier learnt from the label table gives each document a posterior over the domains. A document's rate is how often
it is to be drawn; the rates are the nonnegative least-squares fit of the expected token totals of the domains (rate x
tokens x posterior, summed) to their targets, found by projected gradient from rates of one.

Minimised are the squared residuals of the domains, each as a share of its domain's tokens and FIRM times as heavy where the
target is positive, and RIDGE times the squared distance of the rates from one, weighted by tokens. So targets that the corpus
can meet are met, and one that only the tails of the posteriors stand against, such as nothing toxic at all, takes the
documents that are likely toxic and not all that may be. The solution is unique and the fit runs until it stands still; a
warning says how far from the targets it lies.

Domains: toxic (toxic is 1), else high (quality is 1) or low (quality is 0). A label row with a null is no label; a document
with several label rows trains with each, and repeated rows train once. Training uses at most SAMPLE labelled rows (in
expectation, chosen by hashes); all else covers all rows and whole texts.

The classifier is a multinomial logistic one with an L1 penalty that lets a term in once it is off, in documents, by PENALTY
times the root of how many have it: chance alone grows in this way. A term in PENALTY squared documents or fewer has weight
zero at the optimum, so it is left out beforehand without changing the fit.

Rows: a null or empty text has no tokens; it gets a posterior and a rate like any other and adds nothing to the totals.
Repeated rows each get their rate. Extra columns are ignored. Without labels all domains are equally likely; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnframe.llm.common import join_rows, text_key, whole_rows, written
from turnframe.llm.shipping import hand_back

DOMAINS = ["high", "low", "toxic"]
#: Shares of the drawn tokens. The total is the least that needs no domain with a positive share to be thinned out.
TARGETS = {"high": 0.9, "low": 0.1, "toxic": 0.0}
SAMPLE, PENALTY, STEM = 20_000, 1.0, 6
AT_ONCE, STEPS_ROUGH = 100, 60
#: The chosen terms are fitted again with this part of the penalty: it chooses well, but shrinks too much for a posterior.
RELAXED = 0.3
#: Cells a side of the triangle of posteriors, over which the fit runs; the weights of rates near one and of positive targets;
#: the change at which a step stands still; and the share by which a domain may be off without a warning.
GRID, RIDGE, FIRM, STILL, TOLERANCE = 256, 1 / 60, 32.0, 1e-10, 0.01

WORD = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+")


def terms_of(text: str | None) -> set[str]:
    """Words in lower case and what stands between them, the first STEM letters of longer words, and a mark for capitals."""
    said = set(WORD.findall(text or ""))
    found = {w.lower() for w in said}
    found |= {"^" + w[:STEM] for w in found if len(w) > STEM}
    if any(w.isupper() and len(w) > 1 and w.isalpha() for w in said):
        found.add("<capitals>")
    return found


# --- the classifier -------------------------------------------------------------------------------------------------


class _Docs:
    """Documents as sets of terms: place by place the document and the term, columns centred."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, n_docs: int, n_terms: int):
        self.doc, self.term, self.n_docs, self.n_terms = doc, term, n_docs, n_terms
        self.mean = np.bincount(term, minlength=n_terms) / n_docs

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.doc, c[self.term], self.n_docs) for c in w.T], 1) - self.mean @ w

    def turned(self, r: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.term, c[self.doc], self.n_terms) for c in r.T], 1) - np.outer(self.mean, r.sum(0))

    def only(self, terms: np.ndarray) -> _Table:
        place = np.full(self.n_terms, -1)
        place[terms] = np.arange(len(terms))
        kept = place[self.term] >= 0
        full = np.zeros((self.n_docs, len(terms)), np.float32)
        full[self.doc[kept], place[self.term[kept]]] = 1
        return _Table(full, self.mean[terms])


class _Table:
    """The same for a few terms, as a full matrix: a sample times the terms that tell domains apart."""

    def __init__(self, full: np.ndarray, mean: np.ndarray):
        self.full, self.mean = full, mean
        self.n_docs, self.n_terms = full.shape

    def times(self, w: np.ndarray) -> np.ndarray:
        return self.full @ w.astype(np.float32) - self.mean @ w

    def turned(self, r: np.ndarray) -> np.ndarray:
        r = np.where(np.abs(r) < 1e-20, 0.0, r)  # numbers too small for 32 bits are slow to multiply
        return self.full.T @ r.astype(np.float32) - np.outer(self.mean, r.sum(0))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _scale(mean: np.ndarray) -> np.ndarray:
    return 1 / np.sqrt(np.maximum(mean * (1 - mean), 1e-12))[:, None]


def _descend(x: _Table, y: np.ndarray, w: np.ndarray, b: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated proximal gradient steps in columns of variance one, restarted where they turn back, until no gradient is off by a fifth of the penalty."""
    s = _scale(x.mean)
    v = np.random.default_rng(0).normal(size=(x.n_terms, 1))
    size = 1.0
    for _ in range(20):
        v = s * x.turned(x.times(s * v)) / x.n_docs
        size = float(np.linalg.norm(v))
        v /= max(size, 1e-12)
    # centred columns are at right angles to the bias, so each has a step of its own
    rate, rate_b, w = 1 / (0.55 * max(1.0, size)), 1 / 0.55, w / s
    at, at_b, pace = w, b, 1.0
    for k in range(steps):
        off = (softmax(x.times(s * at) + at_b) - y) / x.n_docs
        g = s * x.turned(off)
        if at is w and max(np.max(np.where(w != 0, np.abs(g + penalty * np.sign(w)), np.maximum(np.abs(g) - penalty, 0)), initial=0), np.abs(off.sum(0)).max()) < penalty / 5:
            break
        z = at - rate * g
        new, new_b = np.sign(z) * np.maximum(np.abs(z) - rate * penalty, 0), at_b - rate_b * off.sum(0)
        turns = np.sum((at - new) * (new - w)) + np.sum((at_b - new_b) * (new_b - b)) > 0
        ahead = 1.0 if turns else (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        push = 0.0 if turns or (k + 1) % 20 == 0 else (pace - 1) / ahead
        at, at_b = (new, new_b) if push == 0 else (new + push * (new - w), new_b + push * (new_b - b))
        w, b, pace = new, new_b, ahead
    return w * s, b


def learn(labels: np.ndarray, doc: np.ndarray, term: np.ndarray, n_terms: int, n_classes: int, strength: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """(weights: terms x classes, bias). Terms whose gradients break the bound join the fit, AT_ONCE at a time, until none does, so the optimum is that over all terms."""
    n, penalty = len(labels), strength / len(labels) ** 0.5
    y = np.eye(n_classes)[labels]
    every = _Docs(doc, term, n, n_terms)
    w, b = np.zeros((n_terms, n_classes)), np.log(np.maximum(y.mean(0), 1e-9))
    active = np.zeros(n_terms, bool)
    while True:
        g = np.abs(_scale(every.mean) * every.turned((softmax(every.times(w) + b) - y) / n)).max(1)
        late = np.flatnonzero(~active & (g > penalty * 1.2))
        if not len(late):
            break
        active[late[np.argsort(-g[late], kind="stable")[:AT_ONCE]]] = True
        own = np.flatnonzero(active)
        w[own], b = _descend(every.only(own), y, w[own], b, penalty, STEPS_ROUGH)
    own = np.flatnonzero(active)
    w[own], b = _descend(every.only(own), y, w[own], b, penalty)
    own = np.flatnonzero(np.abs(w).sum(1) > 0)
    w[own], b = _descend(every.only(own), y, w[own], b, penalty * RELAXED)
    return w, b - every.mean @ w


def _learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, terms) of the sample, in one task, to (term, w): the terms with weights, and as a null term the bias."""
    labels, sizes, flat = [], [], []
    for batch in batches:
        labels.append(batch.column("label").to_numpy())
        sizes.append(np.diff(batch.column("terms").offsets.to_numpy()))
        flat.append(batch.column("terms").flatten())
    labels = np.concatenate(labels) if labels else np.zeros(0, int)
    present = np.unique(labels)
    if len(present) < 2:
        return
    coded = pa.concat_arrays(flat).dictionary_encode()
    del flat
    term, doc = coded.indices.to_numpy(), np.repeat(np.arange(len(labels), dtype=np.int32), np.concatenate(sizes))
    # the gradient of a term is at most the documents that have it, or lack it
    n = np.bincount(term, minlength=len(coded.dictionary))
    able = np.flatnonzero(n > PENALTY**2)
    place = np.full(len(n), -1, np.int32)
    place[able] = np.arange(len(able))
    kept = place[term] >= 0
    w, b = learn(np.searchsorted(present, labels), doc[kept], place[term[kept]], len(able), len(present))
    full = np.full((len(able) + 1, len(DOMAINS)), 0.0)
    full[-1] = -np.inf
    full[:-1, present], full[-1, present] = w, b
    some = np.append(np.flatnonzero(np.abs(w).sum(1) > 0), len(able))
    names = [*coded.dictionary.take(pa.array(able[some[:-1]])).to_pylist(), None]
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(list(full[some]), pa.list_(pa.float64()))], ["term", "w"])
    del coded, term, doc, kept
    hand_back()


def taught(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(label, terms) of at most `sample` labelled rows, in expectation; a written table."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)
    usable = labels.where("quality is not null and toxic is not null and doc_id is not null").select("doc_id", domain.alias("label")).distinct()
    usable = _sampled(written(usable, "labels"), sample, "doc_id", "label")
    # the first choice bounds the labels and the second the rows, should a labelled doc_id have many texts
    rows = documents.select("doc_id", "text").join(written(usable, "labelled"), "doc_id").withColumn("_key", text_key(F.col("text")))
    met = written(rows.groupBy("doc_id", "label", "_key").agg(F.first("text").alias("text")), "rows")

    @F.pandas_udf("array<string>")
    def terms(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(terms_of(t)) for t in texts], dtype=object)

    return written(_sampled(met, sample, "doc_id", "_key", "label").select("label", terms("text").alias("terms")), "taught")


def _sampled(rows: DataFrame, sample: int, *by: str) -> DataFrame:
    n = rows.count()
    return rows if n <= sample else rows.where(F.pmod(F.xxhash64(*by), F.lit(1 << 30)) < int((1 << 30) * sample / n))


def with_posteriors(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, _key, n_tokens, p): p is the posterior of DOMAINS, for every row."""
    model = {r.term: np.array(r.w) for r in taught(documents, labels, sample).coalesce(1).mapInArrow(_learnt, "term string, w array<double>").collect()}
    bias = model.pop(None, np.zeros(len(DOMAINS)))
    if not model and labels.limit(1).count():  # nothing tells them apart
        seen = taught(documents, labels, sample).select("label").distinct().collect()
        if len(seen) == 1:
            bias = np.where(np.arange(len(DOMAINS)) == seen[0].label, 0.0, -np.inf)

    @F.pandas_udf("n_tokens long, p array<double>")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = frozenset(model)
        for texts in parts:
            n, z = np.zeros(len(texts), np.int64), np.tile(bias, (len(texts), 1))
            for i, t in enumerate(texts):
                if t:
                    n[i] = len(t.encode("utf-8", "replace").split())  # of bytes: white space 9-13 and 32
                for w in terms_of(t) & known:
                    z[i] += model[w]
            yield pd.DataFrame({"n_tokens": n, "p": pd.Series(list(softmax(z)), dtype=object)})
        hand_back()

    rows = documents.select("doc_id", text_key(F.col("text")).alias("_key"), scored("text").alias("s"))
    return rows.select("doc_id", "_key", "s.n_tokens", "s.p")


# --- the rates ------------------------------------------------------------------------------------------------------


def fit(tokens: np.ndarray, p: np.ndarray, want: np.ndarray, ridge: float = RIDGE, firm: float = FIRM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rate of each cell, residual of each domain as a share of its tokens, the pull of each domain on a rate) by projected gradient.

    Measured by tokens, the curvature lies between ridge and firm + ridge, so that steps of their inverse never overshoot, and
    steps with the momentum of that ratio get there in time.
    """
    have = tokens @ p
    scale, heavy = np.where(have > 0, have, 1.0), np.where(want > 0, firm, 1.0) * (have > 0)
    top = heavy.max(initial=0) + ridge
    speed = (1 - np.sqrt(ridge / top)) / (1 + np.sqrt(ridge / top))
    rate = ahead = np.ones(len(tokens))
    while True:
        error = ((ahead * tokens) @ p - want) / scale
        new = np.maximum(ahead - (p @ (heavy * error) + ridge * (ahead - 1)) / top, 0)
        moved = max(np.abs(new - rate).max(initial=0), np.abs(new - ahead).max(initial=0))
        ahead, rate = new + speed * (new - rate), new
        if moved < STILL:
            error = ((rate * tokens) @ p - want) / scale
            return rate, error * (have > 0), heavy * error


def rate_of(p: Column, pull: Column, ridge: float = RIDGE) -> Column:
    """The rate of a document at the optimum: what its own posteriors and the domains' pulls make of it."""
    return F.greatest(1 - F.aggregate(F.zip_with(p, pull, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / ridge, F.lit(0.0))


def fitted_rates(members: DataFrame, targets: dict[str, float] | None = None, total: float | None = None, ridge: float = RIDGE, firm: float = FIRM) -> DataFrame:
    """members (…, n_tokens, p) with rate. targets: shares of DOMAINS; total: of tokens.

    Tokens and mean posteriors are summed over all documents into at most GRID ** 2 / 2 cells of like posteriors, and one
    task runs the gradient over the cells. A document's rate then comes from its own posteriors and the pulls found, so that
    cells change nothing but those, and by little.
    """
    targets = targets or TARGETS
    share = np.array([targets.get(d, 0.0) for d in DOMAINS])
    share = share / (share.sum() or 1)
    first, second = F.rint(F.col("p")[0] * GRID).cast("int"), F.rint(F.col("p")[1] * GRID).cast("int")
    own = members.select((first * (GRID + 1) + F.least(second, GRID - first)).alias("cell"), F.col("n_tokens").cast("double").alias("t"), "p")
    cells = own.groupBy("cell").agg(F.sum("t").alias("tokens"), *[F.sum(F.col("t") * F.col("p")[k]).alias(f"p{k}") for k in range(len(DOMAINS))])

    def fits(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_cells = pd.concat([pd.DataFrame({"tokens": [], **{f"p{k}": [] for k in range(len(DOMAINS))}}), *parts])
        all_cells = all_cells[all_cells["tokens"] > 0]
        tokens = all_cells["tokens"].to_numpy(float)
        p = all_cells[[f"p{k}" for k in range(len(DOMAINS))]].to_numpy(float) / tokens[:, None]
        have = tokens @ p
        goal = total if total is not None else max([h / s for h, s in zip(have, share) if s > 0 and h > 0], default=0.0)
        _, error, pull = fit(tokens, p, goal * share, ridge, firm)
        yield pd.DataFrame({"error": [error.tolist()], "pull": [pull.tolist()]})

    error, pull = written(cells, "cells").coalesce(1).mapInPandas(fits, "error array<double>, pull array<double>").first()
    worst = max(map(abs, error))
    if worst > TOLERANCE:
        warnings.warn(f"the targets are not met: a domain is off by {worst:.4f} of its tokens", stacklevel=2)
    return members.withColumn("rate", rate_of(F.col("p"), F.array(*map(F.lit, pull)), ridge))


def mixed(documents: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, total: float | None = None) -> DataFrame:
    """(doc_id, _key, n_tokens, p, rate, copies) for every row; copies rounds the rate up or down by a hash of the row, so that the expected number is the rate."""
    members = written(with_posteriors(documents, labels), "members")
    at = F.pmod(F.xxhash64("doc_id", "_key", F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
    return fitted_rates(members, targets, total).withColumn("copies", F.floor(F.col("rate") + at).cast("long"))


def drawn(documents: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """documents with each row as often as its copies say."""
    copies = mixed(documents, labels, targets).groupBy("doc_id", "_key").agg(F.max("copies").alias("_copies")).where("_copies > 0")
    each = join_rows(whole_rows(documents), copies, "inner").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return each.select("_row.*")


def op9_mixing(documents: DataFrame, labels: DataFrame) -> DataFrame:
    found = mixed(documents, labels)
    return found.select("doc_id", "n_tokens", *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", "copies")
