"""Quality and toxicity of documents: heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.llm.base import map_batches
from quoteloom.llm.winnow import _LOWER, _mixed, word_hashes
from quoteloom.session import cut_lineage

TARGETS = ("low_quality", "toxic")
#: Votes: 0 abstains, 1 says bad, 2 says good. The last labeller of a target is the table of given labels.
LABELLERS = {
    "low_quality": ["shouting", "symbols", "repeats", "few_stop_words", "no_sentences", "given"],
    "toxic": ["one_insult", "two_insults", "given"],
}
#: Buckets of the hashed features, and at most about so many rows to fit on (a sample by hash beyond that); one in UNLABELLED of
#: them has no given label where there are both.
DIMENSIONS, TRAIN_ROWS, UNLABELLED = 1 << 17, 12_000, 4
#: Votes that the prior of the given labeller is worth at least. Its accuracy is estimated like that of the others.
GIVEN = 200.0
#: Words from which the measures of a text tell something.
LONG = 20
#: A document is rejected when the scorer gives a target at least this probability.
THRESHOLD = 0.3
ROUNDS, RIDGE, SHRINK = 60, 1.0, 10.0

STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were her all she "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son aux "
    "el los y del las se por con no una su para al lo como más o pero sus le ha me si sin sobre este ya entre cuando").split()
INSULTS = "idiot idiots moron morons stupid loser losers scum trash garbage pathetic worthless disgusting clown imbecile filth jerk dumb bastard retard vermin idiota estúpido imbécil basura crétin salaud connard abruti ordure dummkopf arschloch abschaum trottel widerlich".split()

_CHUNK = 1 << 20
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "!#$%&*|~^=+_<>{}[]\\@"]] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".?!;:"]] = True


def _hashes(words: list[str]) -> np.ndarray:
    return np.unique(word_hashes(_LOWER[np.frombuffer("\n".join(words).encode(), np.uint8)])[2])


class Read:
    """Words of some texts together: bytes, owner of each word, hashes."""

    def __init__(self, texts: list[str | None]) -> None:
        data = [(t or "").encode() for t in texts]
        self.n = len(data)
        self.sizes = np.array([len(d) for d in data], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes + 1)))
        self.raw = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
        self.low = _LOWER[self.raw]
        self.starts, self.ends, self.h = word_hashes(self.low)
        self.owner = np.searchsorted(self.offsets, self.starts, side="right") - 1
        self.words = np.bincount(self.owner, minlength=self.n)

    def per(self, marks: np.ndarray) -> np.ndarray:
        """Marked bytes per text."""
        total = np.concatenate(([0], np.cumsum(marks)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def measures(r: Read) -> np.ndarray:
    """Per text: share of capitals among letters, of symbols among bytes, of words equal to the one before, of stop words, sentence marks per word."""
    some = np.maximum(r.words, 1)
    same = np.zeros(len(r.h), bool)
    same[1:] = (r.h[1:] == r.h[:-1]) & (r.owner[1:] == r.owner[:-1])
    stops = np.isin(r.h, _hashes(STOP_WORDS))
    return np.stack([
        r.per(_UPPER[r.raw]) / np.maximum(r.per(_LETTER[r.raw]), 1), r.per(_SYMBOL[r.raw]) / np.maximum(r.sizes, 1),
        np.bincount(r.owner, same, r.n) / some, np.bincount(r.owner, stops, r.n) / some, r.per(_END[r.raw]) / some], axis=1)


def votes_of(r: Read) -> tuple[np.ndarray, np.ndarray]:
    """Votes of the heuristic labellers, a column each: (low_quality, toxic)."""
    m, long = measures(r), r.words >= LONG
    either = lambda bad, good: np.where(bad, 1, np.where(good, 2, 0))
    low = np.stack([
        either(long & (m[:, 0] > 0.5), long & (m[:, 0] < 0.2)), either(long & (m[:, 1] > 0.06), long & (m[:, 1] < 0.02)),
        either(long & (m[:, 2] > 0.2), long & (m[:, 2] < 0.05)), either(long & (m[:, 3] < 0.03), m[:, 3] > 0.1),
        either((r.words >= 60) & (m[:, 4] < 0.01), long & (m[:, 4] > 0.04))], axis=1)
    insult = np.isin(r.h, _hashes(INSULTS))
    hits = np.bincount(r.owner, insult, r.n)
    kinds = np.unique(np.stack([r.owner[insult], r.h[insult].view(np.int64)]), axis=1)[0] if insult.any() else np.zeros(0, np.int64)
    distinct = np.bincount(kinds, minlength=r.n)
    # that no word of the list stands there says little: most toxic texts use others
    toxic = np.stack([either(hits >= 1, np.zeros(r.n, bool)), either(distinct >= 2, np.zeros(r.n, bool))], axis=1)
    return low, toxic


def features_of(r: Read, target: str) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of the distinct hashed features: words with their first four and five bytes for toxicity, measures in steps for quality."""
    if target == "toxic":
        size = r.ends - r.starts
        parts = [r.h]
        for n in (4, 5):
            code = np.full(len(r.h), n, np.uint64)
            for j in range(n):
                byte = r.low[np.minimum(r.starts + j, len(r.low) - 1)].astype(np.uint64)
                code = code * np.uint64(257) + np.where(size > j, byte, 0).astype(np.uint64)
            parts.append(_mixed(code))
        owner, values = np.tile(r.owner, len(parts)), np.concatenate(parts)
    else:
        m, long = measures(r), r.words >= LONG
        steps = np.minimum(np.floor(m * np.array([10, 50, 20, 20, 50])), 15).astype(np.uint64)
        kind = np.arange(m.shape[1], dtype=np.uint64)
        votes = votes_of(r)[0].astype(np.uint64)
        code = np.concatenate([steps * np.uint64(64) + kind, votes * np.uint64(64) + kind + np.uint64(32)], axis=1)
        # a text too short to measure has one feature, that it is short
        owner = np.concatenate([np.repeat(np.flatnonzero(long), code.shape[1]), np.flatnonzero(~long & (r.words > 0))])
        values = _mixed(np.concatenate([code[long].ravel(), np.full(int((~long & (r.words > 0)).sum()), 63, np.uint64)]) + np.uint64(1))
    pair = np.unique(owner * DIMENSIONS + (values % np.uint64(DIMENSIONS)).astype(np.int64)) if len(owner) else np.zeros(0, np.int64)
    return pair // DIMENSIONS, pair % DIMENSIONS


def _chunks(texts: list[str | None]):
    part, size = [], 0
    for i, t in enumerate(texts):
        part.append(t)
        size += len(t or "")
        if size >= _CHUNK or i == len(texts) - 1:
            yield Read(part)
            part, size = [], 0


@dataclass
class LabelModel:
    """Share of bad documents and, per labeller, the chances of each vote for good and for bad ones."""

    bad: float
    chances: np.ndarray  # labeller, class (0 good, 1 bad), vote

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.log(np.array([1 - self.bad, self.bad]))[None, :] + sum(np.log(self.chances[j][:, votes[:, j]]).T for j in range(votes.shape[1]))
        log -= log.max(axis=1, keepdims=True)
        p = np.exp(log)
        return p[:, 1] / p.sum(axis=1)


def fit_labels(votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns and how many documents have them (at most 3 to the number of labellers)."""
    k = votes.shape[1]
    # before any data, as if ten votes had been seen: a heuristic that looks for one fault sees it in a third of the bad documents
    # and in one good document of twenty; a given label is right 99 times in 100, as if as many had been seen as there are, GIVEN at
    # least (with less, labels that the one-sided heuristics cannot confirm drift away from their class)
    weight = np.where(np.arange(k) == k - 1, max(GIVEN, float(counts[votes[:, -1] > 0].sum())), 10.0)
    finds = np.where(np.arange(k) == k - 1, 0.99, 0.35)
    spares = np.where(np.arange(k) == k - 1, 0.99, 0.95)
    prior = np.empty((k, 2, 3))
    for j in range(k):
        prior[j, 0] = weight[j] * np.array([0.5, 0.5 * (1 - spares[j]), 0.5 * spares[j]])
        prior[j, 1] = weight[j] * np.array([0.5, 0.5 * finds[j], 0.5 * (1 - finds[j])])
    # where all are silent there is nothing to estimate from, and such documents would only repeat the share of bad ones
    counts = counts * votes.any(axis=1)
    one_sided = ~(votes == 2).any(axis=0) & (votes == 1).any(axis=0)
    model = LabelModel(0.1, prior / prior.sum(axis=2, keepdims=True))
    for _ in range(rounds):
        p = model.posterior(votes)
        chances = prior.copy()
        for j in range(k):
            for v in range(3):
                at = votes[:, j] == v
                chances[j, 0, v] += (counts * (1 - p))[at].sum()
                chances[j, 1, v] += (counts * p)[at].sum()
        # that a labeller abstains says nothing about the class: most do so for want of words or labels
        silent = chances[:, :, 0].sum(axis=1) / chances.sum(axis=(1, 2))
        spoken = chances[:, :, 1:] / chances[:, :, 1:].sum(axis=2, keepdims=True)
        # where a labeller only ever says bad, how often it does so in each class tells, instead of its right among its wrong
        spoken = np.where(one_sided[:, None, None], chances[:, :, 1:] / chances.sum(axis=2, keepdims=True), spoken)
        chances = np.concatenate([np.broadcast_to(silent[:, None, None], (k, 2, 1)), (1 - silent)[:, None, None] * spoken], axis=2)
        model = LabelModel(float(np.clip((counts * p).sum() / max(counts.sum(), 1), 1e-4, 0.5)), np.clip(chances, 1e-6, 1))
    return model


def fit_scorer(rows: pa.ChunkedArray, aims: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on hashed presence features (an Arrow list of buckets per row) towards soft labels, by L-BFGS on the whole sample.

    A feature counts by its shrunken log ratio of shares among bad and good rows, so what was seen in a row or two weighs little.
    Sums run over one chunk of the sample after another, so besides the sample only a chunk is held.
    """
    if not len(aims):
        return np.zeros(DIMENSIONS), -5.0
    n = len(aims)

    def chunks():
        at = 0
        for chunk in rows.chunks:
            sizes = np.diff(chunk.offsets.to_numpy())
            flat = chunk.values.to_numpy()[chunk.offsets[0].as_py(): chunk.offsets[-1].as_py()]
            # pieces of whole rows, of about a quarter of a million features
            cuts = np.unique(np.searchsorted(np.cumsum(sizes), np.arange(0, len(flat), 1 << 18), side="right"))
            ends = np.concatenate(([0], np.cumsum(sizes)))
            for a, b in zip(cuts, [*cuts[1:], len(sizes)], strict=True):
                yield at + a, at + b, np.repeat(np.arange(b - a), sizes[a:b]), flat[ends[a]:ends[b]]
            at += len(sizes)

    in_bad, seen, share = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), float(np.clip(aims.mean(), 1e-3, 1 - 1e-3))
    for a, b, owner, at in chunks():
        in_bad += np.bincount(at, aims[a:b][owner], DIMENSIONS)
        seen += np.bincount(at, minlength=DIMENSIONS)
    odds = (in_bad + SHRINK * share) / share, (seen - in_bad + SHRINK * (1 - share)) / (1 - share)
    scale = np.log(odds[0] / np.maximum(odds[1], 1e-9))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        weights, total, sums, errs = x[:-1] * scale, 0.0, np.zeros(DIMENSIONS), 0.0
        z = np.full(n, x[-1])
        for a, b, owner, at in chunks():
            z[a:b] += np.bincount(owner, weights[at], b - a)
            err = 1 / (1 + np.exp(-np.clip(z[a:b], -30, 30))) - aims[a:b]
            sums += np.bincount(at, err[owner], DIMENSIONS)
        errs = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - aims).sum()
        total = (np.logaddexp(0, z) - aims * z).sum()
        return float(total + RIDGE / 2 * (x[:-1] @ x[:-1])), np.append(scale * sums + RIDGE * x[:-1], errs)

    x = np.zeros(DIMENSIONS + 1)
    x[-1] = np.log((aims.mean() + 1e-3) / (1 - aims.mean() + 1e-3))
    f, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(ROUNDS):
        d, tail = g.copy(), []
        for s, y in reversed(past):
            c = s @ d / (s @ y)
            d -= c * y
            tail.append(c)
        d *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, float(np.abs(g).sum()))
        for (s, y), c in zip(past, reversed(tail), strict=True):
            d += s * (c - y @ d / (s @ y))
        step, down = 1.0, g @ d
        while step > 1e-8:
            after, slope = loss(x - step * d)
            if after <= f - 1e-4 * step * down:
                break
            step /= 2
        else:
            break
        s, y = -step * d, slope - g
        if s @ y > 1e-10:
            past = [*past[-9:], (s, y)]
        done = f - after < 1e-6 * max(1.0, abs(f))
        x, f, g = x - step * d, after, slope
        if done:
            break
    return x[:-1] * scale, float(x[-1])


def _voted(docs: DataFrame) -> DataFrame:
    """``id``, ``low_quality`` and ``toxic`` (votes as digits of one number in base three) of every row."""

    def run(ids, texts):
        out = ([], [])
        for r in _chunks(texts):
            for o, v in zip(out, votes_of(r), strict=True):
                o.append(v @ 3 ** np.arange(v.shape[1]))
        return ids, *(pa.array(np.concatenate(o), pa.int64()) for o in out)

    return map_batches(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, low_quality long, toxic long")


def _patterns(voted: DataFrame, target: str) -> tuple[np.ndarray, np.ndarray]:
    k = len(LABELLERS[target])
    rows = voted.groupBy(target, f"given_{target}").agg(F.count("*").alias("n")).collect()  # at most 3**k rows
    votes = np.array([[r[0] // 3**j % 3 for j in range(k - 1)] + [r[1]] for r in rows], np.int64).reshape(-1, k)
    return votes, np.array([r["n"] for r in rows], float)


def scorer(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Callable[[Column], Column]:
    """A function of a text column that gives ``low_quality``, ``toxic`` (probabilities) and ``rejected`` as a struct.

    ``labels``: doc_id, quality (1 good), toxic (1 toxic), covering some documents; one labeller among the others. Votes and
    their patterns cover all documents; the scorers are fitted on at most about ``train_rows`` rows chosen by hash, labelled ones and
    one in UNLABELLED without labels, towards the posteriors of all labellers. A text without words is scored by the bias alone and a null text is such a text; null labels
    abstain; of several labels of a document the worst counts; empty tables give a scorer that rejects nothing.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    given = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.min(F.when(F.col("quality") == 0, 1).when(F.col("quality").isNotNull(), 2)).alias("given_low_quality"),
        F.min(F.when(F.col("toxic") == 1, 1).when(F.col("toxic").isNotNull(), 2)).alias("given_toxic"))
    given = given.select("id", *(F.coalesce(f"given_{t}", F.lit(0)).alias(f"given_{t}") for t in TARGETS))
    voted = _voted(named).join(given, "id", "left").fillna(0, [f"given_{t}" for t in TARGETS])
    voted = cut_lineage(voted)
    models = {t: fit_labels(*_patterns(voted, t)) for t in TARGETS}

    has = (F.col("given_low_quality") > 0) | (F.col("given_toxic") > 0)
    n, labelled = voted.agg(F.count("*"), F.coalesce(F.sum(has.cast("long")), F.lit(0))).first()
    others = n - labelled
    # the sample: labelled rows, and some without labels, which only the heuristics speak for
    plain = min(others, train_rows // UNLABELLED, labelled // (UNLABELLED - 1)) if labelled else min(others, train_rows)
    shares = {True: min(1.0, (train_rows - plain) / max(labelled, 1)), False: min(1.0, plain / max(others, 1))}
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    chosen = voted.filter(F.when(has, draw < int(shares[True] * (1 << 30))).otherwise(draw < int(shares[False] * (1 << 30))))
    sample = named.join(chosen.dropDuplicates(["id"]), "id")

    def look(texts, *votes):
        buckets = {t: ([0], []) for t in TARGETS}
        for r in _chunks(texts):
            for t in TARGETS:
                owner, at = features_of(r, t)
                sizes, parts = buckets[t]
                sizes += (sizes[-1] + np.cumsum(np.bincount(owner, minlength=r.n))).tolist()
                parts.append(at.astype(np.int32))
        lists = (pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32))) for sizes, parts in buckets.values())
        return *lists, *votes

    columns = [c for t in TARGETS for c in (t, f"given_{t}")]
    looked = cut_lineage(map_batches(sample.select("text", *(F.col(c).cast("long") for c in columns)), look, ", ".join([*(f"f_{t} array<int>" for t in TARGETS), *(f"{c} long" for c in columns)])))
    scorers = {}
    for t in TARGETS:
        k = len(LABELLERS[t])
        fitted = looked.select(f"f_{t}", t, f"given_{t}").toArrow()  # bounded by train_rows; one target at a time
        heuristics = fitted.column(t).to_numpy()
        votes = np.stack([*(heuristics // 3**j % 3 for j in range(k - 1)), fitted.column(f"given_{t}").to_numpy()], axis=1).astype(np.int64)
        told = votes.any(axis=1)  # where all abstain there is nothing to learn from
        w, b = fit_scorer(fitted.column(f"f_{t}").filter(pa.array(told)), models[t].posterior(votes[told]))
        scorers[t] = w.astype(np.float32), b
        del fitted, heuristics

    @F.pandas_udf("struct<low_quality: double, toxic: double, rejected: boolean>")
    def score(texts: pd.Series) -> pd.DataFrame:
        out = {t: [] for t in TARGETS}
        for r in _chunks(texts.tolist()):
            for t in TARGETS:
                w, b = scorers[t]
                owner, at = features_of(r, t)
                z = np.bincount(owner, w[at].astype(np.float64), r.n) + b
                out[t].append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        frame = pd.DataFrame({t: np.concatenate(out[t]) if out[t] else [] for t in TARGETS})
        return frame.assign(rejected=(frame["low_quality"] >= THRESHOLD) | (frame["toxic"] >= THRESHOLD))

    return score


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``id``, ``low_quality``, ``toxic`` and ``rejected`` of every row; rows that repeat an id are scored one by one."""
    score = scorer(docs, labels, id_col, text_col, train_rows)
    return docs.select(F.col(id_col).alias("id"), score(F.col(text_col)).alias("s")).select("id", "s.*")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns; rows are not shuffled."""
    score = scorer(docs, labels, id_col, text_col, train_rows)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_ql_row"))
    return whole.withColumn("_ql_s", score(F.col("_ql_row")[text_col])).filter("not _ql_s.rejected").select(*(F.col("_ql_row")[c].alias(c) for c in docs.columns))
