"""Similarity of two strings by longest common subsequence, as Arrow functions.

``ratio`` is the normalised insert/delete similarity, 0 to 100. ``partial_ratio`` is the best ratio of the
shorter string against any window of the longer one (windows cut at the ends included).

One pass over the LCS grid of two strings gives the LCS of every window (semi-local LCS, Tiskin 2008). The grids of many
pairs advance together, an antidiagonal of all of them in one numpy step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoteloom.vocab import LABEL_THRESHOLD

#: Strands that one step of the comb moves.
_AT_ONCE = 1 << 15


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32)


def lcs_length(a: str, b: str) -> int:
    """LCS length with one arbitrary-precision bit vector."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 100.0 * (1.0 - (total - 2 * lcs_length(a, b)) / total)


def _comb(needles: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strands of the LCS grids of all pairs at once (Tiskin 2008): a column per pair, a step per antidiagonal.

    A strand enters every row from the left (numbered from the last row up) and every column from above (numbered on from there).
    Where characters agree two strands turn away from each other, elsewhere they cross unless they have crossed before. Returns the
    strands that leave each row to the right and each column below.
    """
    m, n, pairs = needles.shape[0], texts.shape[0], needles.shape[1]
    kind = np.uint16 if m + n <= 1 << 16 else np.uint32
    upward = np.ascontiguousarray(needles[::-1])
    right = np.repeat(np.arange(m, dtype=kind)[:, None], pairs, axis=1)
    below = np.repeat(np.arange(m, m + n, dtype=kind)[:, None], pairs, axis=1)
    equal, least = np.empty((min(m, n), pairs), bool), np.empty((min(m, n), pairs), kind)
    for step in range(m + n - 1):
        low, high = max(0, step - n + 1), min(m - 1, step)
        h, v = right[m - 1 - high:m - low], below[step - high:step - low + 1]
        same, new = equal[:h.shape[0]], least[:h.shape[0]]
        np.equal(upward[m - 1 - high:m - low], texts[step - high:step - low + 1], out=same)
        np.copyto(new, same.view(np.uint8))
        np.negative(new, out=new)
        np.bitwise_or(new, h, out=new)
        np.minimum(new, v, out=new)
        np.bitwise_xor(v, h, out=v)
        np.bitwise_xor(v, new, out=v)
        np.copyto(h, new)
    return right[::-1], below


def _best_offset(starts: np.ndarray, m: np.ndarray, n: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Best ratio of each pair over the windows that begin ``first`` to ``last`` places from the text's start (before it: cut there).

    ``starts``: where the strand leaving below each place of the text came in from above, negative if it came from the left. A
    window has as many characters outside the LCS as strands that come in and leave inside it.
    """
    places = np.arange(starts.shape[0])[:, None]
    change = np.zeros((starts.shape[0] + int(m.max()) + 1, m.shape[0]), np.int32)
    # a strand in at s and out at e lies in the windows from e - m + 1 to s; all are counted from -(m - 1)
    counts = (starts >= 0) & (places < n) & (starts + m > places)
    change[:starts.shape[0]] += counts
    e, p = np.nonzero(counts)
    change[starts[e, p] + m[p], p] -= 1
    lost = np.cumsum(change, axis=0)
    offset = np.arange(change.shape[0])[:, None] - (m - 1)
    width = np.minimum(np.minimum(offset + m, m), n - offset)
    real = (offset >= first) & (offset <= last) & (width > 0)
    total = np.where(real, m + width, 1)
    score = np.where(real, 1.0 - (total - 2 * (width - lost)) / total, 0.0)
    return 100.0 * score.max(axis=0)


def _codes_of(texts: list[str], size: int, pad: int, kind: type) -> np.ndarray:
    """Texts as columns of character codes, filled up to ``size``."""
    out = np.full((len(texts), size), pad, kind)
    lengths = np.array([len(t) for t in texts])
    out[np.arange(size) < lengths[:, None]] = _codes("".join(texts))
    return np.ascontiguousarray(out.T)


def _score_chunk(pieces: list[tuple[str, str, int, int, bool]]) -> np.ndarray:
    """Best ratios of (needle, text, first, last window, whether windows of the needle count too)."""
    needles, texts = [x[0] for x in pieces], [x[1] for x in pieces]
    m, n = np.array([len(x) for x in needles]), np.array([len(x) for x in texts])
    # codes that no string holds fill columns up; they differ between the sides, so they agree with nothing
    kind, top = (np.uint16, 0xFFFE) if all(max(t) < "\ufffe" for t in (*needles, *texts)) else (np.uint32, 0x110000)
    rows, columns = int(m.max()), int(n.max())
    right, below = _comb(_codes_of(needles, rows, top, kind), _codes_of(texts, columns, top + 1, kind))
    first, last = np.array([x[2] for x in pieces]), np.array([x[3] for x in pieces])
    best = _best_offset(below.astype(np.int64) - rows, m, n, first, last)
    both = np.flatnonzero([x[4] for x in pieces])
    if both.size:
        # seen from the needle, strands come in from the left, numbered from its first row
        starts = rows - 1 - right[:, both].astype(np.int64)
        best[both] = np.maximum(best[both], _best_offset(starts, n[both], m[both], 1 - n[both], m[both] - 1))
    return best


def best_windows(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Best window ratio of each (needle, text); a text is at least as long as its needle, which is not empty. Of two strings of
    equal length, windows of either count."""
    out = np.zeros(len(pairs))
    pieces, owner = [], []
    for i, (needle, text) in enumerate(pairs):
        m, n = len(needle), len(text)
        # a long text is taken in parts that share a needle's length, so each window lies whole in one
        stride = n if n <= 8 * m else 4 * max(m, 16)
        for at in range(0, n, stride):
            end = n if at + stride >= n else at + stride + m - 1
            pieces.append((needle, text[at:end], 0 if at else 1 - m, min(n - at, stride) - 1, m == n))
            owner.append(i)
    order = sorted(range(len(pieces)), key=lambda k: (len(pieces[k][0]) // 8, len(pieces[k][1])))
    chunk: list[int] = []
    rows = columns = cells = 0

    def score() -> None:
        np.maximum.at(out, [owner[k] for k in chunk], _score_chunk([pieces[k] for k in chunk]))

    for k in order:
        m, n = len(pieces[k][0]), len(pieces[k][1])
        tall, wide = max(rows, m), max(columns, n)
        # no more at once than stays near the processor, and few cells that only fill up
        if chunk and ((len(chunk) + 1) * tall > _AT_ONCE or (len(chunk) + 1) * tall * wide > 1.5 * (cells + m * n)):
            score()
            chunk, tall, wide, cells = [], m, n, 0
        chunk.append(k)
        rows, columns, cells = tall, wide, cells + m * n
    if chunk:
        score()
    return out


def partial_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Partial ratio of each pair; strings of equal length are tried both ways."""
    pairs: list[tuple[str, str]] = []
    rows: list[int] = []
    out = np.zeros(len(a))
    for i, (x, y) in enumerate(zip(a, b)):
        short, long_ = (x, y) if len(x) <= len(y) else (y, x)
        if not short:
            out[i] = 100.0 if not long_ else 0.0
            continue
        pairs.append((short, long_))
        rows.append(i)
    if pairs:
        out[rows] = best_windows(pairs)
    return out


def partial_ratio(a: str, b: str) -> float:
    return float(partial_ratios([a], [b])[0])


# ------------------------------------------------------------------ best text of a needle, with a bound before the score
_CHARS, _TWOS = 64, 256


def _counts(texts: list[str]) -> np.ndarray:
    """Per text, how often characters and pairs of characters fall into buckets."""
    out = np.zeros((len(texts), _CHARS + _TWOS), np.int32)
    for i, t in enumerate(texts):
        code = _codes(t).astype(np.int64)
        out[i, :_CHARS] = np.bincount(code * 2654435761 % 4294967296 >> 26, minlength=_CHARS)
        out[i, _CHARS:] = np.bincount((code[:-1] * 31 + code[1:]) * 2654435761 % 4294967296 >> 24, minlength=_TWOS)
    return out


def partial_bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper bounds of partial ratios from the counts of both strings, a row per pair.

    A common subsequence has at most the characters that both hold. Every character of the shorter string that it leaves out
    breaks at most two pairs of neighbours, every further character of the window one, so the pairs that both hold bound it as
    well; the ratio is largest where the window is just the subsequence, of a length that need not be whole here.
    """
    low = np.minimum(a, b)
    sizes = np.minimum(a[:, :_CHARS].sum(1), b[:, :_CHARS].sum(1))
    chars, twos = low[:, :_CHARS].sum(1), low[:, _CHARS:].sum(1)
    most = np.minimum(chars, sizes - np.maximum(0, (sizes - 1 - twos) / 2))
    return np.where(sizes + most > 0, 200.0 * most / np.maximum(sizes + most, 1), 100.0)


def best_of(needles: list[str], texts: list[str], groups: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(row of the best text of each group, its score, pairs never scored). Ties go to the lower ``order``; groups count from 0.

    The pair with the highest bound of each group is scored first; the others are scored if their bound reaches it.
    """
    at_needle, at_text = {}, {}
    n = np.array([at_needle.setdefault(x, len(at_needle)) for x in needles])
    t = np.array([at_text.setdefault(x, len(at_text)) for x in texts])
    of_needle, of_text = _counts(list(at_needle)), _counts(list(at_text))
    bounds = np.empty(len(needles))
    for i in range(0, len(needles), 4096):
        bounds[i:i + 4096] = partial_bounds(of_needle[n[i:i + 4096]], of_text[t[i:i + 4096]])
    ranked = np.lexsort((order, -bounds, groups))
    first = ranked[np.r_[True, np.diff(groups[ranked]) != 0]]
    scores = np.full(len(needles), -1.0)
    scores[first] = partial_ratios([needles[i] for i in first], [texts[i] for i in first])
    # scores are rounded by their arithmetic, so a bound a hair below still counts
    rest = np.flatnonzero((scores < 0) & (bounds >= scores[first][groups] - 1e-6) & (bounds > 0))
    scores[rest] = partial_ratios([needles[i] for i in rest], [texts[i] for i in rest])
    ranked = np.lexsort((order, -scores, groups))
    best = ranked[np.r_[True, np.diff(groups[ranked]) != 0]]
    return best, scores[best], int((scores < 0).sum())


def best_in_batches(rows: DataFrame, keys: list[str], order: list[str], needle: str = "q", text: str = "t") -> DataFrame:
    """Per batch and key, the row whose text scores best against its needle, with ``score``; ties go to the lower ``order``."""
    kept = [f for f in rows.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            named = dict(zip(batch.schema.names, batch.columns, strict=True))
            seen: dict[tuple, int] = {}
            groups = np.array([seen.setdefault(k, len(seen)) for k in zip(*(named[k].to_pylist() for k in keys), strict=True)])
            place = np.lexsort(tuple(named[c].to_numpy(zero_copy_only=False) for c in reversed(order)))
            rank = np.empty(len(place), np.int64)
            rank[place] = np.arange(len(place))
            best, scores, _ = best_of(named[needle].to_pylist(), named[text].to_pylist(), groups, rank)
            where = pa.array(best)
            yield pa.RecordBatch.from_arrays([*(named[f.name].take(where) for f in kept), pa.array(scores)], [*(f.name for f in kept), "score"])

    return rows.mapInArrow(run, schema)


@F.pandas_udf(T.DoubleType())
def partial_ratio_udf(needles: pd.Series, texts: pd.Series) -> pd.Series:
    out = np.zeros(len(needles))
    given = np.flatnonzero(needles.notna().to_numpy() & texts.notna().to_numpy())
    out[given] = partial_ratios([needles.iat[i] for i in given], [texts.iat[i] for i in given])
    return pd.Series(out)


@F.pandas_udf(T.BooleanType())
def labels_match_udf(cells: pd.Series, row_label: pd.Series, col_label: pd.Series) -> pd.Series:
    """Whether one of the row's candidate cells carries both labels, each by at least the label threshold."""
    seen: dict[tuple[str, str], bool] = {}

    def close(x: str, y: str) -> bool:
        key = (x, y)
        if key not in seen:
            seen[key] = ratio(x, y) >= LABEL_THRESHOLD
        return seen[key]

    out = []
    for candidates, row, col in zip(cells, row_label, col_label):
        hit = False
        if candidates is not None and row is not None and col is not None:
            hit = any(close(c["row_label"], row) and close(c["col_label"], col) for c in candidates)
        out.append(hit)
    return pd.Series(out, dtype="bool")
