"""Benchmark passages in documents: winnowed fingerprints propose places, the words around them decide."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.llm.base import bitmap, map_batches
from quoteloom.session import cut_lineage

#: Words of a window; grams of GRAM words are winnowed over WINDOW - GRAM + 1 places, so every shared window holds a chosen gram.
WINDOW, GRAM = 13, 5
#: Fixed size of the bitmap of benchmark fingerprints that all tasks get (bits, as a power of two). It only spares rows.
BITMAP = 22
_SEGMENT = 1 << 22

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[0x30:0x3A] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x80:] = True
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=2)
def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _segment(low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = _IN_WORD[low]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    lengths = ends - starts
    at = np.flatnonzero(inside)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    longest = 1 << max(10, int(lengths.max() - 1).bit_length())
    value = (low[at].astype(np.uint64) + np.uint64(1)) * _powers(longest)[np.arange(len(at)) - np.repeat(first, lengths)]
    return starts, ends, _mixed(np.add.reduceat(value, first))


def word_hashes(low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of lower-cased UTF-8, in segments cut between words."""
    parts, at = [], 0
    while at < len(low):
        end = min(len(low), at + _SEGMENT)
        while end < len(low) and _IN_WORD[low[end]]:
            end += 1
        s, e, h = _segment(low[at:end])
        parts.append((s + at, e + at, h))
        at = end
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k words in a row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p, out = _powers(1024), np.zeros(n, np.uint64)
    for j in range(k):
        out += h[j: j + n] * p[j + 1]
    return _mixed(out)


def winnowed(h: np.ndarray, owner: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(places, grams' hashes) of the grams with the smallest hash in some window of one owner; the last of equal ones."""
    g = gram_hashes(h, gram)
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    best, place = g[:n].copy(), np.arange(n)
    for j in range(1, window - gram + 1):
        other = g[j: j + n]
        take = other <= best
        np.copyto(best, other, where=take)
        np.copyto(place, np.arange(j, j + n), where=take)
    at = np.unique(place[owner[:n] == owner[window - 1:]])
    return at, g[at]


def fingerprints_of(texts: list[str | None], short: list[int], keep: dict[int, np.ndarray] | None, window: int = WINDOW, gram: int = GRAM):
    """For each text (number of words, its fingerprints as (length, hash, place, centre, words around)).

    ``short``: lengths under the window for which every run of that many words is a fingerprint (of items: only the whole
    item). ``keep``: bitmaps by length that a fingerprint must be in; None keeps all and treats the texts as items.
    """
    data = [(t or "").encode() for t in texts]
    sizes = np.array([len(d) + 1 for d in data])
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    low = _LOWER[np.frombuffer(b"\n".join(data) + b"\n", np.uint8)]
    starts, ends, h = word_hashes(low)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    counts = np.bincount(owner, minlength=len(texts)) if len(texts) else np.zeros(0, int)
    first = np.concatenate(([0], np.cumsum(counts)))
    raw = low.tobytes()
    out = [[] for _ in texts]

    def found(length: int, at: np.ndarray, hashes: np.ndarray, before: int, after: int) -> None:
        if keep is not None and len(at):
            low_bits = hashes & np.uint64((1 << BITMAP) - 1)
            hit = keep[length][(low_bits >> np.uint64(6)).astype(np.int64)] >> (low_bits & np.uint64(63)) & np.uint64(1)
            at, hashes = at[hit == 1], hashes[hit == 1]
        for p, v in zip(at.tolist(), hashes.view(np.int64).tolist(), strict=True):
            d = int(owner[p])
            a, b = max(int(first[d]), p - before), min(int(first[d + 1]), p + after + 1)
            around = b" ".join(raw[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True))
            out[d].append((length, v, p - int(first[d]), p - a, around.decode()))

    if keep is None or window in keep:
        at, hashes = winnowed(h, owner, window, gram)
        found(window, at, hashes, window - gram, window - 1)
    for n in short:
        g = gram_hashes(h, n)
        at = np.flatnonzero(owner[: len(g)] == owner[n - 1:]) if len(g) else np.zeros(0, np.int64)
        if keep is None:
            at = at[counts[owner[at]] == n]
        found(n, at, g[at], 0, n - 1)
    return counts.tolist(), out


_PRINT = "struct<length: int, hash: long, place: long, centre: int, around: string>"
_CHUNK = 1 << 20


def _mapped(df: DataFrame, short: list[int], keep: dict[int, np.ndarray] | None, window: int, gram: int) -> DataFrame:
    """``df``: id, text. Gives id, n_words, prints; texts are handled about a megabyte at a time."""

    def run(ids, texts):
        n_words, prints, part, size = [], [], [], 0
        for i, t in enumerate(texts):
            part.append(t)
            size += len(t or "")
            if size >= _CHUNK or i == len(texts) - 1:
                n, p = fingerprints_of(part, short, keep, window, gram)
                n_words += n
                prints += [[dict(zip(("length", "hash", "place", "centre", "around"), x, strict=True)) for x in f] for f in p]
                part, size = [], 0
        return ids, pa.array(n_words, pa.int64()), prints

    return map_batches(df, run, f"id {df.schema['id'].dataType.simpleString()}, n_words long, prints array<{_PRINT}>")


def _runs(doc_words: str, doc_centre: int, item_words: str, item_centre: int, length: int, window: int) -> tuple[int, int] | None:
    """Words before and after the fingerprint's first word on which document and item agree, if they make a window."""
    a, b = doc_words.split(" "), item_words.split(" ")
    if length < window:
        return (0, length - 1) if a == b else None
    left = right = 0
    while left < doc_centre and left < item_centre and a[doc_centre - left - 1] == b[item_centre - left - 1]:
        left += 1
    if a[doc_centre] != b[item_centre]:
        return None
    while doc_centre + right + 1 < len(a) and item_centre + right + 1 < len(b) and a[doc_centre + right + 1] == b[item_centre + right + 1]:
        right += 1
    return (left, right) if left + right + 1 >= window else None


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``id``, ``n_words``, ``n_hit``, ``items`` (ids of items with an occurring window) and ``spans`` (hit runs of words) per row of ``docs``.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. Both sides are
    winnowed alike, so a shared window has a chosen gram at the same place on both sides; the words around that gram travel
    with it and decide, hence no window is missed and none is made up. Only grams in a bitmap of fixed size leave a document.
    Null and empty texts have no words; rows that repeat an id share their hits; ids may be null; empty tables give no hits.
    """
    items = benchmark.select(F.col(item_col).alias("id"), F.col(item_text).alias("text"))
    every = list(range(1, window))
    item_prints = cut_lineage(_mapped(items, every, None, window, gram).select(F.col("id").alias("item"), F.explode("prints").alias("p")).select("item", "p.*"))
    lengths = [r[0] for r in item_prints.select("length").distinct().collect()]  # at most `window` values
    keep = {}
    for n in lengths:
        bits = np.zeros(1 << (BITMAP - 6), np.uint64)
        for w, v in bitmap(item_prints.filter(F.col("length") == n), "hash", BITMAP):
            bits[w] = np.uint64(v & 0xFFFFFFFFFFFFFFFF)
        keep[n] = bits
    whole = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    read = cut_lineage(_mapped(whole, sorted(n for n in lengths if n < window), keep, window, gram))
    doc_prints = read.select("id", F.explode("prints").alias("p")).select("id", "p.length", "p.hash", F.col("p.place").alias("at"), F.col("p.centre").alias("c"), F.col("p.around").alias("a"))
    # the same words around the same gram decide alike wherever they stand: one comparison each
    asked = doc_prints.select("length", "hash", "c", "a").distinct()
    pairs = asked.join(item_prints.select("item", "length", "hash", F.col("centre").alias("ic"), F.col("around").alias("ia")), ["length", "hash"])

    def decide(length, hash_, c, a, item, ic, ia):
        runs = [_runs(x, p, y, q, n, window) for n, x, p, y, q in zip(length, a, c, ia, ic, strict=True)]
        return length, hash_, c, a, item, [r and r[0] for r in runs], [r and r[1] for r in runs]

    kind = benchmark.schema[item_col].dataType.simpleString()
    agreed = map_batches(pairs.select("length", "hash", "c", "a", "item", "ic", "ia"), decide, f"length int, hash long, c int, a string, item {kind}, before int, after int").filter("before is not null")
    told = agreed.groupBy("length", "hash", "c", "a").agg(F.max("before").alias("before"), F.max("after").alias("after"), F.collect_set("item").alias("items"), F.collect_set(F.struct("before", "after")).alias("runs"))
    hits = doc_prints.join(told, ["length", "hash", "c", "a"]).select("id", "items", F.explode("runs").alias("r"), "at").select(
        "id", "items", (F.col("at") - F.col("r.before")).alias("s"), (F.col("at") + F.col("r.after") + 1).alias("e"))
    per = hits.groupBy("id").agg(F.collect_set(F.struct("s", "e")).alias("_runs"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("_items"))
    per = per.select(F.col("id").alias("_id"), "_items", merged(F.col("_runs")).alias("_spans"))
    joined = read.select("id", "n_words").join(per, F.col("id").eqNullSafe(F.col("_id")), "left")
    spans = F.coalesce("_spans", F.array().cast("array<struct<s: bigint, e: bigint>>"))
    return joined.select(
        "id", "n_words", F.aggregate(spans, F.lit(0).cast("long"), lambda t, x: t + x["e"] - x["s"]).alias("n_hit"),
        F.coalesce("_items", F.array().cast(f"array<{kind}>")).alias("items"), spans.alias("spans"))


def contaminated(n_words: Column, n_hit: Column) -> Column:
    """Hit, and a twentieth of the words or more."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    found = contamination(docs, benchmark, id_col, text_col, item_col, item_text).filter(contaminated(F.col("n_words"), F.col("n_hit")))
    bad = found.select(F.col("id").alias("_ql_id")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(F.col("_ql_id")), "left_anti")


def merged(runs: Column) -> Column:
    """Overlapping or touching runs (s, e) joined, in order."""
    kind = "array<struct<s: bigint, e: bigint>>"
    one = lambda x: F.array(F.struct(x["s"].alias("s"), x["e"].alias("e")))
    tail = lambda acc: F.element_at(acc, -1)
    joined = lambda acc, x: F.concat(
        F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(tail(acc)["s"].alias("s"), F.greatest(tail(acc)["e"], x["e"]).alias("e"))))
    return F.aggregate(
        F.array_sort(runs), F.array().cast(kind),
        lambda acc, x: F.when(F.size(acc) == 0, one(x)).when(x["s"] <= tail(acc)["e"], joined(acc, x)).otherwise(F.concat(acc, one(x))).cast(kind))
