"""Spelling variants of a vocabulary: generated edits are asked of Bloom filters first, and only positives meet the words."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteloom.llm.base import map_batches
from quoteloom.session import cut_lineage

#: Letters of a word; only A-Z are lower-cased, so the capitals from À on are letters of their own.
LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
RUN = re.compile("[A-Za-zÀ-ÿ]+")
_OTHER = re.compile("[^A-Za-zÀ-ÿ]")
#: Least length and occurrences of a word; one word in DAMAGE of a document loses a letter; a form is at least RATIO times as frequent.
LEAST, OCCURS, DAMAGE, RATIO = 6, 5, 199, 5
#: Bits of a filter for every word, and blocks of 64 bits of all filters together at most: 16 MiB are sent to the tasks whatever the vocabulary.
BITS, MAX_BLOCKS = 20, 1 << 21
#: Words of this length and longer share a filter.
LONGEST = 48

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_PIECE, _HELD, _CELLS = 1 << 20, 200_000, 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int = DAMAGE) -> DataFrame:
    """``word`` and ``n``: the letter runs of all texts, damaged where the checksum of document and run says so.

    A task counts before the shuffle, in parts of bounded size; long texts are read in pieces that end between runs. Null texts
    have no words; a null id counts as an empty one.
    """
    columns = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text")).filter("text is not null")

    def out(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seed = zlib.crc32(f"{key}:".encode())
                for piece in pieces(text):
                    for word, n in Counter(RUN.findall(piece.encode().translate(_LOWER).decode())).items():
                        h = zlib.crc32(word.encode(), seed)
                        if h % damage == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                        held[word] += n
                if len(held) > _HELD:
                    yield out(held)
                    held = Counter()
        if held:
            yield out(held)

    return columns.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pieces(text: str, size: int = _PIECE) -> Iterator[str]:
    """Parts of a text of about ``size`` code points that end before something that is no letter."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            stop = _OTHER.search(text, end)
            end = stop.start() if stop else len(text)
        yield text[at:end]
        at = end


def _values() -> np.ndarray:
    """A 64-bit value for every code point below 256."""
    with np.errstate(over="ignore"):
        x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
        x ^= x >> np.uint64(32)
        return x * np.uint64(0xBF58476D1CE4E5B9)


_VALUE = _values()


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    with np.errstate(over="ignore"):
        out[1:] = np.cumprod(np.full(n - 1, _BASE, np.uint64)) if n > 1 else out[1:]
    return out


def _codes(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


class Filters:
    """Where words of a length keep their bits: one block of 64 bits by hash, four bits in it by the same hash."""

    def __init__(self, counts: dict[int, int]) -> None:
        wanted = {k: max(1, math.ceil(n * BITS / 64)) for k, n in counts.items()}
        shrink = min(1.0, (MAX_BLOCKS - len(wanted)) / max(1, sum(wanted.values())))
        self.size, self.start, at = {}, {}, 0
        for k in sorted(wanted):
            self.size[k], self.start[k] = max(1, int(wanted[k] * shrink)), at
            at += self.size[k]
        self.blocks = at

    def places(self, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        shard = min(length, LONGEST)
        with np.errstate(over="ignore"):
            x = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(29)
        block = ((x >> np.uint64(40)) * np.uint64(self.size[shard]) >> np.uint64(24)).astype(np.int64) + self.start[shard]
        mask = np.zeros(hashes.shape, np.uint64)
        for j in range(4):
            mask |= np.uint64(1) << ((x >> np.uint64(6 * j)) & np.uint64(63))
        return block, mask


def _by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(len(w), []).append(i)
    return out


def hashed(codes: np.ndarray) -> np.ndarray:
    """A polynomial over the code points, which an edit changes in one term or shifts."""
    with np.errstate(over="ignore"):
        return (_VALUE[codes] * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


def edits(words: list[str], filters: Filters, bits: np.ndarray, letters: list[int]) -> Iterator[tuple[int, str]]:
    """(index, edited word) of one length for the edits that the filters let pass.

    Near words are found from one side: a replacement by a later letter, or a deletion, once for each run of equal letters.
    """
    length = len(words[0])
    step = max(1, _CELLS // length)
    for at in range(0, len(words), step):
        part = words[at:at + step]
        codes = _codes(part)
        with np.errstate(over="ignore"):
            powers = _powers(length)
            terms = _VALUE[codes] * powers
            whole = terms.sum(axis=1, dtype=np.uint64)[:, None]
            if min(length, LONGEST) in filters.size:
                for letter in letters:
                    rows, cols = np.nonzero(codes < letter)
                    asked = whole[rows, 0] + _VALUE[letter] * powers[cols] - terms[rows, cols]
                    block, mask = filters.places(asked, length)
                    for k in np.flatnonzero(bits[block] & mask == mask):
                        i, j = int(rows[k]), int(cols[k])
                        yield at + i, part[i][:j] + chr(letter) + part[i][j + 1:]
            if length > LEAST and min(length - 1, LONGEST) in filters.size:
                upto = np.cumsum(terms, axis=1, dtype=np.uint64)
                first = np.ones(codes.shape, bool)
                first[:, 1:] = codes[:, 1:] != codes[:, :-1]
                rows, cols = np.nonzero(first)
                before = upto[rows, cols] - terms[rows, cols]
                asked = before + (whole[rows, 0] - upto[rows, cols]) * np.uint64(_INVERSE)
                block, mask = filters.places(asked, length - 1)
                for k in np.flatnonzero(bits[block] & mask == mask):
                    i, j = int(rows[k]), int(cols[k])
                    yield at + i, part[i][:j] + part[i][j + 1:]


def near(vocabulary: DataFrame) -> DataFrame:
    """All near pairs of ``vocabulary`` (word, n), both ways: ``word``, ``n``, ``near``, ``near_n``. Words are distinct and of LEAST letters or more.

    The filters are built by the tasks (bits of a block are one partial aggregate) and are at most MAX_BLOCKS blocks; a larger
    vocabulary gets more false positives, which the join with its words removes, and never loses a pair.
    """
    lengths = vocabulary.groupBy(F.least(F.char_length("word"), F.lit(LONGEST)).alias("k")).agg(F.count("*").alias("n")).collect()
    filters = Filters({r["k"]: r["n"] for r in lengths})
    used = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect()
    letters = sorted(ord(r["c"]) for r in used if r["c"])

    def places(words: list[str]):
        blocks, masks = np.zeros(len(words), np.int64), np.zeros(len(words), np.uint64)
        for length, at in _by_length(words).items():
            blocks[at], masks[at] = filters.places(hashed(_codes([words[i] for i in at])), length)
        return pa.array(blocks), pa.array(masks.view(np.int64))

    found = map_batches(vocabulary.select("word"), places, "block long, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(max(1, filters.blocks), np.uint64)
    bits[found.column("block").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    sent = vocabulary.sparkSession.sparkContext.broadcast(bits)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1)
            for at in _by_length(words).values():
                for lot in range(0, len(at), 2048):
                    chosen = at[lot:lot + 2048]
                    hits = list(edits([words[i] for i in chosen], filters, sent.value, letters))
                    if hits:
                        rows = pa.array([chosen[i] for i, _ in hits])
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), counts.take(rows), pa.array([w for _, w in hits], pa.string())], ["word", "n", "near"])

    asked = vocabulary.select("word", "n").mapInArrow(ask, "word string, n long, near string")
    pairs = cut_lineage(asked.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n"))
    return pairs.union(pairs.select("near", "near_n", "word", "n"))


def grouped(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of a vocabulary of distinct words.

    The form is the most frequent near word (ties: the smaller) if it is at least ``ratio`` times as frequent. Counts grow along
    forms, so their chains end and are short; roots are found by doubling, as often as the largest count can need.
    """
    vocabulary = cut_lineage(vocabulary)
    best = near(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("b"))
    is_form = -F.col("b.minus") >= ratio * F.col("n")
    formed = cut_lineage(vocabulary.join(best, "word", "left").select(
        "word", F.when(is_form, F.col("b.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("b.minus")).alias("form_n")))
    top = vocabulary.agg(F.max("n")).first()[0] or 1
    steps = cut_lineage(formed.filter("form is not null").select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(max(1.0, math.log(top, ratio) + 1)))):
        steps = cut_lineage(steps.join(steps.select(F.col("word").alias("root"), F.col("root").alias("_up")), "root", "left").select("word", F.coalesce("_up", "root").alias("root")))
    return formed.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spelling groups of the words of ``docs``: those of LEAST letters or more that occur OCCURS times or more.

    Rows that repeat an id are texts like others; an empty table, or one of empty and null texts, gives no words.
    """
    return grouped(counted(docs, id_col, text_col).filter((F.char_length("word") >= LEAST) & (F.col("n") >= OCCURS)))
