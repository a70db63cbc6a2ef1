"""Exact duplicates through a cuckoo-filter index of live digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.sql.pandas.types import to_arrow_schema

from quoteloom.llm.base import map_batches
from quoteloom.session import cut_lineage

SLOTS, KICKS = 4, 64


class CuckooIndex:
    """Cuckoo filter of 16-bit tags over buckets of four slots; each slot also names its stored entry.

    ``find`` compares tags first and confirms a hit against the stored digest, so answers are exact. ``insert`` moves tags
    between their two buckets; when that takes over KICKS moves the table doubles and is filled anew from the stored digests.
    """

    def __init__(self, buckets: int = 64) -> None:
        self.entries: dict[int, tuple[bytes, list]] = {}  # number → digest, [live count, kept id]
        self._next = 0
        self._table(buckets)

    def _table(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.tags = [[] for _ in range(buckets)]  # of (tag, number)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[:8], "little") & self.mask
        return tag, first, self._other(first, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return (bucket ^ (tag * 0x5BD1E995)) & self.mask

    def find(self, digest: bytes) -> list | None:
        """State of a live digest, or None."""
        tag, first, second = self._places(digest)
        for b in (first, second):
            for t, n in self.tags[b]:
                if t == tag and self.entries[n][0] == digest:
                    return self.entries[n][1]
        return None

    def insert(self, digest: bytes, state: list) -> None:
        number = self._next
        self._next += 1
        self.entries[number] = (digest, state)
        if not self._place(digest, number):
            self._grow()

    def _place(self, digest: bytes, number: int) -> bool:
        tag, b, second = self._places(digest)
        if len(self.tags[b]) >= SLOTS and len(self.tags[second]) < SLOTS:
            b = second
        for kick in range(KICKS):
            if len(self.tags[b]) < SLOTS:
                self.tags[b].append((tag, number))
                return True
            slot = (number + kick) % SLOTS
            (tag, number), self.tags[b][slot] = self.tags[b][slot], (tag, number)
            b = self._other(b, tag)
        return False

    def _grow(self) -> None:
        size = 2 * (self.mask + 1)
        while True:
            self._table(size)
            if all(self._place(d, n) for n, (d, _) in self.entries.items()):
                return
            size *= 2

    def delete(self, digest: bytes) -> bool:
        """Takes a live digest out of the filter and the stored entries."""
        tag, first, second = self._places(digest)
        for b in (first, second):
            for i, (t, n) in enumerate(self.tags[b]):
                if t == tag and self.entries[n][0] == digest:
                    del self.tags[b][i], self.entries[n]
                    return True
        return False

    def add(self, digest: bytes, keep: int, count: int) -> None:
        """Counts ``count`` more live documents of a digest, the largest of them ``keep``."""
        state = self.find(digest)
        if state is None:
            self.insert(digest, [count, keep])
        else:
            state[0] += count
            state[1] = keep if state[1] is None else state[1] if keep is None else max(state[1], keep)

    def remove(self, digest: bytes, keep: int | None, count: int) -> None:
        """Counts ``count`` live documents less; the last one deletes the digest. A lost keeper leaves None, to be settled from the rest."""
        state = self.find(digest)
        if state is not None:
            state[0] -= count
            if state[0] <= 0:
                self.delete(digest)
            elif keep is not None and state[1] is not None and keep >= state[1]:
                state[1] = None

    def rows(self) -> Iterator[tuple[bytes, int, int]]:
        for digest, (count, keep) in self.entries.values():
            yield digest, keep, count


_INDEX = "digest binary, keep_id long, live long"


def _indexed(rows: DataFrame) -> DataFrame:
    """Rows (digest, keep_id, live, sign) gathered per task in an index; sign -1 takes documents away."""
    struct = _parse_datatype_string(_INDEX)
    assert isinstance(struct, StructType)
    arrow = to_arrow_schema(struct)

    def run(batches):
        index = CuckooIndex()
        for batch in batches:
            for digest, keep, live, sign in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sign > 0:
                    index.add(digest, keep, live)
                else:
                    index.remove(digest, keep, live)
        found = list(index.rows())
        for i in range(0, len(found), 50_000):
            part = list(zip(*found[i: i + 50_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(part, arrow, strict=True)], schema=arrow)

    return rows.select("digest", "keep_id", "live", "sign").mapInArrow(run, struct)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``digest``: SHA-256 of the UTF-8 text with A-Z lower-cased; a null text is empty."""

    def run(ids, texts):
        return ids, [hashlib.sha256((t or "").encode().lower()).digest() for t in texts]

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, digest binary")


def build_index(digested: DataFrame) -> DataFrame:
    """Index rows (digest, keep_id = largest id, live = documents with the digest), one per live digest.

    Each task first indexes its own rows, so a digest with a third of all rows crosses the shuffle once per task; the tasks
    behind the shuffle by digest merge those. A task holds the digests of its share only, which more partitions shrink.
    """
    ones = digested.select("digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("live"), F.lit(1).alias("sign"))
    partial = _indexed(ones).withColumn("sign", F.lit(1))
    return _indexed(partial.repartition("digest"))


def update_index(index: DataFrame, added: DataFrame, removed: DataFrame, live: DataFrame) -> DataFrame:
    """Index after documents came and went. ``added``, ``removed`` and ``live`` (all documents after the change) hold id, digest.

    Live digests gain or lose documents; a digest without documents is deleted. Where the kept document went, the largest
    id of ``live`` with that digest takes its place.
    """
    plus = index.select("digest", "keep_id", "live").union(_indexed(added.select("digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("live"), F.lit(1).alias("sign"))))
    minus = removed.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("live"))
    # additions before removals inside a task
    rows = plus.withColumn("sign", F.lit(1)).union(minus.withColumn("sign", F.lit(-1)))
    after = cut_lineage(_indexed(rows.repartition("digest").sortWithinPartitions(F.desc("sign"))))
    open_ = after.filter("keep_id is null").select("digest")
    settled = live.join(open_, "digest", "left_semi").groupBy("digest").agg(F.max("id").alias("_keep"))
    return after.join(settled, "digest", "left").select("digest", F.coalesce("keep_id", "_keep").alias("keep_id"), "live")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id``, ``digest``, ``keep_id``, ``group_size``, ``kept``.

    The row with the largest id of equal texts stays; rows that repeat that id all count as it. A null id is never larger;
    a group of null ids only has a null ``keep_id`` and keeps its rows. An empty table gives an empty one.
    """
    digested = cut_lineage(digests(docs, id_col, text_col))
    index = build_index(digested)
    # ids and digests only: the text is not shuffled, and a hot digest's rows are split by the adaptive skew join
    return digested.join(index, "digest").select(
        "id", "digest", "keep_id", F.col("live").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))
