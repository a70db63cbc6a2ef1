"""Where passages stand in a corpus: a join of positional character runs, without texts on the shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteloom.functions.grams import gram_hashes
from quoteloom.functions.text import norm
from quoteloom.operators.spread import spread_join
from quoteloom.session import cut_lineage

#: Lengths of the runs that passages are laid out in, the longest that fits first.
SIZES = (12, 4, 1)
#: Bits of the set of asked runs that tasks receive: half a megabyte, whatever is asked. Further runs that pass it only cost their rows.
BITS = 22
_TILES = pa.schema([("q_id", pa.string()), ("size", pa.int32()), ("gram", pa.int64()), ("at", pa.int64())])


def tiles(quotes: DataFrame) -> DataFrame:
    """``q_id``, ``size``, ``gram``, ``at``: the runs a passage is laid out in, end to end, the last one ending with it. ``quotes``: q_id, q."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for key, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = next(s for s in SIZES if s <= len(q))
                all_ = np.concatenate([h for _, h in gram_hashes(q, size)])
                at = np.unique(np.append(np.arange(0, len(all_), size), len(all_) - 1))
                out[0] += [key] * len(at)
                out[1] += [size] * len(at)
                out[2] += all_[at].view(np.int64).tolist()
                out[3] += at.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _TILES, strict=True)], schema=_TILES)

    return quotes.select("q_id", "q").mapInArrow(run, "q_id string, size int, gram long, at long")


def _asked_bits(asked: DataFrame) -> np.ndarray:
    """The low bits of all asked runs as a bitmap of fixed size."""
    low = F.col("gram").bitwiseAND(F.lit((1 << BITS) - 1))
    words = asked.groupBy(F.shiftright(low, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(gram & 63 as int))")).alias("v")).toArrow()
    bits = np.zeros(1 << (BITS - 6), np.uint64)
    bits[words.column("w").to_numpy()] = words.column("v").to_numpy().view(np.uint64)
    return bits


def hits(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """``row``, ``doc_id``, ``size``, ``gram``, ``off`` of the runs of the texts that may be asked ones. ``texts``: doc_id and ``t``."""
    sizes = sorted(r["size"] for r in asked.select("size").distinct().collect())  # at most len(SIZES)
    sent = texts.sparkSession.sparkContext.broadcast(_asked_bits(asked))
    schema = pa.schema([("at", pa.int32()), ("size", pa.int32()), ("gram", pa.int64()), ("off", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            for i, t in enumerate(batch.column(2).to_pylist()):
                for size in sizes:
                    for first, h in gram_hashes(t or "", size):
                        low = h & np.uint64((1 << BITS) - 1)
                        k = np.flatnonzero((bits[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1))
                        if len(k):
                            where = pa.array(np.full(len(k), i))
                            yield pa.RecordBatch.from_arrays([
                                batch.column(0).take(where), batch.column(1).take(where), pa.array(np.full(len(k), size, np.int32)), pa.array(h[k].view(np.int64)),
                                pa.array(k + first)], ["row", "doc_id", *schema.names[1:]])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "t").mapInArrow(run, f"row long, doc_id {kind}, size int, gram long, off long")


def passage_locations(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts that contain each passage, both in comparable form: ``quote_id``, ``doc_id``, ``start`` of its first place.

    ``quotes``: quote_id, quote; ``texts``: doc_id, text. A passage is laid out in runs of characters at their offsets. Texts are
    read once and give (run, offset) of the runs asked for. The run of a passage that the texts hold least proposes places;
    a passage stands where all its other runs stand at the same distances. Frequent runs are dealt over tasks. Rows that repeat
    a doc_id are texts of their own; empty passages stand nowhere.
    """
    normed = quotes.select("quote_id", norm("quote").alias("q")).withColumn("q_id", F.md5("q"))
    laid = cut_lineage(tiles(normed.filter("q <> ''").dropDuplicates(["q_id"])))
    found = cut_lineage(hits(texts.select("doc_id", norm("text").alias("t")), laid))
    held = found.groupBy("size", "gram").agg(F.count("*").alias("n"))
    counted = laid.join(held, ["size", "gram"], "left")
    # a passage one of whose runs stands nowhere stands nowhere; the others know all their runs
    asked = counted.groupBy("q_id", "size").agg(
        F.min_by(F.struct("gram", "at"), F.struct("n", "at")).alias("key"), F.collect_list(F.struct("gram", "at")).alias("runs"), F.min(F.coalesce("n", F.lit(0))).alias("least"))
    asked = cut_lineage(asked.filter("least > 0").select("q_id", "size", F.col("key.gram").alias("gram"), F.col("key.at").alias("at"), "runs"))
    places = spread_join(found, asked, ["size", "gram"], ["row", "off"]).withColumn("base", F.col("off") - F.col("at")).filter("base >= 0")
    alone = places.filter(F.size("runs") == 1).select("row", "doc_id", "q_id", "base")
    rest = F.explode(F.filter("runs", lambda r: r["at"] != F.col("at"))).alias("r")
    wanted = places.filter(F.size("runs") > 1).select("row", "q_id", "base", (F.size("runs") - 1).alias("n"), "size", rest).select(
        "row", "q_id", "base", "n", "size", F.col("r.gram").alias("gram"), (F.col("base") + F.col("r.at")).alias("off"))
    stand = wanted.join(found, ["row", "size", "gram", "off"]).groupBy("row", "doc_id", "q_id", "base", "n").agg(F.count("*").alias("_m")).filter("_m = n")
    firsts = alone.union(stand.select("row", "doc_id", "q_id", "base")).groupBy("row", "doc_id", "q_id").agg(F.min("base").alias("start"))
    return normed.select("quote_id", "q_id").join(firsts, "q_id").select("quote_id", "doc_id", F.col("start").cast("int").alias("start"))
