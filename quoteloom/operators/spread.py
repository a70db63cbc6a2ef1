"""Equi-joins in which a frequent key is dealt over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys are counted by so many buckets of their hash; a bucket with over one row in SHARE is hot, so SHARE buckets are at most.
BUCKETS, SHARE = 1 << 12, 256
#: Parts over which the rows of a hot bucket are dealt.
PARTS = 32
#: A right side of at most so many bytes, as counted before the join, goes to every task, and the left side is not shuffled.
BROADCAST_BYTES = 32 << 20


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def hot_buckets(rows: DataFrame, keys: list[str]) -> list[int]:
    """Buckets of the keys' hash that hold over one row in SHARE; the list is short whatever the table.

    The counts are partial aggregates of at most BUCKETS groups.
    """
    counts = rows.filter(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(_bucket(keys).alias("b")).agg(F.count("*").alias("n"))
    top = counts.agg(F.sum("n").alias("total"), F.slice(F.sort_array(F.collect_list(F.struct("n", "b")), False), 1, SHARE).alias("most")).first()
    return [m["b"] for m in top["most"] if m["n"] * SHARE > top["total"]]


def size_of(rows: DataFrame) -> int:
    """Bytes of the texts and 16 for every value of a table: one partial aggregate."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) for f in rows.schema.fields if not isinstance(f.dataType, T.NumericType)]
    each = sum(texts, F.lit(16 * len(rows.columns))).cast("long")
    return rows.agg(F.sum(each)).first()[0] or 0


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], how: str = "inner", hot: list[int] | None = None, may_be_small: bool = True) -> DataFrame:
    """``left`` joined to ``right`` on ``keys``, whatever keys are frequent (inner, left, left_semi or left_anti).

    A right side within BROADCAST_BYTES is sent to all tasks, which its size is counted for unless it ``may_be_small`` is false. Beyond
    that, left rows of a hot bucket are dealt over PARTS by a hash of ``by``, and the right rows of hot buckets alone are repeated,
    once per part, so the result is that of the plain join. Both sides tell a hot bucket from the same short list.
    """
    if may_be_small and size_of(right) <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), keys, how)
    hot = hot_buckets(left, keys) if hot is None else hot
    if not hot:
        return left.join(right, keys, how)
    is_hot = _bucket(keys).isin(hot)
    dealt = left.withColumn("_part", F.when(is_hot, F.pmod(F.xxhash64(*by), F.lit(PARTS)).cast("int")).otherwise(F.lit(0)))
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(right.withColumn("_part", F.explode(every)), [*keys, "_part"], how).drop("_part")
