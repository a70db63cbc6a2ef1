"""Prefix trie of conversations by whole-sequence collapse: equal conversations first, then weighted prefixes of what is left."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteloom.operators.ordering import running_sum
from quoteloom.session import cut_lineage

#: Depths that share a bucket of the running fingerprints.
WIDTH = 1024
#: Tasks over which the first nodes of branches that leave the same parent are spread.
SALTS = 16
KEY = ["depth", "pa", "pb"]
_ENDS = "depth long, pa long, pb long, conv_id long, weight long, total long, ends_sha256 string"


def words(text: Column) -> Column:
    """Number of words, which are runs of anything but a space and the five control characters of white space."""
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id``, ``depth`` (1, 2, …), two halves ``ta`` and ``tb`` of the digest of role and text, and ``words`` of the text.

    Turns are numbered by turn (null first), then role, then text; a null role or text is empty. Rows without a conversation are
    left out. Numbers are running sums in two levels, so a conversation with a third of all rows spreads over its buckets, and
    texts are shuffled once.
    """
    named = rows.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.coalesce(F.col(turn_col).cast("long"), F.lit(-(1 << 60))).alias("_turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # equal rows of a turn are told apart by their number among themselves
    named = named.withColumn("_k", F.row_number().over(Window.partitionBy("conv_id", "_turn").orderBy("role", "text")))
    digest = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    half = lambda at: F.conv(F.substr(digest, F.lit(at), F.lit(15)), 16, 10).cast("long")
    named = cut_lineage(named.select("conv_id", "_turn", "_k", half(1).alias("ta"), half(16).alias("tb"), words(F.col("text")).alias("words")))
    counts = running_sum(named.groupBy("conv_id", "_turn").agg(F.count("*").alias("_n")), ["conv_id"], "_turn", F.col("_n"), "_upto")
    return named.join(counts, ["conv_id", "_turn"]).select("conv_id", (F.col("_upto") - F.col("_n") + F.col("_k")).cast("long").alias("depth"), "ta", "tb", "words")


def prefixes(sequences: DataFrame) -> DataFrame:
    """Adds to turns the fingerprint of the prefix that ends there (``pa``, ``pb``) and ``upto``, the words up to and including it.

    A fingerprint is the exclusive or of 128 bits that each depend on depth and turn, so it runs along a conversation in two
    levels, with no conversation gathered. Two different prefixes of one depth would have to agree in all bits.
    """
    mixed = sequences.withColumn("pa", F.xxhash64("depth", "ta", "tb")).withColumn("pb", F.xxhash64("tb", "depth", "ta", F.lit(1)))
    marked = mixed.withColumn("_bucket", F.floor((F.col("depth") - 1) / WIDTH))
    totals = marked.groupBy("conv_id", "_bucket").agg(F.bit_xor("pa").alias("_a"), F.bit_xor("pb").alias("_b"), F.sum("words").alias("_w"))
    before = Window.partitionBy("conv_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv_id", "_bucket", *(F.coalesce(f(c).over(before), F.lit(0)).alias(c) for f, c in ((F.bit_xor, "_a"), (F.bit_xor, "_b"), (F.sum, "_w"))))
    inside = Window.partitionBy("conv_id", "_bucket").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    return marked.select(
        "conv_id", "_bucket", "depth", "words", F.col("pa").alias("ha"), F.col("pb").alias("hb"), F.bit_xor("pa").over(inside).alias("pa"),
        F.bit_xor("pb").over(inside).alias("pb"), F.sum("words").over(inside).alias("upto"),
    ).join(totals, ["conv_id", "_bucket"]).select(
        "conv_id", "_bucket", "depth", "words", "ha", "hb", F.col("pa").bitwiseXOR(F.col("_a")).alias("pa"), F.col("pb").bitwiseXOR(F.col("_b")).alias("pb"),
        (F.col("upto") + F.col("_w")).alias("upto"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by sequence and block into a row per sequence; the lists stream through the digest and are never held whole."""
    names = [part.split()[0] for part in _ENDS.split(", ")]
    now, first, weight, total, sha = None, 0, 0, 0, None
    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key, (_, low, n, words_, ids) = row[:3], row[3:]
            if key != now:
                if sha is not None:
                    out.append((*now, first, weight, total, sha.hexdigest()))
                now, first, weight, total, sha = key, low, 0, words_, hashlib.sha256()
            elif weight:
                sha.update(b",")
            sha.update(ids.encode())
            weight += n
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=_SCHEMA)
    if sha is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*now, first, weight, total, sha.hexdigest()), strict=True))], schema=_SCHEMA)


_SCHEMA = pa.schema([(part.split()[0], pa.string() if part.endswith("string") else pa.int64()) for part in _ENDS.split(", ")])


def collapsed(running: DataFrame, conversations: DataFrame) -> DataFrame:
    """Equal conversations as one weighted sequence: ``depth`` (turns), ``pa``, ``pb``, ``conv_id`` (smallest), ``weight``, ``total`` words, ``ends_sha256``.

    ``conversations``: every ``conv_id``, those without turns too. The numbers of a sequence's conversations are listed in blocks
    of 4,096 neighbouring numbers, so a sequence that a third of all conversations equal is dealt over tasks; then the blocks of
    a sequence stream in order through one digest.
    """
    last = running.groupBy("conv_id").agg(F.max_by(F.struct("depth", "pa", "pb", "upto"), "depth").alias("e"))
    whole = conversations.join(last, "conv_id", "left").select(
        "conv_id", *(F.coalesce(F.col(f"e.{c}"), F.lit(0)).alias(c) for c in KEY), F.coalesce("e.upto", F.lit(0)).alias("total"), F.shiftright("conv_id", 12).alias("block"))
    blocks = whole.groupBy(*KEY, "block").agg(
        F.min("conv_id").alias("low"), F.count("*").alias("n"), F.max("total").alias("words"), F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return blocks.repartition(*KEY).sortWithinPartitions(*KEY, "block").select(*KEY, "block", "low", "n", "words", "ids").mapInArrow(_ends, _ENDS)


def _spread(per_conversation: DataFrame) -> DataFrame:
    """A row per conversation and bucket of its depths, so that joins to its turns are dealt by both; ``depth`` is its number of turns."""
    last = F.greatest(F.floor((F.col("depth") - 1) / WIDTH), F.lit(0))
    return per_conversation.withColumn("_bucket", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("depth")


def nodes(sequences: DataFrame, conversations: DataFrame) -> DataFrame:
    """The trie of ``sequences`` (conv_id, depth, ta, tb, words), one row per distinct prefix, the textless root included.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (over the subtree)
    and ``ends_sha256`` (numbers of the conversations that end there). (conv_id, depth) names a node. Without conversations
    there are no nodes.
    """
    running = cut_lineage(prefixes(sequences))
    whole = cut_lineage(collapsed(running, conversations))
    # one conversation stands for all that equal it; the root is a prefix of depth 0 of each
    columns = ["conv_id", "_bucket", *KEY, "ha", "hb", "words", "upto", "weight", "total"]
    zero = F.lit(0).cast("long")
    paths = running.join(_spread(whole.select("conv_id", "weight", "total", "depth")), ["conv_id", "_bucket"]).select(columns)
    roots = whole.select("conv_id", *(zero.alias(c) for c in columns[1:-2]), "weight", "total")
    rows = cut_lineage(paths.union(roots))
    # words in a prefix's last turn and after it, times conversations: what the subtree would cost without sharing
    rest = F.col("total") - F.col("upto") + F.col("words")
    found = cut_lineage(rows.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum(F.col("weight") * rest).alias("unshared"), F.min("ha").alias("ha"), F.min("hb").alias("hb")))
    above = [(F.col("depth") - 1).alias("depth"), F.col("pa").bitwiseXOR(F.col("ha")).alias("pa"), F.col("pb").bitwiseXOR(F.col("hb")).alias("pb")]
    children = cut_lineage(found.filter("depth > 0").select(*above).groupBy(*KEY).agg(F.count("*").alias("n_children")))
    # a sequence is a leaf unless it is a proper prefix of another
    leaves = whole.join(children, KEY, "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    # where a conversation begins to be the smallest member, it remains so to the end of its path: from its top on
    tops = cut_lineage(found.groupBy("conv_id").agg(F.min_by(F.struct("depth", *above[1:]), "depth").alias("t")).select("conv_id", F.col("t.depth").alias("depth"), "t.pa", "t.pb"))
    starts = rows.join(tops.select("conv_id", "depth"), ["conv_id", "depth"]).select("conv_id", (F.col("upto") - F.col("words")).alias("before_top"))
    marks = _spread(whole.select("conv_id", "depth").join(leaves, "conv_id", "left").join(starts, "conv_id", "left"))
    # every node counts its words once, for the conversation whose part of the trie it is
    once = F.col("total") - F.greatest(F.col("upto") - F.col("words"), F.coalesce("before_top", "total"))
    below = rows.join(marks, ["conv_id", "_bucket"]).groupBy(*KEY).agg(F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.sum(once).alias("once"))
    # the parent of a top belongs to another conversation: looked up, spread over salts, but for the root's children
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")
    asked = tops.filter("depth > 1").select("conv_id", (F.col("depth") - 1).alias("depth"), "pa", "pb", salt.alias("salt"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    parents = found.join(asked.select(*KEY).distinct(), KEY, "left_semi").select(*KEY, F.col("conv_id").alias("parent"), salts)
    tops = tops.select("conv_id", "depth", F.lit(True).alias("is_top")).join(asked.join(parents, [*KEY, "salt"]).select("conv_id", "parent"), "conv_id", "left")
    root = found.filter("depth = 0").first()
    out = found.join(children, KEY, "left").join(whole.select(*KEY, "ends_sha256"), KEY, "left").join(below, KEY).join(tops, ["conv_id", "depth"], "left")
    parent = F.when(F.col("is_top").isNull(), F.col("conv_id")).when(F.col("depth") == 1, F.lit(root["conv_id"] if root else None)).otherwise(F.col("parent"))
    return out.select(
        "conv_id", "depth", parent.cast("long").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves",
        (F.col("unshared") - F.col("once")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def rebuilt(rows: DataFrame, span: int = 20, shared: int = 4, **names: str) -> tuple[DataFrame, DataFrame]:
    """Turns and numbers of conversations whose first turns are those of the conversation at the start of their span of numbers.

    Conversation c takes the first h = crc32(c) mod ``shared`` turns of c - c % ``span`` (fewer if it has fewer, none if there is
    no such conversation), then its own turns after its first h.
    """
    own = cut_lineage(turns(rows, **names))
    conversations = own.select("conv_id").distinct()
    base = F.col("conv_id") - F.expr(f"conv_id % {int(span)}")
    h = F.pmod(F.crc32(F.encode(F.col("conv_id").cast("string"), "utf-8")), F.lit(shared))
    asked = own.groupBy("conv_id").agg(F.max("depth").alias("depth")).select("conv_id", "depth", base.alias("base"), h.alias("h"))
    heads = own.filter((F.expr(f"conv_id % {int(span)}") == 0) & (F.col("depth") < shared)).withColumnRenamed("conv_id", "base")
    lent = asked.drop("depth").join(heads, "base").filter("depth <= h").select("conv_id", "depth", "ta", "tb", "words")
    sizes = heads.groupBy("base").agg(F.count("*").alias("n"))
    taken = _spread(asked.join(sizes, "base", "left").select("conv_id", "depth", "h", F.least(F.coalesce("n", F.lit(0)), F.col("h")).alias("n")))
    bucket = F.floor((F.col("depth") - 1) / WIDTH).alias("_bucket")
    kept = own.select("*", bucket).join(taken, ["conv_id", "_bucket"]).filter("depth > h")
    kept = kept.select("conv_id", (F.col("depth") - F.col("h") + F.col("n")).cast("long").alias("depth"), "ta", "tb", "words")
    return cut_lineage(lent.union(kept)), conversations
