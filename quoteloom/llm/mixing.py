"""Mixing sources to target weights by weighted fair queueing: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.operators.ordering import in_ranges, ranged_sums
from quoteloom.session import cut_lineage

#: Weights of the sources in their order, repeating.
WEIGHTS = (1, 2, 3)
#: A document is taken at most so many times, so a source's target is at most so many times its size.
EPOCHS = 3


def words(text: Column) -> Column:
    """Number of words, which are runs of anything but a space and the five control characters of white space; null has none."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Adds ``number`` (order of the sources by code point, null last), ``weight``, ``cap`` and ``target`` to rows of ``source`` (a struct of one) and ``source_size``.

    The targets share the sum of all sizes by weight; what exceeds ``epochs`` times a source's size is shared again among the
    rest. Sources in the order of cap over weight are capped up to a point, so two running sums over sampled ranges of sources
    find the share of a unit of weight at once, whatever the number of sources.
    """
    name = F.col("source.source")
    dealt = in_ranges(sources, [F.asc_nulls_last(name)])
    order = ranged_sums(dealt.withColumn("_one", F.lit(1)), ["_one"], [F.asc_nulls_last(name)], {"number": F.lit(1)})
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = order.select("source", "source_size", "number", weight.cast("long").alias("weight"), (F.col("source_size") * epochs).alias("cap"), F.lit(1).alias("_one"))
    # whole numbers of 38 digits keep the comparisons exact
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    ratio = [(F.col("cap") / F.col("weight")), F.col("number")]
    ranked = ranged_sums(in_ranges(weighed, ratio), ["_one"], ratio, {"caps": F.col("cap"), "weights": F.col("weight")})
    ranked = cut_lineage(ranked)
    total = ranked.agg(F.sum("source_size").alias("b"), F.sum("weight").alias("w")).first()
    budget, all_weights = total["b"] or 0, total["w"] or 0
    before = lambda c, of: exact(c) - exact(of)
    full = (F.lit(budget).cast("decimal(19,0)") - before("caps", "cap")) * exact("weight") > exact("cap") * (F.lit(all_weights).cast("decimal(19,0)") - before("weights", "weight"))
    ranked = ranked.withColumn("full", full)
    held = ranked.filter("full").agg(F.sum("cap").alias("c"), F.sum("weight").alias("w")).first()
    left, free = budget - (held["c"] or 0), all_weights - (held["w"] or 0)
    share = F.col("weight") * F.lit(left).cast("double") / F.lit(max(free, 1)).cast("double")
    return ranked.select("source", "source_size", "number", "weight", "cap", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def queued(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS,
           size: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents in the order of their sources' queues, the schedule of what the mix takes).

    Documents: ``id``, ``size``, ``source`` (a struct of one), ``source_size``, ``target``, ``start`` (words before it in its source's shuffled queue).
    A queue is passed up to ``epochs`` times. A copy's virtual finish time is the source's words up to its end over the source's
    target; the copy in which the target falls is cut there, so a long document holds nobody up.

    Schedule: ``source``, ``epoch``, ``id``, ``first`` (word of the document), ``taken`` (words), ``finish``, ``position`` (words of the mix before it), in the
    global order of finish times, cut at the sum of all sizes. ``size`` is a column of token counts, words by default.
    """
    length = words(F.col(text_col)) if size is None else F.greatest(F.coalesce(size, F.lit(0)).cast("long"), F.lit(0))
    # the shuffle: by the digest of the id, which reruns and other engines repeat
    shuffle = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    sized = docs.select(F.col(id_col).alias("id"), F.struct(F.col(source_col).alias("source")).alias("source"), length.alias("size"), shuffle.alias("_shuffle"))
    inside = [F.col("_shuffle"), F.asc_nulls_first("id"), F.col("size")]
    dealt = in_ranges(sized, [F.col("source.source"), *inside], "_part")
    # a source has one row per range, so its documents meet its figures spread over ranges
    parts = dealt.groupBy("_part", "source").agg(F.sum("size").alias("_size"), F.count("*").alias("_n"))
    sources = cut_lineage(targets(parts.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, epochs))
    figures = parts.select("_part", "source").join(sources, "source")
    placed = ranged_sums(dealt, ["source"], inside, {"_upto": F.col("size"), "row": F.lit(1)}, "_part")
    rows = cut_lineage(placed.join(figures, ["_part", "source"]).select(
        "_part", "source", "number", "source_size", "target", "id", "row", "size", (F.col("_upto") - F.col("size")).alias("start")))
    n = sources.count()
    budget = sources.agg(F.sum("source_size")).first()[0] or 0
    # rounding leaves less than a word of every source, which at most so many words past the targets make up
    goal = F.floor("target").cast("long")
    copies = rows.filter("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("from", F.col("epoch") * F.col("source_size") + F.col("start"))
    cuts = F.array_compact(F.array(
        F.when(F.col("from") < goal, F.struct(F.col("from"), F.least(F.col("from") + F.col("size"), goal).alias("to"))),
        F.when((F.col("from") + F.col("size") > goal) & (F.col("from") < goal + n), F.struct(F.greatest("from", goal).alias("from"), (F.col("from") + F.col("size")).alias("to")))))
    pieces = copies.withColumn("cut", F.explode(cuts)).select(
        "source", "number", "epoch", "id", "row", (F.col("cut.from") - F.col("from")).alias("first"), (F.col("cut.to") - F.col("cut.from")).alias("words"), F.col("cut.to").alias("to"),
        (F.col("cut.to") / F.col("target")).alias("finish"))
    order = [F.col("finish"), F.col("number"), F.col("to")]
    lined = ranged_sums(in_ranges(pieces, order, "_slot").withColumn("_all", F.lit(1)), ["_all"], order, {"_end": F.col("words")}, "_slot")
    position = F.col("_end") - F.col("words")
    schedule = lined.filter(position < budget).select(
        "source", "epoch", "id", "row", "first", F.least(F.col("words"), F.lit(budget) - position).alias("taken"), "finish", position.alias("position"))
    return rows, cut_lineage(schedule)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS,
          size: Column | None = None) -> DataFrame:
    """``id``, ``size``, ``source``, ``source_size``, ``target`` and ``taken`` (words the mix takes, repeats counted) of every row.

    What a source gives is the head of its repeated queue, so its sum tells what each document gives. Null texts have no words;
    null sources are one source, the last; null or repeated ids are rows like others, ordered by size among themselves; a source
    without words has target 0; an empty table gives an empty one.
    """
    rows, schedule = queued(docs, id_col, text_col, source_col, weights, epochs, size)
    gave = schedule.groupBy("source").agg(F.sum("taken").alias("_gave"))
    per_part = rows.select("_part", "source").distinct().join(gave, "source", "left").fillna(0, ["_gave"])
    start = lambda e: F.lit(e) * F.col("source_size") + F.col("start")
    given = [F.greatest(F.least(F.col("_gave") - start(e), F.col("size")), F.lit(0)) for e in range(epochs)]
    taken = given[0]
    for more in given[1:]:
        taken = taken + more
    return rows.join(per_part, ["_part", "source"]).select("id", "size", F.col("source.source").alias("source"), "source_size", "target", taken.alias("taken"))
