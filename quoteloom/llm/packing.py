"""Best-fit packing of documents into training sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.llm.base import map_batches
from quoteloom.session import cut_lineage

#: Permitted sequence lengths in tokens.
LENGTHS = (2048, 4096, 8192, 16384)
#: About so many documents are packed together; a group is one small task and groups are independent.
GROUP = 8192
#: Cost of a sequence: a fixed part (padding, launch), its tokens, and attention's square over SQUARE.
FIXED, SQUARE = 64, 65536


def cost(length: int) -> float:
    return FIXED + length + length * length / SQUARE


def byte_tokens(text: Column) -> Column:
    """Tokens of a byte-level model: one per UTF-8 byte and one that ends the document."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def vocabulary_tokens(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``n_tokens`` (one more, for the end) under a byte-pair vocabulary file of base64 tokens and ranks; ``vocabulary`` is a path that executors see."""

    def run(ids, texts):
        import base64

        import tiktoken

        if "coder" not in state:
            with open(vocabulary, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            state["coder"] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return ids, [len(state["coder"].encode_ordinary(t or "")) + 1 for t in texts]

    state: dict = {}
    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, n_tokens long")


def fitted(sizes: Sequence[int], lengths: Sequence[int], price: Callable[[int], float] = cost) -> list[tuple[int, int]]:
    """(bin, offset) of every piece; no piece is over the longest length. Pieces come longest first, ties by position.

    A piece goes to the open bin it leaves least room in. Where none has room, a permitted length is opened: in one trial for
    every length that one (a longer piece: the next that holds it), in the others, one for every longest length to open, that
    which costs least per token it can still get. Bins of a trial are merged while a merged, downsized bin costs less than its
    two parts, and the cheapest outcome of all is taken, so the lengths are weighed together.
    """
    lengths = sorted(lengths)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    best: tuple[float, list[int]] | None = None
    for longest in lengths:
        for fixed in (True, False):
            home, used, room = [0] * len(sizes), [], []  # room: sorted (left, bin)
            waiting = sum(sizes)
            for i in order:
                s = sizes[i]
                at = bisect_left(room, (s, -1))
                if at < len(room):
                    left, b = room.pop(at)
                else:
                    fits = [x for x in lengths if x >= s]
                    some = [x for x in fits if x <= longest] or fits[:1]
                    left = some[-1] if fixed else min(some, key=lambda x: (price(x) / max(1, min(x, waiting)), x))
                    b = len(used)
                    used.append(0)
                home[i] = b
                used[b] += s
                waiting -= s
                if left > s:
                    insort(room, (left - s, b))
            into, total = merged(used, lengths, price)
            if best is None or total < best[0]:
                best = total, [into[b] for b in home]
    assert best is not None
    numbers: dict[int, int] = {}
    filled: list[int] = []
    placed = [(0, 0)] * len(sizes)
    for i in order:
        b = numbers.setdefault(best[1][i], len(filled))
        if b == len(filled):
            filled.append(0)
        placed[i] = (b, filled[b])
        filled[b] += sizes[i]
    return placed


def merged(used: Sequence[int], lengths: Sequence[int], price: Callable[[int], float]) -> tuple[list[int], float]:
    """(the bin each bin goes into, cost of all) when bins are merged with those that save most, fullest first.

    For every length a bin could have, the fullest bin that still fits is a candidate, so a round takes a search per length.
    """
    paid = {u: price(downsized(u, lengths)) for u in set(used)}
    into, total = list(range(len(used))), sum(paid[u] for u in used)
    todo = sorted((u, b) for b, u in enumerate(used))
    while todo:
        u, b = todo.pop()
        best: tuple[float, int] | None = None
        for length in lengths:
            at = bisect_left(todo, (length - u + 1, -1)) - 1
            if length > u and at >= 0:
                both = u + todo[at][0]
                saved = price(downsized(u, lengths)) + price(downsized(todo[at][0], lengths)) - price(downsized(both, lengths))
                if saved > 1e-9 and (best is None or saved > best[0]):
                    best = saved, at
        if best is not None:
            v, other = todo.pop(best[1])
            into[other] = b
            total -= best[0]
            insort(todo, (u + v, b))
    for b in range(len(into)):
        at = b
        while into[at] != at:
            at = into[at]
        into[b] = at
    return into, total


def downsized(used: int, lengths: Sequence[int]) -> int:
    """The shortest permitted length that holds a bin's tokens."""
    return min(x for x in lengths if x >= used)


def packed(docs: DataFrame, tokens: Column | None = None, lengths: Sequence[int] = LENGTHS, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """One row per piece: ``id``, ``row`` (number of the input row), ``piece``, ``start`` and ``n_tokens`` (of the piece in its
    document), ``bin_group``, ``bin``, ``bin_offset``, ``bin_tokens``, ``bin_length``.

    A document over the longest length is cut into full pieces, which fill a bin each, and a rest; every token is in exactly
    one piece. Ids and lengths alone are shuffled, in groups of about ``group`` rows dealt by a hash of the row, so no key can
    make a group large. ``tokens`` is a column over ``docs`` of each row's token count, byte tokens by default; null or under
    one counts as one, the end of the document. Null texts are empty; rows that repeat an id are packed one by one; an empty
    table gives an empty one.
    """
    assert all(x > 0 for x in lengths)
    count = byte_tokens(F.col(text_col)) if tokens is None else tokens
    longest = max(lengths)
    sized = cut_lineage(docs.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(count, F.lit(1)).cast("long"), F.lit(1)).alias("n"), F.monotonically_increasing_id().alias("row")))
    groups = max(1, -(-sized.count() // group))
    full = F.floor((F.col("n") - 1) / longest).cast("long")  # full pieces; the rest holds at least the end
    kind = sized.schema["id"].dataType.simpleString()
    rests = sized.select("id", "row", full.alias("piece"), (full * longest).alias("start"), (F.col("n") - full * longest).alias("n_tokens"),
                         F.pmod(F.xxhash64("row"), F.lit(groups)).alias("bin_group"))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", kind="stable")
        sizes = rows["n_tokens"].tolist()
        placed = fitted(sizes, lengths)
        rows["bin"], rows["bin_offset"] = [b for b, _ in placed], [o for _, o in placed]
        used = rows.groupby("bin")["n_tokens"].sum()
        rows["bin_tokens"] = rows["bin"].map(used)
        rows["bin_length"] = rows["bin"].map({b: downsized(int(u), lengths) for b, u in used.items()})
        return rows

    columns = "id {0}, row long, piece long, start long, n_tokens long, bin_group long, bin long, bin_offset long, bin_tokens long, bin_length long".format(kind)
    packed_rests = rests.groupBy("bin_group").applyInPandas(place, columns)
    # a full piece is a bin of its own; its number counts down from -1 within the row, so numbers never meet
    fulls = sized.filter(F.col("n") > longest).select("id", "row", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("piece")).select(
        "id", "row", "piece", (F.col("piece") * longest).alias("start"), F.lit(longest).cast("long").alias("n_tokens"), (-F.col("row") - 1).alias("bin_group"),
        F.col("piece").alias("bin"), F.lit(0).cast("long").alias("bin_offset"), F.lit(longest).cast("long").alias("bin_tokens"), F.lit(longest).cast("long").alias("bin_length"))
    return packed_rests.unionByName(fulls)
