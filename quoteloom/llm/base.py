"""What the operators share: batches of texts, intermediate tables, components of a link table, bitmaps of fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from quoteloom.session import cut_lineage


#: Rows of an Arrow batch that are Python values at a time.
ROWS = 1024


def map_batches(df: DataFrame, fn: Callable[..., Sequence], schema: str) -> DataFrame:
    """Calls ``fn`` with one Python list per column of ``df`` and takes one list (or Arrow array) per column of ``schema``.

    Batches stream through the task, and ROWS rows at a time become Python values, so memory is that of one Arrow batch and those
    rows; whole texts are passed.
    """
    struct = _parse_datatype_string(schema)
    assert isinstance(struct, StructType)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                out = fn(*(c.to_pylist() for c in batch.slice(at, ROWS).columns))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, struct)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected link table: ``node``, ``root`` (smallest node reachable), one row per linked node.

    Every round a node takes the smallest root among its own and its neighbours' roots, then the root of that root, so the
    longest path halves about each round. Grouping by node is a partial minimum; a hub's links are only joined, never gathered.
    Each round is a table in the shared folder, which survives lost executors. Null ends are dropped; an empty table gives none.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a != b")
    # each link towards the smaller end; both directions are needed
    both = cut_lineage(pairs.union(pairs.select("b", "a")).distinct())
    roots = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m")).select("node", F.least("node", "_m").alias("root")))
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").select(F.col("a").alias("node"), "root")
        best = roots.select("node", "root").union(near).groupBy("node").agg(F.min("root").alias("root"))
        # a root of a root: the candidate's own best root so far
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        jumped = best.join(up, "root", "left").select("node", F.least("root", F.coalesce("_up", "root")).alias("new"))
        after = cut_lineage(jumped.join(roots, "node").select("node", F.col("new").alias("root"), (F.col("new") != F.col("root")).alias("changed")))
        moved = after.filter("changed").limit(1).count()
        roots = after.select("node", "root")
        if not moved:
            return roots


def bitmap(hashes: DataFrame, column: str, bits: int) -> list[tuple[int, int]]:
    """Set bits of the low ``bits`` of a hash column as (word, 64 bits); at most 2**(bits-6) rows whatever the input.

    This is the only thing the callers send to all tasks: its size is fixed by ``bits`` and does not grow with the data.
    """
    assert 6 <= bits <= 26
    low = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = hashes.select(F.shiftright(low, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast({0} & 63 as int))".format(f"`{column}`")).alias("v"))
    return [(r["w"], r["v"]) for r in words.groupBy("w").agg(F.bit_or("v").alias("v")).collect()]
