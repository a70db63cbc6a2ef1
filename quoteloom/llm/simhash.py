"""SimHash fingerprints of word shingles, linked by bit-sliced comparison inside buckets of agreeing bits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.llm.base import components, map_batches
from quoteloom.session import cut_lineage

BITS, SEED = 64, 42
#: A bucket with more fingerprints is compared in pairs of blocks of this many, each pair in a group of its own.
BLOCK = 2048
#: Lanes (fingerprints) of one bit plane; a run of lanes is given up as soon as all of it is beyond the radius.
LANES = 512
_SHINGLES_AT_ONCE = 1 << 16


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return (text or "").encode().lower().split()


def shingle_hashes(ws: list[bytes], k: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, repeats included; fewer words than k make one shingle."""
    if 0 < len(ws) < k:
        ws = [b" ".join(ws)]
        k = 1
    digest = xxhash.xxh64_intdigest
    n = len(ws) - k + 1 if ws else 0
    for at in range(0, n, _SHINGLES_AT_ONCE):
        part = ws[at: at + _SHINGLES_AT_ONCE + k - 1]
        yield np.fromiter((digest(b" ".join(s), SEED) for s in zip(*(part[i:] for i in range(k)), strict=False)), np.uint64)


def fingerprint(text: str | None, k: int = 3) -> int:
    """Bit i is 1 if it is set in over half of the shingle hashes; no words: 0."""
    total, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(words(text), k):
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little") if n else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id`` and ``fingerprint`` (64 bits in a long) of every row; whole texts, one pass, no shuffle."""

    def run(ids, texts):
        return ids, pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, fingerprint long")


def bit_planes(raw: np.ndarray) -> list[int]:
    """Vertical store of fingerprints (a row of bytes each): plane b is a number whose bit i is bit b of fingerprint i."""
    packed = np.packbits(np.unpackbits(raw, axis=1, bitorder="little"), axis=0, bitorder="little")
    return [int.from_bytes(packed[:, b].tobytes(), "little") for b in range(packed.shape[1])]


def within(planes: list[tuple[int, int]], full: int, query: int, radius: int) -> int:
    """Lanes at most ``radius`` bits from ``query``, as a bit mask.

    ``planes``: (bit number, plane) of the planes that differ anywhere. The distances of all lanes are kept as bit-sliced
    counters: adding a plane is a ripple of carries through them, and a lane whose counter passes the radius leaves the mask.
    """
    top = (radius + 1).bit_length()
    # counters start at 2**top - 1 - radius, so that a carry out of the last one means "over the radius"
    start = (1 << top) - 1 - radius
    counters = [full if start >> i & 1 else 0 for i in range(top)]
    alive = full
    for b, plane in planes:
        carry = (plane ^ full if query >> b & 1 else plane) & alive
        for i in range(top):
            if not carry:
                break
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        alive &= ~carry
        if not alive:
            return 0
    return alive


class Sliced:
    """Bit planes of a group of fingerprints, in runs of LANES; ``raw`` has a row of bytes per fingerprint."""

    def __init__(self, raw: np.ndarray) -> None:
        vary = np.unpackbits(np.bitwise_and.reduce(raw) ^ np.bitwise_or.reduce(raw), bitorder="little")
        bits = np.flatnonzero(vary).tolist()
        self.runs = []
        for at in range(0, len(raw), LANES):
            planes = bit_planes(raw[at: at + LANES])
            self.runs.append((at, (1 << len(raw[at: at + LANES])) - 1, [(b, planes[b]) for b in bits]))

    def near(self, query: int, radius: int, open_: list[int]) -> Iterator[int]:
        """Numbers of the lanes still in ``open_`` (a mask per run) within the radius."""
        for r, (at, full, planes) in enumerate(self.runs):
            if open_[r]:
                mask = within(planes, full, query, radius) & open_[r]
                while mask:
                    low = mask & -mask
                    mask ^= low
                    yield at + low.bit_length() - 1


def _numbers(raw: np.ndarray) -> list[int]:
    width, data = raw.shape[1], raw.tobytes()
    return [int.from_bytes(data[i: i + width], "little") for i in range(0, len(data), width)]


def group_links(raw: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Pairs of positions that connect each component of the group's links: one less than its members, whatever the links' number."""
    n, prints = len(raw), _numbers(raw)
    if n == 2:
        return [(0, 1)] if (prints[0] ^ prints[1]).bit_count() <= radius else []
    sliced = Sliced(raw)
    open_ = [full for _, full, _ in sliced.runs]
    out = []
    for s in range(n):
        if not open_[s // LANES] >> (s % LANES) & 1:
            continue
        open_[s // LANES] ^= 1 << (s % LANES)
        todo = [s]
        while todo:
            q = todo.pop()
            for x in list(sliced.near(prints[q], radius, open_)):
                open_[x // LANES] ^= 1 << (x % LANES)
                todo.append(x)
                out.append((q, x))
    return out


def bucket_keys(print_: Column, radius: int, spare: int = 2) -> Column:
    """Keys of a fingerprint: ``radius + spare`` pieces of bits, every choice of ``spare`` of them.

    Two fingerprints within the radius differ in at most ``radius`` pieces, so they agree on a choice: no link is lost.
    """
    pieces = radius + spare
    edges = [BITS * i // pieces for i in range(pieces + 1)]
    masks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(pieces)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    chosen = [sum(masks[i] for i in c) for c in combinations(range(pieces), spare)]
    return F.array(*(F.struct(F.lit(t).alias("t"), print_.bitwiseAND(F.lit(signed(m))).alias("v")) for t, m in enumerate(chosen)))


def links(prints: DataFrame, radius: int = 2, spare: int = 2, block: int = BLOCK) -> DataFrame:
    """Link table (a, b) over distinct fingerprints ``print`` with a node ``node``; components of it are those of all links."""
    keyed = prints.select("node", "print", F.explode(bucket_keys(F.col("print"), radius, spare)).alias("k")).select("node", "print", "k.t", "k.v")
    return compared(keyed, lambda raw: group_links(raw, radius), block)


def compared(keyed: DataFrame, find: Callable[[np.ndarray], list[tuple[int, int]]], block: int = BLOCK) -> DataFrame:
    """Links (a, b) that ``find`` sees inside the buckets (t, v) of rows with ``node`` and ``print`` (64 bits).

    Buckets over ``block`` are dealt into blocks by hash and each pair of blocks is a group of its own, so no task ever holds a
    whole hot bucket and none of its pairs is left out.
    """
    # stored first, so that its size is known before it is joined
    hot = cut_lineage(keyed.groupBy("t", "v").agg(F.count("*").alias("_n")).filter(F.col("_n") > block))
    parts = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64("print"), F.col("_m")).cast("int")
    dealt = keyed.join(hot, ["t", "v"], "left").withColumn("_m", F.coalesce(parts, F.lit(1)))
    others = F.when(F.col("_m") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("_m") - 1), lambda j: j != F.col("_i")))
    dealt = dealt.withColumn("_i", mine).select("node", "print", "t", "v", "_i", F.explode(others).alias("_j"))
    dealt = dealt.select("t", "v", F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j"), "node", "print")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def of(table: pa.Table) -> pa.RecordBatch:
            t, v, i, j, node = (table.column(c).to_numpy() for c in ("t", "v", "i", "j", "node"))
            new = np.r_[True, (np.diff(t) != 0) | (np.diff(v) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)]
            starts = np.flatnonzero(new)
            ends = np.r_[starts[1:], len(t)]
            left, right = [], []
            raw = table.column("print").to_numpy().view(np.uint8).reshape(-1, 8)
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                for x, y in find(raw[s:e]):
                    left.append(int(node[s + x]))
                    right.append(int(node[s + y]))
            return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], schema=schema)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            if not len(table):
                continue
            last = [table.column(c)[-1].as_py() for c in ("t", "v", "i", "j")]
            same = np.logical_and.reduce([table.column(c).to_numpy() == x for c, x in zip(("t", "v", "i", "j"), last, strict=True)])
            begin = len(table) - int(same.sum())
            rest = table.slice(begin)
            if begin:
                yield of(table.slice(0, begin))
        if rest is not None and len(rest):
            yield of(rest)

    return dealt.repartition("t", "v", "i", "j").sortWithinPartitions("t", "v", "i", "j", "node").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """``id``, ``fingerprint``, ``component_id`` (smallest id reachable over links) of every row.

    Copies share a fingerprint and count once; only distinct fingerprints are compared. Null and empty texts have fingerprint
    zero and are linked like any other. Rows that repeat an id each get their row; a null id is never a component's id unless
    all its ids are null. An empty table gives an empty one.
    """
    marked = cut_lineage(fingerprints(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id", "text", shingle))
    distinct = cut_lineage(marked.groupBy(F.col("fingerprint").alias("print")).agg(F.min("id").alias("node")))
    roots = components(links(distinct.filter("node is not null"), radius))
    classes = distinct.join(roots, "node", "left").select(F.col("print").alias("fingerprint"), F.coalesce("root", "node").alias("component_id"))
    return marked.join(classes, "fingerprint").select("id", "fingerprint", "component_id")


# ------------------------------------------------------------------ by a similarity of shingle sets
#: Sets are ordered by how many texts hold a shingle, then by hash. Counted are the shingles in the prefixes of all texts, under the
#: order so far, PASSES times; those of fewer than HOT_TEXTS texts, and all but the HOT_LIMIT most frequent, count as rare. Any order
#: gives the same links; these numbers only decide how many pairs have to be looked at and what each task is sent (16 bytes a shingle).
HOT_TEXTS, HOT_LIMIT, PASSES = 16, 1 << 18, 2


class Order(NamedTuple):
    """Frequent shingles, by hash, with the number of texts found to hold them."""

    tokens: np.ndarray
    counts: np.ndarray


def _shingle_set(text: str | None, k: int) -> np.ndarray:
    parts = list(shingle_hashes(words(text), k))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def prefix(shingles: np.ndarray, order: Order, similarity: float) -> np.ndarray:
    """The first shingles of a sorted set by (count, hash): of two sets that are similar enough, each has one of the other's among them."""
    n = len(shingles)
    held = n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0
    if n and len(order.tokens):
        at = np.minimum(np.searchsorted(order.tokens, shingles), len(order.tokens) - 1)
        counts = np.where(order.tokens[at] == shingles, order.counts[at], 0)
        shingles = shingles[np.argsort(counts, kind="stable")]
    return shingles[:held]


def _prefixes(docs: DataFrame, shingle: int, similarity: float, order: Order) -> DataFrame:
    """``docs``: id, text. Gives id, ``same`` (digest of the words, equal for equal word sequences), ``size`` of the set and its ``prefix``."""

    def run(ids, texts):
        same, sizes, heads = [], [], []
        for t in texts:
            s = _shingle_set(t, shingle)
            same.append(xxhash.xxh3_128_digest(b" ".join(words(t))))
            sizes.append(len(s))
            heads.append(prefix(s, order, similarity).view(np.int64))
        return ids, same, sizes, heads

    return map_batches(docs, run, "id long, same binary, size int, prefix array<long>")


def _reordered(marked: DataFrame, order: Order) -> Order:
    """``order`` with the shingles that the prefixes of many different texts hold put behind the rarer ones."""
    texts = marked.groupBy("same").agg(F.first("prefix").alias("prefix"))
    counted = texts.select(F.explode("prefix").alias("s")).groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= HOT_TEXTS)
    found = counted.orderBy(F.desc("n"), "s").limit(HOT_LIMIT).toArrow()
    tokens = np.concatenate([order.tokens, found.column("s").to_numpy().view(np.uint64)])
    counts = np.concatenate([order.counts, found.column("n").to_numpy()])
    most = np.lexsort((-counts, tokens))  # of a shingle counted twice, the larger number
    most = most[np.r_[True, np.diff(tokens[most]) != 0]] if len(most) else most
    most = most[np.sort(np.argsort(-counts[most], kind="stable")[:HOT_LIMIT])]  # by hash still
    return Order(tokens[most], counts[most])


def _in_company(rows: DataFrame) -> DataFrame:
    """The rows (token, node, size, pos) whose token another row has too; no group is held, only its last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, before = None, None  # the last row, and whether the row before it had its token
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            token = table.column("token").to_numpy()
            equal = token[1:] == token[:-1]
            keep = np.r_[bool(before), equal[:-1]] | equal if len(equal) else np.zeros(0, bool)
            before = bool(equal[-1]) if len(equal) else before
            rest = table.slice(len(table) - 1).to_batches()[0]
            yield from table.slice(0, len(table) - 1).filter(pa.array(keep)).to_batches()
        if rest is not None and before:
            yield rest

    return rows.repartition("token").sortWithinPartitions("token").mapInArrow(run, rows.schema)


def _possible(similarity: float) -> Column:
    """Whether the sets of x and y can be similar enough if the shingle at pos is the first they share: what is left behind it has to do."""
    left = F.least(F.col("x.size") - F.col("x.pos"), F.col("y.size") - F.col("y.pos"))
    return left * (1 + similarity) >= similarity * (F.col("x.size") + F.col("y.size")) - 1e-9


def _pairs_of(rows: DataFrame, leader: Column | None, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes of different roots that share tokens enough: with the one that leads by ``leader`` in each token, or all."""
    groups = rows.groupBy("token").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a != _b").select("token")
    rows = rows.join(groups, "token", "left_semi").select("token", "node", "size", "pos", "root", *([] if leader is None else [leader.alias("lead")]))
    if leader is None:
        other, on = rows, F.col("x.node") < F.col("y.node")
    else:
        first = rows.groupBy("token").agg(F.max(F.struct("lead", "node", "size", "pos", "root")).alias("_f"))
        other, on = first.select("token", "_f.node", "_f.size", "_f.pos", "_f.root"), F.lit(True)
    near = F.least("x.size", "y.size") >= similarity * F.greatest("x.size", "y.size") - 1e-9
    met = (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root")) & near & on
    both = rows.alias("x").join(other.alias("y"), met).select(
        F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), _possible(similarity).alias("_p"),
        (F.col("x.size") + F.col("y.size")).alias("_s"), F.greatest("x.size", "y.size").alias("_g"))
    pairs = both.groupBy("a", "b").agg(F.count("*").alias("_n"), F.max("_p").alias("_p"), F.min("_s").alias("_s"), F.max("_g").alias("_g"))
    # what two sets share up to the end of the shorter-reaching prefix stands in both prefixes; behind it are ceil(similarity * size) - 1 at most
    most = F.col("_n") + F.ceil(similarity * F.col("_g") - 1e-9) - 1
    return pairs.filter(F.col("_p") & (most * (1 + similarity) >= similarity * F.col("_s") - 1e-9)).select("a", "b")


def _set_links(reps: DataFrame, named: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) between nodes with similar sets; their components are those of all such links.

    ``reps``: node, size, prefix. Two similar sets share a token of their prefixes. In each token all are first checked against
    the one that shares most with others (the middle of a star), then against one taken by hash; at last every pair that
    shares enough tokens and is not yet in one component is checked, so no link between components is left out.
    """
    rows = reps.select("node", "size", F.posexplode("prefix").alias("pos", "token")).select("token", "node", "size", "pos")
    rows = cut_lineage(_in_company(rows))
    held = rows.groupBy("token").agg(F.count("*").alias("_n"))
    nodes = rows.join(held, "token").groupBy("node").agg(F.sum("_n").alias("weight"))

    def sets(ids, texts):
        return ids, [_shingle_set(t, shingle).view(np.int64) for t in texts]

    rows = cut_lineage(rows.join(nodes, "node"))
    sure = checked = roots = None
    for leader in (F.col("weight"), F.xxhash64("token", "node"), None):
        now = rows.withColumn("root", F.col("node")) if roots is None else rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        found = _pairs_of(now, leader, similarity)
        found = cut_lineage(found if checked is None else found.join(checked, ["a", "b"], "left_anti"))
        checked = found if checked is None else checked.union(found)
        linked = found.select(F.col("a").alias("id")).union(found.select(F.col("b").alias("id"))).distinct()
        of = cut_lineage(map_batches(named.join(linked, "id", "left_semi"), sets, "id long, s array<long>").groupBy("id").agg(F.first("s").alias("s")))
        both = found.join(of.select(F.col("id").alias("a"), F.col("s").alias("_x")), "a").join(of.select(F.col("id").alias("b"), F.col("s").alias("_y")), "b")
        shared = F.size(F.array_intersect("_x", "_y"))
        links_ = cut_lineage(both.filter(shared >= similarity * (F.size("_x") + F.size("_y") - shared)).select("a", "b"))
        sure = links_ if sure is None else sure.union(links_)
        if leader is not None:
            roots = components(sure)
    return sure


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``id`` and ``component_id`` of every row, linking documents whose sets of ``shingle``-word shingles are similar enough (Jaccard).

    Equal word sequences are one document. The others meet in the shingles of their prefixes, which two similar sets cannot
    both miss, and the whole sets decide on each link, so the components are those of all similar pairs. Null and empty texts
    are equal; null ids and repeated ids are handled as by ``near_duplicates`` (of rows that repeat an id, equal or not, one text counts).
    """
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = Order(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for _ in range(PASSES):
        order = _reordered(_prefixes(named, shingle, similarity, order), order)
    marked = cut_lineage(_prefixes(named, shingle, similarity, order))
    reps = cut_lineage(marked.groupBy("same").agg(F.min("id").alias("node"), F.first("size").alias("size"), F.first("prefix").alias("prefix")).filter("node is not null"))
    roots = components(_set_links(reps, named, shingle, similarity))
    classes = reps.join(roots, "node", "left").select("same", F.coalesce("root", "node").alias("component_id"))
    return marked.select("id", "same").join(classes, "same", "left").select("id", "component_id")


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose id is that of their class by ``similar``: one document of each group; rows that repeat that id stay together."""
    return _firsts(docs, id_col, similar(docs, id_col, text_col, shingle, similarity))


def kept_by_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` whose id is that of their class by ``near_duplicates``; rows that repeat that id stay together."""
    return _firsts(docs, id_col, near_duplicates(docs, id_col, text_col, shingle, radius))


def _firsts(docs: DataFrame, id_col: str, classes: DataFrame) -> DataFrame:
    firsts = classes.filter(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("_ql_id")).distinct()
    return docs.join(firsts, docs[id_col].eqNullSafe(F.col("_ql_id")), "left_semi")
