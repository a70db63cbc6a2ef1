"""Recurring lines across documents, found by a log-template tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteloom.llm.base import components, map_batches
from quoteloom.session import cut_lineage

#: Leading tokens that, with the token count, lead to a leaf of the tree.
DEPTH = 3
#: The tokens behind them are cut into so many fields (one each while they last); templates compare fields.
FIELDS = 8
#: A template recurs when it stands in at least so many documents and documents times tokens reach the weight: a short line
#: meets itself by chance, a long one does not.
MIN_DOCS, MIN_WEIGHT = 2, 20
#: Parts over which the occurrences of a frequent line or template are spread.
SALTS = 16
_VARIABLE, _DIGIT = re.compile(r"\S*[0-9]\S*"), re.compile("[0-9]")
MARK = "<*>"


def allowed(n_tokens: int) -> int:
    """Fields two lines of one template may differ in, besides tokens that hold digits: none under 5 tokens, one under 10, then two."""
    return min(2, n_tokens // 5)


def tokens_of(line: str) -> tuple[list[str], bool]:
    """(tokens of a line, whether it is a row of data). Tokens that hold a digit are variable; in a row of data, where less than
    a third of the tokens is fixed, they are its content, so all stay and the row equals only rows of the same values."""
    if not _DIGIT.search(line):
        return line.split(), False
    masked = _VARIABLE.sub(MARK, line).split()
    data = 3 * (len(masked) - masked.count(MARK)) < len(masked)
    return (line.split() if data else masked), data


def key_of(tokens: list[str]) -> int:
    return _signed(xxhash.xxh64_intdigest(" ".join(tokens)))


def parsed(tokens: list[str], depth: int = DEPTH) -> tuple[int, list[int]]:
    """(leaf, hashes of the fields) of a line's tokens; with a depth of all tokens there are no fields."""
    n = len(tokens)
    leaf = _signed(xxhash.xxh64_intdigest(f"{n} " + " ".join(tokens[:depth])))
    m = min(FIELDS, n - depth)
    if m <= 0:
        return leaf, []
    rest, digest = tokens[depth:], xxhash.xxh32_intdigest
    if m < FIELDS:
        return leaf, [digest(x) for x in rest]
    cuts = [(n - depth) * i // m for i in range(m + 1)]
    return leaf, [digest(" ".join(rest[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def occurrences(docs: DataFrame) -> DataFrame:
    """``docs``: id, text. One row per document and distinct masked line that isn't blank: id, n (tokens), leaf, key, fields."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(ids, texts):
        who, n, leaves, keys, sizes, fields = [], [], [], [], [0], []
        for i, t in zip(ids, texts, strict=True):
            seen = set()
            for line in (t or "").split("\n"):
                tokens, data = tokens_of(line)
                if tokens and (key := key_of(tokens)) not in seen:
                    seen.add(key)
                    leaf, f = parsed(tokens, len(tokens) if data else DEPTH)
                    who.append(i)
                    n.append(len(tokens))
                    leaves.append(leaf)
                    keys.append(key)
                    fields += f
                    sizes.append(len(fields))
        values = pa.array(np.array(fields, np.uint32).view(np.int32))
        return who, n, leaves, keys, pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)

    return map_batches(docs, run, f"id {kind}, n int, leaf long, key long, fields array<int>")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _template_links(distinct: DataFrame) -> DataFrame:
    """Links (leaf, a, b) that connect lines (leaf, key) as all pairs of a leaf that differ in few enough fields do.

    A line's fields are cut into ``allowed + 1`` parts; two lines of one template agree on a whole part, so each part is a
    group, much narrower than the leaf. Inside a group lines meet under every choice of fields they may differ in: equal rest,
    equal key, and lines of one key need no more than a link to its first. Groups are sorted by range, so a large one spreads
    over tasks; nothing is held but a batch, and keys of groups that reach its edge meet once more by a join.
    """
    wide = F.least(F.lit(2), F.floor(F.col("n") / 5)).cast("int")
    m = F.size("fields")
    part = F.transform(F.sequence(F.lit(0), F.col("w")), lambda j: F.struct(
        j.alias("j"), F.xxhash64(F.slice("fields", (F.floor(m * j / (F.col("w") + 1)) + 1).cast("int"), (F.floor(m * (j + 1) / (F.col("w") + 1)) - F.floor(m * j / (F.col("w") + 1))).cast("int"))).alias("h")))
    open_ = distinct.withColumn("w", wide).filter((F.col("w") > 0) & (m > F.col("w")))
    keyed = open_.select("leaf", "key", "w", "fields", F.explode(part).alias("p")).select("leaf", "p.j", "p.h", "w", "key", "fields")
    schema = pa.schema([("leaf", pa.int64()), ("g", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf, j, h, w, key = (batch.column(i).to_numpy() for i in range(5))
            new = np.r_[True, (np.diff(leaf) != 0) | (np.diff(j) != 0) | (np.diff(h) != 0)]
            group = np.cumsum(new)
            edge = (group == 1) | (group == group[-1])  # these groups may go on in another batch
            alone = new & np.r_[new[1:], True] & ~edge
            offsets, values = batch.column(5).offsets.to_numpy(), batch.column(5).values.to_numpy().view(np.uint32).astype(np.uint64)
            m = np.diff(offsets)
            for kind in np.unique(np.stack([m, w, j])[:, ~alone], axis=1).T.tolist():
                at = np.flatnonzero(~alone & (m == kind[0]) & (w == kind[1]) & (j == kind[2]))
                yield from _met(leaf[at], key[at], edge[at], values[offsets[at][:, None] + np.arange(kind[0])], kind[1], kind[2])

    def _met(leaf: np.ndarray, key: np.ndarray, edge: np.ndarray, fields: np.ndarray, w: int, j: int) -> Iterator[pa.RecordBatch]:
        m = fields.shape[1]
        mine = range(m * j // (w + 1), m * (j + 1) // (w + 1))
        hashes = _mixed(fields + (np.arange(1, m + 1, dtype=np.uint64) << np.uint64(32)))
        whole = hashes.sum(1, dtype=np.uint64) + _mixed(leaf.view(np.uint64))
        for c, gone in enumerate(combinations(range(m), w)):
            if any(x in mine for x in gone):
                continue
            g = _mixed(whole - hashes[:, list(gone)].sum(1, dtype=np.uint64) + np.uint64(c)).view(np.int64)
            _, first, of = np.unique(g, return_index=True, return_inverse=True)
            linked = np.flatnonzero(first[of] != np.arange(len(g)))
            open_ = first[edge[first]]
            none = pa.nulls(len(linked), pa.int64()), pa.nulls(len(open_), pa.int64())
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(leaf[linked]), none[0], pa.array(key[first[of[linked]]]), pa.array(key[linked])], schema=schema)
            if len(open_):
                yield pa.RecordBatch.from_arrays([pa.array(leaf[open_]), pa.array(g[open_]), pa.array(key[open_]), none[1]], schema=schema)

    sorted_ = keyed.repartitionByRange("leaf", "j", "h", "key").sortWithinPartitions("leaf", "j", "h", "key")
    met = cut_lineage(sorted_.mapInArrow(run, "leaf long, g long, a long, b long"))
    edges = met.filter("b is null").select("leaf", "g", F.col("a").alias("b"))
    firsts = edges.groupBy("leaf", "g").agg(F.min("b").alias("a"))
    return met.filter("b is not null").select("leaf", "a", "b").union(edges.join(firsts, ["leaf", "g"]).filter("a != b").select("leaf", "a", "b")).distinct()


def distinct_lines(occ: DataFrame) -> DataFrame:
    """``leaf``, ``key``, ``n`` (tokens), ``fields`` and ``rows`` (occurrences) of every distinct line."""
    return occ.groupBy("leaf", "key").agg(F.first("n").alias("n"), F.first("fields").alias("fields"), F.count("*").alias("rows"))


def templates(occ: DataFrame, distinct: DataFrame | None = None) -> DataFrame:
    """``leaf``, ``key``, ``root`` of the lines that share a template with another line; the root names the template."""
    distinct = distinct_lines(occ) if distinct is None else distinct
    # most leaves hold one line and need no look
    shared = distinct.groupBy("leaf").agg(F.count("*").alias("_n")).filter("_n > 1").select("leaf")
    # a node is leaf and key in one number; both are kept, so equal numbers of two leaves stay apart
    found = cut_lineage(_template_links(distinct.join(shared, "leaf", "left_semi")))
    node = lambda k: F.struct(F.col("leaf").alias("leaf"), F.col(k).alias("key"))
    roots = components(found.select(node("a").alias("a"), node("b").alias("b")))
    return roots.select("node.leaf", "node.key", F.col("root.key").alias("root"))


def _salted(occ: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Occurrences with the row that ``table`` has for them, spread over SALTS parts of each key by document; ``table`` holds few of the keys."""
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return occ.withColumn("_salt", salt).join(copies, [*on, "_salt"]).drop("_salt")


def recurring(occ: DataFrame, min_docs: int = MIN_DOCS, min_weight: int = MIN_WEIGHT) -> DataFrame:
    """``id``, ``leaf``, ``key``, ``root``, ``n_docs`` and ``first_id`` of the occurrences of templates that recur across documents.

    Lines that occur once and share no template leave before occurrences are shuffled by template.
    """
    distinct = cut_lineage(distinct_lines(occ))
    shared = templates(occ, distinct)
    several = distinct.filter("rows > 1").select("leaf", "key").join(shared.select("leaf", "key"), ["leaf", "key"], "left_anti")
    shaped = cut_lineage(_salted(occ.select("id", "n", "leaf", "key"), several.withColumn("root", F.col("key")).unionByName(shared), ["leaf", "key"]))
    # one row per document and template, then per template: both sums start before their shuffle
    per_doc = shaped.groupBy("leaf", "root", "id").agg(F.first("n").alias("n"))
    counted = per_doc.groupBy("leaf", "root").agg(F.count("*").alias("n_docs"), F.min("id").alias("first_id"), F.first("n").alias("n"))
    kept = counted.filter((F.col("n_docs") >= min_docs) & (F.col("n_docs") * F.col("n") >= min_weight))
    return _salted(shaped, kept.select("leaf", "root", "n_docs", "first_id"), ["leaf", "root"])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_weight: int = MIN_WEIGHT) -> DataFrame:
    """``docs`` with the lines of recurring templates dropped but in the document with the smallest id; all columns stay.

    The text column changes, and two columns follow: ``lines_dropped`` and ``templates_dropped`` (replaced if they exist).
    Blank lines stay, and so do rows of data (most tokens hold digits) unless the same values recur. A null text stays null; rows that repeat an id lose the same lines; rows with a null id count as one
    document, never the first one unless there is no other. A document may end up empty. An empty table gives an empty one.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    occ = cut_lineage(occurrences(named))
    gone = recurring(occ, min_docs, min_weight).filter(~F.col("id").eqNullSafe(F.col("first_id")))
    drops = gone.groupBy(F.col("id").alias("_ql_id")).agg(F.collect_set("key").alias("_ql_keys"))
    columns = [c for c in docs.columns if c not in ("lines_dropped", "templates_dropped")]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_ql_row"))
    at = F.col("_ql_row")[id_col].eqNullSafe(F.col("_ql_id"))
    joined = packed.join(drops, at, "left")
    cleaned = _without(joined, id_col, text_col)
    return cleaned.select(*(F.when(F.col("_ql_n") > 0, F.col("_ql_text")).otherwise(F.col("_ql_row")[c]).alias(c) if c == text_col else F.col("_ql_row")[c].alias(c) for c in columns),
                          F.col("_ql_n").alias("lines_dropped"), F.size(F.coalesce("_ql_keys", F.array())).alias("templates_dropped"))


def _without(joined: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds ``_ql_text``, the text without the lines whose key is in ``_ql_keys`` (null where there are none), and ``_ql_n``, how many went."""

    kind = pa.struct([("text", pa.string()), ("n", pa.int32())])

    @F.arrow_udf("struct<text: string, n: int>")
    def cut(texts: pa.Array, keys: pa.Array) -> pa.Array:
        # one text at a time is a Python value
        out, counts = [], []
        for t, ks in zip(texts, keys, strict=True):
            if not ks.is_valid or not t.is_valid:
                out.append(None)
                counts.append(0)
                continue
            gone, lines = set(ks.as_py()), t.as_py().split("\n")
            kept = [x for x in lines if not ((tokens := tokens_of(x)[0]) and key_of(tokens) in gone)]
            out.append("\n".join(kept))
            counts.append(len(lines) - len(kept))
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(counts, pa.int32())], fields=list(kind))

    return joined.withColumn("_ql_cut", cut(F.col("_ql_row")[text_col], F.col("_ql_keys"))).select(
        "_ql_row", "_ql_keys", F.col("_ql_cut.text").alias("_ql_text"), F.col("_ql_cut.n").alias("_ql_n"))
