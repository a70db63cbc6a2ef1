"""Searches in texts against plain scans, and how they deal frequent keys over tasks."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quoteloom.functions import fuzzy
from quoteloom.functions.grams import gram_hashes
from quoteloom.functions.grid import html_grid
from quoteloom.functions.text import norm
from quoteloom.operators import anchoring, passages, spread
from quoteloom.operators.ordering import in_ranges, ranged_sums
from quoteloom.operators.spread import hot_buckets, spread_join

BLOCKS = "project_id string, doc_id string, block_id string, pos int, page int, rect struct<x0: double, y0: double, x1: double, y1: double>, variants array<string>"


@pytest.fixture()
def wide(spark, monkeypatch):
    """A session whose joins shuffle into 32 partitions that are not merged, and no side is small enough to be sent to all tasks."""
    monkeypatch.setattr(spread, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(anchoring, "BROADCAST_BYTES", -1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def per_task(df):
    """Rows per partition of a result, most first."""
    counts = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    return sorted((r["count"] for r in counts), reverse=True)


# ------------------------------------------------------------------ spread joins
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_is_the_plain_join(wide, monkeypatch, how):
    rng = random.Random(3)
    left = [(rng.choice(["hot"] * 9 + ["a", "b", "c", None]), i) for i in range(3000)] + [(f"k{i}", -i) for i in range(2000)]
    right = [("hot", 1), ("hot", 2), ("a", 3), ("k7", 4), (None, 5)]
    a, b = wide.createDataFrame(left, "k string, v int"), wide.createDataFrame(right, "k string, w int")
    assert len(hot_buckets(a, ["k"])) >= 4
    got = spread_join(a, b, ["k"], ["v"], how)
    want = a.join(b, "k", how)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    if how == "inner":
        assert per_task(want)[0] > 4000 and per_task(got)[0] < 1200
        monkeypatch.setattr(spread, "BROADCAST_BYTES", 1 << 20)
        small = spread_join(a, b, ["k"], ["v"], how)
        assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString() and sorted(map(str, small.collect())) == sorted(map(str, want.collect()))
    assert hot_buckets(a.limit(0), ["k"]) == [] and spread.size_of(b) == 5 * 32 + 3 + 3 + 1 + 2


def test_ranged_sums_spread_one_key(wide):
    rows = [("p" if i % 4 else "q", i * 7919 % 10007, i % 5) for i in range(4000)]
    df = wide.createDataFrame(rows, "k string, o int, v int")
    dealt = in_ranges(df, [F.col("k"), F.col("o")])
    assert dealt.groupBy("_range").count().agg(F.max("count")).first()[0] < 1000
    got = {(r.k, r.o): (r.s, r.n) for r in ranged_sums(dealt, ["k"], [F.col("o")], {"s": F.col("v"), "n": F.lit(1)}).collect()}
    for k in "pq":
        total = 0
        for n, (_, o, v) in enumerate(sorted(r for r in rows if r[0] == k), 1):
            total += v
            assert got[k, o] == (total, n)


# ------------------------------------------------------------------ literal search
def test_literal_search_with_one_word_everywhere_and_one_huge_document(wide):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    docs = {f"d{d}": [" ".join(["everywhere", *(rng.choice(words) for _ in range(6)), "everywhere"]) for _ in range(2500 if d == 0 else 20)] for d in range(12)}
    blocks = [("P", d, f"b{i}", i, 1, None, [t]) for d, ts in docs.items() for i, t in enumerate(ts)]
    quotes = set()
    for d, ts in docs.items():
        for t in rng.sample(ts, 20):
            at = rng.randrange(0, len(t) - 14)
            quotes |= {(d, t[at: at + rng.choice([1, 2, 3, 5, 14])].strip()), (d, " ".join(t.split(" ")[1:5])), (d, "x everywhere y"), (d, t.split(" ")[2])}
    quotes = {(d, q) for d, q in quotes if q}
    b = wide.createDataFrame(blocks, BLOCKS)
    asked = wide.createDataFrame([("P", d, q) for d, q in quotes], "project_id string, doc_id string, q string")
    got = {(r.doc_id, r.q): (r.found.block_id, r.found.start) for r in anchoring.first_in_document(asked, b).collect()}
    want = {}
    for d, q in quotes:
        hit = next(((f"b{i}", t.find(q)) for i, t in enumerate(docs[d]) if q in t), None)
        if hit:
            want[d, q] = hit
    assert got == want and len(want) > 100
    pairs = anchoring.locate_literal(asked.filter("char_length(q) > 2"), b, ["project_id", "doc_id"], ["block_id"])
    assert pairs.count() == sum(t.count(q) > 0 for d, q in quotes if len(q) > 2 for t in docs[d])


def test_rarest_key_is_searched_for(spark):
    """A quote of a frequent and a rare word meets only the blocks with the rare one."""
    blocks = spark.createDataFrame([("P", i, ["the commonplace word stands here " + ("rareword again" if i == 5 else "and here")]) for i in range(50)], "p string, u int, variants array<string>")
    asked = spark.createDataFrame([("P", "the commonplace word stands here rareword again"), ("P", "a commonplace word absentone here")], "p string, q string")
    got = [(r.q, r.u) for r in anchoring.locate_literal(asked, blocks, ["p"], ["u"]).collect()]
    assert got == [("the commonplace word stands here rareword again", 5)]


# ------------------------------------------------------------------ passages
@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abé 𝒳", max_size=40), st.integers(1, 6))
def test_gram_hashes_tell_runs_apart(text, size):
    hashes = np.concatenate([h for _, h in gram_hashes(text, size)] or [np.zeros(0, np.uint64)])
    runs = [text[i: i + size] for i in range(len(text) - size + 1)]
    assert len(hashes) == len(runs) and len(set(zip(runs, hashes.tolist(), strict=True))) == len(set(runs)) == len(set(hashes.tolist()))


def test_gram_hashes_of_long_texts_go_on_over_pieces():
    text = "".join(random.Random(1).choice("abcd") for _ in range(200_000))
    whole = np.concatenate([h for _, h in gram_hashes(text, 12)])
    assert len(whole) == len(text) - 11 and [at for at, _ in gram_hashes(text, 12)][1] == 65536 - 12
    for i in (0, 65_523, 65_524, 65_530, 131_050, len(text) - 12):
        assert whole[i] == next(gram_hashes(text[i: i + 12], 12))[1][0]


def test_passages_equal_a_plain_scan(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    texts = [(i % 70, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(90)] + [(200, None), (201, "a" * 300), (202, "ab" * 200)]
    quotes = [(0, "zzz"), (1, ""), (2, None), (3, "a" * 40), (4, "b"), (5, "abab" * 10), (6, "Ab  \n c"), (7, "a" * 301)]
    for n in range(8, 80):
        t = rng.choice([t for _, t in texts if t and len(t) > 3])
        at = rng.randrange(len(t) - 2)
        quotes.append((n, t[at: at + rng.choice([1, 2, 4, 7, 12, 13, 30, 500])]))
    quotes.append((90, quotes[10][1]))
    qs, ts = spark.createDataFrame(quotes, "quote_id int, quote string"), spark.createDataFrame(texts, "doc_id int, text string")
    normed_q = {r.quote_id: r.q for r in qs.select("quote_id", norm("quote").alias("q")).collect()}
    normed_t = [(r.doc_id, r.t) for r in ts.select("doc_id", norm("text").alias("t")).collect()]
    want = sorted((q, d, t.find(x)) for q, x in normed_q.items() if x for d, t in normed_t if t and x in t)
    got = sorted((r.quote_id, r.doc_id, r.start) for r in passages.passage_locations(qs, ts).collect())
    assert got == want and len(want) > 100
    assert passages.passage_locations(qs, ts.limit(0)).count() == 0 and passages.passage_locations(qs.limit(0), ts).count() == 0


def test_passages_read_documents_once_and_shuffle_no_text(spark):
    ts = spark.createDataFrame([(1, "x y z")], "doc_id int, text string")
    plan = passages.passage_locations(spark.createDataFrame([(1, "y")], "quote_id int, quote string"), ts)._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan  # what is left to do reads the written runs alone


# ------------------------------------------------------------------ approximate search
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcd ", min_size=1, max_size=30), st.text(alphabet="abcd ", min_size=1, max_size=60))
def test_bounds_are_never_under_the_score(a, b):
    counts = fuzzy._counts([a, b])
    assert fuzzy.partial_bounds(counts[:1], counts[1:])[0] >= fuzzy.partial_ratio(a, b) - 1e-9


def test_best_of_equals_scoring_everything_and_skips_most():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(25)) for _ in range(300)]
    needles, pairs, groups = [], [], []
    for g in range(8):
        t = rng.choice(texts)
        needle = t[20:90].replace("e", "")
        for x in texts:
            needles.append(needle)
            pairs.append(x)
            groups.append(g)
    order = np.array([i % 300 for i in range(len(pairs))])
    best, scores, skipped = fuzzy.best_of(needles, pairs, np.array(groups), order)
    every = fuzzy.partial_ratios(needles, pairs)
    for g in range(8):
        mine = every[g * 300: g * 300 + 300]
        assert scores[g] == mine.max() and best[g] == g * 300 + int(np.argmax(mine))
    assert skipped > 0.8 * len(pairs)


def test_one_page_of_many_blocks_is_spread(wide):
    rng = random.Random(2)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(8))
    texts = [line() for _ in range(3000)]
    blocks = wide.createDataFrame([("P", "D", f"b{i}", i, 1, None, [t]) for i, t in enumerate(texts)] + [("P", f"E{i}", "b", 0, 1, None, [line()]) for i in range(300)], BLOCKS)
    quotes = wide.createDataFrame([("P", "D", texts[i][3:30].replace("a", ""), 1 + i % 2) for i in (5, 700, 2999)], "project_id string, doc_id string, q string, near_page int")
    got = {r.q: (r.best.block_id, r.best.score) for r in anchoring.best_near_page(quotes, blocks).collect()}
    for i in (5, 700, 2999):
        q = texts[i][3:30].replace("a", "")
        scores = fuzzy.partial_ratios([q] * 3000, texts)
        assert got[q] == (f"b{int(np.argmax(scores))}", scores.max())
    met = spread_join(blocks, quotes.withColumnRenamed("near_page", "page"), ["project_id", "doc_id", "page"], ["pos"])
    assert per_task(met)[0] < 1500


# ------------------------------------------------------------------ grids
def test_grid_equals_painting_cell_by_cell():
    rng = random.Random(1)
    for _ in range(3000):
        rows = [[(f"t{r}{i}", rng.choice([1, 1, 2, 3, 9]), rng.choice([1, 1, 2, 4])) for i in range(rng.randrange(0, 4))] for r in range(rng.randrange(1, 7))]
        grid = [{} for _ in rows]
        for r, cells in enumerate(rows):
            c = 0
            for text, down, across in cells:
                while c in grid[r]:
                    c += 1
                for y in range(r, min(r + down, len(rows))):
                    grid[y].update({x: text for x in range(c, c + across)})
                c += across
        width = max((max(g) + 1 for g in grid if g), default=0)
        html = "".join("<tr>" + "".join(f"<td rowspan={d} colspan={a}>{t}</td>" for t, d, a in cells) + "</tr>" for cells in rows)
        assert html_grid(html) == [[g.get(c, "") for c in range(width)] for g in grid]


def test_a_stray_span_costs_no_other_cell():
    grid = html_grid("<table><tr><td rowspan=65534 colspan=80>stray</td><td>sound</td></tr><tr><td>below</td></tr></table>")
    assert len(grid) == 2 and grid[0] == ["stray"] * 80 + ["sound"] and grid[1] == ["stray"] * 80 + ["below"]
