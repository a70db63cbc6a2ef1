"""Prefix trie, source mix and spelling variants against plain definitions, and on nulls, ties, repeated rows, long texts and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quoteloom.llm import mixing, trie, variants

TURNS = "conv_id long, turn long, role string, text string, depth string, _bucket string, words string"


def turn_rows(spark, rows):
    return spark.createDataFrame([(*r, "x", None, "y") for r in rows], TURNS).repartition(3)


# ------------------------------------------------------------------------------------------------- trie
def n_words(text):
    return len(re.findall("[^\x20\x09-\x0D]+", text))


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((-(1 << 60) if turn is None else turn, role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    out = set()
    for p, cs in members.items():
        below = [q for q in members if q[:len(p)] == p]
        kids = [q for q in members if len(q) == len(p) + 1 and q[:len(p)] == p]
        leaves = [q for q in below if not any(len(k) == len(q) + 1 and k[:len(q)] == q for k in members)]
        saved = sum((len(members[q]) - 1) * (n_words(q[-1][1]) if q else 0) for q in below)
        ends = ",".join(str(c) for c in sorted(c for c in cs if built[c] == p))
        out.add((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie_of(df):
    return [tuple(r) for r in trie.nodes(*trie.rebuilt(df)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]


def test_trie_is_that_of_the_definition(spark):
    rng = random.Random(4)
    rows = []
    for c in [*range(-25, 70), 4095, 4096, 4100, 8200]:
        for t in range(rng.randrange(0, 6)):
            rows.append((c, rng.choice([None, t, t, t // 2]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "", None, "c", "é  d\n"])))
    rows += rows[:7] + [(None, 1, "user", "lost")]
    got = trie_of(turn_rows(spark, rows))
    assert len(got) == len(set(got)) and set(got) == brute_trie(rows)


def test_trie_of_a_long_conversation_and_equal_ones(spark):
    long_ = [(1, t, "user", f"turn {t % 7}") for t in range(2500)]
    equal = [(c, t, "user", "same thing") for c in range(100, 160) for t in range(2)]
    rows = long_ + equal + [(7, 0, "user", "word " * 5000)]
    got = trie_of(turn_rows(spark, rows))
    assert len(got) == len(set(got))
    nodes = {(r[0], r[1]): r for r in got}
    root = nodes[1, 0]
    assert root[3] == 62 and root[2] is None
    # conversation 1 takes none from conversation 0, which is missing, and loses its own first turns
    h = zlib.crc32(b"1") % 4
    assert max(d for c, d in nodes if c == 1) == 2500 - h and nodes[1, 2500 - h][2] == 1
    assert trie_of(turn_rows(spark, [])) == []


# ------------------------------------------------------------------------------------------------- mixing
DOCS = "doc_id long, text string, source string, size long, target double, start string, row long"


def mix_rows(spark, rows):
    return spark.createDataFrame([(*r, 1, 0.5, "z", 9) for r in rows], DOCS).repartition(3)


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    held, target = set(), {}
    while True:
        rest, free = sum(sizes.values()) - sum(3 * sizes[s] for s in held), sum(weight[s] for s in names if s not in held)
        target = {s: 3 * sizes[s] if s in held else weight[s] * rest / free for s in names}
        over = {s for s in names if s not in held and target[s] > 3 * sizes[s]}
        if not over:
            return target
        held |= over


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_comes_to_its_targets(spark, seed):
    rng = random.Random(seed)
    sources = [None, "", "a", "B", "é", "zz", *(f"s{i}" for i in range(rng.choice([2, 12])))]
    rows = [(i, "w " * int(rng.paretovariate(0.8)), rng.choice(sources[: 2 + i % len(sources)])) for i in range(400)]
    rows += [(401, "w " * 20_000, "a"), (402, None, "a"), (403, "", "empty"), (404, "one", None), (404, "one", None), (None, "x y", "zz"), (None, None, None)]
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += n_words(text or "")
    got = mixing.mixed(mix_rows(spark, rows)).collect()
    assert Counter((r["id"], r["source"], r["size"]) for r in got) == Counter((i, s, n_words(t or "")) for i, t, s in rows)
    want, took = brute_targets(dict(sizes)), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-12) and 0 <= r["taken"] <= 3 * r["size"]
        took[r["source"]] += r["taken"]
    assert sum(took.values()) == sum(sizes.values())
    assert all(abs(took[s] - want[s]) <= len(sizes) for s in sizes)
    again = mixing.mixed(mix_rows(spark, rows).repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mix_is_a_schedule_in_the_order_of_finish_times(spark):
    rows = [(i, "w " * (i % 9), "abc"[i % 3]) for i in range(90)]
    docs, schedule = mixing.queued(mix_rows(spark, rows))
    got = schedule.orderBy("position").collect()
    assert [r["finish"] for r in got] == sorted(r["finish"] for r in got)
    assert [r["position"] for r in got] == [sum(x["taken"] for x in got[:i]) for i in range(len(got))]
    # at any place the sources stand near the shares of their weights
    half = Counter()
    for r in got[: len(got) // 2]:
        half[r["source"]["source"]] += r["taken"]
    share = {r["source"]["source"]: r["target"] for r in docs.collect()}
    done = sum(half.values()) / sum(share.values())
    assert all(abs(half[s] - done * share[s]) <= 20 for s in share)
    assert mixing.mixed(mix_rows(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mixed(mix_rows(spark, [(1, None, None), (2, "", "a")])).collect()] == [0, 0]


def test_mix_has_no_python_in_its_plan(spark):
    plan = mixing.mixed(mix_rows(spark, [(1, "a", "b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ------------------------------------------------------------------------------------------------- variants
VOCABULARY = "doc_id long, text string, word string, n long, near string"


def damaged(doc, run):
    run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
    h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
    return run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long_ = sorted((a, b), key=len)
    return any(long_[:i] + long_[i + 1:] == short for i in range(len(long_)))


def brute_variants(rows):
    counts = Counter(damaged(i, r) for i, t in rows for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""))
    voc = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in voc if is_near(w, v)] for w in voc}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-voc[v], v), default=None)
        form[w] = best if best is not None and voc[best] >= 5 * voc[w] else None
    out = set()
    for w in voc:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, voc[w], len(near[w]), voc[form[w]] if form[w] is not None else None))
    return out


def test_variants_are_those_of_all_pairs(spark):
    rng = random.Random(9)
    roots = ["".join(rng.choice("abcdeéÀ×") for _ in range(rng.choice([5, 6, 6, 7, 9]))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "Banana", "bananna", "x" * 60, "x" * 61, "x" * 59 + "y"]
    def edit(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abcdeé") + w[i:], w[:i] + rng.choice("abcdeé") + w[i + 1:]])
    rows = []
    for i in range(700):
        words = []
        for _ in range(25):
            w = rng.choice(roots[: 1 + int(rng.random() ** 3 * len(roots))])
            for _ in range(int(rng.random() < 0.15) + int(rng.random() < 0.05)):
                w = edit(w)
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((i % 650, rng.choice([" ", "-", "1", "\n"]).join(words)))
    rows += [(800 + i, "elephant " * 4 + "elephxnt " * (i % 2) + "elephxnqt " * (i % 20 == 1)) for i in range(120)]
    rows += [(None, "banana " * 9), (700, None), (701, ""), (702, "123 . é")]
    df = spark.createDataFrame([(*r, "w", 1, "n") for r in rows], VOCABULARY).repartition(3)
    got = [tuple(r) for r in variants.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = brute_variants(rows)
    assert len(got) == len(set(got)) and set(got) == want
    assert len([r for r in want if r[2] not in (r[0], r[1])]) > 0 and any(len(r[0]) == 61 for r in want)
    assert variants.variants(df.limit(0)).count() == 0


def test_full_filters_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(variants, "MAX_BLOCKS", 8)
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.choice([6, 7, 8]))) for _ in range(500)})
    voc = spark.createDataFrame([(w, 5 + i) for i, w in enumerate(words)], "word string, n long")
    got = {(r["word"], r["near"]) for r in variants.near(voc).collect()}
    assert got == {(a, b) for a in words for b in words if is_near(a, b)}


def test_filters_stay_within_their_bound():
    f = variants.Filters({k: 10**9 for k in range(6, variants.LONGEST + 1)})
    assert f.blocks <= variants.MAX_BLOCKS
    at, _ = f.places(np.arange(10_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 20)
    assert at.min() >= f.start[20] and at.max() < f.start[20] + f.size[20]


def test_pieces_of_long_texts_end_between_runs():
    text = "abc déf " * 5000 + "z" * 3000 + " end"
    parts = list(variants.pieces(text, 1000))
    assert "".join(parts) == text and [w for p in parts for w in variants.RUN.findall(p)] == variants.RUN.findall(text) and len(parts) > 30
