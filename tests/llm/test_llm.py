"""The training-data operators against brute force, and on nulls, empty and repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quoteloom.llm import base, chat, cuckoo, extraction, lines, packing, pii, quality, reputation, simhash, winnow

DOCS = "doc_id long, text string, id string, key string, lines_dropped string, n_chars long"
LONG = "word " * 30_000


def docs(spark, rows):
    """Rows (doc_id, text) with further columns whose names the operators also use."""
    return spark.createDataFrame([(i, t, "x", None, "y", None) for i, t in rows], DOCS).repartition(3)


ODD = [(1, None), (2, ""), (3, "   \n \n"), (4, "one"), (4, "one"), (None, "no id here"), (5, LONG), (6, None)]


# ------------------------------------------------------------------------------------------------- personal data
def base_spans(t):
    digits = lambda s: "".join(c for c in s if c in "0123456789")
    out = [("email", m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [("phone", m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(((s, pii.BASE.index(k), e) for k, (s, e) in out))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1234567890.@+-() é\n", max_size=60) | st.lists(st.sampled_from(["a.b@c.de", "@", "1.2.3.4", ".5", "4111111111111111", " ", "-", "+1 (555) 010-9999", "x", "."]), max_size=9).map("".join))
def test_pii_base_spans_are_those_of_the_patterns(text):
    got = [(s, pii.BASE.index(k), e) for k, s, e, _ in pii.spans_of(text) if k in pii.BASE]
    assert got == base_spans(text)


def test_pii_checksums_and_context(spark):
    text = "Bank account IBAN GB82 WEST 1234 5698 7654 32 or GB82 WEST 1234 5698 7654 33; social security number 219-09-9999"
    kinds = [(k, text[s:e]) for k, s, e, _ in pii.spans_of(text)]
    assert ("iban", "GB82 WEST 1234 5698 7654 32") in kinds and sum(k == "iban" for k, _ in kinds) == 1
    assert any(k == "ssn" for k, _ in kinds)
    assert pii.scored("call tel +15550109999", "phone", 9, 21) > pii.scored("order +15550109999", "phone", 6, 18)
    got = {(r["id"], len(r["spans"])) for r in pii.detect(docs(spark, ODD)).collect()}
    assert got == {(1, 0), (2, 0), (3, 0), (4, 0), (None, 0), (5, 0), (6, 0)}
    assert pii.detect(docs(spark, [])).count() == 0
    assert pii.redact(docs(spark, [(1, "mail a@b.cd now"), (2, None)])).orderBy("id").collect()[0]["text"] == "mail [EMAIL] now"


def test_pii_long_runs_take_linear_time():
    assert pii.spans_of("a" * 200_000 + " " + "1" * 200_000 + "1." * 50_000) is not None


# ------------------------------------------------------------------------------------------------- lines
def test_lines_of_recurring_templates_go(spark):
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage = prose(60)
    own = {i: prose(25) for i in range(8)}
    rows = []
    for i in range(8):
        login = f"Posted by user {i * 37} of the board named {prose(1)} on day {i}"
        rows.append((i, "\n".join([own[i], passage, login, "", "Yes ."])))
    got = {r["doc_id"]: r for r in lines.deduplicated(docs(spark, rows)).collect()}
    assert got[0]["text"] == rows[0][1]
    for i in range(1, 8):
        assert got[i]["text"] == f"{own[i]}\n\nYes ." and got[i]["lines_dropped"] == 2
    assert got[1]["id"] == "x" and got[1]["key"] is None


def test_lines_leave_what_differs_more(spark):
    rows = [(i, f"the same start alpha{'abcdefgh'[i]} beta{'abcdefgh'[i]} gamma{'abcdefgh'[i]} delta epsilon zeta eta") for i in range(8)]
    assert {r["lines_dropped"] for r in lines.deduplicated(docs(spark, rows)).collect()} == {0}
    odd = lines.deduplicated(docs(spark, ODD))
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in odd.collect()) == sorted((i or -1, t or "") for i, t in ODD)
    assert lines.deduplicated(docs(spark, [])).count() == 0


def test_line_templates_of_a_random_pool_against_all_pairs(spark):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "bdfgk" for b in "aeiou"]
    pool = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(40)]
    rows = []
    for i in range(60):
        out = []
        for _ in range(5):
            toks = rng.choice(pool).split()
            for _ in range(rng.randrange(3)):
                toks[rng.randrange(3, 12)] = rng.choice(words)
            out.append(" ".join(toks))
        rows.append((i, "\n".join(out)))
    occ = lines.occurrences(docs(spark, rows).select(F.col("doc_id").alias("id"), "text"))
    roots = {(r["leaf"], r["key"]): r["root"] for r in lines.templates(occ).collect()}
    seen = {(r["leaf"], r["key"]): r["fields"] for r in occ.collect()}
    nodes = sorted(seen)
    linked = [(x, y) for i, x in enumerate(nodes) for y in nodes[i + 1:] if x[0] == y[0] and sum(p != q for p, q in zip(seen[x], seen[y], strict=True)) <= 2]
    assert {n: (n[0], roots.get(n, n[1])) for n in nodes} == classes(nodes, linked) and len(roots) > 50


def test_rows_of_numbers_stay_unless_their_values_recur(spark):
    rows = [(i, f"Table of values for the year\n{i} {i * 7} 45 78 90 {i + 3}\n1 2 3 4 5 6 7 8 9 10 11 12\n{i}.5 kg {i + 1} 22 {i + 9}") for i in range(7)]
    got = {r["doc_id"]: r["text"].split("\n") for r in lines.deduplicated(docs(spark, rows)).collect()}
    for i, text in rows:
        own = text.split("\n")
        assert got[i] == (own if i == 0 else [own[1], own[3]])


def test_a_template_in_all_documents_is_spread(spark):
    rows = [(i, f"copied line {i} of many with enough words in it") for i in range(600)] + [(600 + i, "alone " + " ".join(chr(97 + i % 26) * 3 + str(i) for _ in range(4))) for i in range(40)]
    got = {r["doc_id"]: r["text"] for r in lines.deduplicated(docs(spark, rows)).collect()}
    assert got[0] == rows[0][1] and all(got[i] == "" for i in range(1, 600)) and all(got[i] == t for i, t in rows[600:])


@pytest.mark.parametrize("batch", [10_000, 50])
def test_line_templates_against_all_pairs(spark, batch):
    """Variants of one line with two to four of eight fields changed, and shorter lines; small batches cut the groups."""
    rng = random.Random(33)
    rows = []
    for i in range(900):
        n = (11, 11, 11, 9, 6)[i % 5]
        toks = [f"{'bcdfghjk'[x]}o" for x in range(n - 3)]
        for at in rng.sample(range(n - 3), rng.randrange(2, min(5, n - 3))):
            toks[at] = "".join(rng.choice("aeiou") for _ in range(2))
        rows.append((i, " ".join(["x", "y", "z", *toks])))
    occ = lines.occurrences(docs(spark, rows).select(F.col("doc_id").alias("id"), "text"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        roots = {(r["leaf"], r["key"]): r["root"] for r in lines.templates(occ).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    seen = {(r["leaf"], r["key"]): (r["n"], r["fields"]) for r in occ.collect()}
    nodes = sorted(seen)
    linked = [(x, y) for i, x in enumerate(nodes) for y in nodes[i + 1:] if x[0] == y[0]
              and sum(p != q for p, q in zip(seen[x][1], seen[y][1], strict=True)) <= lines.allowed(seen[x][0])]
    assert {n: (n[0], roots.get(n, n[1])) for n in nodes} == classes(nodes, linked) and len(linked) > 500


# ------------------------------------------------------------------------------------------------- quality
def _quality_rows(n):
    rng = random.Random(7)
    stops = ["the", "of", "and", "to", "in", "is"]
    rows, labels = [], []
    for i in range(n):
        ws = []
        for _ in range(60):
            ws.append(rng.choice(stops) if rng.random() < 0.3 else "".join(rng.choice("abcdeilnorst") for _ in range(6)))
        kind = i % 10
        if kind == 0:
            text = " ".join(w.upper() + "!!" for w in ws)
        elif kind == 1:
            text = " ".join(w for w in ws[:6] for _ in range(10))
        elif kind == 2:
            for p in (5, 17, 40):
                ws[p] = rng.choice(["grukala", "grukami", "grukeno", "idiot"])
            text = " ".join(ws) + "."
        else:
            text = ". ".join(" ".join(ws[j: j + 12]) for j in range(0, 60, 12)) + "."
        rows.append((i, text))
        if i % 20 >= 10:
            labels.append((i, int(kind > 1), int(kind == 2)))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = _quality_rows(1200)
    given_ = spark.createDataFrame(labels + [(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    got = {r["id"]: r for r in quality.scored(docs(spark, rows), given_).collect()}
    held = [i for i in range(1200) if i % 20 < 10]
    wrong = sum(got[i]["rejected"] != (i % 10 < 3) for i in held)
    assert len(got) == 1200 and wrong <= 0.05 * len(held)
    kept = quality.accepted(docs(spark, rows), given_)
    assert kept.columns == docs(spark, []).columns and abs(kept.count() - 840) <= 40


def test_quality_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.2
    right = [0.95, 0.8, 0.7]
    votes = np.stack([np.where(rng.random(len(truth)) < a, np.where(truth, 1, 2), np.where(truth, 2, 1)) for a in right] + [np.zeros(len(truth), int)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_labels(patterns, counts.astype(float))
    assert abs(model.bad - 0.2) < 0.04
    for j, a in enumerate(right):
        assert abs(model.chances[j, 0, 2] / model.chances[j, 0, 1:].sum() - a) < 0.06


def test_quality_estimates_the_given_labeller():
    """Labels that are wrong three times in ten are trusted half way from the prior to that, and where they clash with the others the posterior follows the others."""
    rng = np.random.default_rng(3)
    truth = rng.random(30_000) < 0.3
    right = [0.93, 0.9, 0.9, 0.7]
    votes = np.stack([np.where(rng.random(len(truth)) < a, np.where(truth, 1, 2), np.where(truth, 2, 1)) for a in right], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_labels(patterns, counts.astype(float))
    assert abs(model.chances[3, 0, 2] / model.chances[3, 0, 1:].sum() - (0.7 + 0.99) / 2) < 0.05
    assert model.posterior(np.array([[1, 1, 1, 2]]))[0] > 0.8 and model.posterior(np.array([[2, 2, 2, 1]]))[0] < 0.2


def test_quality_fault_that_only_heuristics_see_reaches_the_scorer(spark):
    """The labels know no repeated words; documents of them are without labels, and the heuristics that flag them train the scorer."""
    rows, labels = _quality_rows(1200)
    labels = [x for x in labels if x[0] % 10 != 1]
    given_ = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["id"]: r for r in quality.scored(docs(spark, rows), given_).collect()}
    caught = [got[i]["low_quality"] for i in range(1200) if i % 10 == 1]
    clean = [got[i]["low_quality"] for i in range(1200) if i % 10 > 2]
    assert sum(p >= quality.THRESHOLD for p in caught) >= 0.9 * len(caught) and sum(p >= quality.THRESHOLD for p in clean) <= 0.03 * len(clean)


def test_quality_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.scored(docs(spark, ODD), none).count() == len(ODD)
    assert quality.scored(docs(spark, []), none).count() == 0
    assert quality.accepted(docs(spark, [(1, None), (2, "")]), none).count() == 2


# ------------------------------------------------------------------------------------------------- chat
MESSAGES = "tree long, node long, parent long, role string, text string, score double"


def test_chat_chooses_and_spells_out_branches(spark):
    rng = random.Random(11)
    rows, parent = [], {}
    for tree in range(12):
        n = rng.choice([1, 2, 7, 30, 70])
        for node in range(n):
            parent[tree, node] = None if node == 0 else rng.randrange(max(0, node - 3), node)
            rows.append((tree, node, parent[tree, node], rng.choice(["user", "assistant", None, "</s>"]), rng.choice(["a\\b", "[INST] x", None, "<|end|>", "<\\s>", "é"]), rng.choice([None, 1.0, 0.25])))
    info = {(r[0], r[1]): r for r in rows}
    got = {(r["tree"], r["rank"]): r for r in chat.read_back(chat.formatted(spark.createDataFrame(rows, MESSAGES).repartition(3), keep=2)).collect()}
    for tree in range(12):
        nodes = [k[1] for k in info if k[0] == tree]
        leaves = [x for x in nodes if all(parent[tree, y] != x for y in nodes)]
        paths = {}
        for leaf in leaves:
            path, at = [], leaf
            while at is not None:
                path.append(at)
                at = parent[tree, at]
            paths[leaf] = path[::-1]
        best = sorted(leaves, key=lambda x: (-sum(info[tree, y][5] or 0 for y in paths[x]) / len(paths[x]), -len(paths[x]), x))[:2]
        assert [got[tree, i + 1]["leaf"] for i in range(len(best))] == best
        for i, leaf in enumerate(best):
            r = got[tree, i + 1]
            assert [tuple(t) for t in r["turns"]] == [(info[tree, y][3] or "", info[tree, y][4] or "") for y in paths[leaf]]
            assert r["learned"] == "".join(info[tree, y][4] or "" for y in paths[leaf] if info[tree, y][3] == "assistant")
            inner = r["formatted"][len(chat.OPEN): -len(chat.CLOSE)]
            assert inner.count(chat.END) == len(paths[leaf]) and "[INST]" not in inner and chat.CLOSE not in inner


def test_chat_cycles_and_linear_turns(spark):
    rows = [(1, 1, 2, "user", "a", 1.0), (1, 2, 1, "user", "b", 1.0), (2, 1, 9, "user", "c", 1.0)]
    assert [r["tree"] for r in chat.formatted(spark.createDataFrame(rows, MESSAGES)).collect()] == [2]
    turns = spark.createDataFrame([(1, 5, "user", "q"), (1, 9, "assistant", "r"), (1, 9, "assistant", "r"), (None, None, None, None), (1, None, "system", "s")],
                                  "conv_id long, turn long, role string, text string")
    got = {r["tree"]["id"]: [tuple(t) for t in r["turns"]] for r in chat.read_back(chat.formatted(chat.linear(turns))).collect()}
    assert got == {1: [("system", "s"), ("user", "q"), ("assistant", "r"), ("assistant", "r")], None: [("", "")]}
    assert chat.formatted(chat.linear(turns.limit(0))).count() == 0


# ------------------------------------------------------------------------------------------------- simhash
def plain_print(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i: i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(nodes, linked):
    root = {i: i for i in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


def test_simhash_against_all_pairs(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(300)]
    rows = []
    for i in range(150):
        t = [rng.choice(words) for _ in range(rng.choice([1, 2, 40, 200]))] if i < 60 else rows[rng.randrange(60)][1].split()
        for _ in range(rng.randrange(4) if i >= 60 else 0):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    rows += [(900, None), (901, ""), (902, "É X"), (903, "É x"), (903, "É x")]
    got = {r["id"]: r for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    prints = {i: plain_print(t) for i, t in rows}
    linked = [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 2]
    assert {i: r["fingerprint"] & (1 << 64) - 1 for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == classes(prints, linked)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.near_duplicates(docs(spark, ODD)).count() == len(ODD)


def test_similar_documents_against_all_pairs(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 60, 300])))) for i in range(120)]
    for i in range(120, 320):
        t = rows[rng.randrange(120)][1].split()
        for _ in range(rng.randrange(max(1, len(t) // 25))):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, "  ".join(t)))
    rows += [(900, None), (901, " \n"), (None, "lone")]
    sets = {i: frozenset(zip(*((t or "").split()[j:] for j in range(5)), strict=False)) or ((t or "").split() and frozenset([(t or "",)])) or frozenset() for i, t in rows if i is not None}
    text = {i: " ".join((t or "").split()) for i, t in rows if i is not None}
    want = [(i, j) for i in sets for j in sets if i < j and (text[i] == text[j] or (len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and sets[i]))]
    got = {r["id"]: r["component_id"] for r in simhash.similar(docs(spark, rows)).collect()}
    true = classes(sets, want)
    linked = [(i, j) for i, j in want if got[i] == got[j]]
    assert len(linked) >= 0.95 * len(want) > 50
    assert all(true[i] == true[c] for i, c in got.items() if i is not None) and got[None] is None
    kept = simhash.kept(docs(spark, rows))
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted({c for c in got.values() if c is not None})
    assert kept.columns == docs(spark, []).columns and simhash.kept(docs(spark, [])).count() == 0
    assert simhash.kept(docs(spark, ODD)).count() == 5


def _jaccard(x, y, k=5):
    x, y = ({tuple(t[i: i + k]) for i in range(len(t) - k + 1)} for t in (x, y))
    return len(x & y) / len(x | y)


def test_similar_finds_the_middle_of_a_star(spark):
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(5000)]
    first = [rng.choice(words) for _ in range(204)]
    texts = {}
    for i in range(1000):
        t = list(first)
        for at in rng.sample(range(4, 200), 4):
            t[at] = rng.choice(words)
        texts[i if i < 500 else i + 1] = t
    texts[500] = first
    near = {i for i, t in texts.items() if _jaccard(first, t) >= 0.8}
    got = {r["id"]: r["component_id"] for r in simhash.similar(docs(spark, [(i, " ".join(t)) for i, t in texts.items()])).collect()}
    assert len(near) > 900 and {got[i] for i in near} == {min(near)}


def test_similar_loses_no_link_at_the_threshold(spark):
    rng = random.Random(32)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(5000)]
    rows, want = [], {}
    for i in range(600):
        n = rng.choice([54, 204, 1004])
        x = [rng.choice(words) for _ in range(n)]
        y = list(x)
        while (j := _jaccard(x, y)) >= 0.85:
            y[rng.randrange(n)] = rng.choice(words)
        want[2 * i] = j >= 0.8
        rows += [(2 * i, " ".join(x)), (2 * i + 1, " ".join(y))]
    got = {r["id"]: r["component_id"] for r in simhash.similar(docs(spark, rows)).collect()}
    assert sum(want.values()) > 500 and {i: got[i + 1] == i for i in want} == want


def test_similar_checks_pairs_that_no_leader_joins(spark):
    """Rings: each set is similar to its two neighbours only, and shares words with more of its ring."""
    rows = [(100 * g + i, " ".join(f"r{g}w{(6 * i + k) % 180}" for k in range(64))) for g in range(3) for i in range(30)]
    got = {r["id"]: r["component_id"] for r in simhash.similar(docs(spark, rows)).collect()}
    assert got == {i: i // 100 * 100 for i, _ in rows}


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_distances(radius):
    rng = random.Random(radius)
    prints = [rng.getrandbits(64) for _ in range(70)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for p in prints]
    sliced = simhash.Sliced(np.array(prints, np.uint64).view(np.uint8).reshape(-1, 8))
    for q in prints[:40]:
        full = [f for _, f, _ in sliced.runs]
        assert sorted(sliced.near(q, radius, full)) == [i for i, p in enumerate(prints) if (p ^ q).bit_count() <= radius]


def test_simhash_hot_bucket_in_blocks(spark):
    rng = random.Random(4)
    prints = {0}
    while len(prints) < 400:
        prints.add(rng.choice(sorted(prints)[-40:]) ^ sum(1 << rng.randrange(12) for _ in range(2)))
    rows = [(i, p) for i, p in enumerate(sorted(prints))]
    found = simhash.links(spark.createDataFrame(rows, "node long, print long"), radius=1, block=50)
    got = classes([i for i, _ in rows], [(r["a"], r["b"]) for r in found.collect()])
    want = classes([i for i, _ in rows], [(i, j) for i, p in rows for j, q in rows if i < j and (p ^ q).bit_count() <= 1])
    assert got == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 7), (200, 201), (300, 300), (None, 4)] + [(500, x) for x in range(501, 530)]
    got = {r["node"]: r["root"] for r in base.components(spark.createDataFrame(chain, "a long, b long").repartition(4)).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 0, 200: 200, 201: 200, **{i: 500 for i in range(500, 530)}}
    assert base.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------------------------------------- decontamination
def plain_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(13, len(v))
        windows = {tuple(v[i: i + n]) for i in range(len(v) - n + 1)} if v else set()
        for p in range(len(w) - n + 1) if windows else ():
            if tuple(w[p: p + n]) in windows:
                hit |= set(range(p, p + n))
                found.add(item)
    return len(w), len(hit), sorted(found)


def test_decontamination_against_all_windows(spark):
    rng = random.Random(9)
    for words in (["ab", "cd", "É", "xyz", "q1"], ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(200)]):
        items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 12, 13, 14, 40])))) for i in range(30)] + [(50, None), (51, "..."), (52, "Same words here"), (53, "same WORDS, here")]
        rows = []
        for i in range(40):
            t = [rng.choice(words) for _ in range(rng.randrange(80))]
            if i % 2:
                at, (_, item) = rng.randrange(len(t) + 1), rng.choice(items[:30])
                part = item.split()[rng.randrange(3):]
                t[at:at] = part
            rows.append((i, " - ".join(t)))
        rows += [(90, "x same words here y"), (91, None), (92, ""), (None, items[3][1])]
        got = {r["id"]: (r["n_words"], r["n_hit"], sorted(r["items"])) for r in
               winnow.contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
        assert got == {i: plain_hits(t, items) for i, t in rows}


def test_decontamination_odd_rows(spark):
    items = spark.createDataFrame([(1, "word " * 20)], "item_id long, text string")
    got = {r["id"]: r["n_hit"] for r in winnow.contamination(docs(spark, ODD), items).collect()}
    assert got[5] == 30_000 and got[1] == 0
    assert winnow.contamination(docs(spark, ODD), items.limit(0)).filter("n_hit > 0").count() == 0
    assert winnow.contamination(docs(spark, []), items).count() == 0
    kept = winnow.clean(docs(spark, ODD), items)
    assert kept.count() == len(ODD) - 1 and kept.columns == docs(spark, []).columns


def test_words_across_segments(monkeypatch):
    text = " ".join(f"w{i}" for i in range(2000)) + " " + "z" * 500
    want = winnow.word_hashes(winnow._LOWER[np.frombuffer(text.encode(), np.uint8)])
    monkeypatch.setattr(winnow, "_SEGMENT", 64)
    got = winnow.word_hashes(winnow._LOWER[np.frombuffer(text.encode(), np.uint8)])
    assert all((a == b).all() for a, b in zip(got, want, strict=True)) and len(got[0]) == 2001


# ------------------------------------------------------------------------------------------------- packing
def test_packing_keeps_every_token(spark):
    rng = random.Random(6)
    rows = [(i, "é" * rng.choice([0, 3, 700, 1500, 4000, 9000])) for i in range(300)] + ODD
    lengths = (1024, 2048, 4096)
    got = packing.packed(docs(spark, rows), lengths=lengths, group=64).collect()
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 1) for i, t in rows)
    by_row, bins = defaultdict(list), defaultdict(list)
    for r in got:
        by_row[r["row"]].append(r)
        bins[r["bin_group"], r["bin"]].append(r)
    assert sorted((p[0]["id"] if p[0]["id"] is not None else -1, sum(x["n_tokens"] for x in p)) for p in by_row.values()) == want
    for pieces in by_row.values():
        at = 0
        for r in sorted(pieces, key=lambda x: x["piece"]):
            assert r["start"] == at and r["n_tokens"] > 0
            at += r["n_tokens"]
    for held in bins.values():
        at = 0
        for r in sorted(held, key=lambda x: x["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["n_tokens"]
        assert {r["bin_tokens"] for r in held} == {at} and {r["bin_length"] for r in held} == {packing.downsized(at, lengths)}
    assert packing.packed(docs(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=40))
def test_packing_is_no_dearer_than_one_length(sizes):
    lengths = (20, 40, 60)
    placed = packing.fitted(sizes, lengths)
    used = defaultdict(int)
    for (b, o), s in zip(placed, sizes, strict=True):
        used[b] += s
    assert max(used.values()) <= 60
    # plain best fit into the longest bins only, then downsized
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, u in enumerate(bins) if 60 - u >= s]
        if fits:
            bins[max(fits, key=lambda i: bins[i])] += s
        else:
            bins.append(s)
    total = sum(packing.cost(packing.downsized(u, lengths)) for u in used.values())
    assert total <= 1.25 * sum(packing.cost(packing.downsized(u, lengths)) for u in bins)


def _partitions(sizes):
    if not sizes:
        yield []
        return
    for rest in _partitions(sizes[1:]):
        yield [sizes[0], *rest]
        for i in range(len(rest)):
            yield [*rest[:i], rest[i] + sizes[0], *rest[i + 1:]]


def test_packing_is_near_the_cheapest_of_all_partitions():
    rng = random.Random(11)
    ratios = []
    for _ in range(400):
        lengths = rng.choice([(20, 40, 60), (10, 25, 70), (16, 32, 64, 128)])
        sizes = [rng.randint(1, lengths[-1] if rng.random() < 0.5 else lengths[0]) for _ in range(rng.randint(1, 6))]
        used = defaultdict(int)
        for (b, _), s in zip(packing.fitted(sizes, lengths), sizes, strict=True):
            used[b] += s
        total = lambda bins: sum(packing.cost(packing.downsized(u, lengths)) for u in bins)
        ratios.append(total(used.values()) / min(total(p) for p in _partitions(sizes) if max(p) <= lengths[-1]))
    assert max(ratios) <= 1.25 and sum(ratios) / len(ratios) < 1.005


def test_packing_of_null_counts_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "abc", None), (1, "abc", 0), (None, None, 5000), (2, "x", -4)], "doc_id long, text string, bin long")
    got = packing.packed(df, tokens=F.col("bin"), lengths=(1024, 2048)).collect()
    assert sorted(((r["id"] or -1), r["n_tokens"]) for r in got) == [(-1, 904), (-1, 2048), (-1, 2048), (1, 1), (1, 1), (2, 1)]


# ------------------------------------------------------------------------------------------------- urls
def test_url_rules_and_hosts(spark):
    urls = {1: "http://A.Example.NET/en/x?y", 2: "https://example.com/de/", 3: "http://x.org/fr/a#b", 4: "http://x.net", 5: "no url", 6: None, 7: "http://x.co.uk/", 8: "http://x.net/?q"}
    pages = spark.createDataFrame([(i, u, "z") for i, u in urls.items()], "page_id long, url string, host string")
    none = spark.createDataFrame([], "id long, good int")
    got = {r["id"]: r for r in reputation.judged(pages, none).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert [got[i]["rule"] for i in range(2, 9)] == ["example.com/de/", "org/fr/", None, None, None, None, "net/"]
    assert (got[6]["host"], got[6]["path"]) == ("", "") and got[8]["verdict"] == "block"
    assert reputation.judged(pages.limit(0), none).count() == 0


def test_url_reputation_shrinks(spark):
    rows, outcomes, n = [], [], 0
    for host, good, bad in (("a.bad.com", 1, 40), ("b.bad.com", 0, 30), ("new.bad.com", 0, 0), ("c.fine.com", 600, 1), ("d.fine.com", 300, 2), ("once.fine.com", 0, 1)):
        for k in range(max(1, good + bad)):
            rows.append((n, f"http://{host}/{k}"))
            if good + bad:
                outcomes.append((n, int(k < good)))
            n += 1
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["host"]: r["verdict"] for r in reputation.judged(pages, spark.createDataFrame([*outcomes, (0, None), (None, 1)], "id long, good int")).collect()}
    assert got == {"a.bad.com": "block", "b.bad.com": "block", "new.bad.com": "block", "c.fine.com": "allow", "d.fine.com": "allow", "once.fine.com": "allow"}


# ------------------------------------------------------------------------------------------------- exact copies
def test_exact_copies(spark):
    rows = [(1, "Ab"), (2, "aB"), (3, "ab"), (4, None), (5, ""), (6, "É"), (7, "é"), (8, LONG), (9, LONG.upper()), (9, LONG)]
    got = {r["id"]: r for r in cuckoo.deduplicated(docs(spark, rows)).collect()}
    assert {i: r["keep_id"] for i, r in got.items()} == {1: 3, 2: 3, 3: 3, 4: 5, 5: 5, 6: 6, 7: 7, 8: 9, 9: 9}
    assert got[8]["group_size"] == 3 and got[3]["kept"] and not got[1]["kept"]
    assert bytes(got[4]["digest"]).hex() == hashlib.sha256(b"").hexdigest()
    assert cuckoo.deduplicated(docs(spark, [])).count() == 0
    assert cuckoo.deduplicated(docs(spark, ODD)).count() == len(ODD)


def test_cuckoo_index_against_a_dictionary():
    rng = random.Random(8)
    index, plain = cuckoo.CuckooIndex(buckets=2), {}
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for _ in range(12_000):
        k = rng.choice(keys)
        if rng.random() < 0.65:
            index.add(k, rng.randrange(100), 1)
            plain[k] = plain.get(k, 0) + 1
        else:
            index.remove(k, None, 1)
            if plain.get(k, 0) > 1:
                plain[k] -= 1
            else:
                plain.pop(k, None)
    assert {d: n for d, _, n in index.rows()} == plain
    assert all((index.find(k) is not None) == (k in plain) for k in keys)


def test_index_updates(spark):
    first = cuckoo.digests(docs(spark, [(1, "a"), (2, "a"), (3, "b"), (4, "c")]))
    added, removed = cuckoo.digests(docs(spark, [(5, "c"), (6, "d")])), cuckoo.digests(docs(spark, [(2, "a"), (3, "b")]))
    live = first.union(added).join(removed, ["id", "digest"], "left_anti")
    got = {(bytes(r["digest"]), r["keep_id"], r["live"]) for r in cuckoo.update_index(cuckoo.build_index(first), added, removed, live).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).digest()
    assert got == {(sha("a"), 1, 1), (sha("c"), 5, 2), (sha("d"), 6, 1)}


# ------------------------------------------------------------------------------------------------- main text
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</head><p>no</p>"</script></head><body class="page">
<header><h2>Site name</h2></header><nav><ul><li><a href="/">Home</a><li><a href="/x">The way to the top of it</a></ul></nav>
<div class="cookie-notice"><p>This is the notice that we use and it is for the cookies of this site, as you can see.</p></div>
<article><h1>Title &amp; more</h1><header>By the author</header><p>First   the\n of &eacute; <b>bold<br>line <p>Short.
<div class="comments"><p>This is what the reader said and it is not of the text at all, but of the comment.</p></div>
<form><p>Name</p></form></article><aside>See also</aside><p>After the end</p><footer>&copy; x</footer></body></html>"""


def test_main_text(spark):
    assert extraction.main_text(PAGE) == "Title & more\nBy the author\nFirst the of é bold line\nShort."
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", PAGE), (3, "u", PAGE), (None, "u", "<p>" + "it is the case that " * 20)], "page_id long, url string, html string")
    got = sorted((r["id"] or 0, len(r["text"])) for r in extraction.extracted(pages).collect())
    assert got == [(0, 399), (1, 0), (2, 0), (3, 58), (3, 58)]
    assert extraction.extracted(pages.limit(0)).count() == 0


def test_main_text_without_article():
    good = "It is the first of the long texts that a page can have, and it was made for this test by the one who had to do it. " * 3
    page = f"<div><a href=a>one</a> <a href=b>two</a></div><h2>Head</h2><p>{good}<p>Short one.<p>{good}<div>Ad here</div><ul><li><a>x</a><li><a>y</a></ul>"
    assert extraction.main_text(page).split("\n") == ["Head", good.strip(), "Short one.", good.strip()]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/pa=\"'! -scriptbody&;amp", max_size=80))
def test_main_text_reads_anything(text):
    extraction.main_text(text)


def test_frequent_shingles_come_last_in_every_set(spark):
    """Documents of one passage and words of their own: the passage leaves their prefixes, and the order is the same for all sets."""
    rng = random.Random(33)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([*passage, *("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(60))])) for i in range(60)]
    named = docs(spark, rows).select(F.col("doc_id").alias("id"), "text")
    order = none = simhash.Order(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    shared = simhash._shingle_set(" ".join(passage), 5)
    for _ in range(simhash.PASSES):
        order = simhash._reordered(simhash._prefixes(named, 5, 0.8, order), order)
        assert list(order.tokens) == sorted(set(order.tokens.tolist())) and (order.counts >= simhash.HOT_TEXTS).all()

    def pairs(o):
        held = np.unique(np.concatenate([simhash.prefix(simhash._shingle_set(t, 5), o, 0.8) for _, t in rows]), return_counts=True)[1]
        return (held * (held - 1) // 2).sum()

    # shingles that enter the prefixes in the last pass are not counted, so some frequent ones stay: only the direction is claimed
    assert np.isin(order.tokens, shared).all() and pairs(none) > pairs(order)
    got = simhash.similar(docs(spark, rows)).collect()
    assert all(r["component_id"] == r["id"] for r in got) and len(got) == 60
    assert simhash._reordered(simhash._prefixes(named.limit(0), 5, 0.8, none), none).tokens.size == 0
