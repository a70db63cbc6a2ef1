"""Scorers against a plain dynamic programme over every window."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quoteloom.functions.fuzzy import best_windows, lcs_length, partial_ratios, ratio


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            row[j], before = (before + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def every_window(a, b):
    def one_way(short, long_):
        m, n = len(short), len(long_)
        windows = [long_[:i] for i in range(1, m)] + [long_[i:i + m] for i in range(n - m + 1)] + [long_[i:] for i in range(n - m + 1, n)]
        return max(100 * (1 - (m + len(w) - 2 * table_lcs(short, w)) / (m + len(w))) for w in windows)

    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    best = one_way(short, long_)
    return max(best, one_way(long_, short)) if len(a) == len(b) else best


words = st.text(alphabet="abcñ ", min_size=1, max_size=40)


@settings(max_examples=150, deadline=None)
@given(words, words)
def test_lcs_and_partial_ratio(a, b):
    assert lcs_length(a, b) == table_lcs(a, b)
    assert abs(partial_ratios([a], [b])[0] - every_window(a, b)) < 1e-9


def test_many_pairs_with_long_needles():
    rng = np.random.default_rng(3)
    pick = lambda n: "".join(rng.choice(list("abcd "), n))
    a = [pick(int(n)) for n in rng.integers(1, 150, 120)]
    b = [pick(int(n)) for n in rng.integers(1, 200, 120)]
    got = partial_ratios(a, b)
    assert all(abs(g - every_window(x, y)) < 1e-9 for g, x, y in zip(got, a, b))


def test_edges():
    assert ratio("", "") == 100.0 and ratio("a", "") == 0.0
    assert list(partial_ratios(["", "", "abc"], ["", "a", "xxabcxx"])) == [100.0, 0.0, 100.0]


def test_one_pass_scores_windows_of_both_strings_and_parts_of_long_texts():
    rng = np.random.default_rng(4)
    pick = lambda n: "".join(rng.choice(list("abc é😀"), n))
    same = [(pick(int(n)), pick(int(n))) for n in rng.integers(1, 90, 60)]
    assert np.abs(best_windows(same) - [every_window(a, b) for a, b in same]).max() < 1e-9
    long_ = [(pick(int(m)), pick(int(n))) for m, n in zip(rng.integers(1, 12, 40), rng.integers(100, 400, 40))]
    assert np.abs(best_windows(long_) - [every_window(a, b) for a, b in long_]).max() < 1e-9


def test_rect_check_reads_its_texts_once_and_keeps_rows_without_clips(spark):
    from quoteloom.operators.documents import rect_check

    blocks = spark.createDataFrame([("p", "d", "b1", "parrafo", "abc def"), ("p", "d", "b2", "parrafo", " "), ("p", "d", "b3", "parrafo", "xyz"), ("p", "d", "b4", "tabla", "t")],
                                   "project_id string, doc_id string, block_id string, type string, text string")
    clips = spark.createDataFrame([("p", "d", "b1", "abc def", None), ("p", "d", "b1", "zzz", "abc"), ("p", "d", "b2", "q", "q")],
                                  "project_id string, doc_id string, block_id string, clip string, shifted string")
    out = rect_check(blocks, clips)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("ArrowEvalPython") == 1
    assert sorted((r.block_id, r.similarity, r.state, r.control_similarity) for r in out.collect()) == [
        ("b1", 100.0, "OK", 100.0), ("b2", None, "SIN_TEXTO", None), ("b3", 0.0, "REVISAR", 0.0)]
