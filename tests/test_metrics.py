"""Prediction metrics against brute force on small fixtures."""

from __future__ import annotations

import itertools
import math
import random

from hourglass.operators import metrics as M


def _auc_brute(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y]
    neg = [s for s, y in zip(scores, labels) if not y]
    if not pos or not neg:
        return None
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def _ap_brute(scores, labels):
    P = sum(labels)
    if P == 0:
        return None
    ap, prev_r = 0.0, 0.0
    for t in sorted(set(scores), reverse=True):
        tp = sum(1 for s, y in zip(scores, labels) if s >= t and y)
        fp = sum(1 for s, y in zip(scores, labels) if s >= t and not y)
        r = tp / P
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    return ap


def test_roc_auc_and_ap_with_ties(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(200):
        s = rnd.choice([0.1, 0.2, 0.2, 0.5, 0.7, 0.9])
        rows.append((i, [1 - s, s], int(rnd.random() < s)))
    df = spark.createDataFrame(rows, "id long, probs array<double>, label int")
    auc = {r.cls: r.auc for r in M.roc_auc(df, classes=(0, 1)).collect()}
    ap = {r.cls: r.ap for r in M.average_precision(df, classes=(0, 1)).collect()}
    for c in (0, 1):
        sc = [p[c] for _, p, _ in rows]
        lb = [int(y == c) for *_, y in rows]
        assert math.isclose(auc[c], _auc_brute(sc, lb), rel_tol=1e-12)
        assert math.isclose(ap[c], _ap_brute(sc, lb), rel_tol=1e-12)


def test_auc_undefined_class_and_monotone_invariance(spark):
    rows = [(0, [0.9, 0.1], 0), (1, [0.2, 0.8], 0)]
    df = spark.createDataFrame(rows, "id long, probs array<double>, label int")
    got = {r.cls: (r.auc, r.auc_or_zero) for r in M.roc_auc(df, classes=(0, 1)).collect()}
    assert got[0] == (None, 0.0) and got[1] == (None, 0.0)


def test_candidate_metrics_fixture(spark):
    rows = [
        (1, [2.0, 1.0, 0.0], [0, -1], 0),       # hit
        (2, [0.0, 0.0, 5.0], [0, 1], 1),        # miss, tied logits
        (3, [1.0, 2.0, 3.0], [], 2),            # no candidates
        (4, [0.0, 1.0, 0.5], [0, 1, 2], 1),     # every class a candidate
    ]
    df = spark.createDataFrame(rows, "id long, logits array<double>, candidates array<int>, label int")
    r = M.candidate_metrics(M.score(df), ks=(1, 2)).first()
    assert math.isclose(r.cand_acc, 2 / 3)
    assert math.isclose(r.hit_at_1, 2 / 3) and r.hit_at_2 == 1.0  # row 2: top-2 is [2, 0]
    assert r.cmg == float("inf")  # a row with every class a candidate has no competitor
    assert r.pred_unique == 3 and r.top_pred == 2 and math.isclose(r.top_ratio, 0.5)
    assert r.k_cand == 3


def test_macro_f1_matches_definition(spark):
    rows = [(0, 0), (1, 1), (1, 0), (2, 2), (2, 1), (3, 3)]
    df = spark.createDataFrame(rows, "pred int, label int")
    got = M.macro_f1(df).first().f1_macro
    f1s = []
    for c in {0, 1, 2, 3}:
        tp = sum(1 for p, y in rows if p == c and y == c)
        fp = sum(1 for p, y in rows if p == c and y != c)
        fn = sum(1 for p, y in rows if p != c and y == c)
        f1s.append(2 * tp / (2 * tp + fp + fn))
    assert math.isclose(got, sum(f1s) / len(f1s))


def test_pseudo_labels_single_candidate_infinite_margin(spark):
    rows = [(1, [0.0, 3.0, 2.95], [1, 2]), (2, [0.0, 3.0, 1.0], [1, 2]), (3, [9.0, 0.0, 0.0], [2]), (4, [1.0, 1.0], [])]
    df = spark.createDataFrame(rows, "id long, logits array<double>, candidates array<int>")
    got = {r.id: (r.pseudo_label, r.confident) for r in M.pseudo_labels(df, margin=0.1).collect()}
    assert got == {1: (1, False), 2: (1, True), 3: (2, True)}


def test_clpl_matches_formula(spark):
    rows = [(1, [1.0, -2.0, 0.5], [0, 2, 2])]
    df = spark.createDataFrame(rows, "id long, logits array<double>, candidates array<int>")
    got = M.clpl_loss(df, kind="logistic").first().clpl_loss
    exp = math.log1p(math.exp(-(1.0 + 0.5) / 2)) + math.log1p(math.exp(-2.0))
    assert math.isclose(got, exp, rel_tol=1e-12)
