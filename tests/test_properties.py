"""Randomized properties: operators against plain-Python brute force on many groups at once."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from hourglass.operators import scan as SC
from hourglass.operators import sequences as SQ
from hourglass.operators import timeline as TL


def _random_states(seed=7, n_groups=60):
    rnd = random.Random(seed)
    rows = []
    for g in range(n_groups):
        for h in range(rnd.randint(1, 30)):
            rows.append((g, h, rnd.choice([0, 1, 1, 0, None]) if rnd.random() < 0.9 else None))
    return rows


def test_transition_labels_brute_force(spark):
    rows = [(g, h, v if v is not None else 0) for g, h, v in _random_states()]
    df = spark.createDataFrame(rows, "g long, h long, v int")
    got = {(r.g, r.h): r.y for r in TL.transition_labels(df, "v", gap=3, n=4, by="g", order="h", out="y").collect()}
    by = {}
    for g, h, v in rows:
        by.setdefault(g, []).append(v)
    exp = {}
    for g, seq in by.items():
        for t in range(len(seq)):
            win = seq[t + 3:t + 7]
            if len(win) < 4:
                continue
            steps = list(zip(win, win[1:]))
            if any(a == 0 and b == 1 for a, b in steps):
                exp[(g, t)] = 0
            elif any(a == 1 and b == 0 for a, b in steps):
                exp[(g, t)] = 1
            elif all(x == 1 for x in win):
                exp[(g, t)] = 2
            else:
                exp[(g, t)] = 3
    assert got == exp


def test_channels_brute_force(spark):
    rnd = random.Random(11)
    rows = []
    for g in range(40):
        for h in range(rnd.randint(1, 25)):
            x = rnd.choice([None, None, float("nan"), rnd.uniform(-5, 5)])
            rows.append((g, h, x))
    df = spark.createDataFrame(rows, "g long, h long, x double")
    got = {(r.g, r.h): (r.V__x, r.M__x, r.D__x) for r in TL.channels(df, ["x"], "g", "h").collect()}
    last_v, last_h, cur = None, None, None
    for g, h, x in rows:
        if g != cur:
            cur, last_v, last_h = g, None, None
        obs = x is not None and not math.isnan(x)
        if obs:
            last_v, last_h = x, h
        assert got[(g, h)] == (last_v, int(obs), h - (last_h if last_h is not None else 0))


def test_prefix_sums_match_accumulate(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 3), i, rnd.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, o long, v long")
    got = {(r.g, r.o): (r.v_cum, r.v_ex) for r in
           SC.prefix_sums(SC.prefix_sums(df, ["g"], ["o"], ["v"], suffix="_cum"), ["g"], ["o"], ["v"],
                          suffix="_ex", inclusive=False).collect()}
    acc = {}
    for g, o, v in sorted(rows, key=lambda r: (r[0], r[1])):
        before = acc.get(g, 0)
        assert got[(g, o)] == (before + v, before)
        acc[g] = before + v


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(9)
    vals = {g: [rnd.choice([rnd.randint(0, 20), rnd.random() * 100]) for _ in range(rnd.randint(1, 400))] for g in range(5)}
    rows = [(g, float(v)) for g, vs in vals.items() for v in vs] + [(0, None)]
    df = spark.createDataFrame(rows, "g int, x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    out = {r.g: r for r in SC.exact_quantiles(df, "x", probs, groups=["g"]).collect()}
    for g, vs in vals.items():
        for p in probs:
            assert math.isclose(out[g][f"p{int(round(p * 100))}"], float(np.percentile(vs, p * 100)), rel_tol=1e-12,
                                abs_tol=1e-12)


def test_build_sequences_matches_numpy_scatter(spark):
    rnd = random.Random(13)
    L = 10
    rows = []
    for g in range(30):
        hours = sorted(rnd.sample(range(0, 15), rnd.randint(1, 12)))
        for h in hours:
            rows.append((g, h, rnd.uniform(-1, 1), rnd.choice([0, 1, 2, 3, None])))
    df = spark.createDataFrame(rows, "g long, h long, x double, y long")
    got = {r.g: r for r in SQ.build_sequences(df, "g", "h", ["x"], seq_len=L, label="y").collect()}
    for g in {r[0] for r in rows}:
        kept = [r for r in rows if r[0] == g and 0 <= r[1] < L]
        if not kept:
            assert g not in got
            continue
        mh = max(r[1] for r in kept)
        xs = np.zeros(L, dtype=np.float32)
        ys = np.full(L, -100)
        for _, h, x, y in kept:
            xs[h + L - 1 - mh] = x
            ys[h + L - 1 - mh] = -100 if y is None else y
        assert np.allclose(np.array(got[g].X_num[0], dtype=np.float32), xs)
        assert list(got[g].y) == ys.tolist()


def test_first_per_key_is_min_of_order(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 20), rnd.randint(0, 5), i, rnd.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, t long, i long, x double")
    got = {r.k: (r.t, r.i, r.x) for r in TL.first_per_key(df, "k", ["t", "i"]).collect()}
    exp = {}
    for k, t, i, x in rows:
        if k not in exp or (t, i) < exp[k][:2]:
            exp[k] = (t, i, x)
    assert got == exp
    assert df.select(F.col("k")).distinct().count() == len(got)
