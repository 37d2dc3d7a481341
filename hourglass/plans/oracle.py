"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Written independently of the Spark code, from the operator definitions:
same inputs (the driver's tables), same outputs, DOUBLEs rounded to 6 places.
"""

from __future__ import annotations

import re

FEATURES = ("click", "error", "purchase", "signup", "view", "refund")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
GRID_HOURS = 720
SEQ_LEN = 120


def r(x: str, alias: str | None = None) -> str:
    return f"round({x}, 6) AS {alias or x}"


# ------------------------------------------------------------------ event timeline CTEs
EV_STAYS = """ev_stays AS (
  SELECT user_id, date_trunc('hour', min(ts)) AS intime, max(ts) AS outtime,
         date_sub('hour', date_trunc('hour', min(ts)), max(ts)) AS STAY_HOURS
  FROM events GROUP BY user_id)"""

EV_HOURLY = """ev_hourly AS (
  SELECT e.user_id,
         CAST(floor((epoch_us(e.ts) - epoch_us(s.intime)) / 3600000000.0) AS BIGINT) AS HOURS_IN,
         e.event_type, avg(e.value) AS MEAN, count(e.value) AS COUNT, stddev_samp(e.value) AS STDDEV
  FROM events e JOIN ev_stays s
    ON e.user_id = s.user_id AND e.ts >= s.intime AND e.ts <= s.outtime
  WHERE floor((epoch_us(e.ts) - epoch_us(s.intime)) / 3600000000.0) >= 0
  GROUP BY 1, 2, 3)"""


def _pivot(src: str, names, key_alias: str = "HOUR_IN") -> str:
    cols = ",\n         ".join(f"avg(MEAN) FILTER (WHERE event_type = '{n}') AS {n}" for n in names)
    return f"""SELECT user_id, HOURS_IN AS {key_alias},
         {cols}
  FROM {src} GROUP BY 1, 2"""


EV_WIDE = f"ev_wide AS (\n  {_pivot('ev_hourly', FEATURES)})"

EV_GRID = f"""ev_grid AS (
  SELECT user_id, intime, unnest(range(STAY_HOURS)) AS HOUR_IN
  FROM ev_stays WHERE STAY_HOURS > 0)"""

EV_FLAGGED = """ev_flagged AS (
  SELECT g.user_id, g.intime, g.HOUR_IN,
         CAST(coalesce(last_value(f.F IGNORE NULLS) OVER (PARTITION BY g.user_id ORDER BY g.HOUR_IN
              ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0) AS TINYINT) AS VENT
  FROM ev_grid g LEFT JOIN (SELECT DISTINCT user_id, HOURS_IN, 1 AS F FROM ev_hourly
                            WHERE event_type IN ('purchase', 'error')) f
    ON g.user_id = f.user_id AND g.HOUR_IN = f.HOURS_IN)"""

_LBL = """CASE WHEN f0 IS NULL OR f1 IS NULL OR f2 IS NULL OR f3 IS NULL THEN NULL
              WHEN (f0 = 0 AND f1 = 1) OR (f1 = 0 AND f2 = 1) OR (f2 = 0 AND f3 = 1) THEN 0
              WHEN (f0 = 1 AND f1 = 0) OR (f1 = 1 AND f2 = 0) OR (f2 = 1 AND f3 = 0) THEN 1
              WHEN f0 = 1 AND f1 = 1 AND f2 = 1 AND f3 = 1 THEN 2
              WHEN f0 = 0 AND f1 = 0 AND f2 = 0 AND f3 = 0 THEN 3 END"""

EV_LABELS = f"""ev_labels AS (
  SELECT user_id, HOUR_IN, CAST(lbl AS BIGINT) AS target FROM (
    SELECT user_id, HOUR_IN, {_LBL} AS lbl FROM (
      SELECT user_id, HOUR_IN,
             lead(VENT, 6) OVER w AS f0, lead(VENT, 7) OVER w AS f1,
             lead(VENT, 8) OVER w AS f2, lead(VENT, 9) OVER w AS f3
      FROM ev_flagged WINDOW w AS (PARTITION BY user_id ORDER BY HOUR_IN)))
  WHERE lbl IS NOT NULL)"""


def _channel_cols(features, seq_len: int, rnd: bool) -> str:
    w = "(PARTITION BY user_id ORDER BY HOUR_IN ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    out = []
    for f in features:
        fin = f"CASE WHEN isfinite({f}) THEN {f} END"
        v = f"last_value({fin} IGNORE NULLS) OVER {w}"
        out.append(f"round({v}, 6) AS V__{f}" if rnd else f"{v} AS V__{f}")
        out.append(f"CAST(coalesce(isfinite({f}), false) AS TINYINT) AS M__{f}")
        lh = f"last_value(CASE WHEN isfinite({f}) THEN HOUR_IN END IGNORE NULLS) OVER {w}"
        out.append(f"CAST(HOUR_IN - coalesce({lh}, 0) AS INTEGER) AS D__{f}")
    t = f"CAST(HOUR_IN AS DOUBLE) / {float(seq_len)}"
    out.append(f"round({t}, 6) AS V__time" if rnd else f"{t} AS V__time")
    return ",\n         ".join(out)


EV_CHANNELS = f"""ev_channels AS (
  SELECT user_id, HOUR_IN, intime, VENT,
         {_channel_cols(FEATURES, GRID_HOURS, False)}
  FROM ev_flagged LEFT JOIN ev_wide USING (user_id, HOUR_IN))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


EV_BASE = (EV_STAYS, EV_HOURLY)
EV_ALL = (EV_STAYS, EV_HOURLY, EV_WIDE, EV_GRID, EV_FLAGGED, EV_LABELS, EV_CHANNELS)


def _round_channels(features) -> str:
    cols = ["user_id", "HOUR_IN"]
    for f in features:
        cols += [r(f"V__{f}"), f"M__{f}", f"D__{f}"]
    cols.append(r("V__time"))
    return ", ".join(cols)


# ------------------------------------------------------------------ order stays / cohort
ORDER_STAYS = """order_stays AS (
  SELECT o.o_orderkey AS ICUSTAY_ID, o.o_orderkey AS HADM_ID, o.o_custkey AS SUBJECT_ID,
         o.o_orderdate AS INTIME, s.outtime AS OUTTIME, s.ret + INTERVAL 3 DAY AS DEATHTIME,
         o.o_orderpriority AS ADMISSION_TYPE
  FROM orders o JOIN (SELECT l_orderkey, max(l_shipdate) AS outtime,
                             max(CASE WHEN l_returnflag = 'R' THEN l_shipdate END) AS ret
                      FROM lineitem GROUP BY l_orderkey) s ON o.o_orderkey = s.l_orderkey)"""

PERSONS = """persons AS (
  SELECT c.c_custkey AS SUBJECT_ID,
         TIMESTAMP '1930-01-01 00:00:00' + to_days(CAST((c.c_custkey * 7919) % 30000 AS INTEGER))
           + to_hours(CAST(c.c_custkey % 24 AS BIGINT)) AS DOB,
         n.n_name AS ETHNICITY, c.c_mktsegment AS INSURANCE, c.c_acctbal AS ACCTBAL
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

COHORT = """cohort AS (
  SELECT s.SUBJECT_ID, s.HADM_ID, s.ICUSTAY_ID, s.INTIME, s.OUTTIME,
         s.INTIME AS ADMITTIME, s.OUTTIME + INTERVAL 7 DAY AS DISCHTIME, s.DEATHTIME, s.ADMISSION_TYPE,
         p.DOB, p.ETHNICITY, p.INSURANCE, p.ACCTBAL
  FROM order_stays s JOIN persons p ON s.SUBJECT_ID = p.SUBJECT_ID
  WHERE s.OUTTIME > s.INTIME)"""

COHORT_F = """cohort_f AS (
  SELECT *, date_sub('hour', INTIME, OUTTIME) AS STAY_HOURS,
         date_sub('second', INTIME, OUTTIME) / 86400.0 AS LOS,
         CAST(floor(date_sub('day', DOB, INTIME) / 365.2425) AS INTEGER) AS AGE,
         CASE WHEN DEATHTIME BETWEEN INTIME AND OUTTIME THEN 1 ELSE 0 END AS MORT_ICU,
         CASE WHEN DEATHTIME BETWEEN ADMITTIME AND DISCHTIME THEN 1 ELSE 0 END AS MORT_HOSP
  FROM cohort)"""

CO_ALL = (ORDER_STAYS, PERSONS, COHORT, COHORT_F)

SEG = ("CASE WHEN upper(c_mktsegment) = 'AUTOMOBILE' THEN 'AUTOMOBILE' WHEN upper(c_mktsegment) = 'BUILDING' "
       "THEN 'BUILDING' WHEN upper(c_mktsegment) = 'FURNITURE' THEN 'FURNITURE' ELSE 'OTHER' END")
BAL = ("CASE WHEN c_acctbal < 0 THEN 'NEG' WHEN c_acctbal < 2500 THEN 'LOW' WHEN c_acctbal < 5000 "
       "THEN 'MID' ELSE 'HIGH' END")


def _onehot(expr: str, levels, prefix: str) -> str:
    return ", ".join(f"CAST(CASE WHEN ({expr}) = '{lv}' THEN 1 ELSE 0 END AS TINYINT) AS {prefix}__{lv}"
                     for lv in levels)


STATICS = f"""statics AS (
  SELECT c_custkey AS SUBJECT_ID,
         {_onehot(SEG, ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'OTHER'], 'S__SEG')},
         {_onehot(BAL, ['NEG', 'LOW', 'MID', 'HIGH'], 'S__BAL')}
  FROM customer)"""

RANGES = """ranges AS (
  SELECT * FROM (VALUES ('click', 1.0, 2.0, 40.0, 45.0), ('view', 0.5, 1.0, 30.0, 48.0),
                        ('purchase', NULL, NULL, NULL, NULL), ('error', 2.0, 3.0, 35.0, 45.0),
                        ('error', NULL, NULL, NULL, NULL))
         t(LEVEL2, OUT_LOW, VAL_LOW, VAL_HIGH, OUT_HIGH))"""

RANGED = """ranged AS (
  SELECT e.event_id, e.event_type, e.value,
         CAST(r.OUT_LOW AS DOUBLE) AS OUT_LOW, CAST(r.VAL_LOW AS DOUBLE) AS VAL_LOW,
         CAST(r.VAL_HIGH AS DOUBLE) AS VAL_HIGH, CAST(r.OUT_HIGH AS DOUBLE) AS OUT_HIGH
  FROM events e LEFT JOIN ranges r ON lower(e.event_type) = lower(r.LEVEL2))"""

KEPT = """kept AS (
  SELECT * FROM ranged
  WHERE NOT (coalesce(value < OUT_LOW, false) OR coalesce(value > OUT_HIGH, false)))"""

# ------------------------------------------------------------------ codes / vocabulary / candidates
ORDER_CODES = """order_codes AS (
  SELECT l.l_orderkey AS o_orderkey, list_sort(list_distinct(list(p.p_brand))) AS CODES
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  WHERE p.p_brand IS NOT NULL GROUP BY 1)"""

VOCAB = """vocab AS (
  SELECT CAST(row_number() OVER (ORDER BY n DESC, code ASC) - 1 AS BIGINT) AS idx, code, n
  FROM (SELECT code, count(*) AS n FROM (SELECT unnest(CODES) AS code FROM order_codes)
        WHERE code IS NOT NULL GROUP BY code))"""

ORDER_CANDS = """order_cands AS (
  SELECT oc.o_orderkey, oc.CODES,
         coalesce(x.candidates, CAST([] AS BIGINT[])) AS candidates
  FROM order_codes oc LEFT JOIN (
    SELECT u.o_orderkey, list(v.idx ORDER BY u.pos) AS candidates
    FROM (SELECT o_orderkey, unnest(CODES) AS code, generate_subscripts(CODES, 1) AS pos FROM order_codes) u
    JOIN vocab v ON u.code = v.code GROUP BY u.o_orderkey) x ON oc.o_orderkey = x.o_orderkey)"""

ALL_CANDS = """all_cands AS (
  SELECT o.o_orderkey, coalesce(c.candidates, CAST([] AS BIGINT[])) AS candidates
  FROM orders o LEFT JOIN order_cands c ON o.o_orderkey = c.o_orderkey)"""

CANDS_ALL = (ORDER_CODES, VOCAB, ORDER_CANDS, ALL_CANDS)

INCLUSION = """inclusion AS (
  SELECT k.class_idx, CAST(coalesce(i.n_rows, 0) AS BIGINT) AS n_rows,
         coalesce(i.n_rows, 0) / (SELECT count(*) FROM all_cands) AS ratio
  FROM (SELECT range AS class_idx FROM range((SELECT count(*) FROM vocab))) k
  LEFT JOIN (SELECT c AS class_idx, count(*) AS n_rows
             FROM (SELECT unnest(list_distinct(list_filter(candidates, lambda x: x >= 0))) AS c FROM all_cands)
             GROUP BY c) i ON k.class_idx = i.class_idx)"""

# ------------------------------------------------------------------ class weights
LABEL_COUNTS = """label_counts AS (
  SELECT k.class_idx, CAST(coalesce(c.n, 0) AS BIGINT) AS n
  FROM (SELECT range AS class_idx FROM range(12)) k
  LEFT JOIN (SELECT CAST(label AS BIGINT) AS class_idx, count(*) AS n FROM embeddings GROUP BY 1) c
    ON k.class_idx = c.class_idx)"""

# ------------------------------------------------------------------ splits
HASH = "('0x' || substr(md5(CAST({k} AS VARCHAR) || ':{seed}'), 1, 8))::BIGINT"
SPLITS = f"""splits AS (
  SELECT user_id, CASE WHEN {HASH.format(k='user_id', seed=42)} % 1000 < 700 THEN 'train'
                       WHEN {HASH.format(k='user_id', seed=42)} % 1000 < 800 THEN 'val'
                       ELSE 'test' END AS split
  FROM ev_stays)"""

Z_COLS = ("V__click", "V__error", "V__purchase", "V__signup", "V__view")
TRAIN_STATS = "train_stats AS (SELECT " + ", ".join(
    f"avg({c}) AS {c}__mean, stddev_samp({c}) AS {c}__std" for c in Z_COLS) + \
    " FROM ev_channels WHERE user_id IN (SELECT user_id FROM splits WHERE split = 'train'))"

SEQ_CHANNELS = (*(f"{block}__{name}" for block in "VMD" for name in FEATURES), "V__time")
SEQ_LONG = f"""ds AS (
  SELECT c.*, l.target FROM ev_channels c LEFT JOIN ev_labels l USING (user_id, HOUR_IN)),
seq_size AS (SELECT greatest(coalesce(max(STAY_HOURS), 0), 1) AS L FROM ev_stays),
seq_rows AS (SELECT * FROM ds),
seq_mh AS (SELECT s.user_id, max(d.HOUR_IN) AS mh FROM ev_stays s LEFT JOIN ds d USING (user_id) GROUP BY s.user_id),
seq_pos AS (SELECT unnest(range(L)) AS pos, L FROM seq_size),
seq_long AS (
  SELECT m.user_id, CAST(ch.channel AS INTEGER) AS channel, CAST(p.pos AS INTEGER) AS pos,
         CAST(coalesce(CASE ch.channel {' '.join(f"WHEN {i} THEN CAST(CASE WHEN isfinite(CAST(s.{c} AS DOUBLE)) THEN CAST(s.{c} AS DOUBLE) END AS FLOAT)" for i, c in enumerate(SEQ_CHANNELS))} END, 0.0) AS FLOAT) AS value
  FROM seq_mh m
  CROSS JOIN (SELECT range AS channel FROM range({len(SEQ_CHANNELS)})) ch
  CROSS JOIN seq_pos p
  LEFT JOIN seq_rows s ON s.user_id = m.user_id AND s.HOUR_IN = p.pos - (p.L - 1 - m.mh)),
seq_y AS (
  SELECT m.user_id, p.pos, coalesce(CASE WHEN s.user_id IS NULL THEN NULL ELSE coalesce(s.target, -100) END, -100) AS y
  FROM seq_mh m CROSS JOIN seq_pos p
  LEFT JOIN seq_rows s ON s.user_id = m.user_id AND s.HOUR_IN = p.pos - (p.L - 1 - m.mh))"""

# ------------------------------------------------------------------ predictions
PREDS = """preds AS (
  SELECT vec_id AS id, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE)) AS logits,
         CASE WHEN vec_id % 7 = 0 THEN CAST([] AS INTEGER[])
              ELSE [label, (label + 1) % 10, (label + 9) % 10] END AS candidates,
         CAST(label AS INTEGER) AS label
  FROM embeddings)"""

SCORED = """scored AS (
  SELECT id, logits, candidates, label, logits AS scaled,
         list_transform(logits, lambda x: exp(x - list_max(logits))) AS e,
         CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred
  FROM preds),
scored2 AS (
  SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS probs FROM scored)"""

TOPK = ("list_transform(list_sort(list_transform(scaled, lambda x, i: {{'neg': -x, 'idx': i - 1}}))[1:{k}], "
        "lambda s: s.idx)")

BINARY = """binary AS (
  SELECT l.doc_id, l.quality AS label, l.toxic,
         [1.0 - (d.n_chars % 97) / 97.0, (d.n_chars % 97) / 97.0] AS probs
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def _auc_sql(src: str, classes, label: str) -> str:
    cls = ", ".join(f"({c})" for c in classes)
    return f"""WITH {src},
cls AS (SELECT * FROM (VALUES {cls}) t(cls)),
long AS (SELECT c.cls, CAST(b.probs[c.cls + 1] AS DOUBLE) AS score,
                CASE WHEN b.{label} = c.cls THEN 1 ELSE 0 END AS is_pos
         FROM src b CROSS JOIN cls c WHERE b.{label} IS NOT NULL AND b.{label} <> -100),
t AS (SELECT cls, score, sum(is_pos) AS pos, sum(1 - is_pos) AS neg FROM long GROUP BY 1, 2),
t2 AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY cls ORDER BY score
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM t),
per AS (SELECT cls, sum(pos * (neg_below + neg / 2.0)) AS u, sum(pos) AS P, sum(neg) AS N FROM t2 GROUP BY cls)
SELECT CAST(c.cls AS INTEGER) AS cls,
       round(CASE WHEN P > 0 AND N > 0 THEN u / (P * N) END, 6) AS auc,
       round(coalesce(CASE WHEN P > 0 AND N > 0 THEN u / (P * N) END, 0.0), 6) AS auc_or_zero
FROM cls c LEFT JOIN per USING (cls)"""


def _ap_sql(src: str, classes, label: str) -> str:
    cls = ", ".join(f"({c})" for c in classes)
    return f"""WITH {src},
cls AS (SELECT * FROM (VALUES {cls}) t(cls)),
long AS (SELECT c.cls, CAST(b.probs[c.cls + 1] AS DOUBLE) AS score,
                CASE WHEN b.{label} = c.cls THEN 1 ELSE 0 END AS is_pos
         FROM src b CROSS JOIN cls c WHERE b.{label} IS NOT NULL AND b.{label} <> -100),
t AS (SELECT cls, score, sum(is_pos) AS pos, sum(1 - is_pos) AS neg FROM long GROUP BY 1, 2),
t2 AS (SELECT *, sum(pos) OVER w AS pos_ge, sum(neg) OVER w AS neg_ge FROM t
       WINDOW w AS (PARTITION BY cls ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
tot AS (SELECT cls, sum(pos) AS P FROM t GROUP BY cls),
per AS (SELECT t2.cls, sum(t2.pos / tot.P * (t2.pos_ge / (t2.pos_ge + t2.neg_ge))) AS ap, max(tot.P) AS P
        FROM t2 JOIN tot USING (cls) GROUP BY t2.cls)
SELECT CAST(c.cls AS INTEGER) AS cls, round(CASE WHEN P > 0 THEN ap END, 6) AS ap
FROM cls c LEFT JOIN per USING (cls)"""


LSE = "(list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))))"


def _focal(weights: dict | None, smoothing: float) -> str:
    k = 10
    tgt = f"list_transform(range({k}), lambda i: (CASE WHEN i = label THEN {1.0 - smoothing} ELSE 0.0 END) + {smoothing} / {k})"
    lsm = f"list_transform(logits, lambda x: x - {LSE})"
    ce = f"(- list_sum(list_transform(range({k}), lambda i: ({tgt})[i + 1] * ({lsm})[i + 1])))"
    pt = f"list_sum(list_transform(range({k}), lambda i: ({tgt})[i + 1] * exp(({lsm})[i + 1])))"
    loss = f"pow(1.0 - {pt}, 2.0) * {ce}"
    if weights:
        wl = "[" + ", ".join(str(float(weights[i])) for i in range(k)) + "]"
        loss = f"({loss}) * {wl}[label + 1]"
    return f"""WITH {PREDS}
SELECT round(coalesce(avg(CASE WHEN label IS NOT NULL AND label <> -100 THEN {loss} ELSE 0.0 END), 0.0), 6)
       AS focal_loss FROM preds"""


def _clpl(kind: str, clip: float | None, weights: dict | None) -> str:
    lg = f"list_transform(logits, lambda x: least(greatest(x, {-clip}), {clip}))" if clip else "logits"
    c = "list_distinct(list_filter(candidates, lambda x: x >= 0))"

    def psi(u):
        return {"exponential": f"exp(-({u}))", "logistic": f"ln(1 + exp(-({u})))",
                "hinge": f"greatest(1.0 - ({u}), 0.0)"}[kind]
    cand_sum = f"coalesce(list_sum(list_transform({lg}, lambda x, i: CASE WHEN list_contains({c}, i - 1) THEN x ELSE 0.0 END)), 0.0)"
    card = f"greatest(CAST(len({c}) AS DOUBLE), 1.0)"
    term1 = psi(f"{cand_sum} / {card}")
    term2 = (f"coalesce(list_sum(list_transform({lg}, lambda x, i: CASE WHEN list_contains({c}, i - 1) THEN 0.0 "
             f"ELSE {psi('-x')} END)), 0.0)")
    loss = f"({term1} + {term2})"
    if weights:
        wl = "[" + ", ".join(str(float(weights[i])) for i in range(10)) + "]"
        wsum = f"coalesce(list_sum(list_transform({c}, lambda i: {wl}[i + 1])), 0.0)"
        loss = f"{loss} * (CASE WHEN len({c}) > 0 THEN {wsum} / {card} ELSE 1.0 END)"
    return f"WITH {PREDS}\nSELECT round(coalesce(avg({loss}), 0.0), 6) AS clpl_loss FROM preds"


ORACLE: dict[str, str] = {}

# ------------------------------------------------------------------ event timeline
ORACLE["flagship_timeline"] = with_(*EV_ALL) + f"""
SELECT VENT, {_round_channels(FEATURES)}, l.target
FROM ev_channels c LEFT JOIN ev_labels l USING (user_id, HOUR_IN)"""

ORACLE["a1_hourly_stats"] = with_(*EV_BASE) + \
    f"SELECT user_id, HOURS_IN, event_type, {r('MEAN')}, COUNT, {r('STDDEV')} FROM ev_hourly"

ORACLE["a3_pivot_fixed"] = with_(*EV_BASE, EV_WIDE) + \
    "SELECT user_id, HOUR_IN, " + ", ".join(r(f) for f in FEATURES) + " FROM ev_wide"

ORACLE["p15_ensure_columns"] = with_(*EV_BASE) + \
    "SELECT user_id, HOURS_IN, " + ", ".join(r(f) for f in EVENT_TYPES) + \
    ", CAST(NULL AS DOUBLE) AS refund, CAST(NULL AS VARCHAR) AS unit FROM (" + \
    _pivot("ev_hourly", EVENT_TYPES, "HOURS_IN") + ")"

ORACLE["g1_hourly_grid"] = with_(EV_STAYS, EV_GRID) + "SELECT * FROM ev_grid"

ORACLE["j6_flag_hours"] = with_(*EV_BASE, EV_GRID) + """
SELECT g.user_id, g.HOUR_IN, CAST(f.FLAG AS TINYINT) AS FLAG
FROM ev_grid g LEFT JOIN (SELECT DISTINCT user_id, HOURS_IN, 1 AS FLAG FROM ev_hourly
                          WHERE event_type IN ('purchase', 'error')) f
  ON g.user_id = f.user_id AND g.HOUR_IN = f.HOURS_IN"""

ORACLE["w2_ffill_limit"] = with_(*EV_BASE, EV_GRID, EV_FLAGGED) + "SELECT user_id, HOUR_IN, VENT FROM ev_flagged"

ORACLE["w2_ffill_carry_across"] = with_(*EV_BASE, EV_GRID) + """
SELECT g.user_id, g.HOUR_IN,
       CAST(coalesce(last_value(f.F IGNORE NULLS) OVER (ORDER BY g.user_id, g.HOUR_IN
            ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0) AS TINYINT) AS VENT
FROM ev_grid g LEFT JOIN (SELECT DISTINCT user_id, HOURS_IN, 1 AS F FROM ev_hourly
                          WHERE event_type IN ('purchase', 'error')) f
  ON g.user_id = f.user_id AND g.HOUR_IN = f.HOURS_IN"""

ORACLE["w3_channels"] = with_(*EV_ALL) + f"SELECT {_round_channels(FEATURES)} FROM ev_channels"

ORACLE["w4_transition_labels"] = with_(*EV_BASE, EV_GRID, EV_FLAGGED, EV_LABELS) + "SELECT * FROM ev_labels"

ORACLE["j9_attach_wide"] = with_(*EV_BASE, EV_WIDE, EV_GRID) + \
    "SELECT user_id, HOUR_IN, " + ", ".join(r(f) for f in FEATURES) + \
    " FROM ev_grid LEFT JOIN ev_wide USING (user_id, HOUR_IN)"

ORACLE["w1_ffill"] = with_(*EV_BASE, EV_WIDE, EV_GRID) + """
SELECT user_id, HOUR_IN,
  round(last_value(click IGNORE NULLS) OVER w, 6) AS click,
  round(last_value(view IGNORE NULLS) OVER w, 6) AS view
FROM ev_grid LEFT JOIN ev_wide USING (user_id, HOUR_IN)
WINDOW w AS (PARTITION BY user_id ORDER BY HOUR_IN ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

ORACLE["p23_time_channel"] = with_(EV_STAYS, EV_GRID) + \
    f"SELECT user_id, HOUR_IN, CAST(HOUR_IN AS DOUBLE) / {float(SEQ_LEN)} AS V__time FROM ev_grid"

ORACLE["p20_hour_of_day"] = with_(EV_STAYS, EV_GRID) + \
    "SELECT user_id, HOUR_IN, CAST(hour(intime + to_hours(HOUR_IN)) AS TINYINT) AS HOD FROM ev_grid"

ORACLE["p22_add_flags"] = with_(EV_STAYS, EV_GRID) + \
    "SELECT user_id, HOUR_IN, CAST(0 AS TINYINT) AS OUTCOME_FLAG, CAST(0 AS TINYINT) AS VASO FROM ev_grid"

ORACLE["j3_join_in_interval"] = """
SELECT l.l_orderkey AS o_orderkey, l.l_linenumber, l.l_shipdate, o.o_orderdate,
       o.o_orderdate + INTERVAL 90 DAY AS OUTTIME
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
 AND l.l_shipdate >= o.o_orderdate AND l.l_shipdate <= o.o_orderdate + INTERVAL 90 DAY"""

ORACLE["j4_join_in_interval_lookback"] = """
SELECT l.l_orderkey, l.l_linenumber, l.l_shipdate, lo.o_custkey, s.o_orderkey, s.o_orderdate,
       s.o_orderdate + INTERVAL 30 DAY AS OUTTIME
FROM lineitem l JOIN orders lo ON l.l_orderkey = lo.o_orderkey
JOIN orders s ON lo.o_custkey = s.o_custkey
 AND l.l_shipdate >= s.o_orderdate - INTERVAL 6 HOUR AND l.l_shipdate <= s.o_orderdate + INTERVAL 30 DAY"""

ORACLE["p8_hour_offset"] = """
SELECT * FROM (
  SELECT l.l_orderkey, l.l_linenumber, l.l_shipdate, o.o_orderdate,
         CAST(floor((epoch_us(l.l_shipdate) - epoch_us(o.o_orderdate)) / 3600000000.0) AS BIGINT) AS HOURS_IN
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey) WHERE HOURS_IN >= 0"""

ORACLE["p7_drop_null_values"] = with_(ORDER_STAYS) + \
    "SELECT ICUSTAY_ID, DEATHTIME FROM order_stays WHERE DEATHTIME IS NOT NULL"

# ------------------------------------------------------------------ cohort
ORACLE["j1_build_cohort"] = with_(ORDER_STAYS, PERSONS, COHORT) + "SELECT * EXCLUDE (ACCTBAL) FROM cohort"
ORACLE["p3_stay_hours"] = with_(*CO_ALL) + "SELECT ICUSTAY_ID, STAY_HOURS FROM cohort_f"
ORACLE["p5_age_years"] = with_(*CO_ALL) + "SELECT ICUSTAY_ID, DOB, AGE FROM cohort_f"
ORACLE["p6_in_interval_flag"] = with_(*CO_ALL) + "SELECT ICUSTAY_ID, MORT_ICU, MORT_HOSP FROM cohort_f"
ORACLE["p4_cohort_filter"] = with_(*CO_ALL) + """
SELECT ICUSTAY_ID, SUBJECT_ID, round(LOS, 6) AS LOS, STAY_HOURS, AGE FROM cohort_f
WHERE LOS >= 1.0 AND STAY_HOURS >= 24 AND STAY_HOURS < 240 AND AGE >= 15"""
ORACLE["j13_first_stay_per_subject"] = with_(*CO_ALL) + """
SELECT SUBJECT_ID, ICUSTAY_ID, INTIME, STAY_HOURS FROM (
  SELECT *, row_number() OVER (PARTITION BY SUBJECT_ID ORDER BY INTIME, ICUSTAY_ID) AS rn FROM cohort_f)
WHERE rn = 1"""
ORACLE["w5_first_per_key"] = """
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
WHERE rn = 1"""
ORACLE["a5_first_row_per_group"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS rn FROM lineitem)
WHERE rn = 1"""
ORACLE["a6_distinct_by"] = """
SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events)
WHERE rn = 1"""
ORACLE["p17_bin_labels"] = f"SELECT c_custkey, {BAL} AS BAL_BIN FROM customer"
ORACLE["p18_canonicalize"] = f"""
SELECT o.o_orderkey,
       CASE WHEN upper(o.o_orderpriority) LIKE '%URGENT%' THEN 'EMERGENCY'
            WHEN upper(o.o_orderpriority) LIKE '%HIGH%' THEN 'URGENT'
            WHEN upper(o.o_orderpriority) LIKE '%MEDIUM%' THEN 'ELECTIVE' ELSE 'OTHER' END AS ADM4,
       {SEG} AS SEG4
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""
ORACLE["p19_one_hot_fixed"] = with_(STATICS) + "SELECT * FROM statics"
ORACLE["j10_attach_static"] = with_(ORDER_STAYS, PERSONS, COHORT, STATICS) + \
    "SELECT c.ICUSTAY_ID, s.* FROM cohort c LEFT JOIN statics s ON c.SUBJECT_ID = s.SUBJECT_ID"
ORACLE["j7_semi_join"] = with_(ORDER_STAYS, PERSONS, COHORT) + \
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT SUBJECT_ID FROM cohort)"
ORACLE["j2_label_events"] = """
SELECT e.event_type, e.event_id, e.value, i.LEVEL1, i.LEVEL2 FROM events e JOIN (VALUES
  ('click', 'Heart Rate', 'heart_rate'), ('view', 'Temperature F', 'temperature'),
  ('purchase', 'Weight kg', 'weight'), ('error', 'FiO2 set', 'fraction_inspired_oxygen')) i(event_type, LEVEL1, LEVEL2)
  ON e.event_type = i.event_type"""
ORACLE["j5_lookup_ranges"] = with_(RANGES, RANGED) + "SELECT * FROM ranged"
ORACLE["p10_drop_outliers"] = with_(RANGES, RANGED, KEPT) + "SELECT event_id, event_type, value FROM kept"
ORACLE["p11_clip_to_range"] = with_(RANGES, RANGED, KEPT) + """
SELECT event_id, CASE WHEN value < VAL_LOW THEN VAL_LOW WHEN value > VAL_HIGH THEN VAL_HIGH ELSE value END AS value
FROM kept"""
ORACLE["p9_convert_units"] = """
WITH src AS (
  SELECT event_id,
         CASE event_type WHEN 'click' THEN 'Weight' WHEN 'view' THEN 'Temperature' WHEN 'purchase' THEN 'Height'
              WHEN 'error' THEN 'Fraction Inspired Oxygen' ELSE 'Oxygen saturation' END AS LEVEL1,
         ['oz', 'LB', 'degF', 'in', NULL][CAST(event_id % 5 + 1 AS INTEGER)] AS VALUEUOM,
         CASE WHEN event_type IN ('error', 'signup') THEN value / 40.0 ELSE value END AS VALUENUM
  FROM events)
SELECT event_id, round(CASE
  WHEN contains(lower(LEVEL1), 'weight') AND contains(lower(VALUEUOM), 'oz') THEN VALUENUM / 16.0 * 0.45359237
  WHEN contains(lower(LEVEL1), 'weight') AND contains(lower(VALUEUOM), 'lb') THEN VALUENUM * 0.45359237
  WHEN contains(lower(LEVEL1), 'temperature') AND (contains(lower(VALUEUOM), 'f') OR VALUENUM > 79)
       THEN (VALUENUM - 32) * 5.0 / 9.0
  WHEN contains(lower(LEVEL1), 'height') AND contains(lower(VALUEUOM), 'in') THEN VALUENUM * 2.54
  WHEN contains(lower(LEVEL1), 'fraction inspired oxygen') AND VALUENUM <= 1.0 THEN VALUENUM * 100.0
  WHEN contains(lower(LEVEL1), 'oxygen saturation') AND VALUENUM <= 1.0 THEN VALUENUM * 100.0
  ELSE VALUENUM END, 6) AS VALUENUM
FROM src"""
ORACLE["p12_normalize_name"] = """
SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS name
FROM pages"""
ORACLE["a2_regroup_mean"] = with_(EV_STAYS) + """, v AS (
  SELECT user_id, ts, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE ' ' || event_type || '!' END AS LABEL,
         value FROM events),
h AS (
  SELECT e.user_id, CAST(floor((epoch_us(e.ts) - epoch_us(s.intime)) / 3600000000.0) AS BIGINT) AS HOURS_IN,
         e.LABEL, avg(e.value) AS MEAN
  FROM v e JOIN ev_stays s ON e.user_id = s.user_id AND e.ts >= s.intime AND e.ts <= s.outtime
  WHERE floor((epoch_us(e.ts) - epoch_us(s.intime)) / 3600000000.0) >= 0 GROUP BY 1, 2, 3)
SELECT user_id, HOURS_IN,
       regexp_replace(regexp_replace(lower(LABEL), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS LABEL,
       round(avg(MEAN), 6) AS MEAN
FROM h GROUP BY 1, 2, 3"""
ORACLE["p13_filter_names"] = \
    "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase', 'view', 'refund')"
ORACLE["p14_drop_matching"] = with_(*EV_BASE, EV_WIDE) + \
    "SELECT user_id, HOUR_IN, " + ", ".join(r(f) for f in ("click", "purchase", "view", "refund")) + " FROM ev_wide"
ORACLE["p16_finite_or_null"] = """
SELECT event_id, CASE WHEN isfinite(x) THEN x END AS x FROM (
  SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE WHEN event_id % 13 = 0 THEN 'inf'::DOUBLE
                        WHEN event_id % 17 = 0 THEN '-inf'::DOUBLE ELSE value END AS x FROM events)"""
ORACLE["p25_nan_to_zero"] = """
SELECT event_id, coalesce(CASE WHEN isfinite(x) THEN x END, 0.0) AS x FROM (
  SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE WHEN event_id % 13 = 0 THEN 'inf'::DOUBLE
                        WHEN event_id % 19 = 0 THEN NULL ELSE value END AS x FROM events)"""
ORACLE["p1_cast_columns"] = "SELECT * FROM lineitem"
ORACLE["p2_parse_ts"] = "SELECT event_id, CASE WHEN event_id % 3 <> 0 AND event_id % 7 = 1 THEN NULL ELSE ts END AS parsed FROM events"
ORACLE["p21_fill_defaults"] = with_(ORDER_STAYS, PERSONS, COHORT, ORDER_CODES) + """
SELECT o.o_orderkey, o.o_custkey, s.HADM_ID, s.ICUSTAY_ID, coalesce(c.CODES, CAST([] AS VARCHAR[])) AS CODES
FROM orders o LEFT JOIN (SELECT DISTINCT HADM_ID, ICUSTAY_ID FROM cohort) s ON o.o_orderkey = s.HADM_ID
LEFT JOIN order_codes c ON o.o_orderkey = c.o_orderkey"""
ORACLE["p26_parse_list"] = with_(ORDER_CODES) + """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN [array_to_string(CODES, ',')] ELSE CODES END AS CODES
FROM order_codes"""
ORACLE["p27_codes_to_text"] = with_(ORDER_CODES) + \
    "SELECT o_orderkey, coalesce(array_to_string(list_filter(CODES, lambda x: x <> ''), ' '), '') AS TEXT FROM order_codes"
ORACLE["p28_project"] = "SELECT l_orderkey, l_quantity AS QTY FROM lineitem"
ORACLE["u1_union_events"] = "SELECT event_id, user_id, ts, event_type, value FROM events"

# ------------------------------------------------------------------ codes
ORACLE["a4_collect_codes"] = with_(ORDER_CODES) + "SELECT * FROM order_codes"
ORACLE["a7_build_vocab"] = with_(ORDER_CODES, VOCAB) + "SELECT * FROM vocab"
ORACLE["g2_encode_codes"] = with_(ORDER_CODES, VOCAB, ORDER_CANDS) + "SELECT o_orderkey, candidates FROM order_cands"
ORACLE["g2_encode_lists"] = ORACLE["g2_encode_codes"]
ORACLE["g3_pad_candidates"] = with_(*CANDS_ALL) + \
    "SELECT o_orderkey, list_resize(candidates[1:3], 3, -1) AS y_icd FROM all_cands"
ORACLE["g8_multi_hot"] = with_(*CANDS_ALL) + \
    "SELECT o_orderkey, list_transform(range(25), lambda i: CAST(list_contains(candidates, i) AS TINYINT)) AS mask FROM all_cands"
ORACLE["g7_require_candidates"] = with_(*CANDS_ALL) + """
SELECT * FROM all_cands
WHERE len(list_filter(candidates, lambda x: x >= 0)) > 0
   OR NOT EXISTS (SELECT 1 FROM all_cands WHERE len(list_filter(candidates, lambda x: x >= 0)) > 0)"""
ORACLE["a10_candidate_summary"] = with_(*CANDS_ALL) + """
SELECT count(*) AS samples, round(avg(s), 6) AS cand_size_mean,
       round(quantile_cont(s, 0.5), 6) AS cand_size_p50, round(quantile_cont(s, 0.9), 6) AS cand_size_p90,
       CAST(max(s) AS BIGINT) AS cand_size_max
FROM (SELECT len(list_filter(candidates, lambda x: x >= 0)) AS s FROM all_cands)"""
ORACLE["a11_class_inclusion"] = with_(*CANDS_ALL, INCLUSION) + \
    "SELECT class_idx, n_rows, round(ratio, 6) AS ratio FROM inclusion"
ORACLE["o3_top_classes"] = with_(*CANDS_ALL, INCLUSION) + \
    "SELECT class_idx, n_rows, round(ratio, 6) AS ratio FROM inclusion ORDER BY n_rows DESC, class_idx LIMIT 5"
ORACLE["s9_write_vocab"] = with_(ORDER_CODES, VOCAB) + "SELECT * FROM vocab"

# ------------------------------------------------------------------ class weights
ORACLE["a15_class_counts"] = with_(LABEL_COUNTS) + "SELECT * FROM label_counts"
ORACLE["a12_power_class_weights"] = with_(LABEL_COUNTS) + """, w AS (
  SELECT class_idx, n, 1.0 / pow(CASE WHEN n <= 0 THEN 1.0 ELSE CAST(n AS DOUBLE) END, 1.0) AS raw FROM label_counts)
SELECT class_idx, n, round(least(greatest(raw / (SELECT avg(raw) FROM w), 0.0), 10.0), 6) AS weight FROM w"""
ORACLE["a13_balanced_class_weights"] = """
WITH c AS (SELECT CAST(label AS BIGINT) AS class_idx, count(*) AS n_c FROM embeddings
           WHERE label IS NOT NULL AND label <> -100 GROUP BY 1),
t AS (SELECT sum(n_c) AS n, count(*) AS k FROM c)
SELECT k.class_idx, round(least(coalesce(t.n / (t.k * c.n_c), 1.0), 50.0), 6) AS weight
FROM (SELECT range AS class_idx FROM range(12)) k LEFT JOIN c ON k.class_idx = c.class_idx CROSS JOIN t"""
ORACLE["a14_effective_number_weights"] = with_(LABEL_COUNTS) + """, w AS (
  SELECT class_idx, n, (1.0 - 0.999) / (1.0 - pow(0.999, CASE WHEN n = 0 THEN 1 ELSE n END) + 1e-6) AS raw
  FROM label_counts)
SELECT class_idx, n, round(raw / (SELECT sum(raw) FROM w) * (SELECT count(*) FROM w), 6) AS weight FROM w"""
ORACLE["a16_vocab_sizes"] = """
SELECT 'c_nationkey' AS column_name, CAST(max(c_nationkey) + 1 AS BIGINT) AS cardinality FROM customer
UNION ALL SELECT 'p_size', CAST(max(p_size) + 1 AS BIGINT) FROM part"""

# ------------------------------------------------------------------ splits / scaling / sequences
ORACLE["i1_split_by_key"] = with_(EV_STAYS, SPLITS) + "SELECT * FROM splits"
ORACLE["j8_restrict_split"] = with_(EV_STAYS, SPLITS) + \
    "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM splits WHERE split = 'train')"
ORACLE["a9_fit_zscore"] = with_(*EV_ALL, SPLITS, TRAIN_STATS) + \
    "SELECT " + ", ".join(f"round({c}__mean, 6) AS {c}__mean, round({c}__std, 6) AS {c}__std" for c in Z_COLS) + \
    " FROM train_stats"
ORACLE["p24_apply_zscore"] = with_(*EV_ALL, SPLITS, TRAIN_STATS) + \
    "SELECT user_id, HOUR_IN, " + ", ".join(
        f"round(({c} - {c}__mean) / coalesce(nullif({c}__std, 0.0), 1.0), 6) AS {c}" for c in Z_COLS) + \
    " FROM ev_channels CROSS JOIN train_stats"
ORACLE["a8_seq_extent"] = with_(*EV_ALL) + "SELECT user_id, max(HOUR_IN) AS max_hour FROM ev_channels GROUP BY 1"
ORACLE["g4_build_sequences"] = with_(*EV_ALL, SEQ_LONG) + """
SELECT user_id, channel, list(round(CAST(value AS DOUBLE), 6) ORDER BY pos) AS vals FROM seq_long GROUP BY 1, 2"""
ORACLE["g5_stack_channels"] = with_(*EV_ALL, SEQ_LONG) + f"""
SELECT user_id, CAST({len(SEQ_CHANNELS)} AS INTEGER) AS n_channels, CAST(max(pos) + 1 AS INTEGER) AS seq_len,
       list(round(CAST(value AS DOUBLE), 6) ORDER BY channel, pos) AS flat
FROM seq_long GROUP BY user_id"""
ORACLE["g4_sequence_blocks"] = with_(*EV_ALL, SEQ_LONG) + """
SELECT user_id, CAST(pos // 64 AS INTEGER) AS block, CAST(pos // 64 * 64 AS BIGINT) AS start, channel,
       list(round(CAST(value AS DOUBLE), 6) ORDER BY pos) AS vals
FROM seq_long JOIN (SELECT user_id AS kept, (SELECT L FROM seq_size) - 1 - mh AS first_pos FROM seq_mh WHERE mh IS NOT NULL)
  ON user_id = kept AND pos // 64 >= first_pos // 64
GROUP BY user_id, pos // 64, channel"""
ORACLE["s11_read_sequence_range"] = with_(*EV_ALL, SPLITS, SEQ_LONG) + """
SELECT v.user_id, v.channel, v.vals, y.y FROM (
  SELECT user_id, channel, list(round(CAST(value AS DOUBLE), 6) ORDER BY pos) AS vals
  FROM seq_long, seq_size WHERE pos >= L // 3 AND pos < least(L // 3 + 200, L) GROUP BY user_id, channel) v
JOIN (SELECT user_id, list(CAST(y AS BIGINT) ORDER BY pos) AS y
      FROM seq_y, seq_size WHERE pos >= L // 3 AND pos < least(L // 3 + 200, L) GROUP BY user_id) y USING (user_id)
JOIN splits s USING (user_id) WHERE s.split = 'train'"""
ORACLE["w6_last_valid"] = with_(*EV_ALL, SEQ_LONG) + """
SELECT m.user_id, CAST(x.y_last AS BIGINT) AS y_last FROM seq_mh m LEFT JOIN (
  SELECT user_id, arg_max(y, pos) AS y_last FROM seq_y WHERE y <> -100 GROUP BY user_id) x USING (user_id)"""
ORACLE["g6_static_vector"] = with_(*EV_ALL) + """
SELECT user_id, [CAST(coalesce(M__click, 0) AS INTEGER), CAST(coalesce(M__view, 0) AS INTEGER),
                 CAST(coalesce(VENT, 0) AS INTEGER)] AS X_cat FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY HOUR_IN) AS rn FROM ev_channels) WHERE rn = 1"""
ORACLE["s10_write_sequences"] = with_(*EV_ALL, SPLITS, SEQ_LONG) + f"""
SELECT m.user_id AS stay_id, s.split, CAST({len(SEQ_CHANNELS)} AS INTEGER) AS n_channels,
       CAST((SELECT L FROM seq_size) AS INTEGER) AS n_steps
FROM seq_mh m JOIN splits s USING (user_id)"""
ORACLE["s11_read_sequences"] = with_(*EV_ALL, SPLITS, SEQ_LONG) + """
SELECT m.user_id AS stay_id, s.split, CAST(x.y_last AS BIGINT) AS y_last, true AS no_icd
FROM seq_mh m JOIN splits s USING (user_id)
LEFT JOIN (SELECT user_id, arg_max(y, pos) AS y_last FROM seq_y WHERE y <> -100 GROUP BY user_id) x USING (user_id)
WHERE s.split = 'train'"""

# ------------------------------------------------------------------ sampling
ORACLE["i3_sample_rows"] = f"""
SELECT doc_id, lang, n_chars FROM documents ORDER BY {HASH.format(k='doc_id', seed=7)}, doc_id LIMIT 50"""
ORACLE["i3_sample_rows_exact"] = f"""
SELECT * FROM orders ORDER BY {HASH.format(k='o_orderkey', seed=7)}, o_orderkey LIMIT 5000"""
ORACLE["i4_draw_candidate"] = with_(PREDS) + f"""
SELECT id, CAST(CASE WHEN len(c) > 0 THEN c[CAST({HASH.format(k='id', seed=11)} % greatest(len(c), 1) + 1 AS INTEGER)]
               ELSE 0 END AS BIGINT) AS drawn
FROM (SELECT id, list_filter(candidates, lambda x: x >= 0) AS c FROM preds)"""

# ------------------------------------------------------------------ alignment
ORACLE["j12_align_vectors"] = """
SELECT c.c_custkey, CASE WHEN e.vec_id IS NULL THEN 0 ELSE 1 END AS matched,
       coalesce(CAST(e.embedding AS FLOAT[]), list_transform(range(64), lambda x: CAST(0.0 AS FLOAT))) AS X_icd
FROM customer c LEFT JOIN embeddings e ON c.c_custkey = e.vec_id"""

# ------------------------------------------------------------------ metrics
ORACLE["m1_score"] = with_(PREDS, SCORED) + \
    "SELECT id, list_transform(probs, lambda x: round(x, 6)) AS probs, pred FROM scored2"
ORACLE["o4_topk_idx"] = with_(PREDS) + \
    "SELECT id, list_transform(" + TOPK.replace("scaled", "logits").format(k=3) + \
    ", lambda x: CAST(x AS INTEGER)) AS top3 FROM preds"

_VC = "list_filter(candidates, lambda x: x >= 0)"
ROWS = with_(PREDS, SCORED) + f""", rows AS (
  SELECT pred, probs, {_VC} AS c, len(scaled) AS ncls, {TOPK.format(k=10)} AS topk FROM scored2),
per_row AS (
  SELECT pred, c, len(c) > 0 AS has,
    CASE WHEN len(c) > 0 THEN CAST(list_contains(c, pred) AS DOUBLE) END AS hit,
    {', '.join(f"CASE WHEN len(c) > 0 THEN CAST(len(list_intersect(topk[1:least({k}, ncls)], c)) > 0 AS DOUBLE) END AS hit{k}" for k in (1, 3, 5, 10))},
    CASE WHEN len(c) > 0 THEN list_sum(list_transform(c, lambda i: probs[i + 1])) END AS cpm,
    CASE WHEN len(c) > 0 THEN
      list_max(list_filter(probs, lambda p, i: list_contains(c, i - 1)))
      - coalesce(list_max(list_filter(probs, lambda p, i: NOT list_contains(c, i - 1))), '-inf'::DOUBLE) END AS cmg,
    CASE WHEN len(c) > 0 THEN len(c) END AS csize
  FROM rows),
pc AS (SELECT pred AS cls, count(*) AS n FROM per_row GROUP BY 1),
seen AS (SELECT DISTINCT unnest(c) AS cls FROM per_row),
tot AS (SELECT count(*) AS total FROM per_row),
spread AS (
  SELECT (SELECT count(*) FROM pc) AS pred_unique,
         (SELECT cls FROM pc ORDER BY n DESC, cls LIMIT 1) AS top_pred,
         (SELECT max(n) FROM pc) / (SELECT total FROM tot) AS top_ratio,
         (SELECT count(*) FROM seen) AS k,
         (SELECT max(n) FROM pc WHERE cls IN (SELECT cls FROM seen)) AS seen_max,
         (SELECT total FROM tot) AS total,
         (SELECT sum(-(n / (SELECT total FROM tot)) * ln(n / (SELECT total FROM tot))) FROM pc) AS entropy),
spread2 AS (
  SELECT CASE WHEN k > 1 THEN (coalesce(seen_max, 0) / total - 1.0 / k) / (1.0 - 1.0 / k) ELSE 0.0 END AS ndi,
         CASE WHEN k > 0 THEN exp(coalesce(entropy, 0.0)) / k ELSE 0.0 END AS epr,
         CAST(pred_unique AS BIGINT) AS pred_unique, CAST(top_pred AS INTEGER) AS top_pred,
         coalesce(top_ratio, 0.0) AS top_ratio, CAST(k AS BIGINT) AS k_cand
  FROM spread)
"""
ORACLE["m2_m6_candidate_metrics"] = ROWS + """
SELECT round(coalesce(avg(hit), 0.0), 6) AS cand_acc,
       round(coalesce(avg(hit1), 0.0), 6) AS hit_at_1, round(coalesce(avg(hit3), 0.0), 6) AS hit_at_3,
       round(coalesce(avg(hit5), 0.0), 6) AS hit_at_5, round(coalesce(avg(hit10), 0.0), 6) AS hit_at_10,
       round(coalesce(avg(cpm), 0.0), 6) AS cpm, round(coalesce(avg(cmg), 0.0), 6) AS cmg,
       round(coalesce(avg(csize), 0.0), 6) AS avg_cand, count(*) AS n_rows,
       round(any_value(s.ndi), 6) AS ndi, round(any_value(s.epr), 6) AS epr,
       any_value(s.pred_unique) AS pred_unique, any_value(s.top_pred) AS top_pred,
       round(any_value(s.top_ratio), 6) AS top_ratio, any_value(s.k_cand) AS k_cand
FROM per_row CROSS JOIN spread2 s"""
ORACLE["m5_m6_prediction_spread"] = ROWS + """
SELECT round(ndi, 6) AS ndi, round(epr, 6) AS epr, pred_unique, top_pred, round(top_ratio, 6) AS top_ratio, k_cand
FROM spread2"""
ORACLE["m7_accuracy"] = with_(PREDS, SCORED) + \
    "SELECT round(coalesce(avg(CAST(pred = label AS DOUBLE)), 0.0), 6) AS accuracy FROM scored2 WHERE label IS NOT NULL AND label <> -100"
ORACLE["m8_macro_f1"] = with_(PREDS, SCORED) + """, v AS (SELECT * FROM scored2 WHERE label IS NOT NULL AND label <> -100),
cm AS (
  SELECT cls, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
    SELECT label AS cls, CAST(pred = label AS BIGINT) AS tp, 0 AS fp, CAST(pred <> label AS BIGINT) AS fn FROM v
    UNION ALL SELECT pred, 0, 1, 0 FROM v WHERE pred <> label) GROUP BY cls)
SELECT round(coalesce(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END), 0.0), 6)
       AS f1_macro FROM cm"""
ORACLE["m9_roc_auc"] = _auc_sql(BINARY.replace("binary AS", "src AS"), (0, 1), "label")
ORACLE["m9_roc_auc_multiclass"] = _auc_sql(
    PREDS + ",\n" + SCORED + ",\nsrc AS (SELECT * FROM scored2)", tuple(range(10)), "label")
ORACLE["m10_average_precision"] = _ap_sql(BINARY.replace("binary AS", "src AS"), (0, 1), "toxic")
ORACLE["m9_macro_roc_auc"] = (
    "SELECT round(coalesce(avg(auc), 0.0), 6) AS macro_auc FROM (" + ORACLE["m9_roc_auc_multiclass"] + ")")
ORACLE["m10_macro_average_precision"] = (
    "SELECT round(coalesce(avg(ap), 0.0), 6) AS macro_ap FROM (" + ORACLE["m10_average_precision"] + ")")
ORACLE["m1_score_scaled"] = with_(PREDS) + """, lg AS (
  SELECT id, list_transform(candidates, lambda x: CASE WHEN x IN (3, 7) THEN -1 ELSE x END) AS candidates,
         list_transform(logits, lambda x, i: CASE WHEN i - 1 IN (3, 7) THEN -1e9 ELSE x END / 2.5) AS scaled FROM preds),
e AS (SELECT *, list_transform(scaled, lambda x: exp(x - list_max(scaled))) AS e FROM lg)
SELECT id, candidates, list_transform(e, lambda x: round(x / list_sum(e), 6)) AS probs,
       CAST(list_position(scaled, list_max(scaled)) - 1 AS INTEGER) AS pred
FROM e"""
ORACLE["m11_cross_entropy"] = with_(PREDS) + f"""
SELECT round(coalesce(avg(-(logits[label + 1] - {LSE})), 0.0), 6) AS ce_loss FROM preds
WHERE label IS NOT NULL AND label <> -100"""
ORACLE["m12_focal_loss"] = _focal({c: 1.0 + c / 10.0 for c in range(10)}, 0.0)
ORACLE["m12_focal_loss_smoothed"] = _focal(None, 0.1)
ORACLE["m13_clpl_loss"] = _clpl("logistic", 30.0, None)
ORACLE["m13_clpl_loss_weighted"] = _clpl("hinge", None, {c: 0.5 + c / 5.0 for c in range(10)})
ORACLE["m14_pseudo_labels"] = with_(PREDS) + """, c AS (
  SELECT id, logits, list_distinct(list_filter(candidates, lambda x: x >= 0)) AS c FROM preds),
s AS (SELECT id, list_sort(list_transform(c, lambda i: {'neg': -logits[i + 1], 'i': i})) AS srt FROM c WHERE len(c) > 0)
SELECT id, CAST(srt[1].i AS INTEGER) AS pseudo_label,
       (-srt[1].neg) - (CASE WHEN len(srt) > 1 THEN -srt[2].neg ELSE '-inf'::DOUBLE END) >= 0.1 AS confident
FROM s"""
ORACLE["m15_best_run"] = """
WITH runs AS (SELECT user_id AS run, avg(value) AS value FROM events GROUP BY 1)
SELECT (SELECT run FROM runs ORDER BY value DESC, run LIMIT 1) AS best_run, round(max(value), 6) AS best_value FROM runs"""

# ------------------------------------------------------------------ profiling
_DOC_COLS = (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"))
ORACLE["a17_profile"] = "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, count(*) AS rows, "
    f"CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls, count(DISTINCT {c}) AS distinct "
    f"FROM documents" for c, t in _DOC_COLS)
ORACLE["a17_describe_numeric"] = "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(CAST(count({c}) AS DOUBLE), 6) AS count, round(avg({c}), 6) AS mean, "
    f"round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, "
    f"round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max "
    f"FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount"))
ORACLE["a18_array_stats"] = """
WITH e AS (SELECT len(embedding) AS l, unnest(embedding) AS x FROM embeddings)
SELECT (SELECT count(*) FROM embeddings) AS n_rows, CAST(max(l) AS INTEGER) AS max_len,
       round(min(CASE WHEN NOT isnan(x) THEN CAST(x AS DOUBLE) END), 6) AS min,
       round(max(CASE WHEN NOT isnan(x) THEN CAST(x AS DOUBLE) END), 6) AS max,
       round(avg(CASE WHEN NOT isnan(x) THEN CAST(x AS DOUBLE) END), 6) AS mean,
       round(stddev_pop(CASE WHEN NOT isnan(x) THEN CAST(x AS DOUBLE) END), 6) AS std,
       count(CASE WHEN NOT isnan(x) THEN x END) AS n_values, CAST(sum(CASE WHEN isnan(x) THEN 1 ELSE 0 END) AS BIGINT) AS n_nan
FROM e"""
ORACLE["o2_head"] = "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20"
ORACLE["s12_slow_stages"] = """
SELECT CAST(user_id AS VARCHAR) AS stage, min(ts) AS started_at,
       round(date_sub('second', min(ts), max(ts)) / 3600.0, 6) AS duration_sec
FROM events GROUP BY user_id HAVING date_sub('second', min(ts), max(ts)) / 3600.0 >= 700.0"""

# ------------------------------------------------------------------ sources / sinks (round trips)
ORACLE["s1_read_raw"] = "SELECT * FROM orders"
ORACLE["s2_resolve_table"] = "SELECT * FROM customer"
ORACLE["s3_optional_column"] = \
    "SELECT event_id, event_type, value, CAST(NULL AS VARCHAR) AS VALUEUOM, CAST(NULL AS BIGINT) AS ICUSTAY_ID FROM events"
ORACLE["s4_read_dimension"] = "SELECT * FROM nation"
ORACLE["s5_read_names"] = "SELECT DISTINCT event_type AS name FROM events"
ORACLE["s6_read_table"] = "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 25"
ORACLE["s7_write_table"] = "SELECT * FROM orders"
ORACLE["o1_sorted_sink"] = with_(*EV_BASE, EV_GRID, EV_FLAGGED, EV_LABELS) + "SELECT * FROM ev_labels"
ORACLE["o1_ordered_files"] = ORACLE["o1_sorted_sink"]
ORACLE["s7_publish"] = "SELECT * FROM orders"
ORACLE["s12_append_once"] = "SELECT * FROM events"
ORACLE["s8_artifacts"] = """
SELECT c.*, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey"""
ORACLE["a1_hourly_stats_stream"] = """
SELECT user_id, date_trunc('hour', ts) AS hour, event_type, round(avg(value), 6) AS MEAN, count(value) AS COUNT,
       round(stddev_samp(value), 6) AS STDDEV
FROM events GROUP BY 1, 2, 3"""

ORACLE["i1_split_by_key_exact"] = with_(EV_STAYS) + f""", h AS (
  SELECT user_id, row_number() OVER (ORDER BY {HASH.format(k='user_id', seed=42)}, user_id) - 1 AS rk,
         count(*) OVER () AS n FROM ev_stays)
SELECT user_id, CASE WHEN rk < floor(0.7 * n) THEN 'train' WHEN rk < floor(0.8 * n) THEN 'val'
                     ELSE 'test' END AS split
FROM h"""
ORACLE["j11_attach_labels"] = with_(*EV_BASE, EV_GRID, EV_FLAGGED, EV_LABELS) + """, codes AS (
  SELECT user_id, list_sort(list_distinct(list(CAST(event_type AS VARCHAR)))) AS candidates FROM events
  WHERE event_type IS NOT NULL GROUP BY user_id)
SELECT g.user_id, g.HOUR_IN, c.candidates, l.target
FROM ev_grid g LEFT JOIN codes c ON g.user_id = c.user_id
LEFT JOIN ev_labels l ON g.user_id = l.user_id AND g.HOUR_IN = l.HOUR_IN"""
ORACLE["w1_ffill_pieces"] = ORACLE["w1_ffill"]
ORACLE["w3_channels_pieces"] = ORACLE["w3_channels"]
ORACLE["j3_join_in_interval_spread"] = """
WITH o AS (SELECT o_orderkey, o_orderdate, c_nationkey AS nation FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT l.l_orderkey, l.l_linenumber, l.l_shipdate, lo.nation, s.o_orderkey, s.o_orderdate,
       s.o_orderdate + INTERVAL 12 HOUR AS OUTTIME
FROM lineitem l JOIN o lo ON l.l_orderkey = lo.o_orderkey
JOIN o s ON lo.nation = s.nation
 AND l.l_shipdate >= s.o_orderdate - INTERVAL 6 HOUR AND l.l_shipdate <= s.o_orderdate + INTERVAL 12 HOUR"""
ORACLE["j3_join_in_interval_bucketed"] = ORACLE["j4_join_in_interval_lookback"]
ORACLE["j5_lookup_ranges_dedupe"] = """
WITH r AS (
  SELECT * FROM (VALUES ('click', 1.0, 2.0, 40.0, 45.0), ('view', 0.5, 1.0, 30.0, 48.0),
                        ('purchase', NULL, NULL, NULL, NULL), ('error', 2.0, 3.0, 35.0, 45.0))
         t(LEVEL2, OUT_LOW, VAL_LOW, VAL_HIGH, OUT_HIGH))
SELECT e.event_id, e.event_type, e.value,
       CAST(r.OUT_LOW AS DOUBLE) AS OUT_LOW, CAST(r.VAL_LOW AS DOUBLE) AS VAL_LOW,
       CAST(r.VAL_HIGH AS DOUBLE) AS VAL_HIGH, CAST(r.OUT_HIGH AS DOUBLE) AS OUT_HIGH
FROM events e LEFT JOIN r ON lower(e.event_type) = lower(r.LEVEL2)"""

ORACLE["i2_weighted_resample"] = f"""
WITH c AS (SELECT CAST(label AS BIGINT) AS class_idx, count(*) AS n_c FROM embeddings
           WHERE label IS NOT NULL AND label <> -100 GROUP BY 1),
t AS (SELECT sum(n_c) AS n, count(*) AS k FROM c),
w AS (SELECT k.class_idx AS wl, least(coalesce(t.n / (t.k * c.n_c), 1.0), 50.0) AS weight
      FROM (SELECT range AS class_idx FROM range(10)) k LEFT JOIN c ON k.class_idx = c.class_idx CROSS JOIN t),
j AS (SELECT e.vec_id, e.label, w.weight FROM embeddings e JOIN w ON e.label = w.wl),
tot AS (SELECT sum(coalesce(weight, 0.0)) AS wsum, count(*) AS nrows FROM j),
lam AS (SELECT j.*, CASE WHEN wsum > 0 THEN nrows * coalesce(weight, 0.0) / wsum ELSE 0.0 END AS lam,
               {HASH.format(k='vec_id', seed=3)} / 4294967296.0 AS u
        FROM j CROSS JOIN tot),
ks AS (SELECT vec_id, label, weight, lam, u, unnest(range(0, CAST(ceil(lam + 12 * sqrt(lam) + 20) AS BIGINT) + 1)) AS k
       FROM lam),
cdf AS (SELECT *, sum(exp(-lam + k * ln(greatest(lam, 1e-300)) - lgamma(k + 1)))
                  OVER (PARTITION BY vec_id ORDER BY k) AS cdf FROM ks),
cnt AS (SELECT vec_id, label, weight,
               CASE WHEN any_value(lam) <= 0 THEN 0 ELSE coalesce(min(k) FILTER (WHERE u < cdf), max(k)) END AS c
        FROM cdf GROUP BY vec_id, label, weight)
SELECT vec_id, label, round(weight, 6) AS weight, CAST(unnest(range(1, c + 1)) AS BIGINT) AS draw FROM cnt WHERE c > 0"""

ORACLE["i2_weighted_resample_exact"] = f"""
WITH c AS (SELECT CAST(label AS BIGINT) AS class_idx, count(*) AS n_c FROM embeddings
           WHERE label IS NOT NULL AND label <> -100 GROUP BY 1),
t AS (SELECT sum(n_c) AS n, count(*) AS k FROM c),
w AS (SELECT k.class_idx AS wl, least(coalesce(t.n / (t.k * c.n_c), 1.0), 50.0) AS weight
      FROM (SELECT range AS class_idx FROM range(10)) k LEFT JOIN c ON k.class_idx = c.class_idx CROSS JOIN t),
j AS (SELECT e.vec_id, e.label, w.weight FROM embeddings e JOIN w ON e.label = w.wl),
tot AS (SELECT sum(weight) AS wsum, count(*) AS nrows FROM j),
share AS (SELECT j.*, nrows, CAST(floor(weight / wsum * 1152921504606846976.0 + 0.5) AS HUGEINT) AS sh
          FROM j CROSS JOIN tot),
line AS (SELECT *, sum(sh) OVER (ORDER BY {HASH.format(k='vec_id', seed=3)}, vec_id ROWS UNBOUNDED PRECEDING) AS hi,
                sum(sh) OVER () AS whole FROM share),
start AS (SELECT *, CAST({HASH.format(k="'start'", seed=3)} AS HUGEINT) * CAST(whole AS HUGEINT) // 4294967296 AS off
          FROM line),
cnt AS (SELECT *, (CAST(hi AS HUGEINT) * nrows + off) // CAST(whole AS HUGEINT)
                  - (CAST(hi - sh AS HUGEINT) * nrows + off) // CAST(whole AS HUGEINT) AS c FROM start)
SELECT vec_id, label, round(weight, 6) AS weight, CAST(unnest(range(1, CAST(c AS BIGINT) + 1)) AS BIGINT) AS draw
FROM cnt WHERE c > 0"""

ORACLE["x1_score_batches"] = """
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6)
       AS norm FROM embeddings"""

_STAY_Q = with_(*CO_ALL) + """, stats AS (
  SELECT c.ICUSTAY_ID,
         CAST(floor((epoch_us(l.l_shipdate) - epoch_us(c.INTIME)) / 3600000000.0) AS BIGINT) AS HOURS_IN,
         avg(l.l_quantity) AS MEAN, count(l.l_quantity) AS COUNT, stddev_samp(l.l_quantity) AS STDDEV
  FROM cohort_f c JOIN lineitem l ON l.l_orderkey = c.ICUSTAY_ID
   AND l.l_shipdate >= c.INTIME AND l.l_shipdate <= c.OUTTIME
  WHERE floor((epoch_us(l.l_shipdate) - epoch_us(c.INTIME)) / 3600000000.0) >= 0
  GROUP BY 1, 2),
firsts AS (
  SELECT ICUSTAY_ID FROM (
    SELECT ICUSTAY_ID, row_number() OVER (PARTITION BY SUBJECT_ID ORDER BY INTIME, ICUSTAY_ID) AS rn FROM cohort_f)
  WHERE rn = 1)
"""
ORACLE["j13_keep_first_stay"] = _STAY_Q + """
SELECT s.ICUSTAY_ID, s.HOURS_IN,
       round(CASE WHEN f.ICUSTAY_ID IS NOT NULL THEN s.MEAN END, 6) AS MEAN,
       CASE WHEN f.ICUSTAY_ID IS NOT NULL THEN s.COUNT END AS COUNT,
       round(CASE WHEN f.ICUSTAY_ID IS NOT NULL THEN s.STDDEV END, 6) AS STDDEV
FROM stats s LEFT JOIN firsts f ON s.ICUSTAY_ID = f.ICUSTAY_ID"""
ORACLE["j13_keep_first_stay_rows"] = _STAY_Q + """
SELECT ICUSTAY_ID, HOURS_IN, round(MEAN, 6) AS MEAN, COUNT, round(STDDEV, 6) AS STDDEV
FROM stats WHERE ICUSTAY_ID IN (SELECT ICUSTAY_ID FROM firsts)"""

_CLEAN = """clean AS (
  SELECT * FROM (
    SELECT user_id, ts, LEVEL2 AS event_type, VALUENUM AS value, OUT_LOW, OUT_HIGH,
           CASE WHEN VALUENUM < VAL_LOW THEN VAL_LOW WHEN VALUENUM > VAL_HIGH THEN VAL_HIGH ELSE VALUENUM END AS v2,
           VAL_LOW, VAL_HIGH
    FROM (
      SELECT e.user_id, e.ts, i.LEVEL2, CAST(r.OUT_LOW AS DOUBLE) AS OUT_LOW, CAST(r.VAL_LOW AS DOUBLE) AS VAL_LOW,
             CAST(r.VAL_HIGH AS DOUBLE) AS VAL_HIGH, CAST(r.OUT_HIGH AS DOUBLE) AS OUT_HIGH,
             CASE
               WHEN contains(lower(i.LEVEL1), 'weight') AND contains(lower(e.u), 'oz') THEN e.v / 16.0 * 0.45359237
               WHEN contains(lower(i.LEVEL1), 'weight') AND contains(lower(e.u), 'lb') THEN e.v * 0.45359237
               WHEN contains(lower(i.LEVEL1), 'temperature') AND (contains(lower(e.u), 'f') OR e.v > 79)
                    THEN (e.v - 32) * 5.0 / 9.0
               WHEN contains(lower(i.LEVEL1), 'height') AND contains(lower(e.u), 'in') THEN e.v * 2.54
               WHEN contains(lower(i.LEVEL1), 'fraction inspired oxygen') AND e.v <= 1.0 THEN e.v * 100.0
               WHEN contains(lower(i.LEVEL1), 'oxygen saturation') AND e.v <= 1.0 THEN e.v * 100.0
               ELSE e.v END AS VALUENUM
      FROM (SELECT user_id, ts, event_type,
                   ['oz', 'LB', 'degF', 'in', NULL][CAST(event_id % 5 + 1 AS INTEGER)] AS u,
                   CASE WHEN event_type = 'error' THEN value / 40.0 ELSE value END AS v FROM events) e
      JOIN (VALUES ('click', 'Weight', 'click'), ('view', 'Temperature', 'view'),
                   ('purchase', 'Height', 'purchase'), ('error', 'Fraction inspired oxygen', 'error'))
           i(event_type, LEVEL1, LEVEL2) ON e.event_type = i.event_type
      LEFT JOIN ranges r ON lower(i.LEVEL2) = lower(r.LEVEL2)))
  WHERE NOT (coalesce(value < OUT_LOW, false) OR coalesce(value > OUT_HIGH, false))),
clean_ev AS (SELECT user_id, ts, event_type, v2 AS value FROM clean)"""

_CF = ("click", "error", "purchase", "view", "refund")
_C_HOURLY = EV_HOURLY.replace("FROM events e JOIN", "FROM clean_ev e JOIN")
_C_WIDE = f"ev_wide AS (\n  {_pivot('ev_hourly', _CF)})"
_C_CHANNELS = f"""ev_channels AS (
  SELECT user_id, HOUR_IN, intime, VENT,
         {_channel_cols(_CF, GRID_HOURS, False)}
  FROM ev_flagged LEFT JOIN ev_wide USING (user_id, HOUR_IN))"""
ORACLE["flagship_clean_timeline"] = with_(RANGES, _CLEAN, EV_STAYS, _C_HOURLY, _C_WIDE, EV_GRID, EV_FLAGGED,
                                          EV_LABELS, _C_CHANNELS) + f"""
SELECT VENT, {_round_channels(_CF)}, l.target
FROM ev_channels c LEFT JOIN ev_labels l USING (user_id, HOUR_IN)"""


def _split_args(text: str) -> list[str]:
    args, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        if ch in "([{":
            depth += 1
        elif ch in ")]}":
            depth -= 1
        elif ch == "," and depth == 0:
            args.append(text[start:i])
            start = i + 1
    args.append(text[start:])
    return args


def _portable_round(sql: str) -> str:
    """Rewrite every ``round(x, d)`` as ``floor(x * 10^d + 0.5) / 10^d`` (|x| < 1e12).

    Same plain IEEE steps as the Spark side's ``portable_round``: ``round``
    differs between engines on decimal ties and on the sign of zero.
    """
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        depth, k = 0, j + len("round")
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        args = _split_args(_portable_round(sql[j + len("round("):k]))
        x, d = args[0].strip(), int(args[1])
        scale = f"{float(10 ** d):.1f}"
        out.append(f"(CASE WHEN abs({x}) < 1e12 THEN floor(({x}) * {scale} + 0.5) / {scale} ELSE ({x}) END)")
        i = k + 1


def _materialized(sql: str) -> str:
    """Mark every CTE ``MATERIALIZED`` so each is computed once.

    Besides saving work, this keeps DuckDB from scanning the same Parquet file
    in many places of one query, where its dictionary cache has been seen to
    fail intermittently ("dict-surviving cache ... changed identity").
    """
    return re.sub(r"(?<!WINDOW )\b(\w+) AS \(", r"\1 AS MATERIALIZED (", sql)


ORACLE = {k: _materialized(_portable_round(v)) for k, v in ORACLE.items()}
