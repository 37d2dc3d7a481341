"""Registered queries: one per operator of the inventory, on the driver tables.

Each entry is ``fn(spark, sf_dir) -> DataFrame`` and reads whole tables
(nothing is sampled or capped except where a limit is the operator itself,
e.g. top-k and head).  ``hourglass.plans.oracle`` holds the DuckDB SQL of the
same computation for the keys that have one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourglass.functions import arrays as A
from hourglass.functions import columns as C
from hourglass.operators import aggregates as AG
from hourglass.operators import joins as J
from hourglass.operators import metrics as M
from hourglass.operators import profile as PR
from hourglass.operators import sampling as S
from hourglass.operators import sequences as SQ
from hourglass.operators import timeline as TL
from hourglass.plans import inputs as IN
from hourglass.plans import timeline_etl as ETL
from hourglass.plans.common import rounded
from hourglass.session import cut_lineage, scratch_path
from hourglass.sources import io as IO

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def q(key: str):
    def deco(fn):
        QUERIES[key] = fn
        return fn
    return deco


def T(spark, sf, name):  # noqa: N802 - short table accessor
    return IN.table(spark, sf, name)


# =========================================================================== event timeline
def _ev_tables(spark, sf):
    ev = T(spark, sf, "events")
    stays = IN.event_stays(ev)
    return ev, stays, ETL.build_timeline(ev, stays, "user_id", "ts", "event_type", "value",
                                         IN.FEATURES, IN.STATE_EVENTS)


@q("flagship_timeline")
def flagship(spark, sf):
    """Events -> hourly stats -> grid -> state flag -> V/M/D channels -> transition labels."""
    _, _, t = _ev_tables(spark, sf)
    return rounded(ETL.dataset(t, "user_id").drop("intime"))


def _clean_items(spark):
    # Fixed stand-in item dimension: event type -> (family name, range name); signup is unmapped.
    return spark.createDataFrame(
        [("click", "Weight", "click"), ("view", "Temperature", "view"),
         ("purchase", "Height", "purchase"), ("error", "Fraction inspired oxygen", "error")],
        "event_type string, LEVEL1 string, LEVEL2 string")


@q("flagship_clean_timeline")
def flagship_clean(spark, sf):
    """Events cleaned (item map, units, ranges, outliers, clipping), then the full timeline."""
    ev = T(spark, sf, "events")
    unit = F.element_at(F.array(F.lit("oz"), F.lit("LB"), F.lit("degF"), F.lit("in"), F.lit(None).cast("string")),
                        (F.col("event_id") % 5 + 1).cast("int"))
    raw = ev.select("event_id", "user_id", "ts", "event_type", unit.alias("VALUEUOM"),
                    F.when(F.col("event_type") == "error", F.col("value") / 40.0)
                    .otherwise(F.col("value")).alias("VALUENUM"))
    clean = ETL.clean_events(raw, _clean_items(spark), _ranges(spark), "event_type")
    stays = IN.event_stays(ev)
    t = ETL.build_timeline(clean, stays, "user_id", "ts", "LEVEL2", "VALUENUM",
                           ("click", "error", "purchase", "view", "refund"), IN.STATE_EVENTS)
    return rounded(ETL.dataset(t, "user_id").drop("intime"))


@q("a1_hourly_stats")
def a1(spark, sf):
    _, _, t = _ev_tables(spark, sf)
    return rounded(t["hourly"])


@q("a3_pivot_fixed")
def a3(spark, sf):
    _, _, t = _ev_tables(spark, sf)
    return rounded(t["wide"])


@q("p15_ensure_columns")
def p15(spark, sf):
    _, _, t = _ev_tables(spark, sf)
    wide = AG.pivot_fixed(t["hourly"], ["user_id", "HOURS_IN"], "event_type", "MEAN", list(IN.EVENT_TYPES))
    return rounded(C.ensure_columns(wide, {"refund": "double", "unit": "string"}))


@q("g1_hourly_grid")
def g1(spark, sf):
    _, _, t = _ev_tables(spark, sf)
    return t["grid"]


@q("j6_flag_hours")
def j6(spark, sf):
    _, _, t = _ev_tables(spark, sf)
    ev = t["hourly"].filter(F.col("event_type").isin(*IN.STATE_EVENTS))
    return J.flag_hours(t["grid"], ev, ["user_id", "HOUR_IN"], ["user_id", "HOURS_IN"]).drop("intime")


@q("w2_ffill_limit")
def w2(spark, sf):
    _, _, t = _ev_tables(spark, sf)
    return t["flagged"].drop("intime")


@q("w2_ffill_carry_across")
def w2c(spark, sf):
    """Fill limit 6 across entity boundaries (trap T5), without a global window over rows."""
    _, _, t = _ev_tables(spark, sf)
    ev = t["hourly"].filter(F.col("event_type").isin(*IN.STATE_EVENTS))
    flagged = J.flag_hours(t["grid"], ev, ["user_id", "HOUR_IN"], ["user_id", "HOURS_IN"], flag="F")
    return TL.ffill_limit(flagged, "F", 6, "user_id", "HOUR_IN", carry_across=True,
                          out="VENT", default=0).drop("intime", "F")


@q("w3_channels")
def w3(spark, sf):
    _, _, t = _ev_tables(spark, sf)
    return rounded(t["channels"].drop("intime", "VENT"))


@q("w4_transition_labels")
def w4(spark, sf):
    _, _, t = _ev_tables(spark, sf)
    return t["labels"]


@q("j11_attach_labels")
def j11(spark, sf):
    """Grid rows get the user's code set (candidates) and the hour's transition label."""
    _, _, t = _ev_tables(spark, sf)
    ev = T(spark, sf, "events")
    codes = AG.collect_codes(ev, "user_id", "event_type", "candidates")
    return J.attach_labels(t["grid"].drop("intime"), codes, t["labels"], "user_id", "HOUR_IN")


@q("j3_join_in_interval_bucketed")
def j3b(spark, sf):
    """J4's customer fan-out join with 24 h time buckets added to the key (hot-key form)."""
    o = T(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    stays = o.withColumn("OUTTIME", F.timestamp_add("DAY", F.lit(30), F.col("o_orderdate")))
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    ev = li.join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), ["l_orderkey"])
    return J.join_in_interval(ev, stays, "o_custkey", "l_shipdate", "o_orderdate", "OUTTIME",
                              lookback_hours=6, bucket_hours=24, broadcast_max_bytes=None)


@q("j5_lookup_ranges_dedupe")
def j5d(spark, sf):
    ev = T(spark, sf, "events").select("event_id", "event_type", "value")
    return J.lookup_ranges(ev, _ranges(spark), "event_type", dedupe=True)


@q("j9_attach_wide")
def j9(spark, sf):
    _, _, t = _ev_tables(spark, sf)
    return rounded(J.attach_wide(t["grid"], t["wide"], ["user_id", "HOUR_IN"]).drop("intime"))


@q("w1_ffill")
def w1(spark, sf):
    _, _, t = _ev_tables(spark, sf)
    j = J.attach_wide(t["grid"], t["wide"], ["user_id", "HOUR_IN"]).select("user_id", "HOUR_IN", "click", "view")
    return rounded(TL.ffill(j, ["click", "view"], "user_id", "HOUR_IN"))


@q("w1_ffill_pieces")
def w1p(spark, sf):
    """W1 by pieces: stays of over 100 hours are filled piece by piece."""
    _, _, t = _ev_tables(spark, sf)
    j = J.attach_wide(t["grid"], t["wide"], ["user_id", "HOUR_IN"]).select("user_id", "HOUR_IN", "click", "view")
    return rounded(TL.ffill_pieces(j, ["click", "view"], "user_id", "HOUR_IN", piece_rows=100))


@q("w3_channels_pieces")
def w3p(spark, sf):
    """W3 by pieces: stays of over 100 hours are scanned piece by piece."""
    _, _, t = _ev_tables(spark, sf)
    j = J.attach_wide(t["grid"], t["wide"], ["user_id", "HOUR_IN"]).select("user_id", "HOUR_IN", *IN.FEATURES)
    return rounded(TL.channels_pieces(j, IN.FEATURES, "user_id", "HOUR_IN", seq_len=IN.GRID_HOURS, piece_rows=100))


@q("p23_time_channel")
def p23(spark, sf):
    _, _, t = _ev_tables(spark, sf)
    return t["grid"].select("user_id", "HOUR_IN", C.time_channel("HOUR_IN", IN.SEQ_LEN).alias("V__time"))


@q("p20_hour_of_day")
def p20(spark, sf):
    _, _, t = _ev_tables(spark, sf)
    return t["grid"].select("user_id", "HOUR_IN", C.hour_of_day("intime", "HOUR_IN").alias("HOD"))


@q("p22_add_flags")
def p22(spark, sf):
    _, _, t = _ev_tables(spark, sf)
    return C.add_flags(t["grid"].drop("intime"), ["OUTCOME_FLAG", "VASO"])


@q("j3_join_in_interval")
def j3(spark, sf):
    """Ship lines inside [order date, order date + 90 d] of their order (key = order)."""
    o = T(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    stays = o.withColumn("OUTTIME", F.timestamp_add("DAY", F.lit(90), F.col("o_orderdate")))
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    ev = li.withColumnRenamed("l_orderkey", "o_orderkey")
    return J.join_in_interval(ev, stays, "o_orderkey", "l_shipdate", "o_orderdate", "OUTTIME")


@q("j4_join_in_interval_lookback")
def j4(spark, sf):
    """Lines by customer key into every order window of that customer, 6 h lookback (fan-out)."""
    o = T(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    stays = o.withColumn("OUTTIME", F.timestamp_add("DAY", F.lit(30), F.col("o_orderdate")))
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    ev = li.join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), ["l_orderkey"])
    return J.join_in_interval(ev, stays, "o_custkey", "l_shipdate", "o_orderdate", "OUTTIME", lookback_hours=6)


@q("j3_join_in_interval_spread")
def j3s(spark, sf):
    """J4's fan-out join over one key per nation of the customer: 25 hot keys, each cut along its own times."""
    o = T(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = T(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    o = o.join(J.broadcast_if_small(c), ["o_custkey"]).drop("o_custkey")
    stays = o.withColumn("OUTTIME", F.timestamp_add("HOUR", F.lit(12), F.col("o_orderdate")))
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    ev = li.join(o.select(F.col("o_orderkey").alias("l_orderkey"), "nation"), ["l_orderkey"])
    return J.join_in_interval_spread(ev, stays, "nation", "l_shipdate", "o_orderdate", "OUTTIME",
                                     lookback_hours=6, piece_rows=500)


@q("p8_hour_offset")
def p8(spark, sf):
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = T(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return C.with_hour_offset(li.join(o, ["l_orderkey"]), "l_shipdate", "o_orderdate", "HOURS_IN", 0)


@q("p7_drop_null_values")
def p7(spark, sf):
    st = IN.order_stays(T(spark, sf, "orders"), T(spark, sf, "lineitem"))
    return C.drop_null_values(st.select("ICUSTAY_ID", "DEATHTIME"), "DEATHTIME")


# =========================================================================== order stays / cohort
def _cohort(spark, sf):
    st = IN.order_stays(T(spark, sf, "orders"), T(spark, sf, "lineitem"))
    st = st.filter(F.col("OUTTIME") > F.col("INTIME"))
    adm = st.select("HADM_ID", "SUBJECT_ID", F.col("INTIME").alias("ADMITTIME"),
                    F.timestamp_add("DAY", F.lit(7), F.col("OUTTIME")).alias("DISCHTIME"),
                    "DEATHTIME", "ADMISSION_TYPE")
    stays = st.select("SUBJECT_ID", "HADM_ID", "ICUSTAY_ID", "INTIME", "OUTTIME")
    per = IN.persons(T(spark, sf, "customer"), T(spark, sf, "nation"))
    return J.build_cohort(stays, adm, per)


def _cohort_features(spark, sf):
    c = _cohort(spark, sf)
    return c.select(
        "*",
        C.stay_hours("INTIME", "OUTTIME").alias("STAY_HOURS"),
        (F.timestamp_diff("SECOND", F.col("INTIME"), F.col("OUTTIME")) / F.lit(86400.0)).alias("LOS"),
        C.age_years("DOB", "INTIME").alias("AGE"),
        C.in_interval_flag("DEATHTIME", "INTIME", "OUTTIME").alias("MORT_ICU"),
        C.in_interval_flag("DEATHTIME", "ADMITTIME", "DISCHTIME").alias("MORT_HOSP"))


@q("j1_build_cohort")
def j1(spark, sf):
    return _cohort(spark, sf).drop("ACCTBAL")


@q("p3_stay_hours")
def p3(spark, sf):
    return _cohort_features(spark, sf).select("ICUSTAY_ID", "STAY_HOURS")


@q("p5_age_years")
def p5(spark, sf):
    return _cohort_features(spark, sf).select("ICUSTAY_ID", "DOB", "AGE")


@q("p6_in_interval_flag")
def p6(spark, sf):
    return _cohort_features(spark, sf).select("ICUSTAY_ID", "MORT_ICU", "MORT_HOSP")


@q("p4_cohort_filter")
def p4(spark, sf):
    f = C.cohort_filter(_cohort_features(spark, sf), min_los=1.0, min_hours=24, max_hours=240, min_age=15)
    return rounded(f.select("ICUSTAY_ID", "SUBJECT_ID", "LOS", "STAY_HOURS", "AGE"))


@q("j13_first_stay_per_subject")
def j13(spark, sf):
    c = _cohort_features(spark, sf).select("SUBJECT_ID", "ICUSTAY_ID", "INTIME", "STAY_HOURS")
    return TL.first_per_key(c, "SUBJECT_ID", ["INTIME", "ICUSTAY_ID"])


def _stay_quantities(spark, sf):
    """Hourly line quantities per order stay (ship time relative to the order date)."""
    c = _cohort_features(spark, sf).select("SUBJECT_ID", "ICUSTAY_ID", "INTIME", "OUTTIME")
    li = T(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ICUSTAY_ID"), "l_shipdate", "l_quantity")
    inside = J.join_in_interval(li, c, "ICUSTAY_ID", "l_shipdate", "INTIME", "OUTTIME",
                                stay_cols=["ICUSTAY_ID", "INTIME", "OUTTIME"])
    hourly = C.with_hour_offset(inside, "l_shipdate", "INTIME", "HOURS_IN", 0)
    stats = AG.hourly_stats(hourly, ["ICUSTAY_ID", "HOURS_IN"], "l_quantity")
    firsts = TL.first_per_key(c.select("SUBJECT_ID", "ICUSTAY_ID", "INTIME"), "SUBJECT_ID", ["INTIME", "ICUSTAY_ID"])
    return stats, firsts


@q("j13_keep_first_stay")
def j13k(spark, sf):
    """Later stays keep their rows with measurements nulled (parity, trap T6)."""
    stats, firsts = _stay_quantities(spark, sf)
    return rounded(J.keep_first_stay(stats, firsts, "ICUSTAY_ID", ["MEAN", "COUNT", "STDDEV"]))


@q("j13_keep_first_stay_rows")
def j13r(spark, sf):
    """Rows of later stays dropped (``restrict_rows=True``)."""
    stats, firsts = _stay_quantities(spark, sf)
    return rounded(J.keep_first_stay(stats, firsts, "ICUSTAY_ID", ["MEAN", "COUNT", "STDDEV"], restrict_rows=True))


@q("w5_first_per_key")
def w5(spark, sf):
    o = T(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return TL.first_per_key(o, "o_custkey", ["o_orderdate", "o_orderkey"])


@q("a5_first_row_per_group")
def a5(spark, sf):
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return TL.first_per_key(li, "l_orderkey", ["l_linenumber", "l_partkey", "l_quantity"])


@q("a6_distinct_by")
def a6(spark, sf):
    ev = T(spark, sf, "events")
    return AG.distinct_by(ev, ["user_id", "event_type"], ["ts", "event_id"])


@q("p17_bin_labels")
def p17(spark, sf):
    c = T(spark, sf, "customer")
    return c.select("c_custkey", C.bin_labels("c_acctbal", (-1000, 0, 2500, 5000),
                                              ("NEG", "LOW", "MID", "HIGH")).alias("BAL_BIN"))


@q("p18_canonicalize")
def p18(spark, sf):
    o = T(spark, sf, "orders")
    c = T(spark, sf, "customer")
    pri = o.select("o_orderkey", C.canonicalize(
        "o_orderpriority", [("URGENT", "EMERGENCY"), ("HIGH", "URGENT"), ("MEDIUM", "ELECTIVE")],
        mode="contains").alias("ADM4"))
    seg = c.select("c_custkey", C.canonicalize("c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE"],
                                               mode="exact").alias("SEG4"))
    return pri.join(o.select("o_orderkey", "o_custkey"), ["o_orderkey"]).join(
        seg, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "ADM4", "SEG4")


def _statics(spark, sf):
    c = T(spark, sf, "customer")
    seg = C.canonicalize("c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE"], mode="exact")
    bal = C.bin_labels("c_acctbal", (-1000, 0, 2500, 5000), ("NEG", "LOW", "MID", "HIGH"))
    return c.select(F.col("c_custkey").alias("SUBJECT_ID"),
                    *C.one_hot_fixed(seg, ["AUTOMOBILE", "BUILDING", "FURNITURE", "OTHER"], "S__SEG"),
                    *C.one_hot_fixed(bal, ["NEG", "LOW", "MID", "HIGH"], "S__BAL"))


@q("p19_one_hot_fixed")
def p19(spark, sf):
    return _statics(spark, sf)


@q("j10_attach_static")
def j10(spark, sf):
    st = _cohort(spark, sf).select("ICUSTAY_ID", "SUBJECT_ID")
    return J.attach_static(st, _statics(spark, sf), "SUBJECT_ID")


@q("j7_semi_join")
def j7(spark, sf):
    c = T(spark, sf, "customer").select("c_custkey", "c_name")
    keys = _cohort(spark, sf).select(F.col("SUBJECT_ID").alias("c_custkey"))
    return J.semi_join(c, keys, ["c_custkey"])


@q("j2_label_events")
def j2(spark, sf):
    items = spark.createDataFrame(
        [("click", "Heart Rate", "heart_rate"), ("view", "Temperature F", "temperature"),
         ("purchase", "Weight kg", "weight"), ("error", "FiO2 set", "fraction_inspired_oxygen")],
        "event_type string, LEVEL1 string, LEVEL2 string")
    ev = T(spark, sf, "events").select("event_id", "event_type", "value")
    return J.label_events(ev, items, key="event_type")


def _ranges(spark):
    # Fixed parameters: one duplicated key (error) and one all-null-bound key (purchase).
    return spark.createDataFrame(
        [("click", 1.0, 2.0, 40.0, 45.0), ("view", 0.5, 1.0, 30.0, 48.0),
         ("purchase", None, None, None, None), ("error", 2.0, 3.0, 35.0, 45.0),
         ("error", None, None, None, None)],
        "LEVEL2 string, OUT_LOW double, VAL_LOW double, VAL_HIGH double, OUT_HIGH double")


@q("j5_lookup_ranges")
def j5(spark, sf):
    ev = T(spark, sf, "events").select("event_id", "event_type", "value")
    return J.lookup_ranges(ev, _ranges(spark), "event_type")


@q("p10_drop_outliers")
def p10(spark, sf):
    ev = T(spark, sf, "events").select("event_id", "event_type", "value")
    j = J.lookup_ranges(ev, _ranges(spark), "event_type")
    return C.drop_outliers(j, "value", "OUT_LOW", "OUT_HIGH").select("event_id", "event_type", "value")


@q("p11_clip_to_range")
def p11(spark, sf):
    ev = T(spark, sf, "events").select("event_id", "event_type", "value")
    j = C.drop_outliers(J.lookup_ranges(ev, _ranges(spark), "event_type"), "value", "OUT_LOW", "OUT_HIGH")
    return j.select("event_id", C.clip_to_range("value", "VAL_LOW", "VAL_HIGH").alias("value"))


@q("p9_convert_units")
def p9(spark, sf):
    ev = T(spark, sf, "events")
    name = (F.when(F.col("event_type") == "click", F.lit("Weight"))
            .when(F.col("event_type") == "view", F.lit("Temperature"))
            .when(F.col("event_type") == "purchase", F.lit("Height"))
            .when(F.col("event_type") == "error", F.lit("Fraction Inspired Oxygen"))
            .otherwise(F.lit("Oxygen saturation")))
    unit = F.element_at(F.array(F.lit("oz"), F.lit("LB"), F.lit("degF"), F.lit("in"), F.lit(None).cast("string")),
                        (F.col("event_id") % 5 + 1).cast("int"))
    v = F.when(F.col("event_type").isin("error", "signup"), F.col("value") / 40.0).otherwise(F.col("value"))
    src = ev.select("event_id", name.alias("LEVEL1"), unit.alias("VALUEUOM"), v.alias("VALUENUM"))
    return rounded(src.select("event_id", C.convert_units("VALUENUM", "VALUEUOM", "LEVEL1").alias("VALUENUM")))


@q("p12_normalize_name")
def p12(spark, sf):
    return T(spark, sf, "pages").select("page_id", C.normalize_name("url").alias("name"))


@q("a2_regroup_mean")
def a2(spark, sf):
    ev = T(spark, sf, "events")
    variant = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(
        F.concat(F.lit(" "), F.col("event_type"), F.lit("!")))
    ev = ev.select("user_id", "ts", variant.alias("LABEL"), "value")
    stays = IN.event_stays(T(spark, sf, "events"))
    hourly = ETL.measurements(ev, stays, "user_id", "ts", "LABEL", "value")
    norm = hourly.withColumn("LABEL", C.normalize_name("LABEL"))
    return rounded(AG.regroup_mean(norm, ["user_id", "HOURS_IN", "LABEL"], "MEAN"))


@q("p13_filter_names")
def p13(spark, sf):
    names = spark.createDataFrame([("click",), ("purchase",), ("view",), ("refund",)], "name string")
    ev = T(spark, sf, "events").select("event_id", "event_type")
    return C.filter_names(ev, "event_type", names)


@q("p14_drop_matching")
def p14(spark, sf):
    _, _, t = _ev_tables(spark, sf)
    return rounded(C.drop_matching(t["wide"], ["sign", "ERR"], keep=["user_id"]))


@q("p16_finite_or_null")
def p16(spark, sf):
    ev = T(spark, sf, "events")
    x = (F.when(F.col("event_id") % 11 == 0, F.lit(float("nan")))
         .when(F.col("event_id") % 13 == 0, F.lit(float("inf")))
         .when(F.col("event_id") % 17 == 0, F.lit(float("-inf"))).otherwise(F.col("value")))
    return ev.select("event_id", C.finite_or_null(x).alias("x"))


@q("p25_nan_to_zero")
def p25(spark, sf):
    ev = T(spark, sf, "events")
    x = (F.when(F.col("event_id") % 11 == 0, F.lit(float("nan")))
         .when(F.col("event_id") % 13 == 0, F.lit(float("inf")))
         .when(F.col("event_id") % 19 == 0, F.lit(None).cast("double")).otherwise(F.col("value")))
    return ev.select("event_id", C.nan_to_zero(x).alias("x"))


@q("p1_cast_columns")
def p1(spark, sf):
    li = T(spark, sf, "lineitem")
    types = dict(li.dtypes)
    as_text = li.select(*[F.col(c).cast("string").alias(c) for c in li.columns])
    return C.cast_columns(as_text, types)


@q("p2_parse_ts")
def p2(spark, sf):
    ev = T(spark, sf, "events").select("event_id", "ts")
    text = (F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
            .when(F.col("event_id") % 7 == 1, F.lit("not a time"))
            .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    return ev.select("event_id", C.parse_ts(text).alias("parsed"))


@q("p21_fill_defaults")
def p21(spark, sf):
    """Every order with its admission and stay in the cohort (null outside it) and its code list, empty without codes."""
    o = T(spark, sf, "orders").select("o_orderkey", "o_custkey")
    stays = _cohort(spark, sf).select("HADM_ID", "ICUSTAY_ID").distinct()
    o = o.join(stays, F.col("o_orderkey") == F.col("HADM_ID"), "left")
    return C.fill_defaults(o.join(_order_codes(spark, sf), ["o_orderkey"], "left"), {"CODES": []})


@q("p26_parse_list")
def p26(spark, sf):
    codes = _order_codes(spark, sf)
    k = F.col("o_orderkey") % 3
    text = (F.when(k == 0, F.to_json("CODES"))
            .when(k == 1, F.concat(F.lit("["), F.array_join("CODES", ", "), F.lit("]")))
            .otherwise(F.array_join("CODES", ",")))  # no list syntax: one element
    return codes.select("o_orderkey", C.parse_list(text).alias("CODES"))


@q("p27_codes_to_text")
def p27(spark, sf):
    return _order_codes(spark, sf).select("o_orderkey", C.codes_to_text("CODES").alias("TEXT"))


@q("p28_project")
def p28(spark, sf):
    li = T(spark, sf, "lineitem")
    return (li.select("l_orderkey", "l_linenumber", "l_quantity")
            .withColumnRenamed("l_quantity", "QTY").drop("l_linenumber"))


@q("u1_union_events")
def u1(spark, sf):
    """Clicks and all other events (no type included) put together again by column name."""
    ev = T(spark, sf, "events")
    click = F.coalesce(F.col("event_type") == "click", F.lit(False))
    clicks = ev.filter(click).select("event_id", "user_id", "ts", "event_type", "value")
    others = ev.filter(~click).select("value", "event_type", "ts", "event_id", "user_id")
    return clicks.unionByName(others)


# =========================================================================== codes, vocabulary, candidates
def _order_codes(spark, sf):
    return AG.collect_codes(IN.order_brands(T(spark, sf, "lineitem"), T(spark, sf, "part")),
                            "o_orderkey", "code", "CODES")


def _vocab(spark, sf):
    return AG.build_vocab(_order_codes(spark, sf), "CODES")


def _codes(spark, sf):
    """The vocabulary, every coded order's candidate indexes, and those of all orders."""
    pairs = cut_lineage(IN.order_brands(T(spark, sf, "lineitem"), T(spark, sf, "part")).distinct(), spark, "codes")
    vocab = cut_lineage(AG.build_vocab_long(pairs), spark, "vocab")
    cands = SQ.encode_long(pairs, "o_orderkey", "code", vocab)
    o = T(spark, sf, "orders").select("o_orderkey")
    allc = C.fill_defaults(o.join(cands.select("o_orderkey", "candidates"), ["o_orderkey"], "left"), {"candidates": []})
    return vocab, cands, allc


def _order_cands(spark, sf):
    return _codes(spark, sf)[1]


def _all_order_cands(spark, sf):
    return _codes(spark, sf)[2]


@q("a4_collect_codes")
def a4(spark, sf):
    return _order_codes(spark, sf)


@q("a7_build_vocab")
def a7(spark, sf):
    return _vocab(spark, sf)


@q("g2_encode_codes")
def g2(spark, sf):
    return _order_cands(spark, sf).select("o_orderkey", "candidates")


@q("g2_encode_lists")
def g2l(spark, sf):
    """G2 over rows that come with their code lists."""
    codes = _order_codes(spark, sf)
    return SQ.encode_codes(codes, "o_orderkey", "CODES", AG.build_vocab(codes, "CODES")).select("o_orderkey", "candidates")


@q("g3_pad_candidates")
def g3(spark, sf):
    return _all_order_cands(spark, sf).select("o_orderkey", A.pad_candidates("candidates", 3).alias("y_icd"))


@q("g8_multi_hot")
def g8(spark, sf):
    return _all_order_cands(spark, sf).select("o_orderkey", A.multi_hot("candidates", 25).alias("mask"))


@q("g7_require_candidates")
def g7(spark, sf):
    return SQ.require_candidates(_all_order_cands(spark, sf), "candidates")


@q("a10_candidate_summary")
def a10(spark, sf):
    return rounded(AG.candidate_summary(_all_order_cands(spark, sf), "candidates"))


@q("a11_class_inclusion")
def a11(spark, sf):
    vocab, _, allc = _codes(spark, sf)
    return rounded(AG.class_inclusion(allc, "candidates", vocab.select("idx")))


@q("o3_top_classes")
def o3(spark, sf):
    vocab, _, allc = _codes(spark, sf)
    return rounded(AG.top_classes(AG.class_inclusion(allc, "candidates", vocab.select("idx")), 5))


@q("s9_write_vocab")
def s9(spark, sf):
    path = IO.write_vocab(_vocab(spark, sf), scratch_path(spark, "vocab"))
    return IO.read_vocab(spark, path)


# =========================================================================== class weights
def _label_counts(spark, sf):
    emb = T(spark, sf, "embeddings")
    return AG.class_counts(emb, "label", list(range(12)))


@q("a15_class_counts")
def a15(spark, sf):
    return _label_counts(spark, sf)


@q("a12_power_class_weights")
def a12(spark, sf):
    return rounded(AG.power_class_weights(_label_counts(spark, sf), power=1.0, clip=10.0))


@q("a13_balanced_class_weights")
def a13(spark, sf):
    emb = T(spark, sf, "embeddings")
    return rounded(AG.balanced_class_weights(emb, "label", list(range(12)), cap=50.0))


@q("a14_effective_number_weights")
def a14(spark, sf):
    return rounded(AG.effective_number_weights(_label_counts(spark, sf), beta=0.999))


@q("a16_vocab_sizes")
def a16(spark, sf):
    return AG.vocab_sizes(T(spark, sf, "customer"), ["c_nationkey"]).unionByName(
        AG.vocab_sizes(T(spark, sf, "part"), ["p_size"]))


# =========================================================================== splits, scaling, sequences
def _splits(spark, sf):
    ev = T(spark, sf, "events")
    return S.split_by_key(IN.event_stays(ev).select("user_id"), "user_id", (0.7, 0.1, 0.2), seed=42)


@q("i1_split_by_key")
def i1(spark, sf):
    return _splits(spark, sf)


@q("i1_split_by_key_exact")
def i1x(spark, sf):
    ev = T(spark, sf, "events")
    return S.split_by_key(IN.event_stays(ev).select("user_id"), "user_id", (0.7, 0.1, 0.2), seed=42, exact=True)


@q("j8_restrict_split")
def j8(spark, sf):
    ev = T(spark, sf, "events").select("event_id", "user_id")
    return J.restrict_split(ev, _splits(spark, sf), "user_id", "train")


_Z_COLS = ("V__click", "V__error", "V__purchase", "V__signup", "V__view")


def _train_stats(spark, sf):
    _, _, t = _ev_tables(spark, sf)
    ch = t["channels"].select("user_id", "HOUR_IN", *_Z_COLS)
    train = J.restrict_split(ch, _splits(spark, sf), "user_id", "train")
    return ch, AG.fit_zscore(train, list(_Z_COLS))


@q("a9_fit_zscore")
def a9(spark, sf):
    return rounded(_train_stats(spark, sf)[1])


@q("p24_apply_zscore")
def p24(spark, sf):
    ch, stats = _train_stats(spark, sf)
    return rounded(C.apply_zscore(ch, stats, list(_Z_COLS)))


@q("a8_seq_extent")
def a8(spark, sf):
    _, _, t = _ev_tables(spark, sf)
    return AG.seq_extent(t["channels"], "user_id", "HOUR_IN")


_SEQ_CHANNELS = (*(f"{block}__{name}" for block in "VMD" for name in IN.FEATURES), "V__time")


def _sequences(spark, sf):
    """Every stay's whole timeline; the sequences are as long as the longest stay."""
    _, _, t = _ev_tables(spark, sf)
    ds = ETL.dataset(t, "user_id")
    longest = t["stays"].agg(F.max("STAY_HOURS")).first()[0]
    return SQ.build_sequences(ds, "user_id", "HOUR_IN", list(_SEQ_CHANNELS), seq_len=max(int(longest or 0), 1),
                              label="target", entities=t["stays"])


@q("g4_build_sequences")
def g4(spark, sf):
    """One row per stay and channel, its values by position."""
    s = _sequences(spark, sf).select("user_id", F.posexplode("X_num").alias("channel", "vals"))
    return rounded(s.withColumn("vals", F.col("vals").cast("array<double>")))


@q("g5_stack_channels")
def g5(spark, sf):
    s = _sequences(spark, sf)
    return s.select("user_id", F.size("X_num").alias("n_channels"),
                    F.size(F.element_at("X_num", 1)).alias("seq_len"),
                    F.flatten("X_num").cast("array<double>").alias("flat")).transform(rounded)


@q("w6_last_valid")
def w6(spark, sf):
    s = _sequences(spark, sf)
    return s.select("user_id", A.last_valid("y").alias("y_last"))


@q("g6_static_vector")
def g6(spark, sf):
    _, _, t = _ev_tables(spark, sf)
    return SQ.static_vector(t["channels"], "user_id", ["HOUR_IN"], ["M__click", "M__view", "VENT"])


@q("s10_write_sequences")
def s10(spark, sf):
    s = _sequences(spark, sf).join(_splits(spark, sf), ["user_id"]).withColumnRenamed("user_id", "stay_id")
    s = s.withColumn("X_cat", F.array(F.lit(0))).withColumnRenamed("y", "y_vent")
    path = IO.write_sequences(s, scratch_path(spark, "sequences"))
    back = spark.read.parquet(path)
    return back.select("stay_id", "split", F.size("X_num").alias("n_channels"), F.size("y_vent").alias("n_steps"))


@q("s11_read_sequences")
def s11(spark, sf):
    s = _sequences(spark, sf).join(_splits(spark, sf), ["user_id"]).withColumnRenamed("user_id", "stay_id")
    s = s.withColumn("X_cat", F.array(F.lit(0))).withColumnRenamed("y", "y_vent")
    path = IO.write_sequences(s, scratch_path(spark, "sequences"))
    r = IO.read_sequences(spark, path, label_key="y_vent", split="train")
    return r.select("stay_id", "split", A.last_valid("y").alias("y_last"),
                    F.col("X_icd").isNull().alias("no_icd"))


#: Short blocks, so that the given timelines fill several.
_BLOCK = 64


def _sequence_blocks(spark, sf):
    """Every stay's whole timeline in blocks, all stays, and the positions of a whole sequence."""
    _, _, t = _ev_tables(spark, sf)
    longest = t["stays"].agg(F.max("STAY_HOURS")).first()[0]
    seq_len = max(int(longest or 0), 1)
    blocks = SQ.sequence_blocks(ETL.dataset(t, "user_id"), "user_id", "HOUR_IN", list(_SEQ_CHANNELS), seq_len,
                                block=_BLOCK, label="target", extents=AG.seq_extent(t["grid"], "user_id", "HOUR_IN"))
    return blocks, t["stays"], seq_len


@q("g4_sequence_blocks")
def g4b(spark, sf):
    """One row per stay, block and channel, its values by position in the block."""
    blocks = _sequence_blocks(spark, sf)[0].select("user_id", "block", "start", F.posexplode("X_num").alias("channel", "vals"))
    return rounded(blocks.withColumn("vals", F.col("vals").cast("array<double>")))


@q("s11_read_sequence_range")
def s11r(spark, sf):
    """200 positions of every training stay (from a third of the sequence on), read from blocks written by split."""
    blocks, stays, seq_len = _sequence_blocks(spark, sf)
    splits = _splits(spark, sf)
    path = IO.write_sequence_blocks(blocks.join(splits, ["user_id"]), scratch_path(spark, "blocks"), "user_id")
    train = J.restrict_split(stays, splits, "user_id", "train")
    lo = seq_len // 3
    part = IO.read_sequence_range(spark, path, "user_id", lo, min(lo + 200, seq_len), len(_SEQ_CHANNELS), seq_len, _BLOCK,
                                  split="train", entities=train, label=True)
    long = part.select("user_id", "y", F.posexplode("X_num").alias("channel", "vals"))
    return rounded(long.withColumn("vals", F.col("vals").cast("array<double>")))


# =========================================================================== sampling
@q("i3_sample_rows_exact")
def i3e(spark, sf):
    """5,000 orders by the smallest hash of their key, cut by histograms (all of them where there are fewer)."""
    return S.sample_rows_exact(T(spark, sf, "orders"), 5000, "o_orderkey", seed=7)


@q("i2_weighted_resample")
def i2(spark, sf):
    emb = T(spark, sf, "embeddings").select("vec_id", "label")
    w = AG.balanced_class_weights(emb, "label", list(range(10)), cap=50.0)
    j = emb.join(F.broadcast(w.withColumnRenamed("class_idx", "label")), ["label"])
    return rounded(S.weighted_resample(j, "weight", None, "vec_id", seed=3))


@q("i2_weighted_resample_exact")
def i2_exact(spark, sf):
    """Exactly as many draws as rows, weighted by inverse class frequency."""
    emb = T(spark, sf, "embeddings").select("vec_id", "label")
    w = AG.balanced_class_weights(emb, "label", list(range(10)), cap=50.0)
    j = emb.join(F.broadcast(w.withColumnRenamed("class_idx", "label")), ["label"])
    return rounded(S.weighted_resample_exact(j, "weight", None, "vec_id", seed=3))


@q("i3_sample_rows")
def i3(spark, sf):
    d = T(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return S.sample_rows(d, 50, "doc_id", seed=7)


@q("i4_draw_candidate")
def i4(spark, sf):
    p = IN.predictions(T(spark, sf, "embeddings"))
    return p.select("id", A.draw_candidate("candidates", "id", seed=11).alias("drawn"))


# =========================================================================== alignment and batch scoring
@q("j12_align_vectors")
def j12(spark, sf):
    cust = T(spark, sf, "customer").select(F.col("c_custkey"))
    emb = T(spark, sf, "embeddings").select(F.col("vec_id").alias("c_custkey"), "embedding")
    return J.align_vectors(cust, emb, "c_custkey", "embedding", 64)


@q("x1_score_batches")
def x1(spark, sf):
    from hourglass.operators.batch import score_batches

    def fn(pdf):
        import numpy as np
        v = np.stack(pdf["embedding"].to_numpy()).astype("float64")
        return pdf[["vec_id"]].assign(norm=np.sqrt((v * v).sum(axis=1)))

    emb = T(spark, sf, "embeddings").select("vec_id", "embedding")
    return rounded(score_batches(emb, fn, "vec_id bigint, norm double"))


# =========================================================================== metrics
def _scored(spark, sf):
    return M.score(IN.predictions(T(spark, sf, "embeddings")))


@q("m1_score")
def m1(spark, sf):
    return rounded(_scored(spark, sf).select("id", "probs", "pred"))


@q("o4_topk_idx")
def o4(spark, sf):
    p = IN.predictions(T(spark, sf, "embeddings"))
    return p.select("id", A.topk_idx("logits", 3).alias("top3"))


@q("m2_m6_candidate_metrics")
def m2(spark, sf):
    return rounded(M.candidate_metrics(_scored(spark, sf)))


@q("m5_m6_prediction_spread")
def m5(spark, sf):
    return rounded(M.prediction_spread(_scored(spark, sf)))


@q("m7_accuracy")
def m7(spark, sf):
    return rounded(M.accuracy(_scored(spark, sf)))


@q("m8_macro_f1")
def m8(spark, sf):
    return rounded(M.macro_f1(_scored(spark, sf)))


def _binary(spark, sf, label="label"):
    b = IN.binary_scores(T(spark, sf, "documents"), T(spark, sf, "labels"))
    return b.withColumn("label", F.col(label))


@q("m9_roc_auc")
def m9(spark, sf):
    return rounded(M.roc_auc(_binary(spark, sf), classes=(0, 1)))


@q("m9_roc_auc_multiclass")
def m9b(spark, sf):
    return rounded(M.roc_auc(_scored(spark, sf), classes=tuple(range(10))))


@q("m10_average_precision")
def m10(spark, sf):
    return rounded(M.average_precision(_binary(spark, sf, "toxic"), classes=(0, 1)))


@q("m1_score_scaled")
def m1_scaled(spark, sf):
    """Ignored classes and a temperature."""
    p = IN.predictions(T(spark, sf, "embeddings"))
    return rounded(M.score(p, ignored=(3, 7), temperature=2.5).select("id", "candidates", "probs", "pred"))


@q("m9_macro_roc_auc")
def m9_macro(spark, sf):
    return rounded(M.macro_summary(m9b(spark, sf), "auc", "macro_auc"))


@q("m10_macro_average_precision")
def m10_macro(spark, sf):
    return rounded(M.macro_summary(m10(spark, sf), "ap", "macro_ap"))


@q("m11_cross_entropy")
def m11(spark, sf):
    return rounded(M.cross_entropy(IN.predictions(T(spark, sf, "embeddings"))))


@q("m12_focal_loss")
def m12(spark, sf):
    w = {c: 1.0 + c / 10.0 for c in range(10)}
    return rounded(M.focal_loss(IN.predictions(T(spark, sf, "embeddings")), gamma=2.0, weights=w))


@q("m12_focal_loss_smoothed")
def m12s(spark, sf):
    return rounded(M.focal_loss(IN.predictions(T(spark, sf, "embeddings")), gamma=2.0, smoothing=0.1))


@q("m13_clpl_loss")
def m13(spark, sf):
    return rounded(M.clpl_loss(IN.predictions(T(spark, sf, "embeddings")), kind="logistic", clip=30.0))


@q("m13_clpl_loss_weighted")
def m13w(spark, sf):
    w = {c: 0.5 + c / 5.0 for c in range(10)}
    return rounded(M.clpl_loss(IN.predictions(T(spark, sf, "embeddings")), kind="hinge", weights=w))


@q("m14_pseudo_labels")
def m14(spark, sf):
    p = IN.predictions(T(spark, sf, "embeddings"))
    return M.pseudo_labels(p, margin=0.1).select("id", "pseudo_label", "confident")


@q("m15_best_run")
def m15(spark, sf):
    ev = T(spark, sf, "events")
    runs = ev.groupBy(F.col("user_id").alias("run")).agg(F.avg("value").alias("value")).withColumn(
        "name", F.lit("mean_value"))
    return rounded(M.best_run(runs, "mean_value", "max"))


# =========================================================================== profiling
@q("a17_profile")
def a17(spark, sf):
    return PR.profile(T(spark, sf, "documents"))


@q("a17_describe_numeric")
def a17d(spark, sf):
    li = T(spark, sf, "lineitem")
    return rounded(PR.describe_numeric(li, ["l_quantity", "l_extendedprice", "l_discount"]))


@q("a18_array_stats")
def a18(spark, sf):
    return rounded(PR.array_stats(T(spark, sf, "embeddings"), "embedding"))


@q("o2_head")
def o2(spark, sf):
    d = T(spark, sf, "documents").select("doc_id", "n_chars")
    return PR.head(d, 20, [F.desc("n_chars"), F.asc("doc_id")])


@q("s12_slow_stages")
def s12(spark, sf):
    ev = T(spark, sf, "events")
    trace = ev.groupBy(F.col("user_id").cast("string").alias("stage")).agg(
        F.min("ts").alias("started_at"),
        (F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")) / F.lit(3600.0)).alias("duration_sec"))
    path = IO.append_metrics(trace, scratch_path(spark, "trace"))
    return rounded(IO.slow_stages(spark.read.parquet(path), 700.0))


# =========================================================================== sources and sinks
@q("s1_read_raw")
def s1(spark, sf):
    o = T(spark, sf, "orders")
    path = scratch_path(spark, "orders_csv")
    (o.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
     .mode("overwrite").csv(path))
    raw = IO.read_raw(spark, path)
    return C.cast_columns(raw, dict(o.dtypes))


@q("s2_resolve_table")
def s2(spark, sf):
    root = scratch_path(spark, "raw")
    c = T(spark, sf, "customer")
    c.write.option("header", True).option("compression", "gzip").csv(f"{root}/customer.csv.gz")
    path = IO.resolve_table(spark, root, "customer", prefer=(".csv.gz", ".csv"))
    return C.cast_columns(IO.read_raw(spark, path, min_partitions=4), dict(c.dtypes))


@q("s3_optional_column")
def s3(spark, sf):
    ev = T(spark, sf, "events").select("event_id", "event_type", "value")
    path = scratch_path(spark, "events_csv")
    ev.write.option("header", True).csv(path)
    raw = IO.read_raw(spark, path, optional={"VALUEUOM": "string", "ICUSTAY_ID": "bigint"})
    return C.cast_columns(raw, {"event_id": "bigint", "value": "double"})


@q("s4_read_dimension")
def s4(spark, sf):
    n = T(spark, sf, "nation")
    path = scratch_path(spark, "nation_csv")
    n.write.option("header", True).csv(path)
    return IO.read_dimension(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@q("s5_read_names")
def s5(spark, sf):
    ev = T(spark, sf, "events")
    lines = ev.select(F.concat(F.lit("  "), F.col("event_type"), F.lit(" ")).alias("value")).unionByName(
        ev.filter(F.col("event_id") % 50 == 0).select(F.lit("   ").alias("value")))
    path = scratch_path(spark, "names_txt")
    lines.write.text(path)
    return IO.read_names(spark, path)


@q("s6_read_table")
def s6(spark, sf):
    return IO.read_table(spark, f"{sf.rstrip('/')}/lineitem.parquet", ["l_orderkey", "l_quantity"]).filter(
        F.col("l_quantity") > 25)


@q("s7_write_table")
def s7(spark, sf):
    o = T(spark, sf, "orders")
    path = IO.write_table(o, scratch_path(spark, "orders_pq"), partition_by=["o_orderstatus"],
                          sort_within=["o_orderdate", "o_orderkey"])
    return spark.read.parquet(path)


@q("o1_sorted_sink")
def o1(spark, sf):
    _, _, t = _ev_tables(spark, sf)
    path = IO.write_table(t["labels"], scratch_path(spark, "labels_pq"), sort_within=["user_id", "HOUR_IN"])
    return spark.read.parquet(path)


@q("o1_ordered_files")
def o1f(spark, sf):
    """The labels in one order over all files, read back."""
    _, _, t = _ev_tables(spark, sf)
    path = IO.write_ordered(t["labels"], scratch_path(spark, "labels_ordered"), ["user_id", "HOUR_IN"])
    return spark.read.parquet(path)


@q("s7_publish")
def s7p(spark, sf):
    """Orders published without their priority, then, read back and completed, as the next version."""
    from hourglass.sources.versions import publish, read_published
    o = T(spark, sf, "orders")
    path = scratch_path(spark, "orders_versions")
    publish(o.drop("o_orderpriority"), path)
    more = read_published(spark, path).join(o.select("o_orderkey", "o_orderpriority"), ["o_orderkey"])
    publish(more.select(*o.columns), path)
    return read_published(spark, path)


@q("s12_append_once")
def s12o(spark, sf):
    """Every event type appended as a batch, and then once more as by a retry."""
    from hourglass.sources.versions import append_once, read_appended
    ev = T(spark, sf, "events")
    path = scratch_path(spark, "events_batches")
    for _ in range(2):
        for name in IN.EVENT_TYPES:
            append_once(ev.filter(F.col("event_type") == name), path, name)
        append_once(ev.filter(F.col("event_type").isNull() | ~F.col("event_type").isin(*IN.EVENT_TYPES)), path, "others")
    return read_appended(spark, path)


@q("s8_artifacts")
def s8(spark, sf):
    art = IO.Artifacts(spark, scratch_path(spark, "run"))
    art.save(T(spark, sf, "customer"), "customer")
    art.save_json(T(spark, sf, "nation"), "nation")
    return art.load("customer").join(art.load_json("nation", "n_nationkey int, n_name string, n_regionkey int")
                                     .select("n_nationkey", "n_name"),
                                     F.col("c_nationkey") == F.col("n_nationkey")).drop("n_nationkey")


@q("a1_hourly_stats_stream")
def a1s(spark, sf):
    from hourglass.streaming.hourly import hourly_stats_stream
    return rounded(hourly_stats_stream(spark, sf))

