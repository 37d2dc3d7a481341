"""Hand-made fixtures for the semantic traps (T1-T18) and small array fixtures."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from hourglass.functions import arrays as A
from hourglass.functions import columns as C
from hourglass.operators import aggregates as AG
from hourglass.operators import joins as J
from hourglass.operators import sequences as SQ
from hourglass.operators import timeline as TL

T0 = dt.datetime(2150, 1, 1, 0, 0, 0)


def h(n, minutes=0, micros=0):
    return T0 + dt.timedelta(hours=n, minutes=minutes, microseconds=micros)


def test_t1_lookback_rows_before_intime_vanish(spark):
    stays = spark.createDataFrame([(1, 10, h(0), h(48))], "HADM_ID long, ICUSTAY_ID long, INTIME timestamp_ntz, OUTTIME timestamp_ntz")
    labs = spark.createDataFrame([(1, h(-5), 1.0), (1, h(1), 2.0)], "HADM_ID long, CHARTTIME timestamp_ntz, VALUENUM double")
    j = J.join_in_interval(labs, stays, "HADM_ID", "CHARTTIME", "INTIME", "OUTTIME", lookback_hours=6)
    assert j.count() == 2  # lookback admits the -5 h row ...
    kept = C.with_hour_offset(j, "CHARTTIME", "INTIME", "HOURS_IN", 0)
    assert [r.VALUENUM for r in kept.collect()] == [2.0]  # ... and the hour filter drops it


def test_t2_duplicate_range_rows_fan_out(spark):
    ev = spark.createDataFrame([("Bilirubin", 50.0)], "LEVEL2 string, VALUENUM double")
    ranges = spark.createDataFrame(
        [("bilirubin", 0.0, 0.1, 40.0, 60.0), ("BILIRUBIN", None, None, None, None), ("bilirubin", None, None, None, None)],
        "LEVEL2 string, OUT_LOW double, VAL_LOW double, VAL_HIGH double, OUT_HIGH double")
    j = J.lookup_ranges(ev, ranges, "LEVEL2")
    assert j.count() == 3
    kept = C.drop_outliers(j, "VALUENUM", "OUT_LOW", "OUT_HIGH")
    vals = sorted(r.v for r in kept.select(C.clip_to_range("VALUENUM", "VAL_LOW", "VAL_HIGH").alias("v")).collect())
    assert vals == [40.0, 50.0, 50.0]


def test_t3_fio2_scaled_then_out_of_range(spark):
    df = spark.createDataFrame([("Fraction inspired oxygen", None, 0.5)], "LEVEL1 string, UOM string, V double")
    v = df.select(C.convert_units("V", "UOM", "LEVEL1").alias("v")).first().v
    assert v == 50.0
    assert spark.createDataFrame([(v, 1.1)], "v double, hi double").filter(C.outlier_mask("v", F.lit(None), "hi")).count() == 0


def test_unit_rules_first_match_and_null_unit(spark):
    rows = [("Weight", "oz", 16.0), ("Weight", "lb", 1.0), ("Temperature", None, 100.0), ("Temperature", None, 37.0),
            ("Height", "in", 1.0), ("Oxygen saturation", "%", 0.9), ("Heart rate", "bpm", 70.0)]
    df = spark.createDataFrame(rows, "n string, u string, v double")
    got = [round(r.x, 6) for r in df.select(C.convert_units("v", "u", "n").alias("x")).collect()]
    assert got == [0.453592, 0.453592, round((100 - 32) * 5 / 9, 6), 37.0, 2.54, 90.0, 70.0]


def test_t5_fill_limit_per_entity_and_carry_across(spark):
    # stay 1: value at hour 0 then 7 empty hours; stay 2: 3 empty hours
    rows = [(1, i, 1 if i == 0 else None) for i in range(8)] + [(2, i, None) for i in range(3)]
    df = spark.createDataFrame(rows, "s long, h long, f int")
    per = {(r.s, r.h): r.f for r in TL.ffill_limit(df, "f", 6, "s", "h", default=0).collect()}
    assert [per[(1, i)] for i in range(8)] == [1, 1, 1, 1, 1, 1, 1, 0]  # hour 7 stays empty
    assert [per[(2, i)] for i in range(3)] == [0, 0, 0]
    # stay 1 ends with a value at its last hour; it leaks into stay 2 under carry_across
    rows2 = [(1, i, 1 if i == 7 else None) for i in range(8)] + [(2, i, None) for i in range(8)]
    df2 = spark.createDataFrame(rows2, "s long, h long, f int")
    got = {(r.s, r.h): r.f for r in TL.ffill_limit(df2, "f", 6, "s", "h", carry_across=True, default=0).collect()}
    assert [got[(2, i)] for i in range(8)] == [1, 1, 1, 1, 1, 1, 0, 0]
    loc = {(r.s, r.h): r.f for r in TL.ffill_limit(df2, "f", 6, "s", "h", default=0).collect()}
    assert [loc[(2, i)] for i in range(8)] == [0] * 8


def test_carry_across_matches_row_loop(spark):
    import random
    rnd = random.Random(5)
    rows = []
    for s in range(1, 30):
        for i in range(rnd.randint(1, 12)):
            rows.append((s, i, 1 if rnd.random() < 0.1 else None))
    df = spark.createDataFrame(rows, "s long, h long, f int")
    got = {(r.s, r.h): r.f for r in TL.ffill_limit(df, "f", 3, "s", "h", carry_across=True).collect()}
    last_val, last_pos = None, None
    for pos, (s, i, f) in enumerate(sorted(rows)):
        if f is not None:
            last_val, last_pos = f, pos
            exp = f
        else:
            exp = last_val if last_pos is not None and pos - last_pos <= 3 else None
        assert got[(s, i)] == exp


def test_t7_grid_guards(spark):
    stays = spark.createDataFrame([(1, 0), (2, None), (3, 3), (4, 500)], "s long, STAY_HOURS long")
    g = TL.hourly_grid(stays, max_hours=120, hour_col="H")
    counts = {r.s: r["count"] for r in g.groupBy("s").count().collect()}
    assert counts == {3: 3, 4: 120}


def test_t8_delta_channel_and_mask(spark):
    rows = [(1, 0, None), (1, 1, None), (1, 2, 5.0), (1, 3, None), (1, 4, float("nan")), (1, 5, 7.0)]
    df = spark.createDataFrame(rows, "s long, h long, x double")
    out = TL.channels(df, ["x"], "s", "h").orderBy("h").collect()
    assert [r.D__x for r in out] == [0, 1, 0, 1, 2, 0]   # before first: the hour itself
    assert [r.M__x for r in out] == [0, 0, 1, 0, 0, 1]   # NaN is not observed
    assert [r.V__x for r in out] == [None, None, 5.0, 5.0, 5.0, 7.0]


def test_t9_std_of_one_value_is_null(spark):
    df = spark.createDataFrame([(1, 0, "a", 1.0), (1, 0, "b", 1.0), (1, 0, "b", 3.0)], "s long, h long, n string, v double")
    res = {r.n: r for r in AG.hourly_stats(df, ["s", "h", "n"], "v").collect()}
    assert res["a"].STDDEV is None and res["a"].COUNT == 1
    assert abs(res["b"].STDDEV - 2 ** 0.5) < 1e-12


def test_t10_age_uses_whole_days(spark):
    df = spark.createDataFrame([(dt.datetime(2000, 1, 1, 12), dt.datetime(2015, 1, 1, 11)),
                                (dt.datetime(2000, 1, 1, 12), dt.datetime(2015, 1, 2, 13))],
                               "dob timestamp_ntz, at timestamp_ntz")
    ages = [r.a for r in df.select(C.age_years("dob", "at").alias("a")).collect()]
    assert ages == [14, 15]


def test_w4_label_windows(spark):
    # windows for gap 0, n 4: 0000 1111 0111 1110 1011 1101
    pats = ["0000", "1111", "0111", "1110", "1011", "1101"]
    rows = [(k, i, int(c)) for k, p in enumerate(pats) for i, c in enumerate(p)]
    df = spark.createDataFrame(rows, "s long, h long, v int")
    got = {r.s: r.y for r in TL.transition_labels(df, "v", gap=0, n=4, by="s", order="h", out="y").collect()}
    assert got == {0: 3, 1: 2, 2: 0, 3: 1, 4: 0, 5: 0}  # 1101 has both steps; onset wins


def test_w4_short_stay_has_no_label(spark):
    df = spark.createDataFrame([(1, i, 0) for i in range(9)], "s long, h long, v int")
    assert TL.transition_labels(df, "v", gap=6, n=4, by="s", order="h").count() == 0


def test_w6_last_valid(spark):
    df = spark.createDataFrame([([-100, 1, 2, -100],), ([-100, -100],), ([3],)], "y array<bigint>")
    assert [r.v for r in df.select(A.last_valid("y").alias("v")).collect()] == [2, None, 3]


def test_g3_pad_and_g8_multi_hot(spark):
    df = spark.createDataFrame([([5, 1, 7],), ([],), (None,)], "c array<bigint>")
    assert [r.p for r in df.select(A.pad_candidates("c", 2).alias("p")).collect()] == [[5, 1], [-1, -1], [-1, -1]]
    assert [r.m for r in df.select(A.multi_hot("c", 3).alias("m")).collect()][0] == [0, 1, 0]


def test_o4_topk_ties_to_lower_index(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, 2.0],)], "l array<double>")
    assert df.select(A.topk_idx("l", 3).alias("t")).first().t == [1, 2, 3]


def test_g2_encode_keeps_order_drops_unknown(spark):
    vocab = spark.createDataFrame([(0, "b", 5), (1, "a", 3)], "idx long, code string, n long")
    df = spark.createDataFrame([(1, ["a", "zz", "b"]), (2, None), (3, ["zz"])], "k long, codes array<string>")
    got = {r.k: r.candidates for r in SQ.encode_codes(df, "k", "codes", vocab).collect()}
    assert got == {1: [1, 0], 2: [], 3: []}


def test_g4_right_alignment(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 0), (1, 2, 3.0, 1), (2, 5, 9.0, None)], "s long, h long, x double, y long")
    seq = {r.s: r for r in SQ.build_sequences(df, "s", "h", ["x"], seq_len=4, label="y").collect()}
    assert seq[1].X_num == [[0.0, 1.0, 0.0, 3.0]]
    assert seq[1].y == [-100, 0, -100, 1]
    assert 2 not in seq  # hour 5 is outside [0, 4)


def test_g7_require_candidates_fallback(spark):
    none = spark.createDataFrame([(1, [-1]), (2, [])], "k long, c array<bigint>")
    assert SQ.require_candidates(none, "c").count() == 2
    some = spark.createDataFrame([(1, [-1]), (2, [3])], "k long, c array<bigint>")
    assert [r.k for r in SQ.require_candidates(some, "c").collect()] == [2]


def test_p2_parse_ts_lenient(spark):
    df = spark.createDataFrame([("2150-01-01 05:00:00",), ("2150-01-01T05:00:00Z",), ("2150-01-01T07:00:00+02:00",),
                                ("junk",), (None,)], "s string")
    got = [r.t for r in df.select(C.parse_ts("s").alias("t")).collect()]
    assert got[:3] == [h(5)] * 3 and got[3:] == [None, None]


def test_p12_normalize_name(spark):
    df = spark.createDataFrame([("  Heart Rate (bpm)!",), ("__X__",)], "s string")
    assert [r.n for r in df.select(C.normalize_name("s").alias("n")).collect()] == ["heart_rate_bpm", "x"]


def test_p26_parse_list(spark):
    df = spark.createDataFrame([('["a", "b"]',), ("[a, b]",), ("a,b",), ("a",), (None,)], "s string")
    got = [r.l for r in df.select(C.parse_list("s").alias("l")).collect()]
    assert got == [["a", "b"], ["a", "b"], ["a,b"], ["a"], []]
    more = spark.createDataFrame([("5",), ("",), ("(1, 2)",), ("['x y', 3,]",), ("[]",), ("'q'",), ("[ 'a\\'b' ]",), ("[a,,b]",)], "s string")
    assert [r.l for r in more.select(C.parse_list("s").alias("l")).collect()] == [
        [], [""], ["1", "2"], ["x y", "3"], [], [], ["a'b"], ["a", "b"]]


def test_t18_refuses_to_overwrite_input(spark, tmp_path):
    from hourglass.sources import io as IO
    p = str(tmp_path / "t")
    spark.range(3).write.parquet(p)
    df = spark.read.parquet(p)
    try:
        IO.write_table(df, p)
        raise AssertionError("expected refusal")
    except ValueError:
        pass


def test_g2_join_path_matches_map_path(spark):
    vocab = spark.createDataFrame([(i, f"c{i}", 10 - i) for i in range(6)], "idx long, code string, n long")
    df = spark.createDataFrame([(1, ["c3", "zz", "c0"]), (2, None), (3, ["c5", "c5"]), (4, [])],
                               "k long, codes array<string>")
    a = {r.k: r.candidates for r in SQ.encode_codes(df, "k", "codes", vocab).collect()}
    assert a == {1: [3, 0], 2: [], 3: [5, 5], 4: []}


def test_g2_repeated_keys_and_vocabulary_codes(spark):
    vocab = spark.createDataFrame([(0, "a"), (1, "b"), (7, "b")], "idx long, code string")
    df = spark.createDataFrame([(1, ["a"]), (1, ["b", "a"]), (2, ["b"])], "k long, codes array<string>")
    got = sorted((r.k, r.candidates) for r in SQ.encode_codes(df, "k", "codes", vocab).collect())
    assert got == [(1, [0]), (1, [1, 0]), (2, [1])]


def test_softmax_of_many_classes_is_linear(spark):
    import time

    from hourglass.operators import metrics as M
    df = spark.range(2000).select((F.col("id") % 800).cast("int").alias("label"), F.transform(
        F.sequence(F.lit(0), F.lit(799)), lambda i: F.sin(i + F.col("id")).cast("double")).alias("logits"))
    t = time.time()
    M.focal_loss(df, smoothing=0.1).collect()
    M.score(df, candidates=None).write.format("noop").mode("overwrite").save()
    assert time.time() - t < 60


def test_g1_long_stays_keep_every_hour(spark):
    assert TL.hourly_grid(spark.range(1).withColumn("STAY_HOURS", F.lit(1000))).count() == 1000


def test_g4_repeated_hours_and_absent_entities(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 0, 2.0), ("a", 2, 3.0)], "k string, h int, v double")
    every = spark.createDataFrame([("a",), ("b",)], "k string")
    got = {r.k: r.X_num for r in SQ.build_sequences(df, "k", "h", ["v"], seq_len=4, entities=every).collect()}
    assert got == {"a": [[0.0, 2.0, 0.0, 3.0]], "b": [[0.0, 0.0, 0.0, 0.0]]}


def test_streaming_hours_of_shuffled_files(spark, tmp_path):
    from hourglass.streaming.hourly import hourly_stats_stream
    from tests.conftest import SF_SMALL
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    ev.orderBy(F.xxhash64("event_id")).repartition(6, F.xxhash64("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    got = hourly_stats_stream(spark, str(tmp_path), files_per_trigger=1)
    want = ev.groupBy("user_id", F.date_trunc("hour", "ts"), "event_type").count()
    assert got.count() == want.count()
    assert got.agg(F.sum("COUNT")).first()[0] == ev.where("value IS NOT NULL").count()


def test_p4_cohort_filter_boundaries(spark):
    rows = [(1, 0.99, 30, 40), (2, 1.0, 30, 40), (3, 2.0, 23, 40), (4, 2.0, 24, 40), (5, 2.0, 239, 40),
            (6, 2.0, 240, 40), (7, 2.0, 30, 14), (8, 2.0, 30, 15)]
    df = spark.createDataFrame(rows, "id long, LOS double, STAY_HOURS long, AGE int")
    kept = sorted(r.id for r in C.cohort_filter(df).collect())
    assert kept == [2, 4, 5, 8]


def test_p6_death_flags(spark):
    rows = [(1, h(5)), (2, h(30)), (3, None)]
    df = spark.createDataFrame(rows, "id long, death timestamp_ntz").select(
        "id", C.in_interval_flag("death", F.lit(h(0)), F.lit(h(24))).alias("icu"),
        C.in_interval_flag("death", F.lit(h(0)), F.lit(h(48))).alias("hosp"))
    assert {r.id: (r.icu, r.hosp) for r in df.collect()} == {1: (1, 1), 2: (0, 1), 3: (0, 0)}


def test_p17_p18_p19_static_encodings(spark):
    df = spark.createDataFrame([(14.0, "emergency", None), (40.0, "NEWBORN", "Self Pay"), (95.0, None, "Government")],
                               "age double, adm string, ins string")
    out = df.select(C.bin_labels("age").alias("b"), C.canonicalize("adm", C.ADMISSION_LEVELS[:-1]).alias("a"),
                    C.canonicalize("ins", C.INSURANCE_RULES, mode="contains").alias("i"),
                    *C.one_hot_fixed(C.canonicalize("ins", C.INSURANCE_RULES, mode="contains"),
                                     C.INSURANCE_LEVELS, "S__INS")).collect()
    assert [r.b for r in out] == ["AGE_15_39", "AGE_40_64", "AGE_90PLUS"]
    assert [r.a for r in out] == ["EMERGENCY", "OTHER", "OTHER"]
    assert [r.i for r in out] == ["OTHER", "SELF_PAY", "OTHER"]
    assert [r.S__INS__SELF_PAY for r in out] == [0, 1, 0] and [r.S__INS__OTHER for r in out] == [1, 0, 1]
