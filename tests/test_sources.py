"""Sources and sinks on files written into the session's checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourglass.functions import columns as C
from hourglass.session import scratch_path
from hourglass.sources import io as IO
from tests.conftest import SF_SMALL


def test_resolve_prefers_gzip_and_reads_all_strings(spark):
    root = scratch_path(spark, "t-raw")
    n = spark.read.parquet(f"{SF_SMALL}/nation.parquet")
    n.write.option("header", True).option("compression", "gzip").csv(f"{root}/nation.csv.gz")
    n.filter(F.col("n_nationkey") < 3).write.option("header", True).csv(f"{root}/nation.csv")
    path = IO.resolve_table(spark, root, "nation")
    assert path.endswith("nation.csv.gz")
    raw = IO.read_raw(spark, path, columns=["n_nationkey", "n_name"], min_partitions=3)
    assert dict(raw.dtypes) == {"n_nationkey": "string", "n_name": "string"}
    assert raw.count() == n.count()
    assert IO.resolve_table(spark, root, "nation", prefer=(".csv", ".csv.gz")).endswith("nation.csv")


def test_missing_table_raises(spark):
    root = scratch_path(spark, "t-empty")
    try:
        IO.resolve_table(spark, root, "nothing")
        raise AssertionError("expected FileNotFoundError")
    except FileNotFoundError:
        pass


def test_optional_columns_are_typed_nulls(spark):
    path = scratch_path(spark, "t-ev")
    spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "value").write.option("header", True).csv(path)
    raw = IO.read_raw(spark, path, optional={"VALUEUOM": "string", "ICUSTAY_ID": "bigint"})
    assert dict(raw.dtypes)["ICUSTAY_ID"] == "bigint"
    assert raw.filter(F.col("VALUEUOM").isNotNull()).count() == 0


def test_strict_cast_raises_on_bad_text(spark):
    df = spark.createDataFrame([("12",), ("x1",)], "a string")
    try:
        C.cast_columns(df, {"a": "bigint"}).collect()
        raise AssertionError("expected a cast error under ANSI mode")
    except Exception as e:  # noqa: BLE001
        assert "CAST" in str(e).upper() or "NUMBER" in str(e).upper()


def test_sequences_round_trip_and_required_columns(spark):
    path = scratch_path(spark, "t-seq")
    df = spark.createDataFrame([(1, "train", [[1.0, 2.0]], [0], [5, -100])],
                               "stay_id long, split string, X_num array<array<float>>, X_cat array<int>, y_vent array<bigint>")
    IO.write_sequences(df, path)
    back = IO.read_sequences(spark, path, label_key="y_vent", split="train")
    r = back.first()
    assert r.y == [5, -100] and r.X_icd is None and r.y_icd is None
    bad = scratch_path(spark, "t-seq-bad")
    df.drop("X_cat").write.parquet(bad)
    try:
        IO.read_sequences(spark, bad)
        raise AssertionError("expected a missing-column error")
    except ValueError:
        pass


def test_read_names_trims_and_skips_blanks(spark):
    path = scratch_path(spark, "t-names")
    spark.createDataFrame([("  a ",), ("",), ("   ",), ("b",), ("a",)], "value string").write.text(path)
    assert sorted(r.name for r in IO.read_names(spark, path).collect()) == ["a", "b"]
