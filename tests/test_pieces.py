"""Hot keys in pieces, sequences in blocks, ordered files, exact samples and counts, versions and batches."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from hourglass.operators import joins as J
from hourglass.operators import pieces as P
from hourglass.operators import profile as PR
from hourglass.operators import quantiles
from hourglass.operators import sampling as S
from hourglass.operators import sequences as SQ
from hourglass.operators import timeline as TL
from hourglass.operators.quantiles import exact_quantiles
from hourglass.session import scratch_path
from hourglass.sources import io as IO
from hourglass.sources import versions as V

INF = float("inf")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.fixture(scope="module")
def series(spark):
    """One entity with most rows, a null entity, short ones, gaps and values that are not finite."""
    rng = random.Random(1)
    rows = []
    for who, hours in ((1, 3000), (2, 5), (None, 400), (3, 1), (4, 130)):
        for h in range(hours):
            value = rng.choice([None] * 30 + [1.5, float("nan"), INF, -INF, 0.0, float(h)])
            rows.append((who, h, value, float(h) if h == 7 else None, f"x{h}"))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "who long, h long, a double, b double, note string").repartition(7)


# ---------------------------------------------------------------- pieces
def test_cuts_only_for_hot_keys_and_pieces_of_bounded_size(series):
    cuts = P.key_cuts(series, ["who"], "h", piece_rows=100)
    assert {r["__key0"] for r in cuts.collect()} == {1, None, 4}
    rows = P.with_cuts(series, ["who"], cuts).withColumn("p", P.piece_of(F.col("__cuts"), F.col("h"))).collect()
    assert len(rows) == series.count()
    sizes = Counter((r["who"], r["p"]) for r in rows)
    assert max(sizes.values()) <= 250 and sum(k[0] == 1 for k in sizes) >= 15
    for r in rows:
        assert r["p"] == (0 if r["__cuts"] is None else sum(c < r["h"] for c in r["__cuts"]))


def test_piece_of_bisects(spark):
    rng = random.Random(2)
    rows = [(sorted(rng.sample(range(60), n)), v) for n in range(0, 40, 3) for v in (-1, 0, 5, 30, 59, 99, None)]
    rows.append((None, 3))
    got = spark.createDataFrame(rows, "c array<int>, v int").select("c", "v", P.piece_of(F.col("c"), F.col("v")).alias("p")).collect()
    for r in got:
        assert r["p"] == (0 if r["c"] is None or r["v"] is None else sum(c < r["v"] for c in r["c"]))


@pytest.mark.parametrize("piece_rows", [1, 40, 1000, 10**6])
def test_fill_and_channels_by_pieces(series, piece_rows):
    same(TL.ffill_pieces(series, ["a", "b"], "who", "h", piece_rows=piece_rows), TL.ffill(series, ["a", "b"], "who", "h"))
    same(TL.ffill_pieces(series, ["a"], ["who"], "h", suffix="_f", piece_rows=piece_rows),
         TL.ffill(series, ["a"], ["who"], "h", suffix="_f"))
    same(TL.channels_pieces(series, ["a", "b"], "who", "h", seq_len=50, piece_rows=piece_rows),
         TL.channels(series, ["a", "b"], "who", "h", seq_len=50))


def test_pieces_with_null_order_other_types_and_no_rows(spark, series):
    odd = series.withColumn("h", F.when(F.col("h") % 11 != 0, F.timestamp_seconds("h")))
    first = odd.filter("h IS NULL").groupBy("who").count()
    assert first.count()
    one_null = odd.filter("h IS NOT NULL").unionByName(odd.filter("h IS NULL").dropDuplicates(["who"]))
    same(TL.ffill_pieces(one_null, ["a"], "who", "h", piece_rows=50), TL.ffill(one_null, ["a"], "who", "h"))
    none = series.limit(0)
    assert TL.ffill_pieces(none, ["a"], "who", "h").collect() == []
    assert TL.channels_pieces(none, ["a"], "who", "h").collect() == []


def test_no_window_holds_a_whole_key(series):
    text = plan(TL.channels_pieces(series, ["a", "b"], "who", "h", piece_rows=100))
    windows = [line for line in text.splitlines() if "Window " in line]
    assert windows and all("__piece" in line for line in windows)


# ---------------------------------------------------------------- interval join
@pytest.fixture(scope="module")
def intervals(spark):
    rng = random.Random(3)
    keys = ["hot"] * 20 + ["a", "b", None, "only-events"]
    events = [(rng.choice(keys), rng.randrange(2000) * 1800, i) for i in range(3000)] + [("hot", None, -1)]
    stays = []
    for i in range(400):
        lo = rng.randrange(2000) * 1800
        stays.append((rng.choice([*keys[:-1], "only-stays"]), lo, lo + rng.choice([0, 3600, 40_000, 900_000, -50]), i))
    stays.append(("hot", None, 5, -2))
    ev = spark.createDataFrame(events, "k string, at long, e int").withColumn("ts", F.timestamp_seconds("at").cast("timestamp_ntz"))
    st = spark.createDataFrame(stays, "k string, lo0 long, hi0 long, stay int").select(
        "k", F.timestamp_seconds("lo0").cast("timestamp_ntz").alias("lo"),
        F.timestamp_seconds("hi0").cast("timestamp_ntz").alias("hi"), "stay", F.lit("s").alias("e"))
    return ev.drop("at").repartition(5), st


@pytest.mark.parametrize("bucket_hours", [1, 100_000])
def test_bucketed_join_gives_the_same_rows_and_broadcasts_no_copies(intervals, bucket_hours):
    ev, st = intervals
    st = st.withColumn("hi", F.when(F.col("stay") % 50 == 0, F.expr("lo + INTERVAL '300' YEAR")).otherwise(F.col("hi")))
    got = J.join_in_interval(ev, st, "k", "ts", "lo", "hi", lookback_hours=6, bucket_hours=bucket_hours)
    same(got, J.join_in_interval(ev, st, "k", "ts", "lo", "hi", lookback_hours=6))
    assert "BroadcastHashJoin" not in plan(got) and "SortMergeJoin" in plan(got)


@pytest.mark.parametrize("lookback", [0, 6])
def test_spread_join_gives_the_same_rows(intervals, lookback):
    ev, st = intervals
    plain = J.join_in_interval(ev, st, "k", "ts", "lo", "hi", lookback_hours=lookback)
    for piece_rows in (20, 200, None):
        same(J.join_in_interval_spread(ev, st, "k", "ts", "lo", "hi", lookback_hours=lookback, piece_rows=piece_rows), plain)
    some = dict(stay_cols=["stay"], lookback_hours=lookback)
    same(J.join_in_interval_spread(ev, st, "k", "ts", "lo", "hi", piece_rows=30, **some),
         J.join_in_interval(ev, st, "k", "ts", "lo", "hi", **some))


def test_spread_join_spreads_a_hot_key(intervals):
    ev, st = intervals
    out = J.join_in_interval_spread(ev, st, "k", "ts", "lo", "hi", piece_rows=50)
    join = next(line for line in plan(out).splitlines() if "Join" in line and "__s_piece" in line)
    assert "__piece" in join
    assert J.join_in_interval_spread(ev.limit(0), st, "k", "ts", "lo", "hi").collect() == []
    assert J.join_in_interval_spread(ev, st.limit(0), "k", "ts", "lo", "hi").collect() == []


def test_pieces_are_looked_up_by_compiled_projections(spark):
    rng = random.Random(5)
    nan = float("nan")
    held = [(k, sorted(rng.sample(range(400), n))) for k, n in (("a", 1), ("b", 7), ("c", 8), (None, 300))]
    cuts = spark.createDataFrame([(k, [*map(float, c)]) for k, c in held], "__key0 string, __cuts array<double>")
    rows = [(k, v) for k in ("a", "b", "c", "other", None) for v in (-1.0, 0.0, 399.5, nan, None, *(float(rng.randrange(400)) for _ in range(60)))]
    rows += [(k, float(x)) for k, c in held for x in c]
    df = spark.createDataFrame(rows, "k string, v double")
    got = P.with_pieces(df, ["k"], cuts, {"p": F.col("v"), "next": F.col("v") + 1})
    want = P.with_cuts(df, ["k"], cuts).select("k", "v", P.piece_of(F.col("__cuts"), F.col("v")).alias("p"),
                                               P.piece_of(F.col("__cuts"), F.col("v") + 1).alias("next"),
                                               F.col("__cuts").isNotNull().alias("__hot"))
    same(got, want)
    none = P.with_pieces(df, ["k"], cuts.limit(0), {"p": F.col("v")})
    assert none.filter("p <> 0 OR __hot").count() == 0 and none.count() == len(rows)


def test_spread_join_and_pieces_interpret_nothing_per_row(intervals, series):
    ev, st = intervals
    for df in (J.join_in_interval_spread(ev, st, "k", "ts", "lo", "hi", piece_rows=50),
               TL.ffill_pieces(series, ["a"], "who", "h", piece_rows=100)):
        text = plan(df)
        assert "lambdafunction" not in text and "__cuts" in text
        exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
        assert exchanges and not any("__cuts" in line for line in exchanges)


def test_spread_join_deals_tasks_by_the_pairs_they_compare(spark, intervals, monkeypatch):
    ev, st = intervals
    # one instant of a key holds 900 events and 60 stays, which no cut divides; a map cannot be hashed
    noon = F.timestamp_seconds(F.lit(43_200)).cast("timestamp_ntz")
    ev = ev.unionByName(spark.range(900).select(F.lit("hot").alias("k"), F.col("id").cast("int").alias("e"), noon.alias("ts")))
    ev = ev.withColumn("a.b", F.map_from_arrays(F.array("e"), F.array("k")))
    st = st.unionByName(spark.range(60).select(F.lit("hot").alias("k"), noon.alias("lo"), (noon + F.expr("INTERVAL 1 HOUR")).alias("hi"),
                                               F.col("id").cast("int").alias("stay"), F.lit("s").alias("e")))
    plain = J.join_in_interval(ev, st, "k", "ts", "lo", "hi", stay_cols=["stay"])
    for task_pairs, tasks, dealt in ((1 << 40, None, False), (70_000, 8, False), (4_000, None, True)):
        monkeypatch.setattr(P, "TASK_PAIRS", task_pairs)
        got = J.join_in_interval_spread(ev, st, "k", "ts", "lo", "hi", stay_cols=["stay"], piece_rows=50)
        same(got, plain)
        text = got._jdf.queryExecution().optimizedPlan().toString()
        assert ("RepartitionByExpression" in text) == (task_pairs < 1 << 40) and ("__deal" in text) == dealt
    parts = [p for p in got.select(F.spark_partition_id().alias("p"), "e", "ts").filter(F.col("ts") == noon).groupBy("p").count().collect()]
    assert len(parts) > 3 and max(p["count"] for p in parts) < 0.6 * sum(p["count"] for p in parts)


# ---------------------------------------------------------------- sequence blocks
@pytest.fixture(scope="module")
def timelines(spark):
    rng = random.Random(4)
    rows = []
    for who, hours in (("long", range(0, 300, 1)), ("gaps", range(3, 90, 7)), ("one", [5]), ("late", [299]), ("none", [-4, 300, 999]),
                       (None, range(20))):
        for h in hours:
            rows.append((who, h, rng.choice([None, float(h), float("nan"), INF]), rng.random(), rng.choice([None, 0, 1]), 150))
    rows.append(("one", 5, 9.0, 9.0, 1, 150))  # a repeated hour
    return spark.createDataFrame(rows, "who string, h long, a double, b double, y0 int, until int").repartition(4)


@pytest.mark.parametrize("block,as_of", [(1, None), (7, None), (64, "until"), (300, None), (1024, None)])
def test_blocks_hold_the_whole_sequences(spark, timelines, block, as_of):
    args = (timelines, "who", "h", ["a", "b"])
    who = timelines.select("who").distinct().filter("who IS NOT NULL")
    whole = {r["who"]: r for r in SQ.build_sequences(*args, seq_len=300, label="y0", as_of=as_of, entities=who).collect()}
    blocks = SQ.sequence_blocks(*args, seq_len=300, block=block, label="y0", as_of=as_of)
    for r in blocks.collect():
        assert r["start"] == r["block"] * block and len(r["y"]) == min(block, 300 - r["start"])
        if r["who"] is not None:
            z = r["start"] + len(r["y"])
            assert r["X_num"] == [line[r["start"]:z] for line in whole[r["who"]]["X_num"]]
            assert r["y"] == whole[r["who"]]["y"][r["start"]:z]
    for lo, hi in ((0, 300), (0, 1), (299, 300), (63, 129), (100, 200)):
        part = SQ.read_range(blocks, "who", lo, hi, 2, 300, block, entities=who, label=True).collect()
        assert len(part) == len(whole)
        for r in part:
            assert r["X_num"] == [line[lo:hi] for line in whole[r["who"]]["X_num"]]
            assert r["y"] == whole[r["who"]]["y"][lo:hi]


def test_blocks_of_padding_have_no_row(timelines):
    blocks = SQ.sequence_blocks(timelines, "who", "h", ["a"], seq_len=300, block=50)
    found = defaultdict(set)
    for r in blocks.collect():
        found[r["who"]].add(r["block"])
    assert found == {"long": set(range(6)), "gaps": {4, 5}, "one": {5}, "late": {5}, None: {5}}
    assert SQ.sequence_blocks(timelines.limit(0), "who", "h", ["a"], seq_len=300).collect() == []
    with pytest.raises(ValueError):
        SQ.read_range(blocks, "who", 10, 301, 1, 300, 50)


def test_blocks_by_split_read_only_their_range(spark, timelines):
    blocks = SQ.sequence_blocks(timelines, "who", "h", ["a", "b"], seq_len=300, block=20, label="y0")
    blocks = blocks.withColumn("split", F.when(F.col("who") == "gaps", "val").otherwise("train"))
    path = IO.write_sequence_blocks(blocks, scratch_path(spark, "test-blocks"), "who")
    back = IO.read_sequence_range(spark, path, "who", 240, 300, 2, 300, 20, split="train", label=True)
    assert {r["who"] for r in back.collect()} == {"long", "one", "late", None}
    text = plan(back)
    assert "GreaterThanOrEqual(block,12)" in text and "PartitionFilters: [isnotnull(split" in text
    with pytest.raises(ValueError, match="required"):
        IO.read_sequence_range(spark, path, "stay", 0, 1, 2, 300, 20)


# ---------------------------------------------------------------- profile
def test_exact_counts_without_expand(spark):
    rows = [(1, "a", 1.0, [1], True), (1, "A", -0.0, None, True), (2, None, 0.0, [1], True), (None, "a", float("nan"), [], True),
            (3, "", float("nan"), [2], True)]
    df = spark.createDataFrame(rows, "i int, s string, `d x` double, l array<int>, t boolean").withColumn("z", F.lit(None).cast("string"))
    out = PR.profile(df)
    assert "Expand" not in plan(out)
    got = {r["column_name"]: tuple(r)[1:] for r in out.collect()}
    assert got == {"i": ("int", 5, 1, 3), "s": ("string", 5, 1, 3), "d x": ("double", 5, 0, 3), "l": ("array<int>", 5, 1, 3),
                   "t": ("boolean", 5, 0, 1), "z": ("string", 5, 5, 0)}
    assert {tuple(r)[2:] for r in PR.profile(df.limit(0)).collect()} == {(0, 0, 0)}
    assert [tuple(r) for r in PR.profile(df, cols=["s"]).collect()] == [("s", "string", 5, 1, 3)]
    assert {r["column_name"]: r["nulls"] for r in PR.profile(df.drop("l"), approx=True).collect()}["d x"] == 0


# ---------------------------------------------------------------- ordered files, iteration
def test_files_follow_one_another(spark, series):
    df = series.filter("who IS NOT NULL").select("who", "h", "note")
    path = IO.write_ordered(df, scratch_path(spark, "test-ordered"), ["who", "h"], files=9)
    files = sorted(Path(path.removeprefix("file:")).glob("part-*.parquet"))
    assert len(files) == 9
    rows, seen = [], []
    for f in files:
        meta = pq.read_metadata(f)
        stats = [meta.row_group(g).column(0).statistics for g in range(meta.num_row_groups)]
        seen.append((min(s.min for s in stats), max(s.max for s in stats), meta.num_rows))
        rows += [tuple(r.values()) for r in pq.read_table(f).to_pylist()]
    assert rows == sorted(rows) and len(rows) == df.count()
    assert all(a[1] <= b[0] for a, b in zip(seen, seen[1:]))
    assert max(n for _, _, n in seen) < 2 * len(rows) / 9  # the long entity fills files in a row
    assert IO.count_rows(spark, path) == len(rows)


def test_rows_one_partition_at_a_time(spark, series):
    for size in (10**6, 500, 97):
        rows = list(IO.iterate_rows(series, ["who", "h"], partition_rows=size))
        assert [(r["who"], r["h"]) for r in rows] == sorted(((r["who"], r["h"]) for r in series.collect()),
                                                            key=lambda x: (x[0] is not None, x))
    assert sorted(map(repr, IO.iterate_rows(series, partition_rows=300))) == sorted(map(repr, series.collect()))
    assert list(IO.iterate_rows(series.limit(0), ["h"])) == [] and list(IO.iterate_rows(series.limit(0))) == []
    many = scratch_path(spark, "test-files")
    series.repartition(23).write.parquet(many)
    assert next(IO.iterate_rows(spark.read.parquet(many), ["note"]))["note"] == "x0"
    assert IO.count_rows(spark, many) == series.count()


# ---------------------------------------------------------------- exact sample
def test_sample_cut_by_histograms(spark):
    df = spark.range(5000).withColumnRenamed("id", "k").withColumn("v", F.col("k") * 2)
    for n in (0, 1, 50, 4999, 5000, 6000):
        same(S.sample_rows_exact(df, n, "k", seed=3), S.sample_rows(df, n, "k", seed=3))
    tied = spark.range(400).select((F.col("id") % 3).alias("k"), "id").unionByName(spark.createDataFrame([(None, -1)] * 30, "k long, id long"))
    for n in (1, 29, 31, 150, 429, 430):
        got = S.sample_rows_exact(tied, n, "k", seed=3)
        assert Counter(r["k"] for r in got.collect()) == Counter(r["k"] for r in S.sample_rows(tied, n, "k", seed=3).collect())
    assert S.sample_rows_exact(df.limit(0), 5, "k").collect() == []
    assert "TakeOrdered" not in plan(S.sample_rows_exact(df, 50, "k"))


# ---------------------------------------------------------------- versions and batches
def test_a_failed_publish_leaves_the_old_table(spark):
    path = scratch_path(spark, "test-versions")
    with pytest.raises(FileNotFoundError):
        V.read_published(spark, path)
    assert V.publish(spark.range(5), path) == 1
    broken = spark.range(10).select(F.raise_error(F.lit("lost")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        V.publish(broken, path)
    assert V.read_published(spark, path).count() == 5
    old = V.read_published(spark, path)
    assert V.publish(old.selectExpr("id + 1 AS id"), path) == 2  # from itself
    assert V.read_published(spark, path).agg(F.sum("id")).first()[0] == 15
    assert old.agg(F.sum("id")).first()[0] == 10  # a reader that began before
    for n in (3, 4):
        assert V.publish(spark.range(n), path) == n
    assert V.read_published(spark, path, 3).count() == 3
    with pytest.raises(FileNotFoundError):
        V.read_published(spark, path, 1)
    with pytest.raises(ValueError):
        V.publish(old, path, keep=0)


def test_a_batch_counts_once(spark):
    path = scratch_path(spark, "test-batches")
    with pytest.raises(FileNotFoundError):
        V.read_appended(spark, path)
    broken = spark.range(10).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        V.append_once(broken, path, "a")
    assert V.append_once(spark.range(3), path, "a") and not V.append_once(spark.range(3), path, "a")
    assert V.append_once(spark.range(10, 12), path, "b")
    assert sorted(r[0] for r in V.read_appended(spark, path).collect()) == [0, 1, 2, 10, 11]
    assert V.read_appended(spark, path, ["b"]).count() == 2
    spark.range(99).write.parquet(f"{path}/data/{'0' * 32}")  # a second attempt at the same time
    V.Folder(spark, path).mark("_batches", f"b@{'0' * 32}")
    assert V.read_appended(spark, path, ["b"]).count() == 99 and V.read_appended(spark, path).count() == 102
    with pytest.raises(ValueError):
        V.append_once(spark.range(1), path, "a/../b")


# ---------------------------------------------------------------- quantiles
def quantile(values, p):
    """Linear interpolation between the two ranks, NaN above all numbers."""
    x = sorted((v for v in values if v is not None), key=lambda v: (v != v, v))
    if not x:
        return None
    at = p * (len(x) - 1)
    lo, hi = x[int(at)], x[min(int(at) + (at > int(at)), len(x) - 1)]
    return lo + (at - int(at)) * (hi - lo)


@pytest.mark.parametrize("limit", [1, 60, 10**6])
def test_quantiles_by_closing_brackets(spark, limit):
    rng = random.Random(7)
    rows = [("wide", rng.lognormvariate(0, 4)) for _ in range(6000)] + [("ties", float(rng.randrange(3))) for _ in range(3000)]
    rows += [("one", 5.0), ("none", None), (None, 1.0), (None, 2.0), ("same", 7.0), ("same", 7.0), ("signs", -INF), ("signs", INF)]
    rows += [("mixed", rng.choice([None, -INF, INF, float("nan"), -1.0, 0.0, rng.random()])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    probs = [0.0, 0.25, 0.5, 0.501, 0.9999, 1.0]
    out = exact_quantiles(df, "x", probs, list("abcdef"), groups=["g"], limit=limit).collect()
    assert {r["g"] for r in out} == {"wide", "ties", "one", None, "same", "signs", "mixed"}
    for r in out:
        expected = [quantile([x for g, x in rows if g == r["g"]], p) for p in probs]
        assert [repr(x) for x in r[1:]] == [repr(x) for x in expected]
    whole = exact_quantiles(df.filter("g = 'wide'"), "x", [0.5, 0.9], limit=limit).collect()
    assert [tuple(r) for r in whole] == [tuple(quantile([x for g, x in rows if g == "wide"], p) for p in (0.5, 0.9))]
    assert [tuple(r) for r in exact_quantiles(df.limit(0), "x", [0.5], limit=limit).collect()] == [(None,)]


def test_a_sketch_that_errs_changes_nothing(spark, monkeypatch):
    real = quantiles._closed_in

    def wrong(state, limit):
        return real(state, limit).withColumns({"a": F.lit(900.0), "b": F.lit(901.0)})

    monkeypatch.setattr(quantiles, "_closed_in", wrong)
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    assert exact_quantiles(df, "x", [0.1, 0.9], limit=10).first()[:] == (99.9, 899.1)


def test_quantiles_range_shuffle_nothing(spark):
    text = plan(exact_quantiles(spark.range(1000).selectExpr("cast(id as double) x"), "x", [0.5], limit=50))
    assert "rangepartitioning" not in text


# ---------------------------------------------------------------- tasks of large grids
def _timeline(spark):
    from hourglass.plans import timeline_etl as ETL

    rng = random.Random(5)
    rows = [(u, u * 1000 + i, rng.randrange(40 * (u % 4) + 2) * 1800, rng.choice(["click", "error", "purchase"]), rng.random())
            for u in range(30) for i in range(8)]
    ev = spark.createDataFrame(rows, "user_id long, event_id long, at long, event_type string, value double").withColumn(
        "ts", F.timestamp_seconds("at").cast("timestamp_ntz")).drop("at")
    stays = ev.groupBy("user_id").agg(F.min("ts").alias("intime"), F.max("ts").alias("outtime"))
    return ETL.build_timeline(ev, stays, "user_id", "ts", "event_type", "value", ("click", "error"), ("purchase",))


def test_large_grids_go_into_tasks_of_bounded_hours(spark, monkeypatch):
    from hourglass.plans import timeline_etl as ETL

    usual = _timeline(spark)["dataset"].collect()
    monkeypatch.setattr(ETL, "TASK_HOURS", 10)
    t = _timeline(spark)
    hours = t["grid"].count()
    n = -(-hours // 10)
    assert n > 8 and t["dataset"].rdd.getNumPartitions() == n
    assert sorted(map(repr, t["dataset"].collect())) == sorted(map(repr, usual))
    seq = SQ.build_sequences(t["dataset"], "user_id", "HOUR_IN", ["V__click"], 80, label="target")
    assert seq.rdd.getNumPartitions() == n  # by entity, in the tasks of the windows
    every = SQ.build_sequences(t["dataset"], "user_id", "HOUR_IN", ["V__click"], 80, entities=t["stays"])
    top = next(line for line in plan(every).splitlines() if "Join" in line)
    assert "SortMergeJoin" in top  # no broadcast of sequences


def test_blocks_by_known_extents_write_no_hours(spark, monkeypatch):
    t = _timeline(spark)
    args = (t["dataset"], "user_id", "HOUR_IN", ["V__click", "D__error"], 80)
    plain = SQ.sequence_blocks(*args, block=16, label="target")
    written = []
    cut = SQ.cut_lineage
    monkeypatch.setattr(SQ, "cut_lineage", lambda df, **kw: written.append(kw["name"]) or cut(df, **kw))
    extents = t["grid"].groupBy("user_id").agg(F.max("HOUR_IN").alias("max_hour"))
    same(SQ.sequence_blocks(*args, block=16, label="target", extents=extents), plain)
    assert written == ["extents"]
