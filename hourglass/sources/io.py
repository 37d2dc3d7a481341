"""Sources and sinks.

Reads declare their schema (no inference pass over 100 TB of CSV), and writes
never target the path they read from.  Paths go through Hadoop's FileSystem so
``hdfs://``, ``s3a://`` and local paths behave the same.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourglass.functions.columns import ensure_columns


# --------------------------------------------------------------------------- helpers
def _fs_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


def _qualified(spark: SparkSession, path) -> str:
    """The path with its scheme and authority, as the file system names it."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(jpath).toString().rstrip("/")


def _scan_roots(df: DataFrame) -> list[str]:
    """Root paths of the file scans in a DataFrame's plan."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    roots = []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and \
                leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            paths = leaf.relation().location().rootPaths()
            roots += [_qualified(df.sparkSession, paths.apply(k).toString()) for k in range(paths.size())]
    return roots


# --------------------------------------------------------------------------- S2
def resolve_table(spark: SparkSession, root: str, table: str,
                  prefer: Sequence[str] = (".csv.gz", ".csv")) -> str:
    """First existing ``root/table{ext}`` in ``prefer`` order."""
    root = root.rstrip("/")
    for ext in prefer:
        path = f"{root}/{table}{ext}"
        if _fs_exists(spark, path):
            return path
    raise FileNotFoundError(f"no file for table {table!r} under {root} (tried {list(prefer)})")


def _header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header line only (reads one line, not the file)."""
    first = spark.read.option("header", False).csv(path).limit(1).collect()
    return [str(v) for v in first[0]] if first else []


# --------------------------------------------------------------------------- S1 / S3
def read_raw(spark: SparkSession, path: str, columns: Iterable[str] | None = None,
             optional: Mapping[str, str] | None = None, min_partitions: int | None = None) -> DataFrame:
    """Scan a header CSV (plain or gzip) with every column as STRING.

    ``columns`` restricts the projection (pushed into the CSV reader);
    ``optional`` columns that are absent from the header are added as typed
    nulls (S3).  A ``.gz`` file is a single unsplittable task, so it is
    repartitioned right after the scan when ``min_partitions`` is given.
    """
    names = _header(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType(), True) for n in names])
    df = (spark.read.option("header", True).option("mode", "PERMISSIVE")
          .option("enforceSchema", False).schema(schema).csv(path))
    if columns is not None:
        wanted = [c for c in columns if c in names]
        df = df.select(*wanted)
    if optional:
        df = ensure_columns(df, {k: "string" for k in optional if k not in df.columns})
        df = df.select(*[F.col(c).cast(optional[c]).alias(c) if c in optional else F.col(c)
                         for c in df.columns])
    if min_partitions and path.endswith(".gz"):
        df = df.repartition(min_partitions)
    return df


# --------------------------------------------------------------------------- S4
def read_dimension(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Small reference table (item map, ranges) with an explicit schema.

    The caller decides whether to broadcast after checking its size
    (:func:`hourglass.operators.joins.broadcast_if_small`).
    """
    return spark.read.option("header", True).schema(schema).csv(path)


# --------------------------------------------------------------------------- S5
def read_names(spark: SparkSession, path: str, col: str = "name") -> DataFrame:
    """One name per line; trimmed, blanks skipped, duplicates removed."""
    return (spark.read.text(path)
            .select(F.trim(F.col("value")).alias(col))
            .filter(F.col(col) != "")
            .distinct())


# --------------------------------------------------------------------------- S6 / S7
def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan; projection and filters push into the reader."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def count_rows(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet table (S6); no column is read, Spark takes the counts from the footers."""
    return spark.read.parquet(path).count()


#: Rows that an iteration holds on the driver at a time, about.
ITERATE_ROWS = 100_000


def iterate_rows(df: DataFrame, order: Sequence[str] | None = None, partition_rows: int = ITERATE_ROWS) -> Iterator[Row]:
    """Every row in turn, with one partition of about ``partition_rows`` rows on the driver at a time.

    With ``order`` the rows come in that order (give a total order for a stable one): they are dealt into
    ranges once, and each range is sorted where it lies and fetched when its turn comes.  Without, they come in
    whatever order the table has, large partitions divided.  Nothing runs before the first row is asked for; an
    empty table ends at once.
    """
    parts = max(1, -(-df.count() // partition_rows))
    if order:
        df = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    elif parts > 1:
        df = df.repartition(parts)
    yield from df.toLocalIterator()


def write_ordered(df: DataFrame, path: str, order: Sequence[str], files: int | None = None, mode: str = "overwrite") -> str:
    """Write a table in the order of ``order`` over all its files (O1).

    Rows are dealt into ranges of ``order`` and sorted within, so the ranges of two files do not overlap and files
    follow one another in the order of their part numbers; a scan that filters on the leading columns skips the others by
    their footers.  ``order`` may end in columns that split a hot entity, e.g. (entity, hour): its rows then
    fill files in a row instead of one task.  ``files`` defaults to the session's shuffle partitions.
    """
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return write_table(df.repartitionByRange(n, *order), path, sort_within=order, mode=mode)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] | None = None,
                sort_within: Sequence[str] | None = None, mode: str = "overwrite") -> str:
    """Write a Parquet artifact, optionally partitioned and sorted within files.

    Refuses to overwrite a path the DataFrame reads from (trap T18), by the
    qualified root paths of its scans; no file is listed for that.
    """
    if mode == "overwrite":
        target = _qualified(df.sparkSession, path)
        for root in _scan_roots(df):
            if (root + "/").startswith(target + "/") or (target + "/").startswith(root + "/"):
                raise ValueError(f"refusing to overwrite {path}: it is an input of this DataFrame")
    if sort_within:
        df = df.sortWithinPartitions(*sort_within)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


# --------------------------------------------------------------------------- S8
class Artifacts:
    """Named datasets under one run root (S8): tables as Parquet, metrics as JSON rows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, partition_by: Sequence[str] | None = None) -> str:
        return write_table(df, self.path(name), partition_by=partition_by)

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def exists(self, name: str) -> bool:
        return _fs_exists(self.spark, self.path(name))

    def save_json(self, df: DataFrame, name: str) -> str:
        df.write.mode("overwrite").json(self.path(name + ".json"))
        return self.path(name + ".json")

    def load_json(self, name: str, schema: T.StructType | str | None = None) -> DataFrame:
        r = self.spark.read
        if schema is not None:
            r = r.schema(schema)
        return r.json(self.path(name + ".json"))


# --------------------------------------------------------------------------- S9
def write_vocab(vocab: DataFrame, path: str) -> str:
    """Persist the vocabulary ``(idx, code, n)``; code->idx and idx->code are this table."""
    return write_table(vocab.select("idx", "code", "n"), path)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("idx", "code", "n")


# --------------------------------------------------------------------------- S10 / S11
SEQUENCE_REQUIRED = ("stay_id", "X_num", "X_cat")
SEQUENCE_OPTIONAL = {"y_icd": "array<bigint>", "y_vent": "array<bigint>", "X_icd": "array<float>"}


def write_sequences(df: DataFrame, path: str) -> str:
    """Dense per-stay sequences, one Parquet directory per split."""
    return write_table(df, path, partition_by=["split"])


def read_sequences(spark: SparkSession, path: str, label_key: str = "y_vent",
                   split: str | None = None) -> DataFrame:
    """Read sequences with a required-column check; absent optional columns are typed nulls.

    ``label_key`` picks which label column is exposed as ``y``.  A ``split``
    filter prunes partitions at the scan.
    """
    df = spark.read.parquet(path)
    missing = [c for c in SEQUENCE_REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"sequence table at {path} lacks required columns {missing}")
    if split is not None:
        df = df.filter(F.col("split") == F.lit(split))
    df = ensure_columns(df, SEQUENCE_OPTIONAL)
    if label_key not in df.columns:
        raise ValueError(f"label column {label_key!r} not in {df.columns}")
    return df.withColumn("y", F.col(label_key))


def write_sequence_blocks(df: DataFrame, path: str, key: str) -> str:
    """Sequence blocks (``operators.sequences.sequence_blocks`` with a ``split``), one directory per split.

    Within a split files are ordered by (key, block), so the blocks of a key follow one another.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["split", key, "block"]
    return write_table(df.repartitionByRange(n, *order), path, partition_by=["split"], sort_within=order)


def read_sequence_range(spark: SparkSession, path: str, key: str, lo: int, hi: int, n_channels: int, seq_len: int,
                        block: int, split: str | None = None, entities: DataFrame | None = None,
                        label: bool = False) -> DataFrame:
    """Positions ``lo`` up to ``hi`` of the sequences stored in blocks at ``path`` (S11), see ``sequences.read_range``."""
    from hourglass.operators.sequences import read_range

    blocks = spark.read.parquet(path)
    missing = [c for c in (key, "block", "X_num", *(["y"] if label else [])) if c not in blocks.columns]
    if missing:
        raise ValueError(f"sequence blocks at {path} lack required columns {missing}")
    if split is not None:
        blocks = blocks.filter(F.col("split") == F.lit(split))
    return read_range(blocks, key, lo, hi, n_channels, seq_len, block, entities=entities, label=label)


# --------------------------------------------------------------------------- S12
METRIC_SCHEMA = "name string, step bigint, value double"
TRACE_SCHEMA = "stage string, started_at timestamp_ntz, duration_sec double"


def append_metrics(df: DataFrame, path: str) -> str:
    """Append-only metric history / trace events."""
    df.write.mode("append").parquet(path)
    return path


def slow_stages(trace: DataFrame, threshold_s: float = 120.0) -> DataFrame:
    """Stages whose duration reached the warning threshold."""
    return trace.filter(F.col("duration_sec") >= F.lit(threshold_s))
