"""Column-level functions: casts, parsing, time arithmetic, cleaning, encoding.

All of these return ``Column`` expressions (or apply one ``select``), so they
stay inside whole-stage codegen and cost nothing extra at plan time.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000
EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------- P1
def cast_columns(df: DataFrame, types: Mapping[str, str], keep_others: bool = True) -> DataFrame:
    """Strict typed cast by column map.

    ANSI mode (Spark 4 default) makes a bad numeric text raise, as the reference
    does; timestamps go through :func:`parse_ts` instead, which is lenient.
    """
    cols = []
    for name in df.columns:
        if name in types:
            cols.append(F.col(name).cast(types[name]).alias(name))
        elif keep_others:
            cols.append(F.col(name))
    return df.select(*cols)


# --------------------------------------------------------------------------- P2
_ZONE_RE = r"(Z|[+-][0-9]{2}:?[0-9]{2})$"


def parse_ts(c) -> Column:
    """Lenient ISO timestamp parse to a UTC wall-clock ``TIMESTAMP_NTZ``.

    Unparsable text gives NULL.  Text with a zone suffix (``Z`` or ``+hh:mm``)
    is read as an instant and rendered in UTC, independent of the session zone.
    """
    s = F.trim(_c(c))
    instant = F.try_to_timestamp(s)
    utc_wall = F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.expr(EPOCH_NTZ))
    naive = s.try_cast("timestamp_ntz")
    return F.when(s.rlike(_ZONE_RE), F.coalesce(utc_wall, naive)).otherwise(naive)


# --------------------------------------------------------------------------- P3
def stay_hours(lo, hi) -> Column:
    """Whole hours elapsed between two timestamps, truncated."""
    return F.timestamp_diff("HOUR", _c(lo), _c(hi))


# --------------------------------------------------------------------------- P4
def cohort_filter(df: DataFrame, min_los: float = 1.0, min_hours: int = 24,
                  max_hours: int = 240, min_age: int = 15, los: str = "LOS",
                  hours: str = "STAY_HOURS", age: str = "AGE") -> DataFrame:
    """Keep stays with LOS >= a, b <= hours < c, age >= d."""
    return df.filter(
        (F.col(los) >= F.lit(min_los))
        & (F.col(hours) >= F.lit(min_hours))
        & (F.col(hours) < F.lit(max_hours))
        & (F.col(age) >= F.lit(min_age))
    )


# --------------------------------------------------------------------------- P5
def age_years(dob, at) -> Column:
    """Age = whole 24 h periods / 365.2425, floored (P5)."""
    return F.floor(F.timestamp_diff("DAY", _c(dob), _c(at)) / F.lit(365.2425)).cast("int")


# --------------------------------------------------------------------------- P6
def in_interval_flag(ts, lo, hi) -> Column:
    """1 when ``lo <= ts <= hi``, else 0 (null ts or bounds -> 0)."""
    return F.when(_c(ts).between(_c(lo), _c(hi)), F.lit(1)).otherwise(F.lit(0))


# --------------------------------------------------------------------------- P7
def drop_null_values(df: DataFrame, *cols: str) -> DataFrame:
    """Drop rows where any of ``cols`` is null."""
    return df.dropna(subset=list(cols))


# --------------------------------------------------------------------------- P8
def hour_offset(ts, anchor) -> Column:
    """Hours from anchor to ts, floored toward minus infinity, BIGINT."""
    micros = F.timestamp_diff("MICROSECOND", _c(anchor), _c(ts))
    return F.floor(micros / F.lit(MICROS_PER_HOUR)).cast("bigint")


def with_hour_offset(df: DataFrame, ts: str, anchor: str, out: str = "HOURS_IN",
                     min_hour: int | None = 0) -> DataFrame:
    """Add the hour offset column and keep rows with offset >= ``min_hour``."""
    df = df.withColumn(out, hour_offset(ts, anchor))
    if min_hour is not None:
        df = df.filter(F.col(out) >= F.lit(min_hour))
    return df


# --------------------------------------------------------------------------- P9
# Unit rules of the reference, first match wins.
#   (family substring of the name, unit substring or None, extra value test, conversion)
#   weight + "oz"                     -> v / 16 * 0.45359237
#   weight + "lb"                     -> v * 0.45359237
#   temperature + ("f" or v > 79)     -> (v - 32) * 5 / 9
#   height + "in"                     -> v * 2.54
#   fraction inspired oxygen, v <= 1  -> v * 100
#   oxygen saturation, v <= 1         -> v * 100
LB_TO_KG = 0.45359237


def default_unit_rules(v: Column, unit: Column, name: Column) -> list[tuple[Column, Column]]:
    name_l = F.lower(name)
    unit_l = F.lower(unit)
    weight = name_l.contains("weight")
    temp = name_l.contains("temperature")
    height = name_l.contains("height")
    fio2 = name_l.contains("fraction inspired oxygen")
    o2sat = name_l.contains("oxygen saturation")
    return [
        (weight & unit_l.contains("oz"), v / 16.0 * LB_TO_KG),
        (weight & unit_l.contains("lb"), v * LB_TO_KG),
        (temp & (unit_l.contains("f") | (v > 79)), (v - 32) * 5.0 / 9.0),
        (height & unit_l.contains("in"), v * 2.54),
        (fio2 & (v <= 1.0), v * 100.0),
        (o2sat & (v <= 1.0), v * 100.0),
    ]


def convert_units(v, unit, name, rules=None) -> Column:
    """Chained conversion, first matching rule wins; null tests fall through."""
    v, unit, name = _c(v), _c(unit), _c(name)
    rules = rules(v, unit, name) if callable(rules) else (rules or default_unit_rules(v, unit, name))
    expr = None
    for cond, out in rules:
        expr = F.when(cond, out) if expr is None else expr.when(cond, out)
    return v if expr is None else expr.otherwise(v)


# --------------------------------------------------------------------------- P10/P11
def outlier_mask(v, lo, hi) -> Column:
    """True when the row survives outlier removal; a null bound skips its test (P10)."""
    v = _c(v)
    below = F.coalesce(v < _c(lo), F.lit(False))
    above = F.coalesce(v > _c(hi), F.lit(False))
    return ~(below | above)


def drop_outliers(df: DataFrame, v: str, lo: str, hi: str) -> DataFrame:
    return df.filter(outlier_mask(v, lo, hi))


def clip_to_range(v, lo, hi) -> Column:
    """Clamp to [lo, hi]; a null bound does not clamp."""
    v, lo, hi = _c(v), _c(lo), _c(hi)
    return F.when(v < lo, lo).when(v > hi, hi).otherwise(v)


# --------------------------------------------------------------------------- P12
def normalize_name(c) -> Column:
    """Lower snake case: non-alphanumerics to '_', trimmed of '_' (P12)."""
    s = F.regexp_replace(F.lower(_c(c)), r"[^a-z0-9]+", "_")
    return F.regexp_replace(s, r"^_+|_+$", "")


# --------------------------------------------------------------------------- P13
def filter_names(df: DataFrame, col: str, names: DataFrame, names_col: str | None = None) -> DataFrame:
    """Keep rows whose ``col`` is in the ``names`` table (left semi join)."""
    names_col = names_col or names.columns[0]
    right = names.select(F.col(names_col).alias("__hg_name")).distinct()
    return df.join(right, F.col(col) == F.col("__hg_name"), "left_semi")


# --------------------------------------------------------------------------- P14
def drop_matching(df: DataFrame, markers: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """Drop columns whose lower-cased name contains any marker, except ``keep``."""
    markers = [m.lower() for m in markers]
    keep = set(keep)
    drop = [c for c in df.columns if c not in keep and any(m in c.lower() for m in markers)]
    return df.drop(*drop)


# --------------------------------------------------------------------------- P15 / S3
def ensure_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Add absent columns as typed nulls."""
    missing = [F.lit(None).cast(t).alias(n) for n, t in types.items() if n not in df.columns]
    return df.select("*", *missing) if missing else df


# --------------------------------------------------------------------------- P16 / P25
def finite_or_null(c) -> Column:
    """NaN and +-Inf become NULL."""
    c = _c(c)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def nan_to_zero(c) -> Column:
    """NaN, +-Inf and NULL become 0 (P25)."""
    return F.coalesce(finite_or_null(c), F.lit(0.0))


# --------------------------------------------------------------------------- P17
# Reference age bin edges and labels.
AGE_BIN_EDGES = (15, 40, 65, 90)
AGE_BIN_LABELS = ("AGE_15_39", "AGE_40_64", "AGE_65_89", "AGE_90PLUS")


def bin_labels(c, edges: Sequence[float] = AGE_BIN_EDGES, labels: Sequence[str] = AGE_BIN_LABELS) -> Column:
    """Label by the first upper edge the value is below; the last label is the rest.

    ``edges[0]`` is the lower bound of the first bin and is not tested, as in
    the reference; ``labels`` has ``len(edges)`` entries.
    """
    c = _c(c)
    expr = None
    for edge, lab in zip(edges[1:], labels[:-1]):
        expr = F.when(c < edge, F.lit(lab)) if expr is None else expr.when(c < edge, F.lit(lab))
    return expr.otherwise(F.lit(labels[-1])) if expr is not None else F.lit(labels[-1])


# --------------------------------------------------------------------------- P18
# Reference canonical categories.
ADMISSION_LEVELS = ("EMERGENCY", "URGENT", "ELECTIVE", "OTHER")
ETHNICITY_RULES = (("WHITE", "WHITE"), ("BLACK", "BLACK"), ("HISPANIC", "HISPANIC"))
ETHNICITY_LEVELS = ("WHITE", "BLACK", "HISPANIC", "OTHER")
INSURANCE_RULES = (("MEDICARE", "MEDICARE"), ("MEDICAID", "MEDICAID"),
                   ("PRIVATE", "PRIVATE"), ("SELF", "SELF_PAY"))
INSURANCE_LEVELS = ("MEDICARE", "MEDICAID", "PRIVATE", "SELF_PAY", "OTHER")


def canonicalize(c, rules, mode: str = "exact", other: str = "OTHER") -> Column:
    """Upper-case, then map by exact value list or ordered substring rules.

    ``rules`` is a list of values (exact mode) or of ``(substring, label)``
    pairs (contains mode).  Null and unmatched values become ``other``.
    """
    u = F.coalesce(F.upper(_c(c).cast("string")), F.lit(other))
    expr = None
    for r in rules:
        if mode == "exact":
            cond, lab = (u == F.lit(r)), r
        else:
            cond, lab = u.contains(r[0]), r[1]
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(other)) if expr is not None else F.lit(other)


# --------------------------------------------------------------------------- P19
def one_hot_fixed(c, levels: Sequence[str], prefix: str) -> list[Column]:
    """One TINYINT column per fixed level, named ``{prefix}__{level}``."""
    c = _c(c)
    return [F.coalesce((c == F.lit(lv)).cast("tinyint"), F.lit(0).cast("tinyint")).alias(f"{prefix}__{lv}")
            for lv in levels]


# --------------------------------------------------------------------------- P20
def hour_of_day(anchor, h) -> Column:
    """Hour of day of ``anchor + h hours`` as TINYINT (P20)."""
    return F.hour(F.timestamp_add("HOUR", _c(h), _c(anchor))).cast("tinyint")


# --------------------------------------------------------------------------- P21
def fill_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Replace nulls with per-column defaults; a list default gives a typed empty array."""
    cols = []
    for name, field in zip(df.columns, df.schema.fields):
        if name in defaults:
            d = defaults[name]
            if isinstance(d, (list, tuple)):
                fill = F.array(*[F.lit(x) for x in d]).cast(field.dataType)
            else:
                fill = F.lit(d).cast(field.dataType)
            cols.append(F.coalesce(F.col(name), fill).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


# --------------------------------------------------------------------------- P22
def add_flags(df: DataFrame, names: Iterable[str], value: int = 0) -> DataFrame:
    """Constant TINYINT flag columns."""
    return df.select("*", *[F.lit(value).cast("tinyint").alias(n) for n in names])


# --------------------------------------------------------------------------- P23
def time_channel(h, seq_len: int) -> Column:
    """Normalized time h / L."""
    return (_c(h).cast("double") / F.lit(float(seq_len)))


# --------------------------------------------------------------------------- P24
def apply_zscore(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(c - mean) / std with std null or 0 -> 1, using a 1-row stats table.

    ``stats`` holds ``{c}__mean`` / ``{c}__std`` columns; it is one row by
    construction (a global aggregate), so broadcasting it is size-safe.
    """
    joined = df.crossJoin(F.broadcast(stats))
    out = []
    for name in df.columns:
        if name in cols:
            std = F.coalesce(F.nullif(F.col(f"{name}__std"), F.lit(0.0)), F.lit(1.0))
            out.append(((F.col(name) - F.col(f"{name}__mean")) / std).alias(name))
        else:
            out.append(F.col(name))
    return joined.select(*out)


# --------------------------------------------------------------------------- P26
_ITEM = r"""(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[-+]?(?:0+|[1-9][0-9]*)(?:\.[0-9]*)?(?:[eE][-+]?[0-9]+)?|None|True|False)"""
_ITEMS = rf"{_ITEM}(?:\s*,\s*{_ITEM})*\s*,?"
_LIST = rf"\[\s*(?:{_ITEMS})?\s*\]"
_TUPLE = rf"\(\s*(?:{_ITEM}\s*,\s*(?:{_ITEMS})?)?\s*\)|{_ITEM}\s*,\s*(?:{_ITEMS})?"
_SCALAR = rf"{_ITEM}|\(\s*{_ITEM}\s*\)|\{{\s*\}}"


def parse_list(c) -> Column:
    """List-like text to ``array<string>``.

    A list or tuple literal of quoted texts, numbers and constants -> its
    elements; another literal (a lone number or quoted text) -> empty; other
    ``[a, b]`` text -> split on commas, quotes and spaces stripped, empty parts
    dropped; any other text, the empty one too -> itself as the only element;
    null -> empty.  Nested literals count as other text.
    """
    s = _c(c)
    elements = F.transform(F.regexp_extract_all(s, F.lit(f"({_ITEM})"), F.lit(1)), lambda x: F.when(
        x.rlike(r"""^['"]"""), F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1")).otherwise(x))
    inner = F.regexp_replace(s, r"^[\[\]]+|[\[\]]+$", "")
    parts = F.filter(F.split(inner, ","), lambda x: F.trim(x) != "")
    stripped = F.transform(parts, lambda x: F.regexp_replace(x, r"""^[ '"]+|[ '"]+$""", ""))
    return (F.when(s.isNull(), F.array().cast("array<string>"))
            .when(s.rlike(rf"^[ \t]*(?:{_LIST}|{_TUPLE})\s*$"), elements)
            .when(s.rlike(rf"^[ \t]*(?:{_SCALAR})\s*$"), F.array().cast("array<string>"))
            .when(s.startswith("[") & s.endswith("]"), stripped)
            .otherwise(F.array(s)))


# --------------------------------------------------------------------------- P27
def codes_to_text(c, sep: str = " ") -> Column:
    """Join a code list to text, skipping empty entries; a null list gives the empty text."""
    return F.coalesce(F.array_join(F.filter(_c(c), lambda x: x != ""), sep), F.lit(""))


# --------------------------------------------------------------------------- helpers
def hour_floor(ts) -> Column:
    """Truncate a timestamp to the whole hour without going through the session zone."""
    t = _c(ts)
    micros = F.timestamp_diff("MICROSECOND", F.expr(EPOCH_NTZ), t)
    return F.timestamp_add("MICROSECOND", -F.pmod(micros, F.lit(MICROS_PER_HOUR)), t)
