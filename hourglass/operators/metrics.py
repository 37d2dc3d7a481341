"""Evaluation over prediction tables.

Input rows carry ``logits ARRAY<DOUBLE>`` and ``candidates ARRAY<INT>``
(``-1`` = padding) and/or ``label INT``.  Per-row work is array lambdas
(JVM-side); dataset metrics are one aggregate, or a per-class table whose
size is the number of classes.  ROC AUC and average precision are exact
(ties counted half) and use distributed prefix sums over distinct scores.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourglass.functions.arrays import argmax, bound, topk_idx
from hourglass.operators.scan import prefix_sums

NEG_INF = float("-inf")


def _valid_cands(c: Column) -> Column:
    return F.filter(F.coalesce(c, F.array().cast("array<int>")), lambda x: x >= 0)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def softmax(a: Column) -> Column:
    """Softmax of an array column; the maximum, the exponentials and their sum are computed once per row."""
    return bound(a, lambda v: bound(F.array_max(v), lambda m: bound(
        F.transform(v, lambda x: F.exp(x - m)), lambda e: bound(_sum(e), lambda s: F.transform(e, lambda x: x / s)))))


def log_softmax(a: Column) -> Column:
    """Log-softmax of an array column; the maximum and the log of the sum are computed once per row."""
    return bound(a, lambda v: bound(F.array_max(v), lambda m: bound(
        m + F.log(_sum(F.transform(v, lambda x: F.exp(x - m)))), lambda lse: F.transform(v, lambda x: x - lse))))


# --------------------------------------------------------------------------- M1
def score(df: DataFrame, logits: str = "logits", candidates: str | None = "candidates",
          ignored: Sequence[int] = (), temperature: float = 1.0) -> DataFrame:
    """Mask ignored classes, temperature-scale, softmax and argmax (M1).

    Adds ``scaled`` (scaled logits), ``probs`` and ``pred``; ignored classes get
    logit -1e9 and are replaced by -1 in the candidate list.
    """
    ign = F.array(*[F.lit(int(i)) for i in ignored]) if ignored else None
    lg = F.col(logits).cast("array<double>")
    if ign is not None:
        lg = F.transform(lg, lambda x, i: F.when(F.array_contains(ign, i), F.lit(-1e9)).otherwise(x))
    scaled = F.transform(lg, lambda x: x / F.lit(max(float(temperature), 1e-6)))
    out = df.withColumn("scaled", scaled)
    if candidates is not None and ign is not None:
        out = out.withColumn(candidates, F.transform(F.col(candidates), lambda x: F.when(
            F.array_contains(ign, x), F.lit(-1)).otherwise(x)))
    return (out.withColumn("probs", softmax(F.col("scaled")))
            .withColumn("pred", argmax(F.col("scaled")).cast("int")))


# --------------------------------------------------------------------------- M2-M6
def candidate_metrics(scored: DataFrame, candidates: str = "candidates",
                      ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """One-row candidate metrics over a scored table (M2-M6).

    * ``cand_acc``, ``hit_at_k``: over rows with >= 1 candidate (M2);
    * ``cpm``: mean candidate probability mass (M3);
    * ``cmg``: mean(max candidate prob - max non-candidate prob) (M4);
    * ``ndi``: normalized dominance of the most predicted seen class over all
      rows (M5); ``epr``, ``pred_unique``, ``top_pred``, ``top_ratio``,
      ``avg_cand`` (M6).
    """
    c = _valid_cands(F.col(candidates))
    n_cls = F.size("scaled")
    rows = scored.select(
        F.col("pred"), F.col("probs"), c.alias("__c"), n_cls.alias("__ncls"),
        topk_idx(F.col("scaled"), max(ks)).alias("__topk"))
    has = F.size("__c") > 0
    cand_mass = F.aggregate("__c", F.lit(0.0), lambda acc, i: acc + F.element_at("probs", i + 1))
    in_c = lambda i: F.array_contains(F.col("__c"), i)
    probs_idx = F.transform("probs", lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    cand_max = F.array_max(F.transform(F.filter(probs_idx, lambda s: in_c(s["i"])), lambda s: s["p"]))
    other_max = F.array_max(F.transform(F.filter(probs_idx, lambda s: ~in_c(s["i"])), lambda s: s["p"]))
    margin = cand_max - F.coalesce(other_max, F.lit(NEG_INF))
    per_row = rows.select(
        "pred", "__c", has.alias("__has"),
        F.when(has, F.array_contains("__c", F.col("pred")).cast("double")).alias("__hit"),
        *[F.when(has, F.arrays_overlap(F.slice("__topk", 1, F.least(F.lit(k), F.col("__ncls"))),
                                       "__c").cast("double")).alias(f"__hit{k}") for k in ks],
        F.when(has, cand_mass).alias("__cpm"),
        F.when(has, margin).alias("__cmg"),
        F.when(has, F.size("__c")).alias("__csize"))
    summary = per_row.agg(
        F.coalesce(F.avg("__hit"), F.lit(0.0)).alias("cand_acc"),
        *[F.coalesce(F.avg(f"__hit{k}"), F.lit(0.0)).alias(f"hit_at_{k}") for k in ks],
        F.coalesce(F.avg("__cpm"), F.lit(0.0)).alias("cpm"),
        F.coalesce(F.avg("__cmg"), F.lit(0.0)).alias("cmg"),
        F.coalesce(F.avg("__csize"), F.lit(0.0)).alias("avg_cand"),
        F.count(F.lit(1)).alias("n_rows"))
    spread = prediction_spread(per_row.select("pred", "__c"), "__c")
    return summary.crossJoin(spread)


def prediction_spread(scored: DataFrame, candidates: str = "candidates") -> DataFrame:
    """NDI / EPR and prediction-distribution statistics, one row (M5, M6).

    Prediction counts are per class (one row per predicted class); the set of
    classes seen among valid candidates is a distinct over classes.
    """
    total = scored.agg(F.count(F.lit(1)).alias("__total"))
    pred_counts = scored.groupBy(F.col("pred").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    seen = (scored.select(F.explode(_valid_cands(F.col(candidates))).alias("cls")).distinct()
            .withColumn("__seen", F.lit(1)))
    pc = pred_counts.join(seen, ["cls"], "full").crossJoin(F.broadcast(total))
    q = F.col("n") / F.col("__total")
    stats = pc.agg(
        F.count(F.col("n")).alias("pred_unique"),
        F.min_by(F.col("cls"), F.struct(-F.col("n"), F.col("cls"))).alias("top_pred"),
        (F.max("n") / F.first("__total")).alias("top_ratio"),
        F.sum(F.col("__seen")).alias("__k"),
        F.max(F.when(F.col("__seen") == 1, F.col("n"))).alias("__seen_max"),
        F.first("__total").alias("__total"),
        F.sum(F.when(F.col("n") > 0, -q * F.log(q))).alias("__entropy"))
    k = F.coalesce(F.col("__k"), F.lit(0)).cast("double")
    di = F.coalesce(F.col("__seen_max"), F.lit(0)) / F.col("__total")
    ndi = F.when(k > 1, (di - F.lit(1.0) / k) / (F.lit(1.0) - F.lit(1.0) / k)).otherwise(F.lit(0.0))
    epr = F.when(k > 0, F.exp(F.coalesce(F.col("__entropy"), F.lit(0.0))) / k).otherwise(F.lit(0.0))
    return stats.select(
        F.when(F.col("__total") > 0, ndi).otherwise(F.lit(0.0)).alias("ndi"),
        F.when(F.col("__total") > 0, epr).otherwise(F.lit(0.0)).alias("epr"),
        F.coalesce("pred_unique", F.lit(0)).cast("bigint").alias("pred_unique"),
        F.col("top_pred").cast("int").alias("top_pred"),
        F.coalesce("top_ratio", F.lit(0.0)).alias("top_ratio"),
        k.cast("bigint").alias("k_cand"))


# --------------------------------------------------------------------------- M7 / M8
def accuracy(df: DataFrame, pred: str = "pred", label: str = "label", ignore: int = -100) -> DataFrame:
    """Share of rows whose prediction equals the label (ignored labels skipped) (M7)."""
    v = df.filter(F.col(label).isNotNull() & (F.col(label) != F.lit(ignore)))
    return v.agg(F.coalesce(F.avg((F.col(pred) == F.col(label)).cast("double")), F.lit(0.0)).alias("accuracy"))


def confusion_counts(df: DataFrame, pred: str = "pred", label: str = "label", ignore: int = -100) -> DataFrame:
    """Per-class tp / fp / fn over classes present in truth or prediction."""
    v = df.filter(F.col(label).isNotNull() & (F.col(label) != F.lit(ignore)))
    t = v.select(F.col(label).cast("bigint").alias("cls"), (F.col(pred) == F.col(label)).cast("long").alias("tp"),
                 F.lit(0).cast("long").alias("fp"), (F.col(pred) != F.col(label)).cast("long").alias("fn"))
    p = v.filter(F.col(pred) != F.col(label)).select(
        F.col(pred).cast("bigint").alias("cls"), F.lit(0).cast("long").alias("tp"),
        F.lit(1).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn"))
    return t.unionByName(p).groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"),
                                                F.sum("fn").alias("fn"))


def macro_f1(df: DataFrame, pred: str = "pred", label: str = "label", ignore: int = -100) -> DataFrame:
    """Macro F1 over labels in truth or prediction; an undefined class F1 is 0 (M8)."""
    cm = confusion_counts(df, pred, label, ignore)
    denom = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    f1 = F.when(denom > 0, 2 * F.col("tp") / denom).otherwise(F.lit(0.0))
    return cm.agg(F.coalesce(F.avg(f1), F.lit(0.0)).alias("f1_macro"))


# --------------------------------------------------------------------------- M9 / M10
def _score_table(df: DataFrame, classes: Sequence[int], probs: str, label: str, ignore: int) -> DataFrame:
    """(cls, score, pos, neg) counts per distinct score; only class, score and label are exploded, not the array."""
    v = df.filter(F.col(label).isNotNull() & (F.col(label) != F.lit(ignore)))
    scored = F.array(*[F.struct(F.lit(int(c)).alias("cls"), F.element_at(probs, int(c) + 1).cast("double").alias("score"))
                       for c in classes])
    long = v.select(F.col(label).cast("int").alias("__y"), F.explode(scored).alias("__s"))
    long = long.select("__s.cls", "__s.score", (F.col("__y") == F.col("__s.cls")).cast("long").alias("__is_pos"))
    return long.groupBy("cls", "score").agg(F.sum("__is_pos").alias("pos"),
                                            F.sum(1 - F.col("__is_pos")).alias("neg"))


def roc_auc(df: DataFrame, classes: Sequence[int] = (0, 1, 2, 3), probs: str = "probs",
            label: str = "label", ignore: int = -100) -> DataFrame:
    """One-vs-rest ROC AUC per class, exact with half-counted ties (M9).

    AUC = sum over scores of pos(s) * (neg below s + neg(s) / 2) / (P * N).
    Returns one row per class with ``auc`` (NULL when the class has no
    positive or no negative) and ``auc_or_zero``.
    """
    t = _score_table(df, classes, probs, label, ignore)
    t = prefix_sums(t, ["cls"], ["score"], ["neg"], suffix="_below", inclusive=False)
    per = t.groupBy("cls").agg(
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)).alias("__u"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    auc = F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("__u") / (F.col("P") * F.col("N")))
    spark = df.sparkSession
    base = spark.createDataFrame([(int(c),) for c in classes], "cls int")
    return (base.join(per, ["cls"], "left")
            .select("cls", auc.alias("auc"), F.coalesce(auc, F.lit(0.0)).alias("auc_or_zero")))


def average_precision(df: DataFrame, classes: Sequence[int] = (0, 1, 2, 3), probs: str = "probs",
                      label: str = "label", ignore: int = -100) -> DataFrame:
    """One-vs-rest average precision per class: sum over thresholds of dRecall * Precision.

    Thresholds are the distinct scores in descending order; ``ap`` is NULL
    for a class without positives.
    """
    t = _score_table(df, classes, probs, label, ignore)
    t = prefix_sums(t, ["cls"], [F.col("score").desc()], ["pos", "neg"], suffix="_ge", inclusive=True)
    tot = t.groupBy("cls").agg(F.sum("pos").alias("P"))
    j = t.join(F.broadcast(tot), ["cls"])
    prec = F.col("pos_ge") / (F.col("pos_ge") + F.col("neg_ge"))
    per = j.groupBy("cls").agg(F.sum(F.col("pos") / F.col("P") * prec).alias("__ap"), F.first("P").alias("P"))
    spark = df.sparkSession
    base = spark.createDataFrame([(int(c),) for c in classes], "cls int")
    ap = F.when(F.col("P") > 0, F.col("__ap"))
    return base.join(per, ["cls"], "left").select("cls", ap.alias("ap"))


def macro_summary(per_class: DataFrame, col: str, out: str) -> DataFrame:
    """Mean over defined per-class values, 0 when none is defined."""
    return per_class.agg(F.coalesce(F.avg(col), F.lit(0.0)).alias(out))


# --------------------------------------------------------------------------- M11 / M12
def cross_entropy(df: DataFrame, logits: str = "logits", label: str = "label", ignore: int = -100) -> DataFrame:
    """Mean cross-entropy over rows whose label is not ``ignore``."""
    v = df.filter(F.col(label).isNotNull() & (F.col(label) != F.lit(ignore)))
    lsm = log_softmax(F.col(logits).cast("array<double>"))
    return v.agg(F.coalesce(F.avg(-F.element_at(lsm, F.col(label) + 1)), F.lit(0.0)).alias("ce_loss"))


def focal_loss(df: DataFrame, gamma: float = 2.0, weights: Mapping[int, float] | None = None,
               smoothing: float = 0.0, logits: str = "logits", label: str = "label",
               ignore: int = -100) -> DataFrame:
    """Mean focal loss (1 - p_t)^gamma * CE with optional class weight and smoothing.

    Rows labelled ``ignore`` contribute 0 and still count in the mean, as the
    reference's unreduced loss does.  With smoothing the target is
    ``(1 - s) * onehot + s / K``.
    """
    lg = F.col(logits).cast("array<double>")
    y = F.col(label)

    def target(lsm: Column) -> Column:
        return bound(F.size(lsm), lambda k: F.transform(
            lsm, lambda _x, i: F.when(i == y, F.lit(1.0 - smoothing)).otherwise(F.lit(0.0)) + F.lit(smoothing) / k))

    def row_loss(lsm: Column) -> Column:
        def of(pairs: Column) -> Column:
            ce = -F.aggregate(pairs, F.lit(0.0), lambda acc, s: acc + s["t"] * s["l"])
            pt = F.aggregate(pairs, F.lit(0.0), lambda acc, s: acc + s["t"] * F.exp(s["l"]))
            return F.pow(F.lit(1.0) - pt, F.lit(float(gamma))) * ce
        return bound(F.zip_with(target(lsm), lsm, lambda t, x: F.struct(t.alias("t"), x.alias("l"))), of)

    loss = bound(log_softmax(lg), row_loss)
    if weights:
        wmap = F.create_map(*[x for kv in sorted(weights.items()) for x in (F.lit(int(kv[0])), F.lit(float(kv[1])))])
        if smoothing:
            wsum = F.aggregate(target(lg), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("i")),
                               lambda acc, t: F.struct(
                                   (acc["s"] + t * F.coalesce(F.element_at(wmap, acc["i"]), F.lit(0.0))).alias("s"),
                                   (acc["i"] + 1).alias("i")))["s"]
            loss = loss * wsum
        else:
            loss = loss * F.coalesce(F.element_at(wmap, y.cast("int")), F.lit(1.0))
    valid = y.isNotNull() & (y != F.lit(ignore))
    return df.agg(F.coalesce(F.avg(F.when(valid, loss).otherwise(F.lit(0.0))), F.lit(0.0)).alias("focal_loss"))


# --------------------------------------------------------------------------- M13
def _psi(kind: str, u: Column) -> Column:
    if kind == "exponential":
        return F.exp(-u)
    if kind == "logistic":
        return F.greatest(-u, F.lit(0.0)) + F.log1p(F.exp(-F.abs(u)))  # no overflow for very negative u
    if kind == "hinge":
        return F.greatest(F.lit(1.0) - u, F.lit(0.0))
    raise ValueError(f"unknown loss kind {kind!r}")


def clpl_loss(df: DataFrame, kind: str = "logistic", clip: float | None = None,
              weights: Mapping[int, float] | None = None, logits: str = "logits",
              candidates: str = "candidates") -> DataFrame:
    """Mean partial-label loss psi(mean candidate logit) + sum psi(-other logit).

    Candidates are a set (duplicates count once).  ``clip`` clamps logits to
    [-clip, clip] first.  With ``weights`` each row is scaled by the mean
    weight of its candidate classes (1 when it has none).
    """
    lg = F.col(logits).cast("array<double>")
    if clip:
        lg = F.transform(lg, lambda x: F.least(F.greatest(x, F.lit(-float(clip))), F.lit(float(clip))))
    c = F.array_distinct(_valid_cands(F.col(candidates)))
    pairs = F.transform(lg, lambda x, i: F.struct(x.alias("x"), F.array_contains(c, i).alias("m"), i.alias("i")))
    n_c = F.size(c).cast("double")
    card = F.greatest(n_c, F.lit(1.0))
    cand_sum = F.aggregate(pairs, F.lit(0.0), lambda a, s: a + F.when(s["m"], s["x"]).otherwise(F.lit(0.0)))
    term1 = _psi(kind, cand_sum / card)
    term2 = F.aggregate(pairs, F.lit(0.0), lambda a, s: a + F.when(s["m"], F.lit(0.0)).otherwise(_psi(kind, -s["x"])))
    loss = term1 + term2
    if weights:
        wmap = F.create_map(*[x for kv in sorted(weights.items()) for x in (F.lit(int(kv[0])), F.lit(float(kv[1])))])
        wsum = F.aggregate(c, F.lit(0.0), lambda a, i: a + F.coalesce(F.element_at(wmap, i), F.lit(0.0)))
        loss = loss * F.when(n_c > 0, wsum / card).otherwise(F.lit(1.0))
    return df.agg(F.coalesce(F.avg(loss), F.lit(0.0)).alias("clpl_loss"))


# --------------------------------------------------------------------------- M14
def pseudo_labels(df: DataFrame, margin: float = 0.1, logits: str = "logits",
                  candidates: str = "candidates", ignored: Sequence[int] = ()) -> DataFrame:
    """Argmax among candidate logits, confident when top1 - top2 >= margin.

    Rows without a usable candidate are dropped; a single candidate has an
    infinite margin.  ``margin <= 0`` marks every row confident.
    """
    c = _valid_cands(F.col(candidates))
    if ignored:
        ign = F.array(*[F.lit(int(i)) for i in ignored])
        c = F.filter(c, lambda x: ~F.array_contains(ign, x))
    c = F.array_distinct(c)
    lg = F.col(logits).cast("array<double>")
    cl = F.transform(c, lambda i: F.struct((-F.element_at(lg, i + 1)).alias("neg"), i.alias("i")))
    srt = F.array_sort(cl)
    top1 = -F.element_at(srt, 1)["neg"]
    top2 = F.when(F.size(srt) > 1, -F.element_at(srt, 2)["neg"]).otherwise(F.lit(NEG_INF))
    conf = (top1 - top2 >= F.lit(float(margin))) if margin > 0 else F.lit(True)
    out = df.withColumn("__n", F.size(c)).filter(F.col("__n") > 0)
    return out.select("*", F.element_at(srt, 1)["i"].cast("int").alias("pseudo_label"),
                      conf.alias("confident")).drop("__n")


# --------------------------------------------------------------------------- M15
def best_run(metrics: DataFrame, metric: str, mode: str = "max", run: str = "run",
             value: str = "value", name: str = "name") -> DataFrame:
    """Run with the best value of ``metric`` (ties -> smallest run id)."""
    m = metrics.filter(F.col(name) == F.lit(metric))
    key = F.struct((-F.col(value)) if mode == "max" else F.col(value), F.col(run))
    return m.agg(F.min_by(F.col(run), key).alias("best_run"),
                 (F.max(value) if mode == "max" else F.min(value)).alias("best_value"))

