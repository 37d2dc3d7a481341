"""Quality rules whose cutoffs are chosen under a risk bound on labelled holdouts.

Every document gets rule scores in [0, 1], higher being worse.  For a rule and a stratum
(language) the cutoffs of a fixed grid are tried on the labelled documents: cutoff c rejects k of
the n good ones.  c is admissible if the exact (Clopper-Pearson) upper bound on the true rate of
false rejection is at most ``alpha`` per rule, at a confidence corrected for all
strata x rules x cutoffs tried (Bonferroni).  That bound is at most alpha exactly if a
Binomial(n, alpha) variable is at most k with probability at most delta / tests, which is what is
evaluated.  The bounds hold for all cutoffs at once, so any admissible one may be picked: the one
with the largest excess of rejected bad over rejected good labels, the most lenient on ties.  A
rule without an admissible cutoff that gains anything rejects nothing in that stratum.  The false
rejections of all rules together are then at most ``ALPHA`` per stratum, with probability
1 - ``DELTA``.

Everything here is DataFrame functions; texts are read once and only counts leave that scan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourglass.llm.common import bind, stored
from hourglass.operators.joins import broadcast_if_small

#: Rules with their scores, from the counts of ``features``.
RULES = ("symbols", "capitals", "shouts", "repeated_lines", "repeated_words")
#: Bound on falsely rejected good documents by stratum, all rules together, and its risk.
ALPHA, DELTA = 0.05, 0.05
#: Cutoffs tried: a document is rejected if its score is over i / GRID, for i = 0 .. GRID - 1.
GRID = 20
WINDOW = 5
#: Stratum of the documents without a language; every other language is a stratum.
OTHER = "*"

_SPACE = r"[\x20\x09-\x0D]"
_NOT_SPACE = r"[^\x20\x09-\x0D]"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _repeat_words(words: Column) -> Column:
    """Words covered by a five-word window that occurs twice or more in the array."""
    def covered(hashes: Column) -> Column:
        def spread(sorted_pairs: Column) -> Column:
            again = F.filter(sorted_pairs, lambda p, i: F.coalesce(
                (p.h == F.get(sorted_pairs, i - 1).h), F.lit(False)) | F.coalesce(
                (p.h == F.get(sorted_pairs, i + 1).h), F.lit(False)))
            # each repeated window covers the words up to the next one, five at most
            return bind(F.sort_array(F.transform(again, lambda p: p.i)), lambda at: F.aggregate(
                F.transform(at, lambda x, i: F.coalesce(F.least(F.get(at, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
                F.lit(0), lambda a, x: a + x))
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return (F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0)
                .otherwise(bind(pairs, spread)))
    windows = bind(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(
        F.sequence(F.lit(0), F.size(h) - WINDOW),
        lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))
    return F.when(F.size(words) < WINDOW, 0).otherwise(bind(windows, covered))


def features(text: Column) -> Column:
    """The counts of one text as a struct of longs (null text: all zero).

    Windows of words are compared by 64-bit hashes within their own text.
    """
    def of_words(t: Column, words: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(_NOT_SPACE))
        return bind(lines, lambda ls: F.struct(*[c.cast("long").alias(n) for n, c in {
            "n_words": F.size(words),
            "word_chars": F.length(t) - _count(t, _SPACE),
            "n_symbols": _count(t, "[#*$%&|<>]"),
            "n_dup_lines": F.size(ls) - F.size(F.array_distinct(ls)),
            "n_repeat_words": _repeat_words(words),
            "n_lines": F.size(ls),
            "n_capitals": _count(t, "[A-Z]"),
            "n_shouts": _count(t, "!"),
        }.items()]))
    return bind(F.coalesce(text, F.lit("")), lambda t: bind(
        F.array_remove(F.split(t, _SPACE + "+"), ""), lambda w: of_words(t, w)))


def levels(q: Column) -> dict[str, Column]:
    """For each rule the number of cutoffs, 0 to GRID, that the document's score exceeds."""
    def level(part: Column, whole: Column) -> Column:
        score = F.when(whole > 0, F.least(part / whole, F.lit(1.0))).otherwise(0.0)
        return F.ceil(score * GRID).cast("int")
    return dict(zip(RULES, (level(q.n_symbols, q.word_chars), level(q.n_capitals, q.word_chars),
                            level(q.n_shouts, q.n_words), level(q.n_dup_lines, q.n_lines),
                            level(q.n_repeat_words, q.n_words))))


def _log_gamma(x: Column) -> Column:
    """log of the gamma function for x >= 1, by Stirling's series eight steps further on."""
    y = x + 8.0
    ahead = sum((F.log(x + float(i)) for i in range(1, 8)), F.log(x))
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5)))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - ahead


def _log_binomial_cdf(n: Column, k: Column, p: float) -> Column:
    """log P[Binomial(n, p) <= k] for k < n p: the term at k, and those below it as multiples of it.

    The terms fall from k down, and those more than 40 + 12 standard deviations below are too small to change
    a double, so a sum takes about sqrt(n) steps, however many labels there are.
    """
    n, k = n.cast("double"), k.cast("double")
    first = _log_gamma(n + 1.0) - _log_gamma(k + 1.0) - _log_gamma(n - k + 1.0) + k * math.log(p) + (n - k) * math.log1p(-p)
    steps = F.least(k, F.ceil(40.0 + 12.0 * F.sqrt(n * (p * (1 - p))))).cast("int")

    def step(s: Column, j: Column) -> Column:
        i = k - j + 1.0  # from the term at i to the one at i - 1
        term = s.term * (i / (n - i + 1.0) * ((1 - p) / p))
        return F.struct(term.alias("term"), (s.total + term).alias("total"))

    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    below = F.when(steps < 1, F.lit(1.0)).otherwise(F.aggregate(
        F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), one, step, lambda s: s.total))
    return first + F.log(below)


def learn_cutoffs(scored: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, one cutoff level per rule or null): a row per language with a cutoff that pays.

    ``scored``: id, lang and the level columns of RULES; ``labels``: id, quality (1 good, 0 bad,
    null or anything else ignored; of repeated labels of an id the smallest counts).
    """
    label = labels.where("quality IN (0, 1)").groupBy("id").agg(F.min("quality").alias("quality"))
    held = scored.join(label, "id").select(
        F.coalesce("lang", F.lit(OTHER)).alias("stratum"), F.col("quality").cast("long").alias("good"),
        F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("level")) for r in RULES])).alias("r"))
    counts = stored(held.groupBy("stratum", "r.rule", "r.level").agg(  # at most languages x rules x (GRID + 1) rows
        F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")), "quality-counts")
    total = counts.where(F.col("rule") == RULES[0]).groupBy("stratum").agg(F.sum("good").alias("n"))
    tests = total.agg((F.count("*") * (len(RULES) * GRID)).alias("tests"))
    total = stored(total.crossJoin(F.broadcast(tests)), "quality-strata")
    # a document at level v is rejected by the cutoffs 0 .. v - 1
    tried = (counts.where("level > 0")
             .select("stratum", "rule", "good", "bad", F.explode(F.sequence(F.lit(0), F.col("level") - 1)).alias("cutoff"))
             .groupBy("stratum", "rule", "cutoff").agg(F.sum("good").alias("k"), F.sum("bad").alias("bad"))
             .join(broadcast_if_small(total), "stratum"))
    risk = alpha / len(RULES)
    few = F.col("k") < F.col("n") * risk
    ok = few & (F.when(few, _log_binomial_cdf(F.col("n"), F.col("k"), risk))
                <= F.lit(math.log(delta)) - F.log(F.col("tests").cast("double")))
    best = (tried.where(ok & (F.col("bad") > F.col("k"))).groupBy("stratum", "rule")
            .agg(F.max(F.struct(F.col("bad") - F.col("k"), F.col("cutoff"))).getField("cutoff").alias("cutoff")))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"__cut_{r}") for r in RULES])


def _decide(df: DataFrame, q: Column, lang: Column, cutoffs: DataFrame) -> DataFrame:
    """``df`` with __base and __kept; ``cutoffs`` is broadcast while it is small."""
    cut = broadcast_if_small(cutoffs.withColumnRenamed("stratum", "__stratum"))
    df = df.join(cut, F.coalesce(lang, F.lit(OTHER)) == F.col("__stratum"), "left")
    rejected = F.lit(False)
    for r, level in levels(q).items():
        rejected = rejected | F.coalesce(level > F.col(f"__cut_{r}"), F.lit(False))
    base = (q.n_words < 10) | (100 * q.n_repeat_words > 20 * q.n_words)
    return df.withColumn("__base", base).withColumn("__kept", ~base & ~rejected)


def _cutoffs(scored: DataFrame, labels: DataFrame, id_col: str, alpha: float, delta: float) -> DataFrame:
    flat = scored.select("id", "lang", *[c.alias(r) for r, c in levels(F.col("q")).items()])
    cuts = learn_cutoffs(flat, labels.select(F.col(id_col).alias("id"), "quality"), alpha, delta)
    return stored(cuts.coalesce(1), "quality-cutoffs")


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           lang_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    One row per row of ``docs``: null and empty texts have zero counts and fail the base rule;
    repeated rows and ids are judged one by one; documents without a language are a stratum of their own;
    in a language without labels, or with too few to bound the risk, only the base rule rejects; an empty
    table gives an empty result; other columns are not read.
    """
    q = features(F.col(text_col))
    scored = stored(docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), q.alias("q")), "quality")
    df = _decide(scored, F.col("q"), F.col("lang"), _cutoffs(scored, labels, id_col, alpha, delta))
    return df.select(F.col("id").alias(id_col), "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines",
                     "q.n_repeat_words", F.col("__base").alias("base_failed"), F.col("__kept").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              lang_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, with their columns, whatever their names.

    Null and empty texts go (the base rule); repeated rows stay or go together; an empty table stays
    empty.  The rows are written once with their counts, so no text is counted twice.
    """
    counted = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"),
                                 F.col(lang_col).alias("lang"), features(F.col(text_col)).alias("q")), "quality-rows")
    cuts = _cutoffs(counted, labels, id_col, alpha, delta)
    return _decide(counted, F.col("q"), F.col("lang"), cuts).where("__kept").select("row.*")
