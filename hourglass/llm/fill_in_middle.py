"""Fill-in-middle transformation by repeated-capture matching.

A text is a row of units, a run of letters A-Z a-z or one other character.  One ``fullmatch`` of ``(unit)*`` by the
regex library keeps every repetition of the group: ``match.ends(1)`` is the list of all unit ends, its length is the
number of units and the two cuts are looked up in it.  No unit is visited in Python.

The captures take some hundred bytes a unit, so a text of over RUN characters is matched in runs of about that length,
which end where a unit does; the units are the same.

Draws, forms and the putting together are column expressions; only the match runs in Python, and only two offsets and
a count come back from it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourglass.llm.common import bounded_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100: draws from here on leave a text plain; below here the suffix goes first.
PLAIN_FROM, SUFFIX_FIRST_BELOW = 90, 20
#: Characters of a run.
RUN = 500_000

_UNITS = regex.compile(r"([A-Za-z]+|[^A-Za-z])*")
_OTHER = regex.compile(r"[^A-Za-z]")


def _runs(text: str, size: int = RUN) -> list[int]:
    """Where the runs of a text begin, and its end; a run begins at a character that is a unit of its own."""
    begins, at = [0], size
    while at < len(text) and (found := _OTHER.search(text, at)):
        begins.append(found.start())
        at = found.start() + size
    return [*begins, len(text)]


def cuts(text: str, one: int, two: int, size: int = RUN) -> tuple[int, int, int]:
    """The number n of units, and the places behind the smaller and the larger of one % (n + 1) and two % (n + 1) units."""
    begins = _runs(text, size)

    def ends(k: int) -> list[int]:
        return _UNITS.fullmatch(text, begins[k], begins[k + 1]).ends(1)

    held = ends(0)
    totals = list(accumulate([len(held), *(len(ends(k)) for k in range(1, len(begins) - 1))]))

    def place(units: int) -> int:
        if not units:
            return 0
        k = bisect_left(totals, units)
        return (ends(k) if k else held)[units - (totals[k - 1] if k else 0) - 1]

    n = totals[-1]
    first, second = sorted((one % (n + 1), two % (n + 1)))
    return n, place(first), place(second)


def _cut(texts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for text, one, two in texts:
        found = [cuts(t.as_py() or "", a, b) for t, a, b in zip(text, one.to_pylist(), two.to_pylist())]
        n, first, second = zip(*found) if found else ((), (), ())
        yield pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (n, first, second)], ["n", "first", "second"])


def draws(id_column: Column, seed: str = "1") -> list[Column]:
    """Four numbers below 2**32 of an id: the first digits of the sha256 of ``seed:id``; a null id draws as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1") -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output) of every row.

    ``n`` is the number of units of the whole text, ``form`` is plain, psm or spm and ``output`` the text in that form:
    as it is, ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, or ``<S>`` suffix ``<P>`` prefix ``<M>`` middle.  Texts that
    are empty or hold one of the marks stay plain, so every output can be taken apart again (:func:`restore`).

    A null text counts as empty; a null id is kept and draws as an empty one; repeated rows have the same draws and
    the same output; an empty table gives an empty result; other columns are not read, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    cut = F.arrow_udf(_cut, "struct<n:bigint,first:bigint,second:bigint>")
    text, at = F.col("text"), F.col("at")
    told = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    one, two, three, four = draws(F.col("id"), seed)
    plain = (text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | \
        F.contains(text, F.lit(MIDDLE)) | (three % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(four % 100 < SUFFIX_FIRST_BELOW, "spm").otherwise("psm")
    done = told.select("id", "text", form.alias("form"), cut(text, one, two).alias("at"))
    prefix = F.substr(text, F.lit(1), at.first.cast("int"))
    middle = F.substr(text, at.first.cast("int") + 1, (at.second - at.first).cast("int"))
    suffix = F.substr(text, at.second.cast("int") + 1)
    output = (F.when(F.col("form") == "plain", text)
              .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
              .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)))
    cut_up = F.col("form") != "plain"
    return done.select(F.col("id").alias(id_col), at.n.alias("n"), "form",
                       F.when(cut_up, at.first).alias("prefix_chars"),
                       F.when(cut_up, at.second - at.first).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of; null for a null output.

    The marks stand in no text that was cut, and none can arise across a seam, so the first place of the second and the third mark is theirs.
    """
    def behind(mark: str) -> Column:
        return F.locate(mark, output) + len(mark)

    def before(mark: str, start: Column) -> Column:
        return F.substr(output, start, F.locate(mark, output) - start)

    start = F.lit(1 + len(PREFIX))  # behind the first mark, of either form
    middle = F.substr(output, behind(MIDDLE))
    return (F.when(form == "plain", output)
            .when(form == "psm", F.concat(before(SUFFIX, start), middle, before(MIDDLE, behind(SUFFIX))))
            .otherwise(F.concat(before(MIDDLE, behind(PREFIX)), middle, before(PREFIX, start))))
