"""Guards on transformed text: signs of added content, and the least length of a second pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.fixed_values import FAKE_SECTIONS, MARKERS
from folioflow.functions.pytext import count_words, let

RATIO = 2.5
LEAST_SHARE = 0.5


def added_reason(source: Column, result: Column) -> Column:
    """Why a result is taken to hold added content; null if it isn't."""
    any_of = lambda marks: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(result, m))
    longer = let(count_words(source), lambda before: (before > 0) & (count_words(result) > before * RATIO))
    return F.when(any_of(MARKERS), "marker").when(any_of(FAKE_SECTIONS), "section").when(longer, "length")


def accept_fix(translated: Column, fixed: Column) -> Column:
    """The second pass, unless it lost over half of the first."""
    return F.when(F.length(fixed) < F.length(translated) * LEAST_SHARE, translated).otherwise(fixed)
