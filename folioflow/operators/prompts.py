"""Prompts as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.fixed_values import ANSWER_LABEL, CONTEXT_LABEL, FIX_LABELS, SOURCE_LABEL, SYSTEM_PROMPT, TERM_FIX_PROMPT
from folioflow.functions.pytext import strip

CONTEXT_CHARS = 400
FIX_SOURCE_CHARS = 1200


def build_prompt(text: Column, previous: Column) -> Column:
    """The prompt for a text; ``previous`` is the output before it, or null."""
    context = F.concat(F.lit(CONTEXT_LABEL + "\n"), F.right(previous, F.lit(CONTEXT_CHARS)), F.lit("\n\n"))
    shown = F.when(F.length(strip(previous)) > 0, context).otherwise(F.lit(""))
    return F.concat(F.lit(SYSTEM_PROMPT + "\n\n"), shown, F.lit(SOURCE_LABEL + "\n"), text, F.lit("\n\n" + ANSWER_LABEL))


def fix_prompt(source: Column, translated: Column) -> Column:
    """The prompt of the second pass."""
    parts = [F.lit(TERM_FIX_PROMPT + "\n\n" + FIX_LABELS[0] + "\n"), F.substring(source, 1, FIX_SOURCE_CHARS), F.lit("\n\n" + FIX_LABELS[1] + "\n"), translated]
    return F.concat(*parts, F.lit("\n\n" + FIX_LABELS[2]))
