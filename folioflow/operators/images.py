"""Images go back between the paragraphs of a transformed text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.pytext import let, strip

GAP = "\n\n"


def interleave(text: Column, images: Column) -> Column:
    """``text`` with ``images`` (array of struct(frac, md)) after the paragraphs that stand where they stood."""
    m = F.size(images)

    def placed(paragraphs: Column) -> Column:
        worded = F.filter(F.transform(paragraphs, lambda p, i: F.when(strip(p) != "", i)), lambda i: i.isNotNull())

        def insert(w: Column) -> Column:
            n = F.size(w)
            slot = lambda x, i: F.when(m <= n, F.least(F.floor(x["frac"] * n).cast("int"), n - 1)).otherwise(F.floor(i * n / m).cast("int"))
            targets = F.transform(images, lambda x, i: F.struct(F.get(w, slot(x, i)).alias("at"), x["md"].alias("md")))
            whole = let(targets, lambda t: F.flatten(F.transform(paragraphs, lambda p, i: F.concat(F.array(p), F.transform(F.filter(t, lambda y: y["at"] == i), lambda y: y["md"])))))
            at_end = F.concat(text, F.lit(GAP), F.array_join(F.transform(images, lambda x: x["md"]), GAP))
            return F.when(n == 0, at_end).otherwise(F.array_join(whole, GAP))

        return let(worded, insert)

    return F.when(m > 0, let(F.split(text, GAP, -1), placed)).otherwise(text)
