"""Containment joins of quotes and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grounding import squeezed, words
from ..functions.normalize import let
from .probe import small

_KEY = 3


def _run(w: Column, i: Column, n: int) -> Column:
    """A key of the ``n`` words from the ``i``-th on; behind the last word of fewer."""
    return F.xxhash64(*(F.get(w, i + k) for k in range(n)))


def _runs(w: Column, n: int) -> Column:
    return F.transform(w, lambda _, i: _run(w, i, n))


def _lengths(keyed: DataFrame) -> list[int]:
    """The numbers of words that the runs have: three at most."""
    return sorted(r[0] for r in keyed.select("n").distinct().collect()) or [_KEY]


def quotes_in_texts(quotes: DataFrame, texts: DataFrame, min_words: int = 3) -> DataFrame:
    """(quote_id, key) for each quote (quote_id, text) that stands in a text (key, text), both squeezed.

    A quote's words but the first and the last stand whole in any text that holds
    it.  So quotes and texts meet on the quote's second to fourth words, or on the
    words between its ends where it has fewer than five, and then are compared.
    Few quotes go to the texts, and nothing of a text is shuffled; many meet the
    texts' runs by a join, and what meets is compared after another by the text's
    key.  Quotes of one or two words, which ``min_words`` may let in, have no such
    run and are compared with every text.
    """
    q = quotes.select("quote_id", squeezed(F.col("text")).alias("quote"), words(F.col("text")).alias("w")).filter(F.size("w") >= min_words)
    n = F.least(F.lit(_KEY), F.size("w") - 2)
    run = F.when(n == 1, _run(F.col("w"), F.lit(1), 1)).when(n == 2, _run(F.col("w"), F.lit(1), 2)).otherwise(_run(F.col("w"), F.lit(1), 3))
    keyed = q.filter(F.size("w") > 2).select("quote_id", "quote", n.alias("n"), run.alias("run"))
    t = texts.select("key", squeezed(F.col("text")).alias("hay"))
    lengths = _lengths(keyed)
    # a text is cut into words once; all runs look into that array
    runs = let(F.split("hay", " "), lambda w: F.concat(*(_runs(w, k) for k in lengths)))
    every = F.explode(F.array_distinct(runs))
    if small(keyed):
        met = t.select("key", "hay", every.alias("run")).join(F.broadcast(keyed), "run")
    else:
        met = t.select("key", every.alias("run")).join(keyed, "run").join(t, "key")
    found = met.filter(F.contains("hay", F.col("quote"))).select("quote_id", "key")
    if min_words < 3:
        tiny = q.filter(F.size("w") <= 2)
        found = found.union(tiny.join(t, F.contains("hay", F.col("quote"))).select("quote_id", "key"))
    return found.distinct()
