"""What sources' descriptions say, learned from the sources whose data already tell.

Each source has a text (notes) and one of a few labels holds of it. For some sources the data decide the
label; these teach which words go with which label (naive Bayes over runs of up to four words, as shares
P(label | run) against the label's base rate). A lexicon gives every label a few words to begin with, worth
``SEED`` sources each; whatever the data say outgrows them.

Counts are sums by run of words, combined before the shuffle; the table of runs has one row a distinct run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.session import materialized

_WORD = re.compile(r"(?:[^\W_]|[/°])+")
RUN = 4
SEED = 50.0
SMOOTH = 2.0
#: Standard errors by which a run's share of a label must differ from the label's base rate to count.
SURE = 3.0


def runs_of_words(texts: DataFrame, source: str, text: str) -> DataFrame:
    """(source, gram): the distinct runs of 1 to RUN words of each source's text, in lower case; a null text has none.

    Written once, as the prior of every question put to the texts reads it.
    """
    kind = texts.schema[source].dataType.simpleString()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for key, t in zip(pdf["source"], pdf["text"]):
                w = _WORD.findall(t.lower())
                rows += [(key, g) for g in {" ".join(w[i : i + n]) for n in range(1, RUN + 1) for i in range(len(w) - n + 1)}]
            yield pd.DataFrame(rows, columns=["source", "gram"])

    picked = texts.select(F.col(source).alias("source"), F.col(text).alias("text")).filter("source IS NOT NULL AND text IS NOT NULL")
    return materialized(picked.mapInPandas(split, f"source {kind}, gram string").withColumnRenamed("source", source), "grams")


def wording_prior(
    texts: DataFrame, source: str, text: str, known: DataFrame, labels: Sequence[str], seeds: Mapping[str, Sequence[str]], grams: DataFrame | None = None
) -> DataFrame:
    """(source, prior): prior[i] is the probability of labels[i] by the source's text, for every source of ``texts``.

    grams: what ``runs_of_words`` made of the texts, where it is there already. known: (source, label) of the sources whose data decide; a null label teaches nothing. seeds: label -> words or
    runs of words. A text without any known word, or null, gives the labels' base rates. One row a source is expected.
    """
    grams = runs_of_words(texts, source, text) if grams is None else grams
    told = known.filter(F.col("label").isNotNull()).select(source, "label")
    hits = [F.count(F.when(F.col("label") == x, 1)).cast("double") for x in labels]
    base = told.agg(*[(h + 1.0).alias(f"b{i}") for i, h in enumerate(hits)])
    seeded = [F.when(F.col("gram").isin(list(seeds.get(x, ()))), SEED).otherwise(0.0) for x in labels]
    # one row
    c = grams.join(told, source, "left").groupBy("gram").agg(*[h.alias(f"c{i}") for i, h in enumerate(hits)]).crossJoin(F.broadcast(base))
    rate = [F.col(f"b{i}") / sum(F.col(f"b{k}") for k in range(len(labels))) for i in range(len(labels))]
    got = [F.col(f"c{i}") + s + SMOOTH * r for i, (s, r) in enumerate(zip(seeded, rate))]
    whole = sum(got[1:], got[0])
    n = sum((F.col(f"c{i}") for i in range(1, len(labels))), F.col("c0"))
    # long sentences hold many runs that go with a label by chance alone
    sure = F.greatest(F.lit(0.0), *[F.abs(F.col(f"c{i}") - n * r) / F.sqrt(n * r * (1 - r) + 1e-9) for i, r in enumerate(rate)]) > SURE
    sure = sure | (F.greatest(F.lit(0.0), *seeded) > 0)
    votes = c.filter(sure).select("gram", *[F.ln(g / whole / r).alias(f"v{i}") for i, (g, r) in enumerate(zip(got, rate))])
    sums = grams.join(votes, "gram").groupBy(source).agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(len(labels))])
    every = texts.select(source).join(sums, source, "left").crossJoin(F.broadcast(base))
    score = [F.coalesce(F.col(f"v{i}"), F.lit(0.0)) + F.ln(r) for i, r in enumerate(rate)]
    top = F.greatest(*score) if len(score) > 1 else score[0]
    e = [F.exp(s - top) for s in score]
    return every.select(source, F.array(*[x / sum(e[1:], e[0]) for x in e]).alias("prior"))
