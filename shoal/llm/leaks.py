"""Evaluation texts that leaked into the corpus, found with a distributed positional inverted index.

``build_index`` makes, once for a corpus and for any items, a table of posting lists: (term, shard, places). A shard is
what one task indexed of the documents before it handed its lists on; a place is a document's number in its shard and a position
in its text, in one number. Lists are partitioned by the hash of their term; long lists of frequent terms are spread by shard
besides, so no term is a hot key. One row a shard (term null) has the ids of its documents.

A search takes, of every stretch of ``words`` consecutive words of an item, its rarest terms by the index's own counts. The
list of the rarest gives candidate places; the lists of the next rarer ones, shifted by their offsets, are intersected with it,
shard by shard. What is left is compared word by word with the text itself. Proximity search takes a stretch's rarest terms and
asks for most of them close together, in any order.

Items are a DataFrame like the corpus; nothing of either reaches the driver.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.session import materialized, python_partitions

#: Words are runs of letters and digits.
WORD = re.compile(r"[^\W_]+")
#: Postings a task holds before it hands a shard on.
HOLD = 4_000_000
#: Lists longer than this are spread by shard besides their term.
LONG = 4_096
#: A place is document number * PLACE + position.
PLACE = 1 << 31
#: Lists that are intersected before the texts are compared.
PROBES = 3


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The corpus as posting lists (term, shard, n, places) and, of every shard, a row with term null and its documents' ``ids``.

    Texts are indexed whole; null and empty ones have no words and are in no list. Rows with a null id are left out.
    The table is written to the shared folder and read back, so that any number of searches use it.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    columns = ["term", "shard", "n", "places", "ids"]

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held = TaskContext.get().partitionId() << 24, 0
        lists: dict[str, array] = defaultdict(lambda: array("q"))
        ids: list = []

        def hand_on() -> Iterator[pd.DataFrame]:
            yield pd.DataFrame([(None, shard, len(ids), None, ids)], columns=columns)
            terms = list(lists)
            for i in range(0, len(terms), 20_000):
                part = terms[i : i + 20_000]
                got = [np.frombuffer(lists[t], "int64") for t in part]
                yield pd.DataFrame({"term": part, "shard": shard, "n": [len(g) for g in got], "places": got, "ids": [None] * len(part)})

        for pdf in batches:
            for d, t in zip(pdf["doc_id"].tolist(), pdf["text"]):
                found = words_of(t)
                if not found:
                    continue
                for at, w in enumerate(found, len(ids) * PLACE):
                    lists[w].append(at)
                ids.append(d)
                held += len(found)
                if held >= HOLD:
                    yield from hand_on()
                    shard, held, ids = shard + 1, 0, []
                    lists.clear()
        if ids:
            yield from hand_on()

    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = picked.mapInPandas(index, f"term string, shard long, n int, places array<bigint>, ids array<{kind}>")
    spread = F.when(F.col("term").isNull() | (F.col("n") > LONG), F.col("shard")).otherwise(-1)
    rows = rows.repartition(python_partitions(docs), "term", spread).sortWithinPartitions("term", "shard")
    return materialized(rows, "index")


def _item_words(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, words) of each item; items without id or words are left out."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"item_id": pdf["item_id"], "words": [words_of(t) for t in pdf["text"]]})

    picked = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    return picked.mapInPandas(split, "item_id string, words array<string>").filter(F.size("words") > 0).distinct()


def _counted(words: DataFrame, index: DataFrame) -> DataFrame:
    """(item_id, w): the item's words in order as (count in the corpus, word, position); 0 for words the corpus lacks."""
    every = words.select("item_id", F.xxhash64("words").alias("copy"), F.posexplode("words").alias("at", "term"))
    counts = index.filter("term IS NOT NULL").select("term", "n").join(every.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("c"))
    # an item's own words: as long as its text
    one = F.struct("at", F.coalesce("c", F.lit(0)).alias("c"), "term")
    return every.join(counts, "term", "left").groupBy("item_id", "copy").agg(F.array_sort(F.collect_list(one)).alias("w")).drop("copy")


def _lists(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(t, shard, l): the posting lists of some terms. terms come from a written table, so the optimizer knows whether they can be broadcast."""
    return index.filter("term IS NOT NULL").select(F.col("term").alias("t"), "shard", F.col("places").alias("l")).join(terms.distinct(), "t", "left_semi")


def phrase_plans(counted: DataFrame, words: int) -> DataFrame:
    """(item_id, t0, a0, t1, a1, ...): the rarest terms of every stretch of ``words`` words, and their places in the item.

    Stretches with the same rarest terms are one plan; one with a word that the corpus lacks has none.
    """
    probes = min(PROBES, words)

    def rarest(i: Column) -> Column:
        return F.slice(F.array_sort(F.transform(F.slice("w", i + 1, words), lambda x: F.struct(x["c"].alias("c"), x["term"].alias("term"), x["at"].alias("at")))), 1, probes)

    starts = F.sequence(F.lit(0), F.size("w") - words)
    found = F.array_distinct(F.filter(F.transform(starts, rarest), lambda r: r[0]["c"] > 0))
    plans = counted.filter(F.size("w") >= words).select("item_id", F.explode(found).alias("r"))
    return plans.select("item_id", *[x for k in range(probes) for x in (F.col("r")[k]["term"].alias(f"t{k}"), F.col("r")[k]["at"].alias(f"a{k}"))]).distinct()


def leaked_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = 12, index: DataFrame | None = None
) -> DataFrame:
    """(doc_id, item_id) of each document and item sharing ``words`` or more consecutive words.

    Letter case and all between words is ignored. Items of fewer words, null or empty texts, and rows with a null id match
    nothing. index: what ``build_index`` made of docs, where it is there already.
    """
    index = build_index(docs, doc_id, text) if index is None else index
    split = materialized(_item_words(items, item_id, item_text), "items")
    plans = materialized(phrase_plans(_counted(split, index), words), "plans")
    hits = plans.join(_lists(index, plans.select(F.col("t0").alias("t"))).select(F.col("t").alias("t0"), "shard", F.col("l").alias("hit")), "t0")
    for k in range(1, min(PROBES, words)):
        lists = _lists(index, plans.select(F.col(f"t{k}").alias("t"))).select(F.col("t").alias(f"t{k}"), "shard", "l")
        back = F.transform("l", _shifted(F.col(f"a{k}") - F.col("a0")))
        hits = hits.join(lists, [f"t{k}", "shard"]).withColumn("hit", F.array_intersect("hit", back)).drop("l").filter(F.size("hit") > 0)
    hits = hits.select("item_id", "shard", "a0", F.explode("hit").alias("hit"))
    ids = index.filter("term IS NULL").select("shard", F.posexplode("ids").alias("doc", "id"))
    found = hits.withColumn("doc", F.shiftright("hit", 31).cast("int")).join(ids, ["shard", "doc"])
    at = (F.col("hit").bitwiseAND(F.lit(PLACE - 1)) - F.col("a0")).cast("int")
    # a document's own places: as many as it has words
    cases = found.groupBy("id", "item_id").agg(F.collect_set(at).alias("starts"))
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    checked = texts.join(cases, "id").join(split, "item_id")
    kind = docs.schema[doc_id].dataType.simpleString()

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, have = None, []
        for pdf in batches:
            keep = []
            for t, item, starts in zip(pdf["text"], pdf["words"], pdf["starts"]):
                if t is not last:
                    last, have = t, words_of(t)
                keep.append(any(_run(have, item, int(s), words) for s in starts))
            yield pdf.loc[keep, ["id", "item_id"]]

    out = checked.select("id", "item_id", "text", "words", "starts").mapInPandas(check, f"id {kind}, item_id string")
    return out.select(F.col("id").alias(doc_id), "item_id").distinct()


def _shifted(by: Column):
    return lambda x: x - by


def _run(doc: list[str], item: list[str], start: int, words: int) -> bool:
    """Whether ``words`` words in a row agree when the item is laid over the document from ``start`` on."""
    run = 0
    for i in range(max(0, -start), min(len(item), len(doc) - start)):
        run = run + 1 if doc[start + i] == item[i] else 0
        if run >= words:
            return True
    return False


def _closest(lists: list[np.ndarray], need: int, span: int) -> dict[int, int]:
    """Document number -> least width of a stretch with ``need`` of the terms, where it is ``span`` or less."""
    docs = [np.unique(x // PLACE) for x in lists]
    number, times = np.unique(np.concatenate(docs), return_counts=True)
    wanted = number[times >= need]
    if not len(wanted):
        return {}
    place = np.concatenate(lists)
    term = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    ok = np.isin(place // PLACE, wanted)
    order = np.argsort(place[ok], kind="stable")
    out: dict[int, int] = {}
    at, last = None, {}
    for p, t in zip(place[ok][order].tolist(), term[ok][order].tolist()):
        d, pos = divmod(p, PLACE)
        if d != at:
            at, last = d, {}
        last[t] = pos
        if len(last) >= need:
            w = pos - sorted(last.values())[-need] + 1
            if w <= span and w < out.get(d, span + 1):
                out[d] = w
    return out


def near_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", rare: int = 6, span: int = 60, need: int | None = None, stretch: int | None = None, index: DataFrame | None = None
) -> DataFrame:
    """(doc_id, item_id, width): looser than leaked_items, a stretch's rarest terms close together in any order.

    Of every ``stretch`` words of an item, each half over the one before (the whole item, where it is None or the item is no longer),
    the ``rare`` rarest terms are taken, all where there are fewer; words the corpus lacks are the rarest. A
    document matches where ``need`` of them (all by default; all, where a stretch has fewer) lie within ``span`` words. width is the
    least such width. An item of one word matches wherever the word is met.
    """
    index = build_index(docs, doc_id, text) if index is None else index
    counted = _counted(materialized(_item_words(items, "item_id", "text"), "items"), index)
    if stretch is None:
        parts = counted.select("item_id", F.lit(0).alias("part"), "w")
    else:
        half = max(1, stretch // 2)
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - half - 1), F.lit(half))
        parts = counted.select("item_id", "w", F.explode(starts).alias("part")).withColumn("w", F.slice("w", F.col("part") + 1, stretch))
    terms = F.slice(F.array_sort(F.array_distinct(F.transform("w", lambda x: F.struct(x["c"].alias("c"), x["term"].alias("term"))))), 1, rare)
    plans = parts.select("item_id", "part", terms.alias("terms")).withColumn("need", F.least(F.size("terms"), F.lit(need or rare)))
    plans = plans.select("item_id", "part", "need", F.explode("terms").alias("x")).select("item_id", "part", "need", F.col("x")["term"].alias("t"))
    plans = materialized(plans, "plans")
    hits = plans.join(_lists(index, plans.select("t")), "t").groupBy("item_id", "part", "need", "shard").agg(F.collect_list("l").alias("lists"))
    hits = hits.filter(F.size("lists") >= F.col("need"))

    def closest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for item, need_, shard, lists in zip(pdf["item_id"], pdf["need"], pdf["shard"], pdf["lists"]):
                rows += [(item, shard, d, w) for d, w in _closest([np.asarray(x) for x in lists], int(need_), span).items()]
            yield pd.DataFrame(rows, columns=["item_id", "shard", "doc", "width"])

    near = hits.select("item_id", "need", "shard", "lists").mapInPandas(closest, "item_id string, shard long, doc int, width int")
    near = near.groupBy("item_id", "shard", "doc").agg(F.min("width").alias("width"))
    ids = index.filter("term IS NULL").select("shard", F.posexplode("ids").alias("doc", "id"))
    return near.join(ids, ["shard", "doc"]).groupBy(F.col("id").alias(doc_id), "item_id").agg(F.min("width").alias("width"))
