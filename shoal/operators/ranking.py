"""Top-k selection and diverse re-ranking."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.operators.scans import global_numbers
from shoal.session import materialized, python_partitions

#: Pairs of a block of best_similar, about, and rows it hands on at once.
PAIRS_HELD, ROWS_OUT = 2_000_000, 200_000


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows of each group with their rank from 1. The order must end in a unique key.

    Spark keeps at most k rows a group and task before the shuffle (window group limit), so a hot group stays small.
    """
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def exactly_k(df: DataFrame, key: str, condition: Column, order: list[Column], k: int, out: str = "selected") -> DataFrame:
    """Every row, with out = 1 for the first k rows that meet the condition (all, if fewer do)."""
    chosen = df.filter(condition).orderBy(*order, F.col(key)).limit(k).select(key, F.lit(1).alias(out))
    # k rows
    return df.join(F.broadcast(chosen), key, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def diverse_top_k(candidates: DataFrame, similar: DataFrame, request: str, item: str, k: int = 10, weight: float = 0.9) -> DataFrame:
    """(request, position, item): greedy picks by score - weight * (largest similarity to a pick so far).

    candidates: request, item, score, support; only positive scores compete, ties go to more support, then to the
    smaller item. similar: item_a, item_b, cosine in both directions; pairs left out count as 0. Requests with fewer
    than k candidates come out empty. Each pick depends on those before, so a request is one task; its candidates must be bounded (a short list).
    """
    c = candidates.filter((F.col("score") > 0) & F.col(request).isNotNull() & F.col(item).isNotNull()).select(request, item, "score", "support")
    near = (
        c.select(F.col(request), F.col(item).alias("item_a"))
        .join(similar.select("item_a", "item_b", "cosine"), "item_a")
        .join(c.select(F.col(request).alias("_r"), F.col(item).alias("_i")), (F.col(request) == F.col("_r")) & (F.col("item_b") == F.col("_i")))
        .select(F.col("_r").alias("r"), F.lit(1).alias("part"), F.col("item_a").alias("x"), F.col("item_b").alias("y"), F.col("cosine").cast("double").alias("v"), F.lit(0).cast("long").alias("n"))
    )
    own = c.select(F.col(request).alias("r"), F.lit(0).alias("part"), F.col(item).alias("x"), F.lit(None).cast(c.schema[item].dataType).alias("y"), F.col("score").cast("double").alias("v"), F.col("support").cast("long").alias("n"))
    req, it = c.schema[request].dataType.simpleString(), c.schema[item].dataType.simpleString()

    def pick(a: pd.DataFrame) -> list[tuple]:
        b = a[a["part"] == 1]
        a = a[a["part"] == 0].drop_duplicates("x").sort_values(["n", "x"], ascending=[False, True], kind="stable")
        if len(a) < k:
            return []
        r, names = a["r"].iloc[0], a["x"].tolist()
        at = {x: i for i, x in enumerate(names)}
        sim = np.zeros((len(names), len(names)))
        for x, y, v in zip(b["x"], b["y"], b["v"]):
            sim[at[x], at[y]] = v
        score, most, taken, out = a["v"].to_numpy(float), np.zeros(len(names)), np.zeros(len(names), bool), []
        for p in range(k):
            # rows are in tie order already, and argmax takes the first
            j = int(np.where(taken, -np.inf, score - weight * most).argmax())
            taken[j] = True
            most = np.maximum(most, sim[j])
            out.append((r, p + 1, names[j]))
        return out

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by request: one request at a time, whatever the batches."""
        columns, held, at = [request, "position", item], [], None
        for pdf in batches:
            rows = []
            r = pdf["r"].to_numpy()
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for a, b in zip([0, *cuts], [*cuts, len(pdf)]):
                if a == b:
                    continue
                if at is not None and r[a] != at:
                    rows += pick(pd.concat(held))
                    held = []
                at = r[a]
                held.append(pdf.iloc[a:b])
            yield pd.DataFrame(rows, columns=columns)
        if held:
            yield pd.DataFrame(pick(pd.concat(held)), columns=columns)

    return (
        own.unionByName(near)
        .repartition(python_partitions(candidates), "r")
        .sortWithinPartitions("r", "part")
        .mapInPandas(scan, f"{request} {req}, position int, {item} {it}")
    )


def diverse_by_history(history: DataFrame, similar: DataFrame, request: str, item: str, k: int = 10, weight: float = 0.9, tilt: float = 0.1) -> DataFrame:
    """(request, position, item): greedy picks as in diverse_top_k, out of all items that are similar to a request's history.

    history: request, item, w, an item once a request; its items aren't picked. similar: item_a, item_b, n_a, cosine in both
    directions. An item's score is the sum of w * cosine, times 1 + tilt * ln(1 + n); only positive scores compete, and
    requests with fewer than k such items come out empty. No item and no similarity is left out: requests are cut
    into blocks, and each block's task gets the rows of all similar pairs, so it holds one entry a pair of the catalog.
    """
    similar = materialized(similar.select("item_a", "item_b", "n_a", "cosine"), "similar")
    # numbered in the order of ties: more support first, then the smaller item
    ids = materialized(global_numbers(similar.select((-F.col("n_a")).alias("o"), F.col("item_a").alias("x")).distinct(), ["o", "x"]), "items")
    right = ids.select(F.col("x").alias("item_b"), F.col("n").cast("int").alias("b"))
    stripes = similar.join(right, "item_b").groupBy("item_a").agg(F.sort_array(F.collect_list(F.struct("b", "cosine"))).alias("s"))
    stripes = stripes.join(ids.withColumnRenamed("x", "item_a"), "item_a").select("n", F.col("item_a").alias("x"), (-F.col("o")).alias("support"), F.col("s")["b"].alias("b"), F.col("s")["cosine"].alias("cosine"))
    blocks = python_partitions(history)
    cells = stripes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    h = history.filter(F.col(request).isNotNull()).join(ids.select(F.col("x").alias(item), "n"), item)
    h = h.select(F.col(request).alias("r"), "n", F.col("w").cast("double").alias("w"), F.pmod(F.hash(request), F.lit(blocks)).alias("block"))
    req, it = history.schema[request].dataType.simpleString(), history.schema[item].dataType.simpleString()

    def pick(a: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        rows = []
        m = m.sort_values("n")
        at = {n: i for i, n in enumerate(m["n"])}
        number = np.fromiter(at, "int64", len(at))
        names, boost = m["x"].tolist(), 1 + tilt * np.log1p(m["support"].to_numpy(float))
        near, cosines = [np.searchsorted(number, b) for b in m["b"]], m["cosine"].tolist()
        for r, g in a.sort_values(["r", "n"]).groupby("r", sort=False):
            own, score = [at[n] for n in g["n"]], np.zeros(len(names))
            for i, w in zip(own, g["w"]):
                score[near[i]] += w * cosines[i]
            score = np.round(score * boost, 9)
            score[own] = 0
            if (score > 0).sum() < k:
                continue
            free, most = score > 0, np.zeros(len(names))
            for p in range(k):
                # items are in tie order already, and argmax takes the first
                j = int(np.where(free, score - weight * most, -np.inf).argmax())
                free[j] = False
                most[near[j]] = np.maximum(most[near[j]], cosines[j])
                rows.append((r, p + 1, names[j]))
        return pd.DataFrame(rows, columns=[request, "position", item])

    return h.groupBy("block").cogroup(cells.groupBy("block")).applyInPandas(pick, f"{request} {req}, position int, {item} {it}")


class _Block:
    """Pairs of one block of items: for each owned item, the places of items similar to it and the values."""

    def __init__(self, parts: list[pa.RecordBatch]):
        t = pa.Table.from_batches(parts)
        x, y = (t[c].combine_chunks().dictionary_encode() for c in "xy")
        self.owned, self.items = x.dictionary, y.dictionary
        a, b, v = x.indices.to_numpy(), y.indices.to_numpy(), t["v"].to_numpy()
        order = np.argsort(a, kind="stable")
        self.at, self.v = b[order], v[order]
        self.first = np.searchsorted(a[order], np.arange(len(self.owned) + 1))
        # a full grid is faster, where at least a quarter of it is taken
        self.grid = None
        if len(self.owned) * len(self.items) <= 4 * len(v):
            self.grid = np.full((len(self.owned), len(self.items)), -np.inf)
            self.grid[a, b] = v

    def _best(self, own: np.ndarray) -> np.ndarray:
        if self.grid is not None:
            return self.grid[own].max(axis=0)
        best = np.full(len(self.items), -np.inf)
        for k in own.tolist():
            at, v = self.at[self.first[k] : self.first[k + 1]], self.v[self.first[k] : self.first[k + 1]]
            best[at] = np.maximum(best[at], v)
        return best

    def rows(self, entities: pa.Array, lists: pa.Array, names: list[str]) -> Iterator[pa.RecordBatch]:
        own = pc.index_in(lists.flatten(), value_set=self.owned).fill_null(-1).to_numpy()
        ends = np.cumsum(lists.value_lengths().to_numpy())
        got: list[tuple[int, np.ndarray, np.ndarray]] = []

        def hand_on() -> pa.RecordBatch:
            who = np.repeat([i for i, _, _ in got], [len(hit) for _, hit, _ in got])
            hits, values = (np.concatenate([g[k] for g in got]) for k in (1, 2))
            got.clear()
            return pa.RecordBatch.from_arrays([entities.take(pa.array(who)), self.items.take(pa.array(hits)), pa.array(values)], names=names)

        held = 0
        for i, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends)):
            known = own[lo:hi][own[lo:hi] >= 0]
            if len(known):
                best = self._best(known)
                hit = np.flatnonzero(best > -np.inf)
                got.append((i, hit, best[hit]))
                held += len(hit)
            if held >= ROWS_OUT:
                yield hand_on()
                held = 0
        if got:
            yield hand_on()


def best_similar(owned: DataFrame, similar: DataFrame, entity: str, item: str, value: str, held: int = PAIRS_HELD) -> DataFrame:
    """(entity, item, value): of each entity and item, the largest value of a pair (owned item, item); no row without such a pair.

    owned: entity, item; repeats count once, nulls not at all. similar: item_a, item_b, value, each ordered pair once; nulls don't count.
    A join has a row for every item similar to every owned one. Here items are cut into blocks of some ``held`` pairs and entities into
    buckets; a task holds the pairs of one block and lets the lists of one bucket run past, so each result row is made once.
    Entities' lists are bounded by the number of items.
    """
    kind, unit = owned.schema[entity].dataType.simpleString(), similar.schema["item_a"].dataType.simpleString()
    pairs = similar.select(F.col("item_a").alias("x"), F.col("item_b").cast(unit).alias("y"), F.col(value).cast("double").alias("v")).dropna()
    lists = owned.select(F.col(entity).alias("e"), F.col(item).cast(unit).alias("i")).dropna().groupBy("e").agg(F.collect_set("i").alias("items"))
    pairs, lists = materialized(pairs, "pairs"), materialized(lists, "owned")
    n, entries, tasks = pairs.count(), lists.agg(F.sum(F.size("items"))).first()[0] or 0, python_partitions(owned)
    # pairs move once a bucket, lists once a block; a pair takes some four times the bytes of a list's entry
    buckets = min(tasks, max(1, round(sqrt(tasks * entries / (4 * max(n, 1))))))
    blocks = max(ceil(tasks / buckets), ceil(n / held))

    def numbers(k: int):
        return F.explode(F.sequence(F.lit(0), F.lit(k - 1)))

    def place(c: str, k: int):
        return F.pmod(F.xxhash64(c), F.lit(k)).cast("int")

    p = pairs.select(place("y", blocks).alias("block"), numbers(buckets).alias("bucket"), F.lit(0).alias("part"), "x", "y", "v")
    o = lists.select(numbers(blocks).alias("block"), place("e", buckets).alias("bucket"), F.lit(1).alias("part"), "e", "items")
    names = [entity, item, value]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The block's pairs, then the bucket's lists."""
        parts, block = [], None
        for rb in batches:
            k = int((rb.column("part").to_numpy() == 0).sum())
            if k:
                parts.append(rb.slice(0, k))
            if k < len(rb) and parts:
                block = block or _Block(parts)
                lists = rb.slice(k)
                yield from block.rows(lists.column("e"), lists.column("items"), names)

    return (
        p.unionByName(o, allowMissingColumns=True)
        .repartitionById(blocks * buckets, F.col("block") * buckets + F.col("bucket"))
        .sortWithinPartitions("part")
        .mapInArrow(scan, f"`{entity}` {kind}, `{item}` {unit}, `{value}` double")
    )
