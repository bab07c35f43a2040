"""Filling fixed-capacity containers: the linear grouping scheme, then best fit of what is small.

For each capacity: texts over it are cut into pieces of exactly the capacity and a rest, each full piece being
a container. Items over ``SMALL`` of the capacity are large. Only the histogram of their lengths, at most
``capacity`` numbers, reaches the driver: it is cut into ``GROUPS`` groups of equal cardinality, every length is
rounded up to its group's largest, and the few-size problem is solved by generating configurations (a linear
program over the sizes, priced by a knapsack). Each configuration's slots are then substituted by actual
documents: an item's number within its group says its slot, so the assignment is a join with the
configurations, not a search. What the containers have left, known only now, takes the small items by best
fit, in parts of about ``PART`` items with their share of the containers.

Null and empty texts have no tokens and are put nowhere. Repeated doc_ids count once. Null or non-positive
capacities are left out. Texts keep whole unless they exceed the capacity.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .tokens import TOKENIZERS, uniform, with_tokens

SMALL, GROUPS, PART, SALTS = 1 / 8, 40, 50_000, 16


def pieces(docs: DataFrame, specs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(spec_id, capacity, doc_id, piece, size): the texts, cut where they exceed the capacity."""
    sized = cut(with_tokens(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), ["doc_id"], folder).where("n_tokens > 0"))
    spec = specs.where("spec_id is not null and capacity_tokens > 0").groupBy("spec_id").agg(F.max("capacity_tokens").alias("capacity"))
    out = None
    for r in spec.collect():  # a handful of container sizes
        n = F.ceil(F.col("n_tokens") / r.capacity).cast("int")
        cutting = sized.select(
            F.lit(r.spec_id).cast("long").alias("spec_id"), F.lit(r.capacity).cast("int").alias("capacity"), "doc_id", "n_tokens", F.explode(F.sequence(F.lit(1), n)).alias("piece")
        )
        part = cutting.withColumn("size", F.least(F.lit(r.capacity), F.col("n_tokens") - (F.col("piece") - 1) * r.capacity).cast("int")).drop("n_tokens")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else sized.sparkSession.createDataFrame([], "spec_id long, capacity int, doc_id long, piece int, size int")


def grouped(lengths: np.ndarray, counts: np.ndarray, groups: int) -> list[tuple[int, int, int]]:
    """(smallest, largest length, items) of groups of equal cardinality; one length stays in one group."""
    edges = np.unique(np.searchsorted(np.cumsum(counts), np.arange(1, groups + 1) * counts.sum() / groups - 1e-9))
    edges[-1] = len(lengths) - 1
    starts = [0, *(edges[:-1] + 1)]
    return [(int(lengths[a]), int(lengths[b]), int(counts[a : b + 1].sum())) for a, b in zip(starts, edges)]


def _best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack over the sizes."""
    unit = max(1, int(sizes.min()) // 8)
    cells = capacity // unit
    steps = -(-sizes // unit)
    value, choice = np.zeros(cells + 1), np.full(cells + 1, -1)
    for c in range(1, cells + 1):
        value[c] = value[c - 1]
        gain = np.where(steps <= c, worth + value[np.maximum(c - steps, 0)], -1.0)
        k = int(gain.argmax())
        if gain[k] > value[c] + 1e-12:
            value[c], choice[c] = gain[k], k
    pattern, c = np.zeros(len(sizes), dtype=int), cells
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= int(steps[choice[c]])
    return value[cells], pattern


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 150) -> list[tuple[list[int], int]]:
    """(items of each size, containers): the linear program by column generation, rounded up and trimmed."""
    s, d = np.array(sizes), np.array(demand, dtype=float)
    k = len(s)
    basis = [np.eye(k, dtype=int)[i] * (capacity // s[i]) for i in range(k)]
    for _ in range(rounds):
        matrix = np.array(basis, dtype=float).T
        dual = np.linalg.solve(matrix.T, np.ones(k))
        gain, column = _best_pattern(s, dual, capacity)
        if gain <= 1 + 1e-7:
            break
        amount, direction = np.linalg.solve(matrix, d), np.linalg.solve(matrix, column.astype(float))
        ratio = np.where(direction > 1e-9, amount / np.where(direction > 1e-9, direction, 1), np.inf)
        if not np.isfinite(ratio.min()):
            break
        basis[int(ratio.argmin())] = column
    amount = np.linalg.solve(np.array(basis, dtype=float).T, d)
    plan, left = [], np.array(demand)
    for column, x in sorted(zip(basis, amount), key=lambda t: -t[1]):
        n = int(np.floor(x + 1e-9))
        n = min([n, *[int(left[i] // column[i]) for i in range(k) if column[i]]])
        if n > 0:
            plan.append((column.tolist(), n))
            left = left - n * column
    while left.sum() > 0:  # what rounding down left over: first fit, largest first, a few containers for each size
        room, column = capacity, np.zeros(k, dtype=int)
        for i in np.argsort(-s):
            take = int(min(left[i], room // s[i]))
            column[i], room = take, room - take * s[i]
        n = max(1, int(min(left[i] // column[i] for i in range(k) if column[i])))
        plan.append((column.tolist(), n))
        left = left - n * column
    return plan


def _numbered(items: DataFrame) -> DataFrame:
    """Adds ``slot``: the item's number within its group, from 0, counted in salted parts."""
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)))
    counts = salted.groupBy("group", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("group").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    here = F.row_number().over(Window.partitionBy("group", "salt").orderBy("doc_id", "piece")) - 1
    return salted.withColumn("here", here).join(F.broadcast(before), ["group", "salt"]).withColumn("slot", F.col("here") + F.col("before")).drop("here", "before", "salt")


def _substituted(large: DataFrame, capacity: int, first_bin: int) -> tuple[DataFrame, int]:
    """Containers of the large items (…, bin), and the next free number. Groups and configurations stay below GROUPS squared."""
    spark = large.sparkSession
    histogram = large.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy("size").toPandas()  # at most ``capacity`` rows
    if histogram.empty:
        return large.withColumn("bin", F.lit(0).cast("long")), first_bin
    groups = grouped(histogram["size"].to_numpy(), histogram["n"].to_numpy(), GROUPS)
    plan = configurations([g[1] for g in groups], [g[2] for g in groups], capacity)
    spans, offset, bin_at = [], [0] * len(groups), first_bin
    for column, n in plan:
        for g, each in enumerate(column):
            if each:
                spans.append((g, offset[g], offset[g] + each * n, each, bin_at))
                offset[g] += each * n
        bin_at += n
    span = spark.createDataFrame(spans, "`group` int, start long, stop long, each int, bin_at long")
    edge = spark.createDataFrame([(i, g[0], g[1]) for i, g in enumerate(groups)], "`group` int, low int, high int")
    item = _numbered(large.join(F.broadcast(edge), F.col("size").between(F.col("low"), F.col("high"))).drop("low", "high"))
    # one row for each group: its spans in order, so that an item looks up its own and is not copied for the others
    spans_of = span.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("start", "each", "bin_at"))).alias("spans"))
    placed = item.join(F.broadcast(spans_of), "group").withColumn("span", F.element_at("spans", F.size(F.filter("spans", lambda x: x["start"] <= F.col("slot")))))
    return placed.withColumn("bin", F.col("span.bin_at") + F.floor((F.col("slot") - F.col("span.start")) / F.col("span.each"))).select(*large.columns, "bin"), bin_at


def best_fit(rooms: list[tuple[int, int]], items: list[tuple], capacity: int) -> list[tuple]:
    """(bin or -1 - number of a new one) for items (size, …), largest first, each into the fullest container with room."""
    open_, out, new = sorted(rooms), [], 0
    for item in sorted(items, reverse=True):
        at = bisect_left(open_, (item[0], -(1 << 60)))
        if at < len(open_):
            room, where = open_.pop(at)
        else:
            new += 1
            room, where = capacity, -new
        out.append((*item, where))
        if room > item[0]:
            insort(open_, (room - item[0], where))
    return out


def _filler(capacity: int, parts: int, next_bin: int):
    """Best fit of one part: rows with a bin are rooms, the others items. New containers of part k get every parts-th number."""

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        room, text = pdf[pdf["bin"].notna()], pdf[pdf["bin"].isna()]
        items = zip(text["size"].astype(int), text["doc_id"].astype(int), text["piece"].astype(int))
        got = best_fit(list(zip(room["size"].astype(int), room["bin"].astype(int))), list(items), capacity)
        rows = [(d, p, z, w if w >= 0 else next_bin + (-w - 1) * parts + key[0]) for z, d, p, w in got]
        return pd.DataFrame(rows, columns=["doc_id", "piece", "size", "bin"])

    return fill


def assigned(docs: DataFrame, specs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(spec_id, doc_id, piece, n_tokens, bin): the container of every piece."""
    item = cut(pieces(docs, specs, folder))
    out = None
    for r in item.select("spec_id", "capacity").distinct().collect():  # a handful
        mine = item.where(F.col("spec_id") == r.spec_id).drop("capacity")
        threshold = max(1, int(r.capacity * SMALL))
        large, next_bin = _substituted(mine.where(F.col("size") > threshold), r.capacity, 0)
        large = cut(large)
        small = mine.where(F.col("size") <= threshold)
        parts = max(1, round(small.count() / PART), round(next_bin / PART))
        rooms = large.groupBy("bin").agg((F.lit(r.capacity) - F.sum("size")).cast("int").alias("size")).where("size > 0")
        part = F.floor(uniform("bin", 3) * parts).cast("int")
        both = small.select(F.floor(uniform("doc_id", 5) * parts).cast("int").alias("part"), "doc_id", "piece", "size", F.lit(None).cast("long").alias("bin")).unionByName(
            rooms.select(part.alias("part"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("piece"), "size", "bin")
        )
        fill = _filler(int(r.capacity), parts, next_bin)
        filled = both.groupBy("part").applyInPandas(fill, "doc_id long, piece int, size int, bin long")
        one = large.select("doc_id", "piece", "size", "bin").unionByName(filled).withColumn("spec_id", F.lit(r.spec_id).cast("long"))
        out = one if out is None else out.unionByName(one)
    columns = ["spec_id", "doc_id", "piece", F.col("size").alias("n_tokens"), "bin"]
    if out is None:
        return docs.sparkSession.createDataFrame([], "spec_id long, doc_id long, piece int, n_tokens int, bin long")
    return out.select(*columns)


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, capacity_tokens, items, tokens, bins, least_bins, fill): least_bins is tokens over capacity, rounded up."""
    one = packed.groupBy("spec_id").agg(F.count(F.lit(1)).alias("items"), F.sum("n_tokens").alias("tokens"), F.countDistinct("bin").alias("bins"))
    size = specs.where("capacity_tokens > 0").groupBy("spec_id").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    return one.join(F.broadcast(size), "spec_id").select(
        "spec_id", "capacity_tokens", "items", "tokens", "bins", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_bins"),
        F.round(F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")), 6).alias("fill"),
    )
