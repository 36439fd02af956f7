"""Most similar vectors for every vector: an inverted multi-index.

Vectors are cut into two halves, each quantised with its own codebook, so that K centroids a half
make K * K cells. A query traverses the pairs of centroids in the order of their summed distance
with a heap; the entries of the cells it visits, and no others, are reranked by their exact
cosine. Cells are stored in groups of neighbouring first-half lists, and a query's vector travels
once to each group in which it visits a cell. Exact copies are one entry with its members, so that
no cell fills with them.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.operators.skew import join_on_skewed
from codeweft.session import Scratch

DIM = 64
#: Neighbours per vector, and the cosine below which two vectors are not neighbours.
NEIGHBOURS, LEAST = 5, 0.82
#: Entries a cell holds on average: K = sqrt(n / PER_CELL) centroids a half for n vectors of a model.
PER_CELL = 16
#: Cells a query visits. Without a floor neighbours are far and may lie in any cell: a query then visits FAR of all cells.
CELLS, FAR = 96, 0.7
#: Rows per model on which the codebooks are trained (in expectation): the greater of SAMPLE and SAMPLE_PER_CENTROID * K.
SAMPLE, SAMPLE_PER_CENTROID, ROUNDS = 20_000, 32, 10
#: Entries of a group and queries that one task compares at a time.
ENTRY_BLOCK, QUERY_BLOCK = 32_768, 32_768
#: Queries compared at once, so that scores and cells of no more are in memory.
NEAR_CHUNK, FAR_CHUNK = 8_192, 128


def parse_vector(text: str | None) -> np.ndarray | None:
    """A usable vector as unit float64 array: DIM finite numbers that are not all zero; else None."""
    try:
        a = np.array(json.loads(text), dtype=np.float64)
    except (TypeError, ValueError, OverflowError):
        return None
    if a.shape != (DIM,) or not np.isfinite(a).all():
        return None
    top = np.abs(a).max()
    if not top:
        return None
    a = a / top
    return a / np.linalg.norm(a)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for node, model, text in zip(pdf["node_id"], pdf["model"], pdf["vector_json"]):
            a = parse_vector(text)
            if a is not None:
                out.append((node, model, a.astype(np.float32).tobytes()))
        yield pd.DataFrame(out, columns=["node_id", "model", "vec"])


def current_vectors(vectors: DataFrame) -> DataFrame:
    """Usable current vectors: node_id, model, vec (float32 bytes of unit length).

    The row of a node with the highest generation counts, also when it is unusable; of rows of one
    generation the greatest. Rows without node or generation are left out; a null model is one.
    """
    row = F.struct("generation_id", F.coalesce("vector_json", F.lit("")).alias("vector_json"), F.coalesce("model", F.lit("")).alias("model"))
    last = vectors.where("node_id is not null and generation_id is not null").groupBy("node_id").agg(F.max(row).alias("r"))
    return last.select("node_id", "r.model", "r.vector_json").mapInPandas(_parse, "node_id string, model string, vec binary")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(len(column), DIM)


def train(sample: pd.DataFrame) -> pd.DataFrame:
    """Codebooks of one model: k-means on each half of the sampled vectors, centroids in the order of their main axis."""
    x = _matrix(sample["vec"])
    k = min(int(sample["k"].iloc[0]), len(x))
    books = []
    for half in (x[:, : DIM // 2], x[:, DIM // 2 :]):
        order = np.lexsort(half.T[:4])
        centroids = half[order[np.linspace(0, len(x) - 1, k).astype(int)]].copy()
        for _ in range(ROUNDS):
            nearest = distances(half, centroids).argmin(1)
            sums = np.zeros_like(centroids)
            np.add.at(sums, nearest, half)
            n = np.bincount(nearest, minlength=k)
            centroids[n > 0] = sums[n > 0] / n[n > 0, None]
        axis = np.linalg.svd(centroids - centroids.mean(0), full_matrices=False)[2][0]
        books.append(centroids[np.argsort(centroids @ axis, kind="stable")].astype(np.float32).tobytes())
    return pd.DataFrame([(sample["model"].iloc[0], *books)], columns=["model", "first", "second"])


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (book * book).sum(1) - 2 * x @ book.T


def walk(d1: np.ndarray, d2: np.ndarray, cells: int) -> list[int]:
    """The ``cells`` pairs of centroids of least summed distance, as i * K2 + j: a heap over sorted rows.

    Each first-half centroid is a row of sums in ascending order; the heap holds the next pair of
    every row begun, and a row is begun when the first pair of the row before it leaves the heap.
    """
    o1, o2 = d1.argsort(), d2.argsort()
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    o1, o2 = o1.tolist(), o2.tolist()
    k1, k2, out = len(o1), len(o2), []
    heap = [(s1[0] + s2[0], 0, 0)]
    while heap and len(out) < cells:
        _, i, j = heap[0]
        out.append(o1[i] * k2 + o2[j])
        if j + 1 < k2:
            heapq.heapreplace(heap, (s1[i] + s2[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if not j and i + 1 < k1:
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return out


def visited(d1: np.ndarray, d2: np.ndarray, cells: int) -> list[list[int]]:
    """The cells of every query; where most are visited, all sums are formed at once instead of through a heap."""
    k = d1.shape[1] * d2.shape[1]
    if cells >= k:
        return [list(range(k))] * len(d1)
    if cells * 8 < k:
        return [walk(a, b, cells) for a, b in zip(d1, d2)]
    return [np.argpartition((a[:, None] + b[None, :]).ravel(), cells)[:cells].tolist() for a, b in zip(d1, d2)]


def _groups(n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of neighbouring first-half lists of about ENTRY_BLOCK entries: each list's group, and each group's blocks.

    A list larger than that is a group of its own, of as many blocks as it needs.
    """
    group, size, sizes = np.zeros(len(n1), np.int64), 0, []
    for i, n in enumerate(n1.tolist()):
        if sizes and size and size + n > ENTRY_BLOCK:
            size = 0
        if not size or not sizes:
            sizes.append(0)
        group[i] = len(sizes) - 1
        size += max(n, 1)
        sizes[-1] += n
    return group, np.maximum(1, -(-np.array(sizes) // ENTRY_BLOCK))


def pack(cells: np.ndarray, span: int) -> bytes:
    """Local cell numbers below ``span`` as a list or as a bitmap, whichever is shorter; the first byte tells."""
    if len(cells) * 32 < span:
        return b"L" + cells.astype(np.int32).tobytes()
    mask = np.zeros(span, bool)
    mask[cells] = True
    return b"B" + np.packbits(mask).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    if packed[:1] == b"L":
        return np.frombuffer(packed, np.int32, offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, offset=1)))


def compare_cells(q: np.ndarray, q_cells: list[bytes], e: np.ndarray, e_cell: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the ``k`` best entries of the cells it visits: query, entry and cosine as arrays; ties by entry number."""
    held, starts, sizes = np.unique(e_cell, return_index=True, return_counts=True)
    parts = []
    chunk = NEAR_CHUNK if least > -1 else FAR_CHUNK
    for at in range(0, len(q), chunk):
        cells = [unpack(p) for p in q_cells[at : at + chunk]]
        if least > -1:
            row, col, cosine = _by_cell(q[at : at + chunk], cells, e, held, starts, sizes, least)
        else:
            row, col, cosine = _all_at_once(q[at : at + chunk], cells, e, e_cell, k)
        order = np.lexsort((col, -cosine, row))
        row, col, cosine = row[order], col[order], cosine[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        parts.append((at + row[best], col[best], cosine[best]))
    return tuple(map(np.concatenate, zip(*parts)))


def _by_cell(q: np.ndarray, cells: list[np.ndarray], e: np.ndarray, held: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell by cell, the queries that visit it against its entries."""
    which = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    cell = np.concatenate(cells)
    there = np.isin(cell, held)
    which, cell = which[there], cell[there]
    order = np.argsort(cell, kind="stable")
    which, cell = which[order], cell[order]
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))]
    seen, first = np.unique(cell, return_index=True)
    for c, lo, hi in zip(seen, first, [*first[1:], len(cell)]):
        at = np.searchsorted(held, c)
        s = q[which[lo:hi]] @ e[starts[at] : starts[at] + sizes[at]].T
        row, col = np.nonzero(s >= least)
        if len(row):
            found.append((which[lo + row], starts[at] + col, s[row, col]))
    return tuple(map(np.concatenate, zip(*found)))


def _all_at_once(q: np.ndarray, cells: list[np.ndarray], e: np.ndarray, e_cell: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where most cells are visited: all products, those of other cells left out."""
    span = 1 + max(int(e_cell.max()), *(int(c[-1]) for c in cells if len(c)))
    mask = np.zeros((len(q), span), bool)
    for i, c in enumerate(cells):
        mask[i, c] = True
    s = q @ e.T
    s[~mask[:, e_cell]] = -np.inf
    floor = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -2.0)
    row, col = np.nonzero((s >= floor[:, None]) & np.isfinite(s))
    return row, col, s[row, col]


class Index:
    """An inverted multi-index over ``entries`` (id, model, vec); every row is indexed.

    ``held`` has every entry with its group and local cell, ``asked`` a row for each query and
    group it visits, with the cells there. Both are written tables.
    """

    def __init__(self, entries: DataFrame, least: float = LEAST, cells: int | None = None) -> None:
        self.spark, self.least = entries.sparkSession, least
        self.scratch = scratch = Scratch(self.spark, "neighbours")
        self.sizes = {r["model"]: r["n"] for r in entries.groupBy("model").agg(F.count(F.lit(1)).alias("n")).collect()}
        books = self._train(entries) if self.sizes else {}
        shared = self.spark.sparkContext.broadcast(books)

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for model, part in pdf.groupby("model"):
                    x, (first, second) = _matrix(part["vec"]), shared.value[model]
                    yield part.assign(c1=distances(x[:, : DIM // 2], first).argmin(1).astype("int32"), c2=distances(x[:, DIM // 2 :], second).argmin(1).astype("int32"))

        indexed = scratch.save(entries.select("id", "model", "vec").mapInPandas(assign, "id string, model string, vec binary, c1 int, c2 int"))
        n1 = {m: np.zeros(len(b[0]), np.int64) for m, b in books.items()}
        for r in indexed.groupBy("model", "c1").agg(F.count(F.lit(1)).alias("n")).collect():
            n1[r["model"]][r["c1"]] = r["n"]
        groups = {m: _groups(n) for m, n in n1.items()}
        visits = {m: cells or (CELLS if least > -1 else math.ceil(FAR * len(a) * len(b))) for m, (a, b) in books.items()}
        routes = self.spark.sparkContext.broadcast({m: (g[0], np.searchsorted(g[0], np.arange(len(g[1]) + 1)), visits[m]) for m, g in groups.items()})

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for model, part in pdf.groupby("model"):
                    x, (first, second), (group, bounds, n) = _matrix(part["vec"]), shared.value[model], routes.value[model]
                    out, k2 = [], len(second)
                    for at in range(0, len(x), 1024):
                        d1, d2 = distances(x[at : at + 1024, : DIM // 2], first), distances(x[at : at + 1024, DIM // 2 :], second)
                        for i, c in enumerate(visited(d1, d2, n)):
                            c = np.sort(np.asarray(c))
                            g = group[c // k2]
                            cut = np.flatnonzero(np.diff(g, prepend=-1))
                            for lo, hi in zip(cut, [*cut[1:], len(c)]):
                                a, b = bounds[g[lo]], bounds[g[lo] + 1]
                                out.append((at + i, g[lo], pack(c[lo:hi] - a * k2, (b - a) * k2)))
                    rows, grp, packed = zip(*out)
                    rows = list(rows)
                    yield pd.DataFrame({"id": part["id"].to_numpy()[rows], "model": model, "vec": part["vec"].to_numpy()[rows], "grp": grp, "cells": packed})

        routed = scratch.save(indexed.select("id", "model", "vec").mapInPandas(route, "id string, model string, vec binary, grp int, cells binary"))
        # one row a first-half list and one a group: K of them, that is, the root of the number of vectors
        lists = [(m, i, int(g), int(np.searchsorted(group, g)), len(books[m][1])) for m, (group, _) in groups.items() for i, g in enumerate(group)]
        loads = {(r["model"], r["grp"]): r["n"] for r in routed.groupBy("model", "grp").agg(F.count(F.lit(1)).alias("n")).collect()}
        blocks = [(m, g, int(n), max(1, -(-loads.get((m, g), 0) // QUERY_BLOCK))) for m, (_, eb) in groups.items() for g, n in enumerate(eb)]
        lists = self.spark.createDataFrame(lists, "model string, c1 int, grp int, first int, k2 int")
        blocks = F.broadcast(self.spark.createDataFrame(blocks, "model string, grp int, eb int, qb int"))
        own = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
        self.asked = routed.join(blocks, ["model", "grp"]).select("id", "vec", "model", "grp", "cells", F.explode(F.sequence(F.lit(0), F.col("eb") - 1)).alias("e"), (own % F.col("qb")).cast("int").alias("q"))
        located = indexed.join(F.broadcast(lists), ["model", "c1"]).select("id", "vec", "model", "grp", ((F.col("c1") - F.col("first")) * F.col("k2") + F.col("c2")).alias("cell"))
        self.held = located.join(blocks, ["model", "grp"]).select("id", "vec", "model", "grp", "cell", (own % F.col("eb")).cast("int").alias("e"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"))
        self.located, self.routed = located, routed

    def _train(self, entries: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        size = []
        for m, n in self.sizes.items():
            k = max(1, round(math.sqrt(n / PER_CELL)))
            size.append((m, max(SAMPLE, SAMPLE_PER_CENTROID * k) / n, k))
        size = self.spark.createDataFrame(size, "model string, share double, k int")
        sampled = entries.join(F.broadcast(size), "model").where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.col("share") * 1_000_000)
        # a model so small that the sample may miss it is taken whole, as its share is above 1
        trained = sampled.select("model", "k", "vec").groupBy("model").applyInPandas(train, "model string, first binary, second binary").collect()
        return {r["model"]: tuple(np.frombuffer(b, np.float32).reshape(-1, DIM // 2) for b in (r["first"], r["second"])) for r in trained}

    def nearest(self, neighbours: int = NEIGHBOURS) -> DataFrame:
        """The most similar entries of every entry: id, other, cosine.

        At most ``neighbours`` + 1 rows per id, of cosine >= ``least``, ties by the smaller id.
        Vectors of different models never meet.
        """
        least = self.least

        def compare(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if not len(queries) or not len(held):
                return pd.DataFrame([], columns=["id", "other", "cosine"])
            held = held.sort_values(["cell", "id"])
            row, col, cosine = compare_cells(_matrix(queries["vec"]), list(queries["cells"]), _matrix(held["vec"]), held["cell"].to_numpy(), neighbours + 2, least)
            return pd.DataFrame({"id": queries["id"].to_numpy()[row], "other": held["id"].to_numpy()[col], "cosine": cosine.astype(np.float64)})

        key = ["model", "grp", "e", "q"]
        met = self.asked.groupBy(*key).cogroup(self.held.groupBy(*key)).applyInPandas(compare, "id string, other string, cosine double")
        w = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
        return met.where("id <> other").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= neighbours + 1).drop("_k")

    def compared(self, queries: DataFrame) -> DataFrame:
        """Per query (id) how many entries its cells hold, and how many its model has: id, model, compared, of."""
        counts = self.located.groupBy("model", "grp", "cell").agg(F.count(F.lit(1)).alias("n"))

        def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame([(i, m, g, unpack(c)) for i, m, g, c in zip(pdf["id"], pdf["model"], pdf["grp"], pdf["cells"])], columns=["id", "model", "grp", "cells"])

        asked = self.routed.hint("merge").join(queries.select("id").hint("merge"), "id").select("id", "model", "grp", "cells").mapInPandas(cells, "id string, model string, grp int, cells array<int>")
        seen = asked.select("id", "model", "grp", F.explode("cells").alias("cell")).hint("merge").join(counts.hint("merge"), ["model", "grp", "cell"])
        size = F.broadcast(self.spark.createDataFrame(list(self.sizes.items()), "model string, of long"))
        return seen.groupBy("id", "model").agg(F.sum("n").alias("compared")).join(size, "model")


def brute_force(entries: DataFrame, queries: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """The exact most similar entries of a stated set of queries: id, other, cosine; both have id, model, vec.

    All entries pass by the queries in blocks; each block of queries keeps its best entries of each
    block of entries, so that nothing grows beyond a block in any task.
    """
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    eb = max(1, -(-entries.count() // ENTRY_BLOCK))
    qb = max(1, -(-queries.count() // QUERY_BLOCK))
    left = queries.select("id", "model", "vec", block(qb).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(eb - 1))).alias("e"))
    right = entries.select("id", F.col("model").alias("model"), "vec", block(eb).alias("e"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("q"))

    def compare(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(held):
            return pd.DataFrame([], columns=["id", "other", "cosine"])
        held = held.sort_values("id")
        all_cells = [pack(np.zeros(1, np.int64), 1)] * len(queries)
        row, col, cosine = compare_cells(_matrix(queries["vec"]), all_cells, _matrix(held["vec"]), np.zeros(len(held), np.int64), neighbours + 1, float("-inf"))
        return pd.DataFrame({"id": queries["id"].to_numpy()[row], "other": held["id"].to_numpy()[col], "cosine": cosine.astype(np.float64)})

    key = ["model", "q", "e"]
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(compare, "id string, other string, cosine double")
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return met.where("id <> other").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= neighbours).drop("_k")


def _classes(vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Usable current vectors with their class of exact copies, and one row a class: class_key, id, members, model, vec."""
    usable = scratch.save(current_vectors(vectors).withColumn("class_key", F.sha2(F.concat(F.col("vec"), F.encode(F.col("model"), "utf-8")), 256)))
    classes = usable.groupBy("class_key").agg(F.min("node_id").alias("id"), F.count(F.lit(1)).alias("members"), F.first("model").alias("model"), F.first("vec").alias("vec"))
    return usable, scratch.save(classes)


def similar_pairs(vectors: DataFrame, neighbours: int = NEIGHBOURS, least: float = LEAST) -> DataFrame:
    """Pairs of similar current vectors: node_id_a < node_id_b, cosine.

    A pair comes out when its cosine is at least ``least`` and one is among the ``neighbours`` most
    similar of the other within its model (ties: smaller id first). Exact copies are compared once
    and then take part with each member; rows repeated for a node count once. Null, cut, short,
    non-finite and all-zero vectors take no part; no usable vectors give no pairs.
    """
    scratch = Scratch(vectors.sparkSession, "vectors")
    usable, classes = _classes(vectors, scratch)
    near = scratch.save(Index(classes.select("id", "model", "vec"), least).nearest(neighbours))
    # the first members of a class are all that anyone's list of so few neighbours can hold
    copies = classes.where("members > 1").select("class_key", F.col("id").alias("class_id"))
    w = Window.partitionBy("class_key").orderBy("node_id")
    heads = join_on_skewed(usable.select("class_key", "node_id"), copies, "class_key").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= neighbours + 1)
    lists = scratch.save(heads.groupBy("class_id").agg(F.sort_array(F.collect_list("node_id")).alias("heads")))
    # what a class offers its members: the first members of the classes near it, and its own; a row a class
    others = near.hint("merge").join(lists.hint("merge"), near["other"] == lists["class_id"], "left").select("id", "cosine", F.explode(F.coalesce("heads", F.array("other"))).alias("other"))
    own = lists.select(F.col("class_id").alias("id"), F.lit(1.0).alias("cosine"), F.explode("heads").alias("other"))
    offers = scratch.save(others.unionByName(own).groupBy("id").agg(F.collect_list(F.struct("cosine", "other")).alias("offers")).withColumnRenamed("id", "class_id"))
    several = join_on_skewed(usable.select("node_id", "class_key"), copies, "class_key").select("node_id", "class_id")
    single = classes.where("members = 1").select(F.col("id").alias("node_id"), F.col("id").alias("class_id"))
    offered = join_on_skewed(scratch.save(several.unionByName(single)), offers, "class_id").select("node_id", F.explode("offers").alias("o"))
    top = Window.partitionBy("node_id").orderBy(F.desc("cosine"), "other")
    kept = offered.select("node_id", "o.cosine", "o.other").where("node_id <> other").withColumn("_k", F.row_number().over(top)).where(F.col("_k") <= neighbours)
    return kept.groupBy(F.least("node_id", "other").alias("node_id_a"), F.greatest("node_id", "other").alias("node_id_b")).agg(F.max("cosine").alias("cosine"))


def index_quality(vectors: DataFrame, least: float = LEAST, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Recall of the index and the share of entries it compares, by model: model, entries, queries, neighbours, found, recall, share.

    Queries are the distinct vectors whose id hashes to a multiple of 50, against all; the truth is
    brute force in blocks over neighbours of cosine >= ``least``; without any the recall is null.
    """
    scratch = Scratch(vectors.sparkSession, "quality")
    entries = _classes(vectors, scratch)[1].select("id", "model", "vec")
    queries = scratch.save(entries.where(F.pmod(F.xxhash64("id"), F.lit(50)) == 0))
    index = Index(entries, least)
    true = scratch.save(brute_force(entries, queries, neighbours).where(F.col("cosine") >= F.lit(least)).select("id", "other"))
    near = index.nearest(neighbours).select("id", "other", F.lit(1).alias("hit"))
    seen = index.compared(queries)
    hits = true.hint("merge").join(near.hint("merge"), ["id", "other"], "left").groupBy("id").agg(F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("found"))
    rows = seen.hint("merge").join(hits.hint("merge"), "id", "left").groupBy("model").agg(
        F.max("of").alias("entries"), F.count(F.lit(1)).alias("queries"), F.coalesce(F.sum("neighbours"), F.lit(0)).alias("neighbours"), F.coalesce(F.sum("found"), F.lit(0)).alias("found"), F.avg(F.col("compared") / F.col("of")).alias("share")
    )
    return rows.select("model", "entries", "queries", "neighbours", "found", F.round(F.try_divide(F.col("found"), F.col("neighbours")), 4).alias("recall"), F.round("share", 4).alias("share"))
