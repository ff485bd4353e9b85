"""Approximate nearest neighbours by inner product, over an NN-descent graph.

Equal vectors are one node; a hot vector costs no more than another. An edge leads
to a node with one of the largest inner products, whatever the norms. The graph
starts from brute force inside small random cells and against a fixed number of
entry nodes, so that no node is without edges, wherever it lies. Every round joins each node with its neighbours in both
directions, compares those with each other inside the task, and gives better
ones to their nodes: neighbours of neighbours become neighbours, until hardly
any edge changes. Queries are nodes themselves: the search starts at their own
edges and the entry nodes, and moves greedily, expanding the best nodes found that are not expanded
yet. Graph, search and result all score in double precision, and equal scores go
to the smaller node, so that no cut on the way is coarser than the result: near
copies are told apart as far as the result tells them apart, whatever the norms.
Found nodes are spread to the rows that hold their vectors only at the end.

All joins are made in blocks of nodes: a task gets the lists of its block and
each vector they name once. Nothing is collected but counts and the entry nodes.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor those whose length is not the most frequent one
(the greater of equally frequent lengths). Repeated vectors are
rows like any other; a row finds all others with its vector, except those of its
own id. Ties go to the smaller id. Fewer candidates than asked give all of them. Rows without an id take
no part. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.session import materialise

DEGREE = 40  # edges of a node
PER_LIST = 4  # better neighbours that one list offers to a node
ROUNDS = 6
SETTLED = 0.03  # share of changed edges that ends the descent
CELL = 400
TREES = 2
ENTRIES = 120  # nodes that all nodes and queries are compared with
FAR_BACK = 10  # neighbours in the other direction besides the nearest, at random
BEAM = 80
EXPANDED = (40, 20, 20)  # nodes a query expands, round by round
BLOCK = 2000  # nodes per block, fewer if there would be too few blocks for all cores

NODE = "node long, vec binary"


def usable(vector: str) -> Column:
    v = F.col(vector)
    finite = F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def packed(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Usable rows as ``id`` and ``vec``, little-endian doubles."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & usable("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).count()
    common = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return rows.select("id", F.lit(None).cast("binary").alias("vec")).limit(0)
    rows = rows.filter(F.size("v") == common.d)
    rows = rows.select("id", F.col("v").cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False) + 0.0
            data = flat.reshape(batch.num_rows, -1).astype("<f8")
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([v.tobytes() for v in data], pa.binary())],
                ["id", "vec"],
            )

    return rows.mapInArrow(run, "id long, vec binary")


def matrix(column, kind: str) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def block_of(column: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(blocks))


def blocks_for(df: DataFrame, count: int) -> int:
    return max(count // BLOCK, 4 * df.sparkSession.sparkContext.defaultParallelism)


def top_rows(group: np.ndarray, score: np.ndarray, other: np.ndarray, most: int) -> np.ndarray:
    """Indices of the ``most`` best rows of each group, best first, the smaller ``other`` of equals."""
    order = np.lexsort((other, -score, group))
    ordered = group[order]
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    rank = np.arange(len(ordered)) - first[np.cumsum(new) - 1]
    return order[rank < most]


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the same order wherever a pair is scored."""
    return (left * right).sum(-1)


def entry_nodes(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and vectors of the entry nodes, chosen by hash."""
    rows = vectors.orderBy(F.xxhash64("node", F.lit(1)), "node").limit(ENTRIES).collect()
    data = np.frombuffer(b"".join(bytes(r.vec) for r in rows), "<f8")
    return np.array([r.node for r in rows], np.int64), data.reshape(len(rows), -1)


def entry_edges(vectors: DataFrame, entries: tuple[np.ndarray, np.ndarray], most: int) -> DataFrame:
    """The best ``most`` edges (u, v, s) from each node to the entry nodes."""
    ids, held = entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy()
            data = matrix(batch.column("vec"), "<f8")
            for first in range(0, len(node), 1000):
                at = slice(first, first + 1000)
                score = np.stack([products(data[at], e) for e in held], 1)
                u, v = np.repeat(node[at], len(ids)), np.tile(ids, len(score))
                other = np.flatnonzero(u != v)
                kept = other[top_rows(u[other], score.ravel()[other], v[other], most)]
                found = edge_table(u[kept], v[kept], score.ravel()[kept])
                yield from found.combine_chunks().to_batches()

    return vectors.mapInArrow(run, "u long, v long, s double")


def first_graph(
    vectors: DataFrame, count: int, entries: tuple[np.ndarray, np.ndarray]
) -> DataFrame:
    """The best edges inside the cells of random hyperplanes and to the entry nodes."""
    bits = max(0, int(np.ceil(np.log2(max(count / CELL, 1)))))
    held = entries[1]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = matrix(batch.column("vec"), "<f8")
            for tree in range(TREES if bits else 1):
                planes = np.random.RandomState(tree).standard_normal((data.shape[1], bits))
                middle = np.median(held @ planes, axis=0)  # vectors may lie all on one side of 0
                code = ((data @ planes) > middle) @ (1 << np.arange(bits, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("node"),
                        batch.column("vec"),
                        pa.array((np.int64(tree) << 48) | code.astype(np.int64).reshape(-1)),
                    ],
                    ["node", "vec", "cell"],
                )

    placed = vectors.mapInArrow(cells, NODE + ", cell long")
    # A crowded cell is dealt at random into several.
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / (2 * CELL)).alias("parts"))
    placed = placed.join(sizes, "cell").withColumn(
        "part", F.pmod(F.xxhash64("node", "cell"), F.col("parts"))
    )

    def compare(rows: pa.Table) -> pa.Table:
        node = rows.column("node").to_numpy()
        data = matrix(rows.column("vec"), "<f8")
        score = data @ data.T
        np.fill_diagonal(score, -np.inf)
        most = min(DEGREE, len(node) - 1)
        best = np.argpartition(-score, max(most - 1, 0), axis=1)[:, :most]
        return edge_table(
            np.repeat(node, most),
            node[best.ravel()],
            np.take_along_axis(score, best, 1).ravel(),
        )

    found = placed.groupBy("cell", "part").applyInArrow(compare, "u long, v long, s double")
    found = found.union(entry_edges(vectors, entries, DEGREE))
    return best_edges(found.withColumn("new", F.lit(True)), count)


def edge_table(u: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.Table:
    return pa.table({"u": pa.array(u), "v": pa.array(v), "s": pa.array(s.astype(np.float64))})


def best_edges(offered: DataFrame, count: int) -> DataFrame:
    """The best ``DEGREE`` different edges of each node; an edge stays old if it was."""
    blocks = blocks_for(offered, count)

    def run(rows: pa.Table) -> pa.Table:
        u, v, s, new = (rows.column(c).to_numpy() for c in ("u", "v", "s", "new"))
        order = np.lexsort((new, v, u))
        first = np.ones(len(order), bool)
        first[1:] = (u[order][1:] != u[order][:-1]) | (v[order][1:] != v[order][:-1])
        kept = order[first]
        kept = kept[top_rows(u[kept], s[kept], v[kept], DEGREE)]
        return edge_table(u[kept], v[kept], s[kept]).append_column("new", pa.array(new[kept]))

    dealt = offered.withColumn("block", block_of("u", blocks))
    return dealt.groupBy("block").applyInArrow(run, "u long, v long, s double, new boolean")


def local_joins(edges: DataFrame, vectors: DataFrame, count: int) -> DataFrame:
    """Edges between the neighbours, in both directions, of every node."""
    blocks = blocks_for(edges, count)
    nearest = Window.partitionBy("m").orderBy(F.desc("s"), "x")
    dealt = Window.partitionBy("m").orderBy(F.xxhash64("x", "m"), "x")
    back = (
        edges.select(F.col("v").alias("m"), F.col("u").alias("x"), "s", "new")
        .withColumn("r", F.row_number().over(nearest))
        .withColumn("far", F.row_number().over(dealt))
        .filter((F.col("r") <= DEGREE) | (F.col("far") <= FAR_BACK))
        .drop("r", "far")
    )
    lists = (
        edges.toDF("m", "x", "s", "new")
        .union(back)
        .select("m", "x", "new", block_of("m", blocks).alias("block"))
    )
    worst = edges.groupBy("u").agg(F.min("s").alias("least"), F.count("*").alias("held"))
    limits = vectors.join(worst, vectors.node == worst.u, "left").select(
        "node",
        "vec",
        F.when(F.col("held") >= DEGREE, F.col("least"))
        .otherwise(F.lit(float("-inf")))
        .alias("least"),
    )
    named = lists.select(F.col("block").alias("at"), F.col("x").alias("node")).distinct()
    wanted = named.join(limits, "node")

    def compare(lists: pa.Table, vectors: pa.Table) -> pa.Table:
        ids = vectors.column("node").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        data = matrix(vectors.column("vec"), "<f8")[order]
        least = vectors.column("least").to_numpy()[order]
        m = lists.column("m").to_numpy()
        x = np.searchsorted(ids, lists.column("x").to_numpy())
        new = lists.column("new").to_numpy()
        by = np.lexsort((~new, x, m))  # of an edge both ways one, new if either is
        first = np.ones(len(by), bool)
        first[1:] = (m[by][1:] != m[by][:-1]) | (x[by][1:] != x[by][:-1])
        by = by[first]
        m, x, new = m[by], x[by], new[by]
        bounds = np.flatnonzero(np.append(True, m[1:] != m[:-1])).tolist() + [len(m)]
        found = []
        for a, b in zip(bounds, bounds[1:]):
            at, fresh = x[a:b], new[a:b]
            if b - a < 2 or not fresh.any():
                continue
            score = data[at] @ data[at].T
            score[score <= least[at][:, None]] = -np.inf
            score[np.ix_(~fresh, ~fresh)] = -np.inf
            np.fill_diagonal(score, -np.inf)
            most = min(PER_LIST, b - a - 1)
            best = np.argpartition(-score, most - 1, axis=1)[:, :most]
            value = np.take_along_axis(score, best, 1)
            row, column = np.nonzero(value > -np.inf)
            found.append((at[row], at[best[row, column]], value[row, column]))
        if not found:
            return edge_table(*[np.empty(0, k) for k in (np.int64, np.int64, np.float64)])
        u, v, s = (np.concatenate(c) for c in zip(*found))
        pair = u * np.int64(len(ids)) + v
        once = np.unique(pair, return_index=True)[1]
        return edge_table(ids[u[once]], ids[v[once]], s[once])

    return (
        lists.groupBy("block")
        .cogroup(wanted.groupBy("at"))
        .applyInArrow(compare, "u long, v long, s double")
    )


def neighbour_graph(
    vectors: DataFrame, count: int, entries: tuple[np.ndarray, np.ndarray]
) -> DataFrame:
    """Edges (u, v, s) to about the nearest ``DEGREE`` nodes of each node."""
    edges = materialise(first_graph(vectors, count, entries), "graph")
    for _ in range(ROUNDS if count > 2 * CELL else 0):
        better = local_joins(edges, vectors, count).withColumn("new", F.lit(True))
        kept = edges.withColumn("new", F.lit(False))
        edges = materialise(best_edges(kept.unionByName(better), count), "graph")
        changed = edges.agg(F.avg(F.col("new").cast("int"))).first()[0] or 0
        if changed < SETTLED:
            break
    return edges.select("u", "v", "s")


def score_pairs(pairs: DataFrame, vectors: DataFrame, count: int, most: int) -> DataFrame:
    """Inner products of (q, v), for each query the ``most`` best of a block."""
    blocks = blocks_for(pairs, count)
    dealt = pairs.withColumn("block", block_of("v", blocks))
    asked = dealt.select(F.col("block").alias("at"), F.col("q").alias("node")).distinct()
    asked = asked.join(vectors, "node").select("at", "node", "vec", F.lit(True).alias("asks"))
    held = vectors.withColumn("at", block_of("node", blocks))
    both = asked.unionByName(held.select("at", "node", "vec", F.lit(False).alias("asks")))

    def run(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
        asks = vectors.column("asks").to_numpy()
        node = vectors.column("node").to_numpy()
        data = matrix(vectors.column("vec"), "<f8")
        sides = []
        for side, name in ((asks, "q"), (~asks, "v")):
            ids, rows = node[side], data[side]
            order = np.argsort(ids)
            found = pairs.column(name).to_numpy()
            sides.append((rows[order], np.searchsorted(ids[order], found), found))
        (left, a, q), (right, b, v) = sides
        score = np.empty(len(q))
        for first in range(0, len(q), 50_000):
            at = slice(first, first + 50_000)
            score[at] = products(left[a[at]], right[b[at]])
        kept = top_rows(q, score, v, most)
        return pa.table({"q": pa.array(q[kept]), "v": pa.array(v[kept]), "s": pa.array(score[kept])})

    if_any = dealt.groupBy("block").cogroup(both.groupBy("at"))
    return if_any.applyInArrow(run, "q long, v long, s double")


def greedy_search(
    queries: DataFrame,
    edges: DataFrame,
    vectors: DataFrame,
    count: int,
    entries: tuple[np.ndarray, np.ndarray],
) -> DataFrame:
    """The nodes (q, v) that each query's search ends with."""
    own = edges.withColumnRenamed("u", "q").join(queries, "q")
    beam = score_pairs(own.select("q", "v"), vectors, count, BEAM)
    asking = vectors.join(queries, vectors.node == queries.q).select("node", "vec")
    common = entry_edges(asking, entries, BEAM).withColumnRenamed("u", "q")
    nearest = Window.partitionBy("q").orderBy(F.desc("s"), "v")
    beam = (
        beam.unionByName(common)
        .groupBy("q", "v")
        .agg(F.max("s").alias("s"))
        .withColumn("r", F.row_number().over(nearest))
        .filter(F.col("r") <= BEAM)
        .drop("r")
    )
    beam = materialise(beam.withColumn("open", F.lit(True)), "beam")
    still = Window.partitionBy("q", "open").orderBy(F.desc("s"), "v")
    for expanded in EXPANDED:
        ranked = beam.withColumn("r", F.row_number().over(still))
        now = F.col("open") & (F.col("r") <= expanded)
        marked = ranked.withColumn("now", now)
        reached = (
            marked.filter("now")
            .select("q", F.col("v").alias("u"))
            .join(edges, "u")
            .select("q", "v")
            .filter("q <> v")
            .distinct()
            .join(beam.select("q", "v"), ["q", "v"], "left_anti")
        )
        found = score_pairs(reached, vectors, count, BEAM).withColumn("open", F.lit(True))
        known = marked.select("q", "v", "s", (F.col("open") & ~F.col("now")).alias("open"))
        beam = materialise(
            known.unionByName(found)
            .withColumn("r", F.row_number().over(nearest))
            .filter(F.col("r") <= BEAM)
            .drop("r"),
            "beam",
        )
    return beam.select("q", "v")


def exact_scores(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Inner products of the original vectors of (q, v), in double precision."""
    full = pairs.join(nodes.toDF("q", "vec_q"), "q").join(nodes.toDF("v", "vec_v"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (matrix(batch.column(c), "<f8") for c in ("vec_q", "vec_v"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("q"), batch.column("v"), pa.array(products(left, right))],
                ["q", "v", "score"],
            )

    return full.select("q", "v", "vec_q", "vec_v").mapInArrow(run, "q long, v long, score double")


def search(
    df: DataFrame, queries: Column, k: int, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """For each row where ``queries`` holds, a condition on ``id``, its ``k`` nearest.

    ``query_id``, ``rank``, the neighbour's ``key`` and ``score``.
    """
    rows = materialise(packed(df, key, vector), "vectors")
    nodes = materialise(rows.groupBy("vec").agg(F.min("id").alias("node")).select("node", "vec"), "nodes")
    held = materialise(rows.join(nodes, "vec").select("id", "node"), "held")
    asked = held.filter(queries)
    count = nodes.count()
    if not count:
        return df.sparkSession.range(0).selectExpr(
            "id AS query_id", "0 AS rank", f"id AS `{key}`", "0D AS score"
        )
    entries = entry_nodes(nodes)
    edges = neighbour_graph(nodes, count, entries)
    asking = materialise(asked.select(F.col("node").alias("q")).distinct(), "queries")
    found = greedy_search(asking, edges, nodes, count, entries)
    pairs = found.union(asking.select("q", F.col("q").alias("v")))  # rows of the own vector
    scored = exact_scores(pairs, nodes)
    in_node = Window.partitionBy("node").orderBy("id")
    first_rows = (
        held.withColumn("r", F.row_number().over(in_node)).filter(F.col("r") <= k + 1).drop("r")
    )
    nearest = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    lists = (
        scored.join(first_rows.toDF("id", "v"), "v")
        .withColumn("r", F.row_number().over(nearest))
        .filter(F.col("r") <= k + 1)
        .groupBy("q")
        .agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("near"))
    )
    others = F.filter("near", lambda hit: hit["id"] != F.col("query_id"))
    answers = (
        asked.join(lists, asked.node == lists.q)
        .withColumnRenamed("id", "query_id")
        .select("query_id", F.slice(others, 1, k).alias("near"))
    )
    unfolded = answers.select("query_id", F.posexplode("near").alias("at", "hit"))
    return unfolded.select(
        "query_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("hit.id").alias(key),
        F.col("hit.score").alias("score"),
    )
