"""Topics of varying density: neighbour graph, mutual reachability, spanning tree, condensed tree, choice by stability.

Equal vectors become one weighted point first. Neighbours come from a forest of random projections; the spanning tree is built by
Boruvka rounds; the tree of merges is cut by weight into parts that a task can hold; chains of merges are followed by
pointer jumping. Every round is a few joins, and the rounds grow with logarithms. The last choice goes from the leaves of the tree of
clusters up, subtree by subtree, each within a task; only above that, if more clusters are left than a task holds, it takes a round per level.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticketlens.operators.topics import OUTLIER
from ticketlens.session import materialise

_SAMPLE = 65_536
_PIECE = 50_000


def _cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a written table; a checkpoint would carry the plan's constraints along, which grow with every round."""
    return materialise(df, "density-round")


def as_array(df: DataFrame, vector_col: str) -> Column:
    column = F.col(f"`{vector_col}`")
    return vector_to_array(column) if isinstance(df.schema[vector_col].dataType, VectorUDT) else column.cast("array<double>")


def weighted_points(df: DataFrame, vector_col: str) -> DataFrame:
    """(node, n, vector): distinct vectors and how many rows hold them, written once. Null vectors and those with a null or NaN are left out."""
    vectors = df.select(as_array(df, vector_col).alias("vector")).filter(
        F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)) & (F.size("vector") > 0)
    )
    counted = vectors.groupBy(F.transform("vector", lambda x: x + 0.0).alias("vector")).agg(F.count("*").alias("n"))
    return materialise(counted.select(F.monotonically_increasing_id().alias("node"), "n", "vector"), "density-points")


def _splits(sample: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and medians of a projection tree in heap order."""
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((2**depth - 1, sample.shape[1]))
    cuts, at = np.zeros(len(directions)), np.zeros(len(sample), "int64")
    for level in range(depth):
        value = np.einsum("ij,ij->i", sample, directions[at])
        for heap in range(2**level - 1, 2 ** (level + 1) - 1):
            inside = value[at == heap]
            cuts[heap] = np.median(inside) if len(inside) else 0.0
        at = 2 * at + 1 + (value > cuts[at])
    return directions, cuts


def _closest(x: np.ndarray, node: np.ndarray, n: np.ndarray, label: np.ndarray | None, k: int, leaf: int, rng) -> list[pd.DataFrame]:
    """The k nearest of every point among those of its leaf; larger sets are halved along random directions."""
    stack, out = [np.arange(len(x))], []
    while stack:
        own = stack.pop()
        if len(own) > leaf:
            order = own[np.argsort(x[own] @ rng.standard_normal(x.shape[1]), kind="stable")]
            stack += [order[: len(order) // 2], order[len(order) // 2 :]]
            continue
        take = min(k, len(own) - 1)
        for at in range(0, len(own) if take else 0, 64):
            part = own[at : at + 64]
            d = np.sqrt(((x[part][:, None, :] - x[own][None, :, :]) ** 2).sum(axis=2))
            d[np.arange(len(part)), np.arange(at, at + len(part))] = np.inf
            if label is not None:
                d[label[part][:, None] == label[own][None, :]] = np.inf
            near = np.argsort(d, axis=1, kind="stable")[:, :take]
            out.append(pd.DataFrame({
                "a": np.repeat(node[part], take), "b": node[own[near]].ravel(), "d": np.take_along_axis(d, near, 1).ravel(),
                "nb": n[own[near]].ravel(),
            }))
    return [f[np.isfinite(f["d"])] for f in out]


def neighbours(points: DataFrame, k: int, trees: int = 6, leaf: int = 256, seed: int = 42, apart: bool = False) -> DataFrame:
    """(a, b, d, nb, rank): the k nearest found neighbours of every node, with their distance and weight.

    Each tree cuts space at medians of a sample of at most about 65,536 points into pieces of some 50,000 points (more beyond 100
    million), each halved within its task until at most ``leaf`` points are compared with each other. Exact if ``leaf`` is at
    least the number of points. With ``apart`` only nodes of another ``label`` count.
    """
    points = points.select("node", "n", "vector", (F.col("label") if apart else F.lit(0)).cast("bigint").alias("label"))
    count = points.count()
    depth = int(min(11, max(0, np.ceil(np.log2(max(count, 1) / _PIECE)))))
    plans = []
    if depth:
        step = max(1, count // _SAMPLE)
        sample = points.filter(F.pmod(F.xxhash64("vector"), F.lit(step)) == 0).select("vector").limit(2 * _SAMPLE).collect()
        sample = np.array([r.vector for r in sample])
        plans = [_splits(sample, depth, seed + t) for t in range(trees)]

    def place(batches):
        for pdf in batches:
            x = np.array(pdf["vector"].tolist(), "float64").reshape(len(pdf), -1)
            for tree in range(trees):
                at = np.zeros(len(pdf), "int64")
                for _ in range(depth):
                    directions, cuts = plans[tree]
                    at = 2 * at + 1 + (np.einsum("ij,ij->i", x, directions[at]) > cuts[at])
                yield pdf.assign(tree=tree, piece=at)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        rng = np.random.default_rng(seed + 7919 * int(pdf["tree"].iloc[0]) + int(pdf["piece"].iloc[0]))
        x = np.array(pdf["vector"].tolist(), "float64")
        found = _closest(x, pdf["node"].to_numpy(), pdf["n"].to_numpy(), pdf["label"].to_numpy() if apart else None, k, leaf, rng)
        return pd.concat(found) if found else pd.DataFrame({"a": [], "b": [], "d": [], "nb": []})

    placed = points.mapInPandas(place, "node bigint, n bigint, vector array<double>, label bigint, tree int, piece bigint")
    pairs = placed.groupBy("tree", "piece").applyInPandas(compare, "a bigint, b bigint, d double, nb bigint")
    pairs = pairs.groupBy("a", "b").agg(F.min("d").alias("d"), F.first("nb").alias("nb"))
    order = W.partitionBy("a").orderBy("d", "b")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def core_distances(points: DataFrame, near: DataFrame, min_samples: int) -> DataFrame:
    """(node, core): the distance that reaches ``min_samples`` rows, the own ones included; to the farthest if there are too few."""
    up_to = W.partitionBy("a").orderBy("d", "b").rowsBetween(W.unboundedPreceding, 0)
    reach = near.withColumn("rows", F.sum("nb").over(up_to)).join(points.select(F.col("node").alias("a"), "n"), "a")
    return reach.groupBy(F.col("a").alias("node")).agg(
        F.when(F.first("n") >= min_samples, 0.0)
        .otherwise(F.coalesce(F.min(F.when(F.col("rows") + F.col("n") >= min_samples, F.col("d"))), F.max("d"))).alias("core")
    )


def reachability(near: DataFrame, core: DataFrame) -> DataFrame:
    """(a, b, w), a < b: the larger of the distance and both core distances."""
    pairs = near.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("d").alias("d"))
    both = pairs.join(core.select(F.col("node").alias("a"), F.col("core").alias("ca")), "a").join(core.select(F.col("node").alias("b"), F.col("core").alias("cb")), "b")
    return both.select("a", "b", F.greatest("d", "ca", "cb").alias("w"))


def linked_tree(points: DataFrame, near: DataFrame, core: DataFrame, trees: int = 6, leaf: int = 256) -> DataFrame:
    """The spanning tree (a, b, w) of the points: the neighbour graph lacks the edges between groups whose neighbours are all their own, so
    after every round each point is also joined to the nearest one of another component.

    The join is the same as for neighbours, over all points and, where no piece holds two components, over 64 points of each; then a
    link may be longer than the true gap. What no join links stays apart.
    """
    seeds = iter(range(1000, 1_000_000, trees))

    def links(labels: DataFrame) -> DataFrame | None:
        if labels.select("label").distinct().limit(2).count() < 2:
            return None
        tagged = points.join(labels, "node")
        more = _cut(neighbours(tagged, 1, trees, leaf, next(seeds), apart=True))
        if more.isEmpty():
            order = W.partitionBy("label").orderBy(F.xxhash64("node"), "node")
            some = _cut(tagged.withColumn("at", F.row_number().over(order)).filter("at <= 64").drop("at"))
            more = _cut(neighbours(some, 1, trees, leaf, next(seeds), apart=True))
        return reachability(more, core)

    return spanning_forest(reachability(near, core), links)[0]


def roots(pointers: DataFrame) -> DataFrame:
    """(node, up): the end of every chain of ``pointers`` (node, up); ends point at themselves. The paths halve each round."""
    while True:
        far = pointers.select(F.col("node").alias("up"), F.col("up").alias("far"))
        step = pointers.join(far, "up", "left").select("node", F.coalesce("far", "up").alias("up"), F.col("up").alias("old")).transform(_cut)
        pointers = step.select("node", "up")
        if step.filter("up <> old").isEmpty():
            return pointers


def spanning_forest(edges: DataFrame, grow=None) -> tuple[DataFrame, DataFrame]:
    """The minimum spanning forest (a, b, w) of ``edges`` (a, b, w) and its components (node, label).

    Every round each component takes its least edge by (w, a, b), which makes the forest unique, and components that meet are
    joined; their number at least halves each round. ``grow`` gives more edges for the components (node, label) of a round.
    """
    live = edges.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")).transform(_cut)
    labels = live.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label"))
    taken = []
    while True:
        ends = F.inline(F.array(F.struct(F.col("ca").alias("c"), F.col("cb").alias("to")), F.struct(F.col("cb").alias("c"), F.col("ca").alias("to"))))
        best = live.select("w", "a", "b", ends).groupBy("c").agg(F.min(F.struct("w", "a", "b", "to")).alias("e")).transform(_cut)
        taken.append(best.select("e.a", "e.b", "e.w").distinct())
        back = best.select(F.col("c").alias("other"), F.col("e.to").alias("answer"))
        pointers = best.join(back, F.col("e.to") == F.col("other"), "left").select(
            F.col("c").alias("node"), F.when((F.col("answer") == F.col("c")) & (F.col("c") < F.col("e.to")), F.col("c")).otherwise(F.col("e.to")).alias("up")
        )
        joined = roots(pointers)
        labels = labels.join(joined.select(F.col("node").alias("label"), "up"), "label", "left").select(
            "node", F.coalesce("up", "label").alias("label")
        ).transform(_cut)
        a, b = (joined.select(F.col("node").alias(c), F.col("up").alias(f"_{c}")) for c in ("ca", "cb"))
        live = live.join(a, "ca").join(b, "cb").filter("_ca <> _cb").select("a", "b", "w", F.col("_ca").alias("ca"), F.col("_cb").alias("cb")).transform(_cut)
        more = grow(labels) if grow else None
        if more is not None:
            a, b = (labels.select(F.col("node").alias(c), F.col("label").alias(f"c{c}")) for c in ("a", "b"))
            live = live.unionByName(more.join(a, "a").join(b, "b")).transform(_cut)
        if live.isEmpty():
            tree = taken[0]
            for more in taken[1:]:
                tree = tree.union(more)
            return tree, labels


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """Union-find over the edges of one part in order of weight."""
    above, size, top, out = {}, {}, {}, []
    for rank, w, a, b, na, nb, ta, tb in pdf.sort_values("rank")[["rank", "w", "a", "b", "na", "nb", "ta", "tb"]].itertuples(index=False, name=None):
        ends = []
        for node, n, t in ((a, na, ta), (b, nb, tb)):
            if node not in above:
                above[node], size[node], top[node] = node, n, t
            while above[node] != node:
                above[node] = above[above[node]]
                node = above[node]
            ends.append(node)
        x, y = ends
        total = size[x] + size[y]
        out.append((rank, w, total, top[x], size[x], top[y], size[y]))
        if size[x] < size[y]:
            x, y = y, x
        above[y], size[x], top[x] = x, total, rank
    return pd.DataFrame(out, columns=["id", "w", "size", "left", "lsize", "right", "rsize"])


def merge_tree(tree: DataFrame, points: DataFrame, per_task: int = 1_000_000) -> DataFrame:
    """(id, w, size, left, lsize, right, rsize): one merge per tree edge in order of weight; leaves are ``-(node + 1)``.

    Parts of more than ``per_task`` edges are cut at their median: the lighter half keeps its nodes, the heavier one gets the lighter
    half's components as nodes. So a part never exceeds what a task holds, however many points one component has.
    """
    ranked = tree.repartitionByRange("w", "a", "b").sortWithinPartitions("w", "a", "b").withColumn("rank", F.monotonically_increasing_id())
    ranked = materialise(ranked, "density-tree")
    weights = lambda c: points.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"))
    edges = ranked.join(weights("a"), "a").join(weights("b"), "b").select(
        F.lit(0).cast("bigint").alias("part"), "rank", "w", "a", "b", "na", "nb", (-F.col("a") - 1).alias("ta"), (-F.col("b") - 1).alias("tb")
    ).transform(_cut)
    columns = edges.columns
    while True:
        large = edges.groupBy("part").agg(F.count("*").alias("_n"), F.percentile_approx("rank", 0.5).alias("mid")).filter(F.col("_n") > per_task)
        large = large.drop("_n").transform(_cut)
        if large.isEmpty():
            return edges.groupBy("part").applyInPandas(
                _merge, "id bigint, w double, size bigint, left bigint, lsize bigint, right bigint, rsize bigint"
            )
        marked = edges.join(large, "part", "left").transform(_cut)
        light = marked.filter(F.col("rank") <= F.col("mid"))
        key = lambda c: F.struct("part", F.col(c).alias("node"))
        _, labels = spanning_forest(light.select(key("a").alias("a"), key("b").alias("b"), F.col("rank").alias("w")))
        sizes = light.select(F.inline(F.array(F.struct(key("a").alias("node"), F.col("na").alias("n")), F.struct(key("b").alias("node"), F.col("nb").alias("n")))))
        sizes = sizes.distinct().join(labels, "node").groupBy("label").agg(F.sum("n").alias("n"))
        tops = light.select(key("a").alias("node"), "rank").join(labels, "node").groupBy("label").agg(F.max("rank").alias("t"))
        new = labels.join(sizes, "label").join(tops, "label").select("node", F.col("label.node").alias("to"), "n", "t").transform(_cut)
        heavy = marked.filter(F.col("rank") > F.col("mid"))
        for c in ("a", "b"):
            there = new.select(F.col("node.part").alias("part"), F.col("node.node").alias(c), F.col("to").alias("_to"), F.col("n").alias("_n"), F.col("t").alias("_t"))
            heavy = heavy.join(there, ["part", c], "left").withColumns({
                f"n{c}": F.coalesce("_n", f"n{c}"), f"t{c}": F.coalesce("_t", f"t{c}"), c: F.coalesce("_to", c),
            }).drop("_to", "_n", "_t")
        half = lambda df, bit: df.withColumn("part", 2 * F.col("part") + bit).select(columns)
        # Parts that are not cut keep apart from the halves of others by the same doubling.
        edges = half(marked.filter("mid is null"), 0).union(half(light, 0)).union(half(heavy, 1)).transform(_cut)


def _choose(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whether each cluster of whole subtrees is chosen, from the leaves up. A cluster has more rows than any below it; rows with a ``value``
    are decided already. A cluster that is its own parent is a root."""
    total, out = {}, []
    for cluster, parent, own, value, known in pdf.sort_values("size")[["cluster", "parent", "own", "value", "known"]].itertuples(index=False, name=None):
        if not known:
            below = total.get(cluster)
            value = own if below is None else max(own, below)
            out.append((cluster, value, own >= (0.0 if below is None else below)))
        if parent != cluster:
            total[parent] = total[parent] + value if parent in total else value
    return pd.DataFrame(out, columns=["cluster", "value", "chosen"])


def decisions(clusters: DataFrame, min_cluster_size: int, per_task: int) -> DataFrame:
    """(cluster, value, chosen) of the written ``clusters`` (cluster, parent, size, own): the larger of a cluster's own stability and the sum of what it
    splits into, and whether it is its own.

    A cluster of ``s`` rows has fewer than ``2 s / min_cluster_size`` clusters below it, so subtrees of few rows are decided each within a task, and what is
    above them in one task if it holds at most ``per_task`` clusters, else level by level.
    """
    def parts(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("parent", F.coalesce("parent", "cluster"))
        return rows.groupBy("part").applyInPandas(_choose, "cluster bigint, value double, chosen boolean").transform(_cut)

    unknown = clusters.withColumns({"value": F.lit(0.0), "known": F.lit(False)})
    count = clusters.count()
    if count <= per_task:
        return parts(unknown.withColumn("part", F.lit(0)))
    is_light = F.col("size") < min_cluster_size * per_task // 2
    above = clusters.filter(is_light).select(F.col("cluster").alias("parent"), F.col("cluster").alias("up"))
    tops = roots(clusters.filter(is_light).join(above, "parent", "left").select(F.col("cluster").alias("node"), F.coalesce("up", "cluster").alias("up")))
    part = F.pmod(F.xxhash64("up"), F.lit(2 * count // per_task + 1)).alias("part")
    decided = parts(unknown.join(tops.select(F.col("node").alias("cluster"), part), "cluster"))
    heavy = unknown.filter(~is_light).transform(_cut)
    if heavy.isEmpty():
        return decided
    if heavy.count() <= per_task:
        below = decided.select("cluster", "value").join(clusters, "cluster").join(heavy.select(F.col("cluster").alias("parent")), "parent", "left_semi")
        rows = heavy.unionByName(below.withColumn("known", F.lit(True)))
        return decided.union(parts(rows.withColumn("part", F.lit(0)))).transform(_cut)
    leaves = heavy.join(clusters.select(F.col("parent").alias("cluster")), "cluster", "left_anti")
    best = decided = decided.union(leaves.select("cluster", F.col("own").alias("value"), (F.col("own") >= 0).alias("chosen"))).transform(_cut)
    kids = clusters.filter("parent is not null").groupBy(F.col("parent").alias("cluster")).agg(F.count("*").alias("kids")).transform(_cut)
    while True:
        # A cluster is decided as soon as all those it splits into are.
        ready = best.join(clusters.select("cluster", "parent"), "cluster").filter("parent is not null").groupBy(F.col("parent").alias("cluster"))
        ready = ready.agg(F.count("*").alias("n"), F.sum("value").alias("sum")).join(kids, "cluster").filter("n = kids")
        ready = ready.join(decided.select("cluster"), "cluster", "left_anti").join(clusters, "cluster").select(
            "cluster", F.greatest("own", "sum").alias("value"), (F.col("own") >= F.col("sum")).alias("chosen")
        ).transform(_cut)
        if ready.isEmpty():
            return decided
        decided = best = decided.union(ready).transform(_cut)


def varying_density_topics(
    df: DataFrame, id_col: str = "ticket_id", vector_col: str = "reduced", min_samples: int = 5, min_cluster_size: int = 10,
    k: int = 15, trees: int = 6, leaf: int = 256, per_task: int = 1_000_000,
) -> DataFrame:
    """(id, topic): clusters that last longest while the density threshold rises; other points are -1, topic 0 is the largest.

    A cluster splits where both sides hold ``min_cluster_size`` rows; of a cluster and those it splits into, the side with more stability
    (rows times the range of 1/distance over which they stay) is taken, ties go to the cluster. All points together are no topic, unless
    components stay apart that no join links: then they are the first split. Rows of equal vectors share a topic and leave at the
    smallest distance of the tree. Null vectors and those with a null or NaN get -1; an empty table gives no rows. Repeated ids stay.
    """
    m = min_cluster_size
    points = weighted_points(df, vector_col)
    near = materialise(neighbours(points, max(k, min_samples), trees, leaf), "density-near")
    everyone = df.select(F.col(f"`{id_col}`").alias("_id"), F.transform(as_array(df, vector_col), lambda x: x + 0.0).alias("vector"))
    if near.isEmpty():
        return everyone.select(F.col("_id").alias(id_col), F.lit(OUTLIER).alias("topic"))
    core = materialise(core_distances(points, near, min_samples), "density-core")
    tree = linked_tree(points, near, core, trees, leaf)
    merges = materialise(merge_tree(tree, points, per_task), "density-merges")

    # Every merge and every point, with the merge above it.
    sides = F.inline(F.array(F.struct(F.col("left").alias("id"), F.col("lsize").alias("size")), F.struct(F.col("right").alias("id"), F.col("rsize").alias("size"))))
    is_split = (F.col("lsize") >= m) & (F.col("rsize") >= m)
    below = merges.select(F.col("id").alias("above"), F.col("w").alias("w_above"), is_split.alias("split"), sides)
    tops = merges.join(below.select("id"), "id", "left_anti").select("id", "size")
    nodes = materialise(below.unionByName(tops, allowMissingColumns=True), "density-nodes")
    large = nodes.filter(F.col("size") >= m)
    head = F.col("above").isNull() | F.col("split")
    heads = roots(large.select(F.col("id").alias("node"), F.when(head, F.col("id")).otherwise(F.col("above")).alias("up")))
    heads = heads.select(F.col("node").alias("id"), F.col("up").alias("cluster"))

    # Rows that leave their cluster at each merge, and what the cluster gathers from its birth to then.
    ends = F.when(is_split | ((F.col("lsize") < m) & (F.col("rsize") < m)), F.col("size")).otherwise(F.least("lsize", "rsize"))
    least = merges.agg(F.min("w").alias("w"))
    leaving = merges.filter(F.col("size") >= m).select("id", "w", ends.alias("rows")).unionByName(
        large.filter("id < 0").select("id", F.col("size").alias("rows")).join(F.broadcast(least))  # one row
    )
    gathered = leaving.join(heads, "id").groupBy("cluster").agg(F.sum(F.col("rows") / F.col("w")).alias("gathered"))
    born = large.filter(head).select(F.col("id").alias("cluster"), "size", F.coalesce(1 / F.col("w_above"), F.lit(0.0)).alias("birth"), "above")
    parents = born.join(heads.select(F.col("id").alias("above"), F.col("cluster").alias("parent")), "above", "left")
    clusters = parents.join(gathered, "cluster").select(
        "cluster", "parent", "size", (F.col("gathered") - F.col("size") * F.col("birth")).alias("own")
    )
    # A single component's whole is no choice.
    single = tops.count() == 1
    clusters = materialise(clusters.withColumn("own", F.when(F.col("parent").isNull() & F.lit(single), -1.0).otherwise(F.col("own"))), "density-clusters")

    decided = decisions(clusters, m, per_task)
    # The highest chosen cluster at or above each: paths double, the upper choice wins.
    path = clusters.join(decided, "cluster").select("cluster", "parent", F.when(F.col("chosen"), F.col("cluster")).alias("pick")).transform(_cut)
    while not path.filter("parent is not null").isEmpty():
        up = path.select(F.col("cluster").alias("parent"), F.col("parent").alias("next"), F.col("pick").alias("higher"))
        path = path.join(up, "parent", "left").select("cluster", F.col("next").alias("parent"), F.coalesce("higher", "pick").alias("pick")).transform(_cut)

    home = roots(nodes.select(F.col("id").alias("node"), F.when((F.col("size") >= m) | F.col("above").isNull(), F.col("id")).otherwise(F.col("above")).alias("up")))
    home = home.filter("node < 0").select((-F.col("node") - 1).alias("node"), F.col("up").alias("id"))
    found = home.join(heads, "id").join(path.select("cluster", "pick"), "cluster").filter("pick is not null").select("node", "pick")
    labelled = everyone.join(points.join(found, "node").select("vector", "pick"), "vector", "left")
    labelled = materialise(labelled.select("_id", "pick"), "density-labels")
    sizes = labelled.filter("pick is not null").groupBy("pick").agg(F.count("*").alias("n"), F.min("_id").alias("first"))
    order = sizes.select("pick", (F.row_number().over(W.orderBy(F.desc("n"), "first")) - 1).alias("topic"))
    return labelled.join(order, "pick", "left").select(F.col("_id").alias(id_col), F.coalesce("topic", F.lit(OUTLIER)).alias("topic"))
