"""Clusterings to compare with: DBSCAN, mixtures by BIC, hierarchical density, neighbour votes and folds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.checkpoints import cut
from lacuna.operators.graph import block_trees, components, spanning_tree_of_edges
from lacuna.operators.neighbors import BLOCK, matrix, square
from lacuna.operators.reachability import core_distances, reachability_tree


#: Cells are over the coordinates, at most so many, that spread the widest.
GRID = 3
#: Sets of up to so many points get their tree over mutual reachability from the trees of pairs of blocks.
SMALL = 4 * BLOCK


def _grid_pairs(cloud: DataFrame, eps: float, work, schema: str, extra: tuple[str, ...], left: Column, right: Column, block: int) -> DataFrame:
    """``work(a, b)`` for pieces of points whose distance may be at most eps: a of those with ``left``, b of those with ``right``.

    A point lies in the cell of width eps of its widest coordinates, and meets the points of its cell and of those next to it. A cell
    with more than ``block`` points is split into pieces, and each pair of pieces is a task of its own.
    """
    some = cloud.select("z").first()
    dim = len(some.z) if some else 1
    ends = cloud.agg(*[(F.max(F.col("z")[k]) - F.min(F.col("z")[k])).alias(f"s{k}") for k in range(dim)]).first()
    axes = sorted(range(dim), key=lambda k: -(ends[k] or 0.0))[:GRID]
    cell = F.array(*[F.floor(F.col("z")[k] / eps) for k in axes])
    keep = ["id", "z", *extra]
    own = cloud.select("set_id", *keep, cell.alias("cell"))
    pieces = lambda c: c.groupBy("set_id", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    steps = [[]]
    for _ in axes:
        steps = [[*s, d] for s in steps for d in (-1, 0, 1)]
    around = F.explode(F.array(*[F.array(*[F.lit(d).cast("long") for d in s]) for s in steps]))
    a = own.where(left).select("set_id", *keep, F.col("cell").alias("home"), around.alias("step"))
    a = a.select("set_id", *keep, F.zip_with("home", "step", lambda x, d: x + d).alias("cell"))
    b = own.where(right)
    na, nb = cut(pieces(a)), cut(pieces(b))
    counts = na.withColumnRenamed("n", "na").join(nb.withColumnRenamed("n", "nb"), ["set_id", "cell"])
    deal = lambda c, mine, others, p, q: c.join(counts, ["set_id", "cell"]).select("set_id", "cell", *keep, F.pmod(F.xxhash64("id"), mine).cast("int").alias(p), F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(q))
    key = ["set_id", "cell", "p", "q"]
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in (*key, *keep)])
    first, second = fresh(deal(a, "na", "nb", "p", "q")), fresh(deal(b, "nb", "na", "q", "p"))

    def run(k: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]
        if not len(x) or not len(y):
            return pd.DataFrame({"set_id": pd.Series(dtype=object), **{c: pd.Series(dtype="int64") for c in names}})
        near = square(matrix(x), matrix(y)) <= eps
        out = work(x, y, near)
        return pd.DataFrame({"set_id": np.full(len(out), k[0], object), **{c: out[c].to_numpy() for c in names}})

    return first.groupBy(*key).cogroup(second.groupBy(*key)).applyInPandas(run, f"set_id string, {schema}")


def _stars(x: pd.DataFrame, y: pd.DataFrame, near: np.ndarray) -> pd.DataFrame:
    """Edges (u, v) from each point to the smallest that it is linked with by near pairs: labels spread until they stand."""
    i, j = x["id"].to_numpy(), y["id"].to_numpy()
    most = np.iinfo(np.int64).max
    a, b = i.copy(), j.copy()
    while True:
        down = np.minimum(b, np.where(near, a[:, None], most).min(axis=0))
        back = np.minimum(a, np.where(near, down[None, :], most).min(axis=1))
        if (down == b).all() and (back == a).all():
            break
        a, b = back, down
    u, v = np.concatenate([i, j]), np.concatenate([a, b])
    return pd.DataFrame({"u": u, "v": v})[u != v]


def dbscan(cloud: DataFrame, eps: float, min_samples: int = 3, block: int = BLOCK) -> DataFrame:
    """(set_id, id, cluster, core): clusters named by their smallest core id, -1 for noise; a border point goes to the smallest.

    Near pairs are looked at in three passes over a grid and never listed: the first passes on how many each point has, the second for
    each point the smallest core it is linked with in the task, the third for each border point the smallest cluster near it.
    """
    true = F.lit(True)
    count = lambda x, y, near: pd.DataFrame({"id": x["id"], "n": near.sum(axis=1)})
    counts = _grid_pairs(cloud, eps, count, "id long, n long", (), true, true, block).groupBy("set_id", "id").agg(F.sum("n").alias("n"))
    marked = cut(cloud.join(counts, ["set_id", "id"], "left").select("set_id", "id", "z", (F.coalesce("n", F.lit(1)) >= min_samples).alias("core")))
    cores = marked.where("core")
    edges = _grid_pairs(cores, eps, _stars, "u long, v long", (), true, true, block).distinct()
    labels = components(cores.select("set_id", "id"), edges)
    labelled = cut(marked.join(labels, ["set_id", "id"], "left").withColumn("comp", F.coalesce("comp", F.lit(-1))))

    def smallest(x: pd.DataFrame, y: pd.DataFrame, near: np.ndarray) -> pd.DataFrame:
        hit = near.any(axis=1)
        found = np.where(near, y["comp"].to_numpy()[None, :], np.iinfo(np.int64).max).min(axis=1)
        return pd.DataFrame({"id": x["id"], "near": found})[hit]

    border = _grid_pairs(labelled, eps, smallest, "id long, near long", ("comp",), ~F.col("core"), F.col("core"), block).groupBy("set_id", "id").agg(F.min("near").alias("near"))
    return labelled.join(border, ["set_id", "id"], "left").select("set_id", "id", F.when(F.col("core"), F.col("comp")).otherwise(F.coalesce("near", F.lit(-1))).cast("long").alias("cluster"), "core")


def pca(cloud: DataFrame, k: int = 10) -> DataFrame:
    """The cloud on its first k principal components, centred. It must be one set: several have no components in common."""
    if cloud.select("set_id").distinct().limit(2).count() > 1:
        raise ValueError("pca takes one set at a time")
    mean = cloud.select(F.posexplode("z").alias("p", "x")).groupBy("p").agg(F.avg("x").alias("m")).agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("_mean"))
    centred = cloud.crossJoin(F.broadcast(mean)).select("set_id", "id", F.zip_with("z", "_mean", lambda x, m: x - m).alias("z"))
    vectors = centred.withColumn("_v", array_to_vector("z"))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vectors)
    return model.transform(vectors).select("set_id", "id", vector_to_array("_p").alias("z"))


def gaussian_bic(cloud: DataFrame, n: int, d: int) -> float:
    """BIC of one Gaussian at its maximum likelihood; directions without variance are left out, as in Spark's mixtures."""
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    found = cloud.agg(*[F.covar_pop(F.col("z")[i], F.col("z")[j]) for i, j in pairs]).first()
    spread = np.zeros((d, d))
    for (i, j), x in zip(pairs, found, strict=True):
        spread[i, j] = spread[j, i] = x
    values = np.linalg.eigvalsh(spread)
    values = values[values > np.finfo(float).eps * values.max() * d]
    return float(n * (d * math.log(2 * math.pi) + np.log(values).sum() + len(values)) + (d + d * (d + 1) / 2) * math.log(n))


def mixture_by_bic(cloud: DataFrame, most: int = 15, seed: int = 0) -> tuple[DataFrame, list[tuple[int, float]]]:
    """((id, cluster) of the full-covariance mixture with the lowest BIC, (k, BIC) of all from k = 1), by Spark's own EM."""
    vectors = cut(cloud.select("id", array_to_vector("z").alias("features")))
    n, d = vectors.count(), len(cloud.select("z").first().z)
    tried = [(1, gaussian_bic(cloud, n, d))]
    best = (tried[0][1], None)
    for k in range(2, most + 1):
        model = GaussianMixture(k=k, seed=seed, maxIter=60).fit(vectors)
        bic = -2 * model.summary.logLikelihood + (k - 1 + k * d + k * d * (d + 1) / 2) * math.log(n)
        tried.append((k, bic))
        if bic < best[0]:
            best = (bic, model)
    if best[1] is None:
        return vectors.select("id", F.lit(0).alias("cluster")), tried
    return best[1].transform(vectors).select("id", F.col("prediction").alias("cluster")), tried


def lowest(by: list[str], df: DataFrame, score: str, value: str) -> DataFrame:
    """For each group the value with the lowest score, the smallest of equals."""
    return df.groupBy(*by).agg(F.min(F.struct(score, value)).alias("_m")).select(*by, F.col(f"_m.{value}").alias(value), F.col(f"_m.{score}").alias(score))


def condensed(edges: list[tuple[float, int, int]], n: int, min_size: int) -> list[int]:
    """Labels of the most stable clusters of a hierarchy of n points given by its spanning tree edges (w, u, v); -1 for noise."""
    edges = sorted(edges)
    parent = list(range(2 * n - 1))
    kids: dict[int, tuple[int, int, float]] = {}
    count = [1] * n + [0] * (n - 1)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for k, (w, u, v) in enumerate(edges):
        a, b = root(u), root(v)
        parent[a] = parent[b] = n + k
        kids[n + k] = (a, b, w)
        count[n + k] = count[a] + count[b]

    def leaves(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            x = todo.pop()
            if x < n:
                out.append(x)
            else:
                todo += kids[x][:2]
        return out

    # a cluster is (birth, stability, child clusters, top node); walk down, splitting where both sides are large
    clusters: list[list] = []
    todo = [(2 * n - 2, None, 0.0)] if n > 1 else []
    while todo:
        node, above, birth = todo.pop()
        own = len(clusters)
        clusters.append([birth, 0.0, [], node])
        if above is not None:
            clusters[above][2].append(own)
        while node >= n:
            a, b, w = kids[node]
            rate = 1 / max(w, 1e-300)
            big = [x for x in (a, b) if count[x] >= min_size]
            lost = count[node] if len(big) != 1 else count[node] - count[big[0]]
            clusters[own][1] += lost * (rate - birth)
            if len(big) == 1:
                node = big[0]
                continue
            todo += [(x, own, rate) for x in big]
            break
    chosen: set[int] = set()
    value = [0.0] * len(clusters)
    for k in range(len(clusters) - 1, -1, -1):
        below = sum(value[c] for c in clusters[k][2])
        if k and (clusters[k][1] >= below or not clusters[k][2]):
            value[k] = clusters[k][1]
            chosen.add(k)
        else:
            value[k] = below
    labels = [-1] * n
    todo2 = list(clusters[0][2]) if clusters else []
    while todo2:
        k = todo2.pop()
        if k in chosen:
            for x in leaves(clusters[k][3]):
                labels[x] = k
        else:
            todo2 += clusters[k][2]
    return labels


def hdbscan(cloud: DataFrame, neighbors: DataFrame | None = None, min_cluster_size: int = 10, block: int | None = None) -> DataFrame:
    """(set_id, id, cluster): clusters of excess of mass over mutual-reachability distances, -1 for noise.

    The spanning tree's n - 1 edges of a set are condensed in a grouped function. The core distance is that to the
    ``min_cluster_size``-th neighbour, the point itself counted; it is taken from ``neighbors``, if they are there already.
    """
    if neighbors is None:
        core = core_distances(cloud, min_cluster_size - 1)
    else:
        core = neighbors.where(F.col("rank") == min_cluster_size - 1).select("set_id", F.col("i").alias("id"), F.col("d").alias("core"))
    placed = cut(cloud.join(core, ["set_id", "id"]))
    most = placed.groupBy("set_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= SMALL:  # few pairs of blocks are done sooner than the rounds
        edges = spanning_tree_of_edges(placed, block_trees(placed, block or BLOCK, "core"))
    else:
        edges = reachability_tree(placed, block)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(rows["u"]) | set(rows["v"]))
        place = {x: k for k, x in enumerate(ids)}
        labels = condensed([(w, place[u], place[v]) for w, u, v in zip(rows["w"], rows["u"], rows["v"], strict=True)], len(ids), min_cluster_size)
        return pd.DataFrame({"set_id": rows["set_id"].iloc[0], "id": ids, "cluster": labels})

    return edges.groupBy("set_id").applyInPandas(run, "set_id string, id long, cluster long")


def neighbour_vote(neighbors: DataFrame, labels: DataFrame, label: str = "label", k: int = 5) -> DataFrame:
    """(set_id, id, vote): the commonest label of the k nearest others, the smallest of equals."""
    near = neighbors.where(F.col("rank") <= k).join(labels.select("set_id", F.col("id").alias("j"), F.col(label).alias("_l")), ["set_id", "j"])
    votes = near.groupBy("set_id", "i", "_l").agg(F.count("*").alias("n"))
    first = Window.partitionBy("set_id", "i").orderBy(F.desc("n"), "_l")
    return votes.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("set_id", F.col("i").alias("id"), F.col("_l").alias("vote"))


def stratified_folds(df: DataFrame, label: str, order: list[str], folds: int = 5, name: str = "fold") -> DataFrame:
    """A fold from 0 on for each row, dealt in turn within each label."""
    return df.withColumn(name, F.pmod(F.row_number().over(Window.partitionBy(label).orderBy(*order)) - 1, F.lit(folds)))


def grouped_folds(df: DataFrame, group: str, folds: int = 5, name: str = "fold") -> DataFrame:
    """A fold for each row by a hash of its group, so that a group is never in two folds."""
    return df.withColumn(name, F.pmod(F.xxhash64(F.col(group).cast("string")), F.lit(folds)).cast("int"))


def _dealt_greedily(rows: pd.DataFrame, folds: int) -> pd.DataFrame:
    """A fold for each group (grp, labels, counts), largest first: the one where it adds least to the squared shares of its labels.

    Rows with a ``fold`` are there already. ``totals`` has each label's rows in all.
    """
    have = np.zeros((folds, 0))
    column: dict = {}

    def at(labels: list) -> list[int]:
        nonlocal have
        for x in labels:
            column.setdefault(x, len(column))
        if len(column) > have.shape[1]:
            have = np.concatenate([have, np.zeros((folds, len(column) - have.shape[1]))], axis=1)
        return [column[x] for x in labels]

    for row in rows[rows["fold"] >= 0].itertuples(index=False):
        where = at(row.labels)
        have[row.fold, where] += np.asarray(row.counts) * row.part
    todo = rows[rows["fold"] < 0].assign(n=lambda d: d["counts"].map(sum)).sort_values(["n", "grp"], ascending=[False, True])
    out = []
    for row in todo.itertuples(index=False):
        where, counts, totals = at(row.labels), np.asarray(row.counts, float), np.asarray(row.totals, float)
        cost = ((2 * have[:, where] * counts + counts**2) / totals**2).sum(axis=1)
        fold = int(np.lexsort((np.arange(folds), have.sum(axis=1), cost))[0])
        have[fold, where] += counts
        out.append(fold)
    return pd.DataFrame({"grp": todo["grp"], "fold": np.array(out, np.int32)})


def stratified_group_folds(df: DataFrame, group: str, label: str, folds: int = 5, name: str = "fold", batch: int = 10_000) -> DataFrame:
    """A fold from 0 on for each row: a group is in one fold only, and each fold has about its share of each label's rows.

    The table of rows by group and label is dealt greedily, largest groups first. Groups of at least 1 / (20 * folds) of all rows, of
    which there are few, go first; the others follow in batches of about ``batch`` groups, in a task each, which start from an equal
    part of what the large ones left uneven. Where there are as many groups as folds, no fold is empty. Null is a group and a label.
    """
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))  # noqa: E731  null apart from the empty text
    cells = cut(df.groupBy(text(group).alias("grp"), text(label).alias("label")).agg(F.count("*").alias("n")))
    totals = cells.groupBy("label").agg(F.sum("n").alias("total"))
    groups = cells.join(totals, "label").groupBy("grp").agg(F.sum("n").alias("size"), F.sort_array(F.collect_list(F.struct("label", "n", "total"))).alias("c"))
    groups = cut(groups.select("grp", "size", F.col("c.label").alias("labels"), F.col("c.n").alias("counts"), F.col("c.total").alias("totals"), F.lit(-1).alias("fold"), F.lit(1.0).alias("part")))
    n, rows = groups.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    batches = max(1, -(-n // batch))
    large = F.col("size") * (20 * folds) >= rows
    deal = lambda t: _dealt_greedily(t, folds)
    first = cut(groups.where(large).withColumn("b", F.lit(0)).groupBy("b").applyInPandas(deal, "grp string, fold int"))
    there = groups.drop("fold", "part").join(first, "grp").select("grp", "size", "labels", "counts", "totals", "fold", F.lit(1.0 / batches).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("b"))
    small = groups.where(~large).withColumn("b", F.pmod(F.xxhash64("grp"), F.lit(batches)).cast("int"))
    found = first.unionByName(small.unionByName(there).groupBy("b").applyInPandas(deal, "grp string, fold int"))
    key = "_group_of_fold"
    found = found.select(F.col("grp").alias(key), F.col("fold").alias(name))
    return df.withColumn("_g", text(group)).join(found, F.col("_g") == F.col(key)).select(*df.columns, name)


def out_of_fold(df: DataFrame, features: str, label: str, folds: int = 5, fold: str = "fold", strength: float = 1.0) -> DataFrame:
    """df with ``predicted``: each fold by a class-balanced multinomial logistic regression fitted on the others."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer

    indexer = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(df)
    per_class = df.groupBy(label).agg(F.count("*").alias("_n"))
    rows = indexer.transform(df.join(F.broadcast(per_class), label)).withColumn("_v", array_to_vector(features)).withColumn("_w", 1.0 / F.col("_n"))
    rows = cut(rows)
    back = IndexToString(inputCol="_p", outputCol="predicted", labels=indexer.labels)
    out = None
    for k in range(folds):
        train, test = rows.where(F.col(fold) != k), rows.where(F.col(fold) == k)
        scaler = StandardScaler(withMean=True, inputCol="_v", outputCol="_s").fit(train)
        model = LogisticRegression(featuresCol="_s", labelCol="_y", weightCol="_w", predictionCol="_p", probabilityCol="_q", rawPredictionCol="_r", regParam=1.0 / (strength * max(rows.count(), 1)), family="multinomial", maxIter=60).fit(scaler.transform(train))
        part = back.transform(model.transform(scaler.transform(test))).select(*df.columns, "predicted")
        out = part if out is None else out.unionByName(part)
    return out


def standardised(cloud: DataFrame) -> DataFrame:
    """Each coordinate of each set less its mean, over its population deviation (a constant coordinate: 0)."""
    long = cloud.select("set_id", "id", F.posexplode("z").alias("p", "x"))
    facts = long.groupBy("set_id", "p").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    facts = facts.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("p", "m", "s"))).alias("_f"))
    return cloud.join(facts, "set_id").select("set_id", "id", F.zip_with("z", "_f", lambda x, f: F.coalesce(F.try_divide(x - f["m"], f["s"]), F.lit(0.0))).alias("z"))


def verdict(share: Column, low: float, high: float) -> Column:
    """The decision rule of two cut-offs."""
    return F.when(share >= high, "informative").when(share < low, "uninformative").otherwise("undecided")


