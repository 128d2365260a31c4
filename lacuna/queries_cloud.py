"""Queries over point clouds (table embeddings): neighbours, dimension, trees, gaps, groups, decisions, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.checkpoints import cut
from lacuna.operators import clusters, density, gaps, geometry, graph, neighbors, nulls, scores, signal, synth, umap
from lacuna.operators.gate import decide, gap_test
from lacuna.plans import detection, repertoires
from lacuna.sources import tables


def _cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as one set. Queries on its spanning tree have no SQL: a recursion over all pairs takes minutes; they are
    tested against plain Python on small clouds."""
    return neighbors.points(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cloud with every coordinate of odd ids shifted by 0.4, which makes two types."""
    cloud = _cloud(spark, sf_dir)
    return cloud.withColumn("z", F.transform("z", lambda x: x + F.when(F.col("id") % 2 == 1, 0.4).otherwise(0.0)))


def _r(c, digits: int = 6):
    return F.round(c, digits)


def pairwise_distance(spark, sf_dir):
    return neighbors.pairwise(_cloud(spark, sf_dir)).select("i", "j", _r("d").alias("d"))


def knn_k15(spark, sf_dir):
    return neighbors.knn(_cloud(spark, sf_dir)).select("i", "j", F.col("rank").cast("long").alias("rank"), _r("d").alias("d"))


def kth_nn_radius(spark, sf_dir):
    return neighbors.kth_radius(neighbors.knn(_cloud(spark, sf_dir))).select("id", _r("rk").alias("rk"))


def knn_graph_symmetric(spark, sf_dir):
    return neighbors.symmetric_graph(neighbors.knn(_cloud(spark, sf_dir))).select("i", "j")


def intrinsic_dim(spark, sf_dir):
    return neighbors.intrinsic_dim(neighbors.knn(_cloud(spark, sf_dir))).select(_r("d_hat", 5).alias("d_hat"))


def null_dims(spark, sf_dir):
    dims = neighbors.null_dims(neighbors.intrinsic_dim(neighbors.knn(_cloud(spark, sf_dir))))
    return dims.select(F.explode(F.col("dims").cast("array<long>")).alias("dim"))


def global_rms_scale(spark, sf_dir):
    scaled = neighbors.rms_scaled(_cloud(spark, sf_dir))
    return scaled.select("id", _r(F.col("z")[0], 5).alias("z0"), _r(F.aggregate("z", F.lit(0.0), lambda s, x: s + x * x), 5).alias("norm2"))


def cross_nearest(spark, sf_dir):
    """Nearest point of another label for each point, block against block."""
    labels = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"))
    return neighbors.nearest_of_others(_cloud(spark, sf_dir).join(labels, "id")).select("i", _r("d").alias("d"))


def mst_edges(spark, sf_dir):
    return graph.minimum_spanning_tree(_cloud(spark, sf_dir)).select("u", "v", _r("w").alias("w"))


def _gaps(spark, sf_dir, cloud):
    cloud = cut(cloud)
    near = cut(neighbors.knn(cloud))
    tree = cut(graph.minimum_spanning_tree(cloud, near=near))
    return cloud, near, tree, cut(gaps.gap_tree(tree, near))


def gap_merges(spark, sf_dir):
    return _gaps(spark, sf_dir, _typed(spark, sf_dir))[3].select("u", "v", _r("gap").alias("gap"))


def max_gap(spark, sf_dir):
    cloud, _, _, found = _gaps(spark, sf_dir, _typed(spark, sf_dir))
    return gaps.max_gap(cloud, found).select(_r("max_gap").alias("max_gap"))


def top_k_gaps(spark, sf_dir):
    found = _gaps(spark, sf_dir, _typed(spark, sf_dir))[3]
    return found.orderBy(F.desc("gap"), "u", "v").limit(3).select("u", "v", _r("gap").alias("gap"))


def fixed_threshold_types(spark, sf_dir):
    found = _gaps(spark, sf_dir, _typed(spark, sf_dir))[3]
    return found.agg((1 + F.count_if(F.col("gap") > 2.0)).alias("n_types"))


def cut_groups(spark, sf_dir):
    cloud, _, tree, found = _gaps(spark, sf_dir, _typed(spark, sf_dir))
    thresholds = spark.createDataFrame([("all", 1.5)], "set_id string, thr double")
    return gaps.cut_groups(cloud, tree, found, thresholds).select("id", "grp")


def array_union_median(spark, sf_dir):
    near = cut(neighbors.knn(_cloud(spark, sf_dir)))
    rk = neighbors.kth_radius(near).select("id", "rk")
    sets = near.groupBy("i").agg(F.collect_set("j").alias("s"))
    pairs = sets.alias("a").join(sets.alias("b"), F.col("b.i") == F.col("a.i") + 1)
    both = pairs.select(F.col("a.i").alias("i"), F.explode(F.array_union(F.array_union(F.col("a.s"), F.col("b.s")), F.array(F.col("a.i"), F.col("b.i")))).alias("id"))
    return both.join(rk, "id").groupBy("i").agg(_r(F.median("rk")).alias("med"))


def dbscan_core_points(spark, sf_dir):
    cloud = _cloud(spark, sf_dir).withColumn("z", F.slice("z", 1, 2))
    return clusters.dbscan(cloud, 0.02, 3).select("id", "cluster", "core")


def knn_vote(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    labels = table.select(F.lit("all").alias("set_id"), F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"))
    return clusters.neighbour_vote(neighbors.knn(_cloud(spark, sf_dir)), labels).select("id", "vote")


def _fixed_nulls(spark, sf_dir):
    """A null table that both engines can make: each event's value as a replicate, its type as the shape, in two dimensions."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cells = F.explode(F.expr("array(struct(9 as dim, 0.010D as f), struct(10 as dim, 0.012D as f))"))
    return events.select("event_type", "value", cells.alias("c")).select(F.lit(1).alias("n"), "c.dim", F.col("event_type").alias("shape"), (F.col("value") * F.col("c.f")).alias("max_gap"))


def _decided(spark, sf_dir):
    """The events of a type are the gaps of a set; the length of its name says how they are scaled, and whether it has 9 dimensions, 10 or both."""
    letters = F.length("event_type")
    found = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("set_id"), letters.alias("letters"), (F.col("value") / (70 + 10 * (letters % 5))).alias("gap"))
    dims = F.when(F.col("letters") % 3 == 0, F.array(F.lit(9), F.lit(10))).when(F.col("letters") % 3 == 1, F.array(F.lit(9))).otherwise(F.array(F.lit(10)))
    observed = found.groupBy("set_id", "letters").agg(F.max("gap").alias("max_gap")).select("set_id", F.lit(1).alias("n"), dims.alias("dims"), "max_gap")
    return decide(observed, found.select("set_id", "gap"), _fixed_nulls(spark, sf_dir))


def threshold_given_nulls(spark, sf_dir):
    return _decided(spark, sf_dir).select("set_id", _r("threshold").alias("threshold"))


def pvalue_given_nulls(spark, sf_dir):
    return _decided(spark, sf_dir).select("set_id", _r("p", 9).alias("p"), "is_discrete")


def n_types_given_nulls(spark, sf_dir):
    return _decided(spark, sf_dir).select("set_id", F.col("n_types").cast("long").alias("n_types"))


def shape_invariance_ratio(spark, sf_dir):
    return nulls.shape_invariance(_fixed_nulls(spark, sf_dir)).select(F.col("dim").cast("long").alias("dim"), _r("ratio").alias("ratio"))


def hopkins_given_points(spark, sf_dir):
    """Each label is a repeat; its points halved are the reference points."""
    cloud = _cloud(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("i"), F.col("label").alias("repeat"))
    near = neighbors.knn(cloud, 1).join(labels, "i").select("repeat", "d")
    halved = neighbors.block_pairs(cloud, _nearest_to_half, "i long, d double", None).groupBy("i").agg(F.min("d").alias("d")).join(labels, "i")
    return scores.hopkins(near, halved, 2).select(_r("hopkins").alias("hopkins"))


def _nearest_to_half(a, b):
    import pandas as pd

    i, _, d = neighbors.closest(0.5 * neighbors.matrix(a), neighbors.matrix(b), 1)
    return pd.DataFrame({"i": a["id"].to_numpy()[i], "d": d})


def gate(spark, sf_dir, n_null: int = nulls.N_NULL):
    """The whole gate on all embeddings, with null clouds simulated in Spark."""
    out = gap_test(_cloud(spark, sf_dir), n_null=n_null).result
    return out.select("n", "d_hat", "max_gap", "threshold", "p", "n_types", "is_discrete")


def gate_many_sets(spark, sf_dir):
    """One gate for each label: the sets share all jobs."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    out = gap_test(neighbors.points(df, set_col="label")).result
    return out.select("set_id", "n", "d_hat", "max_gap", "threshold", "p", "n_types", "is_discrete")


def gate_known_clusters(spark, sf_dir):
    """Five coordinates of all embeddings, scaled and moved to eight far centres; 8 types are found."""
    cloud = clusters.standardised(_cloud(spark, sf_dir).withColumn("z", F.slice("z", 1, 5)))
    return gap_test(synth.around_centres(cloud)).result.select("set_id", "n", "p", "n_types", "is_discrete")


def null_table(spark, sf_dir):
    """Null clouds as large as the middle one of the embeddings' labels, in 3 and 5 dimensions."""
    sizes = spark.read.parquet(f"{sf_dir}/embeddings.parquet").groupBy("label").count()
    n = max(nulls.K + 1, int(sizes.agg(F.percentile("count", F.lit(0.5))).first()[0] or 0))
    return nulls.null_table(spark, [(n, 3), (n, 5)])



def group_relative_gaps(spark, sf_dir):
    cloud, near, tree, _ = _gaps(spark, sf_dir, _typed(spark, sf_dir))
    return gaps.gap_tree(tree, near, norm="group").select("u", "v", "gap")


def _dense_clusters(cloud: DataFrame) -> DataFrame:
    """Density clusters of at least ten points, or a hundredth of all."""
    size = max(10, int(0.01 * cloud.count()))
    return clusters.hdbscan(cloud, min_cluster_size=size)


def hdbscan(spark, sf_dir):
    return _dense_clusters(cut(_typed(spark, sf_dir)))


def umap_layout(spark, sf_dir):
    """Places in the plane that keep neighbours near."""
    found = umap.umap(_typed(spark, sf_dir))
    return found.select("id", _r(F.col("z")[0], 4).alias("x"), _r(F.col("z")[1], 4).alias("y"))


def umap_neighbours_kept(spark, sf_dir):
    """The share of each point's 15 nearest that stay so, in the layout and on the first two principal components it begins with."""
    cloud = cut(_typed(spark, sf_dir))
    near = cut(neighbors.knn(cloud))
    start = cut(umap.start_from_components(cloud))
    layouts = {"components": start, "umap": umap.layout(umap.fuzzy_graph(near), start)}
    out = [umap.neighbours_kept(near, neighbors.knn(z)).select(F.lit(name).alias("layout"), "kept") for name, z in layouts.items()]
    return out[0].unionByName(out[1])


def hdbscan_umap(spark, sf_dir):
    return _dense_clusters(cut(umap.umap(_typed(spark, sf_dir))))


def gmm_bic(spark, sf_dir):
    """The best mixture of 1 to 15 Gaussians on ten principal components."""
    found, _ = clusters.mixture_by_bic(clusters.pca(_cloud(spark, sf_dir), 10))
    return found


def prominences(spark, sf_dir):
    return density.prominences(cut(neighbors.knn(_cloud(spark, sf_dir))))


def silverman(spark, sf_dir):
    """Density peaks and modes of each label's points, on their first two coordinates scaled to a deviation of 1."""
    cloud = neighbors.points(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), set_col="label").withColumn("z", F.slice("z", 1, 2))
    return density.peak_and_mode_tests(clusters.standardised(cloud))


def synthetic_repertoires(spark, sf_dir):
    """A call for each embedding: of types where the label is even, of a continuum where it is odd."""
    kind = F.when(F.col("label").cast("long") % 2 == 0, "discrete_tight").otherwise("graded_1d")
    return synth.drawn(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), kind.alias("kind")))


def repertoire_cloud(spark, sf_dir):
    """A call of one of eight types for each embedding, as points."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), F.lit("discrete_tight").alias("kind"))
    return repertoires.cloud_of(cut(synth.drawn(rows)))


def convex_hull(spark, sf_dir):
    """Corners of each label's points on their first two coordinates."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return geometry.convex_hull(neighbors.points(df, set_col="label").withColumn("z", F.slice("z", 1, 2)))


def hopkins(spark, sf_dir):
    """On the first two principal components; a continuum is near 0.5."""
    return geometry.hopkins_test(clusters.pca(_cloud(spark, sf_dir), 2))


def hopkins_in_space(spark, sf_dir):
    """On three principal components, against points of their hull."""
    return geometry.hopkins_test(clusters.pca(_cloud(spark, sf_dir), 3))


def adjusted_information(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", F.floor(F.col("embedding")[0] * 20).alias("other"))
    return scores.adjusted_information(df, "label", "other").select(_r("ami").alias("ami"))


def detected_calls(spark, sf_dir):
    """Bursts in synthetic recordings, one for each user of the events; onset and length come from the user's number."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    return detection.detect(synth.bursts(users, "user_id"))


def call_images(spark, sf_dir):
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    return signal.images(synth.bursts(users, "user_id"), 300.0, 30e3, 110e3, nperseg=512, noverlap=448, floor=1e-20).select("file", "image")


def power_by_bin(spark, sf_dir):
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    return signal.power_by_bin(synth.bursts(users, "user_id"))


def file_profile(spark, sf_dir):
    """Compressed bytes of the documents' columns, from the footers."""
    return tables.profile(spark, [f"{sf_dir}/documents.parquet"])


def pca_cloud(spark, sf_dir):
    return clusters.pca(_cloud(spark, sf_dir), 10)


def stratified_folds(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("label").cast("long").alias("label"))
    return clusters.stratified_folds(df, "label", ["vec_id"]).select("vec_id", "label", F.col("fold").cast("long").alias("fold"))


def grouped_folds(spark, sf_dir):
    return clusters.grouped_folds(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label"), "label")


def stratified_group_folds(spark, sf_dir):
    """Events of a user share a fold, and each fold has its part of each type of event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    return clusters.stratified_group_folds(events, "user_id", "event_type")


def logistic_out_of_fold(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("z"), F.col("label").cast("string").alias("label"))
    folded = clusters.stratified_folds(df, "label", ["vec_id"], 3)
    return scores.balanced_accuracy(clusters.out_of_fold(folded, "z", "label", 3), "label", "predicted")


_PAIRS = "p as (select a.vec_id i, b.vec_id j, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) d from embeddings a join embeddings b on a.vec_id <> b.vec_id)"
_RANKED = f"{_PAIRS}, r as (select *, row_number() over (partition by i order by d, j) rn from p)"


_NULLS = "nulls as (select dim, event_type shape, value * f max_gap from events, (values (9, 0.010::DOUBLE), (10, 0.012::DOUBLE)) c(dim, f))"
_DECIDED = f"""with {_NULLS}, found as (select event_type set_id, value / (70 + 10 * (length(event_type) % 5)) gap from events),
obs as (select set_id, unnest(case length(set_id) % 3 when 0 then [9, 10] when 1 then [9] else [10] end) dim, max_gap from (select set_id, max(gap) max_gap from found group by 1)),
cells as (select o.set_id, n.dim, n.shape, quantile_cont(n.max_gap, 0.95) q, (1 + count(*) filter (n.max_gap >= o.max_gap)) / (1 + count(*)) p from obs o join nulls n on n.dim = o.dim group by 1, 2, 3),
rules as (select set_id, max(q) threshold, max(p) p from cells group by 1)"""

SQL = {
    "pairwise_distance": "select a.vec_id i, b.vec_id j, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) d from embeddings a join embeddings b on a.vec_id < b.vec_id",
    "knn_k15": f"with {_RANKED} select i, j, rn as rank, round(d, 6) d from r where rn <= 15",
    "kth_nn_radius": f"with {_RANKED} select i id, round(d + 1e-9, 6) rk from r where rn = 15",
    "knn_graph_symmetric": f"with {_RANKED} select i, j from r where rn <= 15 union select j, i from r where rn <= 15",
    "intrinsic_dim": f"with {_RANKED}, t as (select i, rn, d + 1e-12 t, max(d + 1e-12) over (partition by i) tk from r where rn <= 15), m as (select i, sum(ln(tk / t)) / 14 m from t where rn < 15 group by i) select round(1 / avg(m), 5) d_hat from m",
    "null_dims": f"with {_RANKED}, t as (select i, rn, d + 1e-12 t, max(d + 1e-12) over (partition by i) tk from r where rn <= 15), m as (select i, sum(ln(tk / t)) / 14 m from t where rn < 15 group by i), h as (select 1 / avg(m) d from m) select distinct unnest([least(greatest(floor(d), 1), 10), least(greatest(ceil(d), 1), 10)])::BIGINT dim from h",
    "global_rms_scale": "with x as (select vec_id, unnest(embedding)::DOUBLE x from embeddings), s as (select sqrt(sum(x * x) / count(*)) s from x) select vec_id id, round(embedding[1]::DOUBLE / s, 5) z0, round((select sum(power(y::DOUBLE / s, 2)) from unnest(embedding) u(y)), 5) norm2 from embeddings, s",
    "cross_nearest": "select a.vec_id i, round(min(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) d from embeddings a, embeddings b where a.label <> b.label group by 1",
    "array_union_median": f"with {_RANKED}, nb as (select i, j from r where rn <= 15 union all select vec_id, vec_id from embeddings), rk as (select i id, d + 1e-9 rk from r where rn = 15), u as (select i, j from nb where exists (select 1 from embeddings where vec_id = nb.i + 1) union select i - 1, j from nb where exists (select 1 from embeddings where vec_id = nb.i - 1)) select u.i, round(median(rk), 6) med from u join rk on rk.id = u.j group by 1",
    "dbscan_core_points": """with recursive pts as (select vec_id id, embedding[1]::DOUBLE x, embedding[2]::DOUBLE y from embeddings), near as (select a.id i, b.id j from pts a join pts b on a.id <> b.id and sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.02),
cores as (select id from pts where 1 + (select count(*) from near where near.i = pts.id) >= 3), inner_ as (select i, j from near where i in (select id from cores) and j in (select id from cores)),
walk(id, node) as (select id, id from cores union select walk.id, inner_.j from walk join inner_ on inner_.i = walk.node), lab as (select id, min(node) c from walk group by 1),
border as (select near.j id, min(lab.c) c from near join lab on lab.id = near.i group by 1)
select pts.id, coalesce(lab.c, border.c, -1) as cluster, lab.c is not null core from pts left join lab using (id) left join border using (id)""",
    "knn_vote": f"with {_RANKED}, v as (select r.i, e.label::BIGINT l, count(*) n from r join embeddings e on e.vec_id = r.j where rn <= 5 group by 1, 2) select i id, l vote from (select *, row_number() over (partition by i order by n desc, l) k from v) where k = 1",
    "threshold_given_nulls": _DECIDED + " select set_id, round(threshold, 6) threshold from rules",
    "pvalue_given_nulls": _DECIDED + " select set_id, round(p, 9) p, p < 0.05 is_discrete from rules",
    "n_types_given_nulls": _DECIDED + " select r.set_id, 1 + count(f.gap) n_types from rules r left join found f on f.set_id = r.set_id and f.gap > r.threshold group by 1",
    "shape_invariance_ratio": f"with {_NULLS} select dim::BIGINT dim, round(max(q) / min(q), 6) ratio from (select dim, shape, quantile_cont(max_gap, 0.95) q from nulls group by 1, 2) group by 1",
    "hopkins_given_points": f"with {_PAIRS}, w as (select label rep, sum(d * d) w from (select i, min(d) d from p group by 1) join embeddings on vec_id = i group by 1), u as (select rep, sum(d * d) u from (select a.label rep, a.vec_id, min(list_distance(list_transform(a.embedding::DOUBLE[], lambda x: x * 0.5), b.embedding::DOUBLE[])) d from embeddings a, embeddings b group by 1, 2) group by 1) select round(avg(w / (u + w)), 6) hopkins from w join u using (rep)",
    "adjusted_information": """with t as (select label a, floor(embedding[1] * 20) b from embeddings), c as (select a, b, count(*)::DOUBLE k from t group by 1, 2), ra as (select a, sum(k) na from c group by 1), rb as (select b, sum(k) nb from c group by 1), s as (select sum(k) n from c),
mi as (select sum(k / n * ln(n * k / (na * nb))) mi from c join ra using (a) join rb using (b), s), ha as (select -sum(na / n * ln(na / n)) h from ra, s), hb as (select -sum(nb / n * ln(nb / n)) h from rb, s),
g as (select na, nb, n, unnest(generate_series(greatest(1, na + nb - n)::BIGINT, least(na, nb)::BIGINT)) k from ra, rb, s),
chance as (select sum(k / n * ln(n * k / (na * nb)) * exp(lgamma(na + 1) + lgamma(nb + 1) + lgamma(n - na + 1) + lgamma(n - nb + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(na - k + 1) - lgamma(nb - k + 1) - lgamma(n - na - nb + k + 1))) e from g)
select round((mi - e) / ((ha.h + hb.h) / 2 - e), 6) ami from mi, ha, hb, chance""",
    "convex_hull": """with p as (select distinct label::VARCHAR set_id, embedding[1]::DOUBLE x, embedding[2]::DOUBLE y from embeddings),
e as (select a.set_id, a.x, a.y, b.x - a.x dx, b.y - a.y dy from p a join p b on a.set_id = b.set_id and (a.x <> b.x or a.y <> b.y)),
r as (select e.*, dx * (p.y - e.y) - dy * (p.x - e.x) side, dx * (p.x - e.x) + dy * (p.y - e.y) along from e join p using (set_id)),
corners as (select set_id, x, y from r group by set_id, x, y, dx, dy having not bool_or(side < 0 or (side = 0 and (along < 0 or along > dx * dx + dy * dy)))),
first as (select *, row_number() over (partition by set_id order by x, y) k from corners)
select c.set_id, row_number() over (partition by c.set_id order by c.k > 1, atan2(c.y - f.y, c.x - f.x)) - 1 corner, c.x, c.y from first c join first f on f.set_id = c.set_id and f.k = 1""",
    "stratified_folds": "select vec_id, label::BIGINT as label, (row_number() over (partition by label order by vec_id) - 1) % 5 fold from embeddings",
}

QUERIES = {
    f.__name__: f
    for f in (
        pairwise_distance, knn_k15, kth_nn_radius, knn_graph_symmetric, intrinsic_dim, null_dims, global_rms_scale, cross_nearest, mst_edges, gap_merges, max_gap, top_k_gaps, fixed_threshold_types, cut_groups, array_union_median,
        dbscan_core_points, knn_vote, threshold_given_nulls, pvalue_given_nulls, n_types_given_nulls, shape_invariance_ratio, hopkins_given_points, gate, gate_many_sets, gate_known_clusters, null_table, group_relative_gaps, hdbscan, gmm_bic, prominences, silverman,
        synthetic_repertoires, repertoire_cloud, convex_hull, hopkins, adjusted_information, detected_calls, call_images, power_by_bin, file_profile, pca_cloud, stratified_folds, grouped_folds, stratified_group_folds, logistic_out_of_fold, umap_layout, umap_neighbours_kept, hdbscan_umap, hopkins_in_space,
    )
}
