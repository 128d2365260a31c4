"""Queries over sequences, contexts, tables of measures and sources (tables events, lineitem, orders, documents and others)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators import scores, sequence, tracks
from lacuna.operators.quantiles import exact_quantiles
from lacuna.plans import context
from lacuna.sources import tables
from lacuna.streaming.sessions import session_events

BY, ORDER = ["user_id"], ["ts", "event_id"]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir):
    return _t(spark, sf_dir, "events")


def _r(c, digits: int = 6):
    return F.round(c, digits)


def _micros(column):
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def prev_label(spark, sf_dir):
    return sequence.previous_label(_events(spark, sf_dir), "event_type", BY, ORDER).select("event_id", "prev")


def run_position(spark, sf_dir):
    return sequence.run_position(_events(spark, sf_dir), "event_type", BY, ORDER).select("event_id", "run_pos")


def position_tercile(spark, sf_dir):
    return sequence.position_tercile(_events(spark, sf_dir), BY, ORDER).select("event_id", "pos_bin")


def recording_quartile(spark, sf_dir):
    return sequence.rank_quartile(_events(spark, sf_dir), ["event_type"], ORDER).select("event_id", "recording")


def value_tertile(spark, sf_dir):
    return sequence.value_tertile(_events(spark, sf_dir), "value").select("event_id", F.col("tertile").cast("long").alias("tertile"))


def _frames(spark, sf_dir):
    return _events(spark, sf_dir).select("user_id", "event_type", "value", _micros("ts").alias("frame")).groupBy("user_id", "frame").agg(F.max("value").alias("value"))


GAP = 6 * 3600 * 1_000_000


def event_islands(spark, sf_dir):
    return sequence.islands(_frames(spark, sf_dir), BY, "frame", GAP).groupBy("user_id", "island").agg(F.min("frame").alias("onset"), F.max("frame").alias("offset"), F.count("*").alias("n"))


def event_islands_filtered(spark, sf_dir):
    out = sequence.sessions(_frames(spark, sf_dir), BY, "frame", "value", GAP, 1_000_000, 40 * GAP, 60.0)
    return out.select("user_id", "island", "onset", "offset", "n_frames", _r("peak").alias("peak"), _r("median_jump").alias("median_jump"))


def jump_filter(spark, sf_dir):
    rows = sequence.jumps(_events(spark, sf_dir), "value", ["user_id", "event_type"], ORDER)
    out = rows.groupBy("user_id", "event_type").agg(F.median("jump").alias("m"), F.count("jump").alias("n"))
    return out.where("n > 0 and m <= 40").select("user_id", "event_type", _r("m").alias("m"), "n")


def session_windows(spark, sf_dir):
    """The streaming form run as a batch."""
    return session_events(_events(spark, sf_dir), gap="6 hours").select("user_id", _micros("onset").alias("onset"), _micros("offset").alias("offset"), "n_frames", _r("peak").alias("peak"))


def top1_per_group(spark, sf_dir):
    return sequence.top_per_group(_events(spark, sf_dir), ["user_id"], [F.desc("value"), F.asc("event_id")]).select("user_id", "event_id", _r("value").alias("value"))


def interp_asof(spark, sf_dir):
    """Each user's values at nine times, two of them beyond the ends, where they are clamped."""
    events = _events(spark, sf_dir).groupBy("user_id", (_micros("ts") / 1e6).alias("x")).agg(F.avg("value").alias("y"))
    grid = events.groupBy("user_id").agg(F.min("x").alias("a"), F.max("x").alias("b")).select("user_id", F.explode(F.expr("transform(sequence(0, 8), k -> cast(a + (b - a) * (k - 1) / 6 as double))")).alias("x")).dropDuplicates()
    out = sequence.interpolated(events, grid, ["user_id"], "x", "y")
    return out.select("user_id", _r("x", 3).alias("x"), _r("y", 4).alias("y"))


def contingency(spark, sf_dir):
    return scores.contingency(_events(spark, sf_dir), "user_id", "event_type")


def crosstab_pivot(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    return scores.crosstab(orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P"]).select("o_orderpriority", *[F.col(c).alias(f"n_{c.lower()}") for c in "FOP"])


def pivot_median(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.median("l_quantity")).select("l_returnflag", F.col("F").alias("med_f"), F.col("O").alias("med_o"))


def _labelled(spark, sf_dir):
    rows = sequence.run_position(_events(spark, sf_dir), "event_type", BY, ORDER)
    rows = sequence.previous_label(rows, "event_type", BY, ORDER)
    rows = sequence.position_tercile(rows, BY, ORDER)
    return rows.withColumn("grp", F.floor(F.col("value") / 25).cast("long"))


def chi2_cramers_v(spark, sf_dir):
    out = scores.chi_square(_labelled(spark, sf_dir), "grp", "run_pos", ["event_type"], 5)
    return out.select("event_type", F.col("n").cast("long").alias("n"), _r("chi2", 5).alias("chi2"), F.col("dof").cast("long").alias("dof"), _r("v").alias("v"))


def chi2_yates(spark, sf_dir):
    rows = _labelled(spark, sf_dir).withColumn("early", F.col("pos_bin") == "early").withColumn("low", F.col("value") < 50)
    out = scores.chi_square(rows, "low", "early", ["event_type"])
    return out.select("event_type", _r("chi2", 5).alias("chi2"), F.col("dof").cast("long").alias("dof"))


def bonferroni(spark, sf_dir):
    rows = _t(spark, sf_dir, "labels").select("doc_id", F.least(F.lit(1.0), (F.col("doc_id") % 97) / 4000.0).alias("p"))
    return scores.bonferroni(rows).select("doc_id", _r("p_bonf", 9).alias("p_bonf"))


def context_tests(spark, sf_dir):
    """All events are one set; its recordings are the quartiles of their order in time, counted day by day."""
    day = F.coalesce(F.to_date("ts"), F.to_date(F.lit("0001-01-01")))
    rows = sequence.rank_quartile(_labelled(spark, sf_dir), [], ORDER, piece=day)
    rows = rows.withColumn("label", F.when(F.col("grp") < 2, "low").otherwise("high")).withColumn("all_", F.lit("x"))
    return context.context_tests(rows, "grp", "label", ["all_"])


def purity_split(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("grp"), F.col("l_returnflag").alias("label"), F.lit("x").alias("s"))
    return context.pure_groups(rows, "grp", "label", ["s"], 10, 0.5).select("grp", "label", "n")


def split_survival(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.lit("x").alias("s"), F.when(F.col("value") < 50, "a").otherwise("b").alias("label"), F.floor(F.col("value") / 12.5).cast("long").alias("before"), F.floor(F.col("value") / 10).cast("long").alias("after"))
    out = context.survival(e, "before", "after", "label", ["s"])
    return out.select("label", "orig_groups", "new_pure_groups", _r("agreement").alias("agreement"), "survives")


def ari(spark, sf_dir):
    return scores.adjusted_rand(_labelled(spark, sf_dir), "grp", "event_type", ["run_pos"]).select("run_pos", _r("ari", 8).alias("ari"))


def mutual_information(spark, sf_dir):
    return scores.mutual_information(_labelled(spark, sf_dir), "grp", "event_type").select(_r("mi", 8).alias("mi"), _r("h_a", 8).alias("h_a"), _r("h_b", 8).alias("h_b"))


def balanced_accuracy(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    return scores.balanced_accuracy(rows.withColumn("guess", F.col("prev")), "event_type", "guess", ["pos_bin"]).select("pos_bin", _r("balanced_accuracy", 8).alias("balanced_accuracy"))


def hit_rate(spark, sf_dir):
    rows = _t(spark, sf_dir, "labels")
    return rows.agg(_r(F.avg((F.col("quality") == 1).cast("double")), 9).alias("rate"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.every(F.col("quality") <= 1).alias("all_small"), F.some(F.col("toxic") > 1).alias("any_large"))


def pass_rule(spark, sf_dir):
    rows = _events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("runs"), F.count_if(F.col("value") < 80).alias("hits"))
    return rows.select("event_type", (F.col("hits") >= F.ceil(0.8 * F.col("runs"))).alias("enough"), (F.col("runs") - F.col("hits") <= F.greatest(F.lit(1), F.floor(0.2 * F.col("runs")))).alias("few_false"))


def misrank_check(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.agg((F.min(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))) <= F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")))).alias("misranked"))


def percentiles_exact(spark, sf_dir):
    q = (0.05, 0.25, 0.5, 0.75, 0.95)
    return _events(spark, sf_dir).groupBy("event_type").agg(*[_r(F.percentile("value", F.lit(x))).alias(f"p{round(100 * x)}") for x in q])


def exploded_quantile_band(spark, sf_dir):
    x = _t(spark, sf_dir, "embeddings").select(F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    low, high = exact_quantiles(x, F.col("x"), [0.01, 0.99])
    return spark.range(1).select(_r(F.lit(low)).alias("lo"), _r(F.lit(high)).alias("hi"))


def nan_skipping_percentiles(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(tables.nan_to_null(F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_extendedprice") / F.col("l_quantity"))).alias("x"))
    low, middle = exact_quantiles(rows, F.col("x"), [0.25, 0.5])
    return rows.agg(_r(F.lit(low).cast("double"), 4).alias("p25"), _r(F.lit(middle).cast("double"), 4).alias("med"), F.count("x").alias("n"))


def named_multi_agg(spark, sf_dir):
    return _t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), _r(F.median("o_totalprice"), 3).alias("med"), _r(F.avg("o_totalprice"), 3).alias("mean"), _r(F.min("o_totalprice"), 3).alias("lo"), _r(F.max("o_totalprice"), 3).alias("hi"))


def value_counts(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


def count_distinct_nonneg(spark, sf_dir):
    rows = _labelled(spark, sf_dir).withColumn("g", F.when(F.col("grp") == 0, -1).otherwise(F.col("grp")))
    return rows.groupBy("user_id").agg(F.countDistinct(F.when(F.col("g") >= 0, F.col("g"))).alias("k"), _r(F.avg((F.col("g") == -1).cast("double")), 8).alias("unassigned"))


def having_min_count(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem")
    keep = rows.groupBy("l_suppkey").agg(F.count("*").alias("n")).where("n >= 600")
    return rows.join(keep, "l_suppkey", "left_semi").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


def categories_with_enough(spark, sf_dir):
    sizes = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return sizes.groupBy("user_id").agg(F.count_if(F.col("n") >= 10).alias("k"))


def null_tolerant_range(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.where(F.col("quality").isNull() | (F.col("quality") >= 1)).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality").isNull()).alias("unlabelled"))


def mode_share(spark, sf_dir):
    n = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    top = sequence.top_per_group(n.join(n.groupBy("user_id").agg(F.sum("n").alias("t")), "user_id"), ["user_id"], [F.desc("n"), F.asc("event_type")])
    return top.select("user_id", F.col("event_type").alias("mode"), _r(F.col("n") / F.col("t"), 9).alias("share"))


def argmin_first(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min(F.struct("l_extendedprice", "l_orderkey", "l_linenumber")).alias("m")).select("l_suppkey", F.col("m.l_orderkey").alias("orderkey"), F.col("m.l_linenumber").cast("long").alias("line"))


def dict_lookup_join(spark, sf_dir):
    names = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    codes = names.select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    return tables.looked_up(_t(spark, sf_dir, "customer"), codes, "c_nationkey").groupBy("r_name", "n_name").agg(F.count("*").alias("n"))


def code_to_name(spark, sf_dir):
    labels = tables.named_codes(_t(spark, sf_dir, "labels"), "quality", ["bad", "good"])
    return labels.select("doc_id", "quality")


def semi_join_isin(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi")
    return rows.where(F.col("lang").isin("en", "de")).select("doc_id", "lang")


def split_from_path(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", tables.split_of(F.concat(F.lit("/data/"), F.element_at(F.array(*[F.lit(x) for x in ("train", "val", "x-test", "other", "valid")]), (F.col("page_id") % 5 + 1).cast("int")), F.lit("/part-"), "page_id", F.lit(".parquet"))).alias("split"))


def signature_predicate(spark, sf_dir):
    up = F.upper("o_orderpriority")
    return _t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).select("o_orderpriority", (up.contains("E") & ~up.contains("NOT")).alias("signature"), F.col("o_orderpriority").startswith("1").alias("first"))


def json_dict_extract(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


def try_cast_numeric(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", F.regexp_replace("p_brand", "[^0-9]", "").try_cast("long").alias("digits"), F.col("p_brand").try_cast("double").alias("nothing"))


def union_frames(spark, sf_dir):
    a = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), "c_mktsegment")
    b = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return tables.all_rows([a, b])


def distinct_pairs(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").dropDuplicates()


def natural_sort(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select("c_name", tables.natural_key(F.col("c_name")).alias("num"))
    return rows.orderBy("num", "c_name")


def with_defaults(spark, sf_dir):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.LongType()), T.StructField("session", T.StringType()), T.StructField("snr_db", T.DoubleType())])
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "quality")
    return tables.with_defaults(rows, schema, {"quality": -1, "session": "unknown"})


def array_mask(spark, sf_dir):
    """Finite, positive elements of two parallel arrays."""
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", F.arrays_zip(F.col("embedding").alias("a"), F.reverse("embedding").alias("b")).alias("z"))
    kept = F.filter("z", lambda p: (p["a"] > 0) & (p["b"] > 0))
    return rows.select("vec_id", F.size(kept).cast("long").alias("kept"), _r(F.aggregate(kept, F.lit(0.0), lambda s, p: s + p["a"].cast("double")), 5).alias("total"))


def weighted_ratio(spark, sf_dir):
    """Edge ratio: mean of first and last lines of an order over the mean of the inner ones."""
    rows = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("q")).where(F.size("q") >= 3)
    first, last = F.col("q")[0]["l_quantity"], F.element_at("q", -1)["l_quantity"]
    inner = F.slice("q", 2, F.size("q") - 2)
    return rows.select("l_orderkey", _r((first + last) / 2 / (F.aggregate(inner, F.lit(0.0), lambda s, x: s + x["l_quantity"]) / F.size(inner))).alias("ratio"))


def elementwise_mean(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return rows.groupBy(F.col("label").cast("long").alias("label"), F.col("pos").cast("long").alias("pos")).agg(_r(F.avg(F.col("x").cast("double"))).alias("m"))


def tracks_cleaned(spark, sf_dir):
    """Each user's events as a contour: time in days, value as frequency."""
    events = _events(spark, sf_dir).where("value > 0")
    rows = events.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct((_micros("ts") / 8.64e10).alias("t"), F.col("value").alias("f")))).alias("p"))
    contours = rows.select("user_id", F.col("p.t").alias("t"), F.col("p.f").alias("f"), F.lit(None).cast("array<double>").alias("conf"), F.lit(30.0).alias("duration"))
    return tracks.clean_tracks(contours, max_gap=3.0, max_rate=25.0, cap=1.0, tol=1.0).select("user_id", F.size("t").alias("n"), "kept_point_frac", "span_frac")


def contour_image(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: k / F.lit(63.0)).alias("t"), F.transform("embedding", lambda x: x.cast("double")).alias("lf"))
    out = tracks.contour_image(rows, 1.2, -0.4, 0.4)
    return out.select("vec_id", F.size("image").alias("n"), F.array_max("image").alias("top"))


_LAB = "lab as (select *, floor(value / 25)::BIGINT grp, coalesce(lag(event_type) over w, 'START') prev, case when count(*) over (partition by user_id) > 1 then (row_number() over w - 1) / (count(*) over (partition by user_id) - 1) else 0 end rel from events window w as (partition by user_id order by ts, event_id)), runs as (select *, sum(case when prev = event_type then 0 else 1 end) over (partition by user_id order by ts, event_id) run from lab), lb as (select *, ['1st', '2nd', '3rd', '4th+'][least(row_number() over (partition by user_id, run order by ts, event_id), 4)] run_pos, ['early', 'middle', 'late'][least(floor(3 * rel), 2)::BIGINT + 1] pos_bin from runs)"
_FR = "fr as (select user_id, epoch_us(ts) frame, max(value) as value from events group by 1, 2), isl as (select *, sum(case when frame - lag_ <= 21600000000 then 0 else 1 end) over (partition by user_id order by frame)::BIGINT island from (select *, lag(frame) over (partition by user_id order by frame) lag_ from fr))"


def _chi(rows: str, group: str, cat: str, least: int) -> str:
    return f"""c0 as (select event_type, {group} g, {cat} c, count(*) n from {rows} group by 1, 2, 3), cell as (select * from (select *, sum(n) over (partition by event_type, c) ct from c0) where ct >= {least}),
r as (select event_type, g, sum(n) r from cell group by 1, 2), k as (select event_type, c, sum(n) c_ from cell group by 1, 2), t as (select event_type, sum(n) t, count(distinct g) nr, count(distinct c) nc from cell group by 1),
x as (select t.*, (nr - 1) * (nc - 1) dof, r * c_ / t e, coalesce(n, 0) o from r join k using (event_type) join t using (event_type) left join cell using (event_type, g, c)),
chi as (select event_type, t, nr, nc, dof, sum(power(abs(o - e) - case when dof = 1 then least(0.5, abs(o - e)) else 0 end, 2) / e) chi2 from x group by all)"""


SQL = {
    "prev_label": "select event_id, coalesce(lag(event_type) over (partition by user_id order by ts, event_id), 'START') prev from events",
    "run_position": f"with {_LAB} select event_id, run_pos from lb",
    "position_tercile": f"with {_LAB} select event_id, pos_bin from lb",
    "recording_quartile": "select event_id, 'Q' || case when n > 1 then greatest(1, ceil(4.0 * (k - 1) / (n - 1)))::INT else 1 end recording from (select event_id, row_number() over (partition by event_type order by ts, event_id) k, count(*) over (partition by event_type) n from events)",
    "value_tertile": "with q as (select quantile_cont(value, 1/3) a, quantile_cont(value, 2/3) b from events) select event_id, case when value <= a then 1 when value <= b then 2 when value is not null then 3 end::BIGINT tertile from events, q",
    "event_islands": f"with {_FR} select user_id, island, min(frame) onset, max(frame) as offset, count(*) n from isl group by 1, 2",
    "event_islands_filtered": f"with {_FR}, j as (select *, abs(value - lag(value) over (partition by user_id, island order by frame)) jump from isl) select user_id, island, min(frame) onset, max(frame) as offset, count(*) n_frames, round(max(value), 6) peak, round(median(jump), 6) median_jump from j group by 1, 2 having max(frame) - min(frame) between 1000000 and 864000000000 and count(jump) > 0 and median(jump) <= 60",
    "jump_filter": "with j as (select user_id, event_type, abs(value - lag(value) over (partition by user_id, event_type order by ts, event_id)) jump from events) select user_id, event_type, round(median(jump), 6) m, count(jump) n from j group by 1, 2 having count(jump) > 0 and median(jump) <= 40",
    "session_windows": f"with {_FR}, cnt as (select user_id, epoch_us(ts) frame, count(*) c from events group by 1, 2) select user_id, min(frame) onset, max(frame) as offset, sum(c)::BIGINT n_frames, round(max(value), 6) peak from isl join cnt using (user_id, frame) group by user_id, island",
    "top1_per_group": "select user_id, event_id, round(value, 6) as value from (select *, row_number() over (partition by user_id order by value desc, event_id) k from events) where k = 1",
    "interp_asof": """with e as (select user_id, epoch_us(ts) / 1e6 x, avg(value) y from events group by 1, 2), g as (select distinct user_id, (a + (b - a) * (k - 1) / 6)::DOUBLE x from (select user_id, min(x) a, max(x) b from e group by 1), range(0, 9) r(k)),
n as (select g.user_id, g.x, (select max(struct_pack(x := e.x, y := e.y)) from e where e.user_id = g.user_id and e.x <= g.x) b, (select min(struct_pack(x := e.x, y := e.y)) from e where e.user_id = g.user_id and e.x >= g.x) a from g)
select user_id, round(x, 3) x, round(case when b.x = n.x then b.y when a is null or b is null then coalesce(b.y, a.y) else b.y + (a.y - b.y) * (n.x - b.x) / (a.x - b.x) end, 4) y from n""",
    "contingency": "select user_id, event_type, count(*) n from events group by 1, 2",
    "crosstab_pivot": "select o_orderpriority, count(*) filter (o_orderstatus = 'F') n_f, count(*) filter (o_orderstatus = 'O') n_o, count(*) filter (o_orderstatus = 'P') n_p from orders group by 1",
    "pivot_median": "select l_returnflag, median(l_quantity) filter (l_linestatus = 'F') med_f, median(l_quantity) filter (l_linestatus = 'O') med_o from lineitem group by 1",
    "chi2_cramers_v": f"with {_LAB}, {_chi('lb', 'grp', 'run_pos', 5)} select event_type, t::BIGINT n, round(chi2, 5) chi2, dof::BIGINT dof, round(case when least(nr, nc) > 1 then sqrt(chi2 / (t * (least(nr, nc) - 1))) end, 6) v from chi",
    "chi2_yates": f"with {_LAB}, {_chi('lb', '(value < 50)', chr(40) + 'pos_bin = ' + chr(39) + 'early' + chr(39) + chr(41), 0)} select event_type, round(chi2, 5) chi2, dof::BIGINT dof from chi",
    "bonferroni": "select doc_id, round(least(least(1.0, (doc_id % 97) / 4000.0)::DOUBLE * (select count(*) from labels), 1.0), 9)::DOUBLE p_bonf from labels",
    "purity_split": "with c as (select l_suppkey grp, l_returnflag as label, count(*) n from lineitem group by 1, 2) select grp, label, n from (select *, n / sum(n) over (partition by grp) s from c) where n >= 10 and s >= 0.5",
    "ari": f"with {_LAB}, c as (select run_pos, grp, event_type, count(*) n from lb group by all), s as (select run_pos, sum(n * (n - 1) / 2) s, sum(n) t from c group by 1), a as (select run_pos, sum(n * (n - 1) / 2) sa from (select run_pos, grp, sum(n) n from c group by 1, 2) group by 1), b as (select run_pos, sum(n * (n - 1) / 2) sb from (select run_pos, event_type, sum(n) n from c group by 1, 2) group by 1) select run_pos, round((s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 8) ari from s join a using (run_pos) join b using (run_pos)",
    "mutual_information": f"with {_LAB}, c as (select grp, event_type, count(*) n from lb group by all), t as (select sum(n)::DOUBLE t from c), a as (select grp, sum(n)::DOUBLE na from c group by 1), b as (select event_type, sum(n)::DOUBLE nb from c group by 1) select round((select sum(n / t * ln(n * t / (na * nb))) from c join a using (grp) join b using (event_type), t), 8) mi, round((select -sum(na / t * ln(na / t)) from a, t), 8) h_a, round((select -sum(nb / t * ln(nb / t)) from b, t), 8) h_b",
    "balanced_accuracy": f"with {_LAB} select pos_bin, round(avg(r), 8) balanced_accuracy from (select pos_bin, event_type, avg((event_type = prev)::INT::DOUBLE) r from lb group by 1, 2) group by 1",
    "hit_rate": "select round(avg((quality = 1)::INT::DOUBLE), 9) rate, count(*) filter (toxic = 1) toxic, bool_and(quality <= 1) all_small, bool_or(toxic > 1) any_large from labels",
    "pass_rule": "select event_type, hits >= ceil(0.8 * runs) enough, runs - hits <= greatest(1, floor(0.2 * runs)) few_false from (select event_type, count(*) runs, count(*) filter (value < 80) hits from events group by 1)",
    "misrank_check": "select min(o_totalprice) filter (o_orderstatus = 'O') <= max(o_totalprice) filter (o_orderstatus = 'F') misranked from orders",
    "percentiles_exact": "select event_type, " + ", ".join(f"round(quantile_cont(value, {x}), 6) p{round(100 * x)}" for x in (0.05, 0.25, 0.5, 0.75, 0.95)) + " from events group by 1",
    "exploded_quantile_band": "with x as (select unnest(embedding)::DOUBLE x from embeddings) select round(quantile_cont(x, 0.01), 6) lo, round(quantile_cont(x, 0.99), 6) hi from x",
    "nan_skipping_percentiles": "with x as (select case when l_discount <> 0 then l_extendedprice / l_quantity end x from lineitem) select round(quantile_cont(x, 0.25), 4) p25, round(median(x), 4) med, count(x) n from x",
    "named_multi_agg": "select o_orderpriority, count(*) n, round(median(o_totalprice), 3) med, round(avg(o_totalprice), 3) mean, round(min(o_totalprice), 3) lo, round(max(o_totalprice), 3) hi from orders group by 1",
    "value_counts": "select source, count(*) n from documents group by 1 order by n desc, source",
    "count_distinct_nonneg": "with g as (select user_id, case when floor(value / 25) = 0 then -1 else floor(value / 25) end g from events) select user_id, count(distinct case when g >= 0 then g end) k, round(avg((g = -1)::INT::DOUBLE), 8) unassigned from g group by 1",
    "having_min_count": "select l_suppkey, count(*) n, sum(l_quantity) qty from lineitem group by 1 having count(*) >= 600",
    "categories_with_enough": "select user_id, count(*) filter (n >= 10) k from (select user_id, event_type, count(*) n from events group by 1, 2) group by 1",
    "null_tolerant_range": "select lang, count(*) n, count(*) filter (quality is null) unlabelled from documents left join labels using (doc_id) where quality is null or quality >= 1 group by 1",
    "mode_share": "with c as (select user_id, event_type, count(*) n from events group by 1, 2) select user_id, event_type as mode, round(n / t, 9) share from (select *, sum(n) over (partition by user_id) t, row_number() over (partition by user_id order by n desc, event_type) k from c) where k = 1",
    "argmin_first": "select l_suppkey, l_orderkey orderkey, l_linenumber::BIGINT line from (select *, row_number() over (partition by l_suppkey order by l_extendedprice, l_orderkey, l_linenumber) k from lineitem) where k = 1",
    "dict_lookup_join": "select r_name, n_name, count(*) n from customer left join (nation join region on n_regionkey = r_regionkey) on c_nationkey = n_nationkey group by 1, 2",
    "code_to_name": "select doc_id, case quality when 0 then 'bad' when 1 then 'good' end quality from labels",
    "semi_join_isin": "select doc_id, lang from documents where doc_id in (select doc_id from labels where toxic = 1) and lang in ('en', 'de')",
    "split_from_path": "select page_id, ['train', 'validation', 'unknown', 'unknown', 'validation'][page_id % 5 + 1] split from pages",
    "signature_predicate": "select o_orderpriority, upper(o_orderpriority) like '%E%' and upper(o_orderpriority) not like '%NOT%' as signature, o_orderpriority like '1%' as first from orders group by 1",
    "json_dict_extract": "select event_id, (props::JSON ->> 'k')::BIGINT k from events",
    "try_cast_numeric": "select p_partkey, try_cast(regexp_replace(p_brand, '[^0-9]', '', 'g') as BIGINT) digits, try_cast(p_brand as DOUBLE) nothing from part",
    "union_frames": "select c_custkey as key, c_name as name, c_mktsegment from customer union all select s_suppkey, s_name, null from supplier",
    "distinct_pairs": "select distinct l_partkey, l_suppkey from lineitem",
    "natural_sort": "select c_name, try_cast(regexp_replace(c_name, '[^0-9]', '', 'g') as BIGINT) num from customer order by num, c_name",
    "with_defaults": "select doc_id, coalesce(quality, -1)::BIGINT quality, 'unknown' as session, null::DOUBLE snr_db from documents left join labels using (doc_id)",
    "array_mask": "with z as (select vec_id, unnest(embedding) a, unnest(list_reverse(embedding)) b from embeddings) select vec_id, count(*) filter (a > 0 and b > 0) kept, round(coalesce(sum(a::DOUBLE) filter (a > 0 and b > 0), 0), 5) total from z group by 1",
    "weighted_ratio": "with q as (select l_orderkey, list(l_quantity order by l_linenumber, l_quantity) q from lineitem group by 1 having count(*) >= 3) select l_orderkey, round((q[1] + q[-1]) / 2 / list_avg(q[2:-2]), 6) ratio from q",
    "elementwise_mean": "with x as (select label::BIGINT as label, unnest(embedding)::DOUBLE x, unnest(range(64)) pos from embeddings) select label, pos, round(avg(x), 6) m from x group by 1, 2",
    "split_survival": """with e as (select case when value < 50 then 'a' else 'b' end as label, floor(value / 12.5)::BIGINT b, floor(value / 10)::BIGINT a from events),
pb as (select b, label, n from (select b, label, count(*) n, sum(count(*)) over (partition by b) t from e where b >= 0 group by 1, 2) where n >= 10 and n / t >= 0.8), pa as (select a, label, n from (select a, label, count(*) n, sum(count(*)) over (partition by a) t from e where a >= 0 group by 1, 2) where n >= 10 and n / t >= 0.8),
old as (select label, b from pb where label in (select label from pb group by 1 having count(*) >= 2)),
rows_ as (select e.* from e where (label, b) in (select label, b from old) and (label, a) in (select label, a from pa)),
c as (select label, a, b, count(*) n from rows_ group by 1, 2, 3), s as (select label, sum(n * (n - 1) / 2) s, sum(n) t from c group by 1), sa as (select label, sum(n * (n - 1) / 2) sa from (select label, a, sum(n) n from c group by 1, 2) group by 1), sb as (select label, sum(n * (n - 1) / 2) sb from (select label, b, sum(n) n from c group by 1, 2) group by 1),
ari as (select label, (s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)) ari from s join sa using (label) join sb using (label)),
o as (select label, count(*) orig_groups from old group by 1), w as (select label, count(*) new_pure_groups from pa group by 1)
select label, orig_groups, coalesce(new_pure_groups, 0) new_pure_groups, round(ari, 6) agreement, coalesce(new_pure_groups >= 2 and ari >= 0.5, false) survives from o left join w using (label) left join ari using (label)""",
}

QUERIES = {
    f.__name__: f
    for f in (
        prev_label, run_position, position_tercile, recording_quartile, value_tertile, event_islands, event_islands_filtered, jump_filter, session_windows, top1_per_group, interp_asof, contingency, crosstab_pivot, pivot_median, chi2_cramers_v, chi2_yates, bonferroni, context_tests, purity_split, split_survival, ari, mutual_information,
        balanced_accuracy, hit_rate, pass_rule, misrank_check, percentiles_exact, exploded_quantile_band, nan_skipping_percentiles, named_multi_agg, value_counts, count_distinct_nonneg, having_min_count, categories_with_enough, null_tolerant_range, mode_share, argmin_first, dict_lookup_join, code_to_name, semi_join_isin, split_from_path,
        signature_predicate, json_dict_extract, try_cast_numeric, union_frames, distinct_pairs, natural_sort, with_defaults, array_mask, weighted_ratio, elementwise_mean, tracks_cleaned, contour_image,
    )
}
