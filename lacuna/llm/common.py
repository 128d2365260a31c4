"""What several operators share: the word pattern, checkpoints in the shared folder, ranks and running sums without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text as a long; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def n_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text as a long; null: 0."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Where none is set, a local session (as in tests) gets one under the warehouse; on a cluster that is an error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: what follows survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows written to ``path`` in the shared folder and read again.

    For rounds of joins: a checkpoint keeps the sizes Spark has estimated, which multiply from round to round, and a table has its own.
    """
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of df is called so (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(names: list[str]) -> list[str]:
    """Column names for ``select`` and the like, whatever characters they hold."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def unit_hash(seed: str, *columns: Column) -> Column:
    """A number in [0, 1) fixed by the seed and the columns (null counts as a value of its own): 52 bits of MD5."""
    parts = [F.coalesce(c.cast("string"), F.lit("\0")) for c in columns]
    digest = F.md5(F.concat_ws("|", F.lit(seed), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def running(df: DataFrame, group: list[str], unit: str, ties: list[str], sums: dict[str, str], rows: int, bucket_rows: int = 4000) -> DataFrame:
    """Adds, for each output name of ``sums``, the running total of its column before the row, within ``group`` by (unit, ties).

    ``unit`` lies in [0, 1) and cuts each group into buckets of about ``bucket_rows`` of the ``rows`` in all. Totals of the
    buckets are made with map-side sums, and only the rows of one bucket meet in a task, however large the group. Rows of equal
    ``unit`` share a bucket: give one that tells all rows apart (``told_apart``). The input is read twice; give it saved.
    """
    buckets = max(1, -(-rows // bucket_rows))
    cut = df.withColumn("_bucket", F.least(F.floor(F.col(unit) * buckets), F.lit(buckets - 1)).cast("long"))
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("\0")).alias(f"_key{i}") for i, g in enumerate(group)] or [F.lit("").alias("_key0")]
    names = [f"_key{i}" for i in range(len(keys))]
    cut = cut.select("*", *keys)
    totals = cut.groupBy(*names, "_bucket").agg(*[F.sum(c).alias(f"_sum_{o}") for o, c in sums.items()])
    before = Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*names, "_bucket", *[F.coalesce(F.sum(f"_sum_{o}").over(before), F.lit(0)).alias(f"_off_{o}") for o in sums])
    within = Window.partitionBy(*names, "_bucket").orderBy(unit, *ties).rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_in_{o}") for o, c in sums.items()])
    out = inside.join(offsets, [*names, "_bucket"])
    return out.select(*quoted(df.columns), *[(F.col(f"_in_{o}") + F.col(f"_off_{o}")).alias(o) for o in sums])


#: A table may be broadcast if its rows, as counted, hold at most so many bytes.
BROADCAST_BYTES = 32_000_000
#: Beyond that, the rows of the large side are dealt over so many copies of the small side's row.
SALTS = 16


def table_bytes(df: DataFrame) -> int:
    """Bytes of a table of numbers, strings and arrays of numbers: counted from its rows, not estimated."""
    sizes = []
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            sizes.append(F.coalesce(F.octet_length(f.name), F.lit(0)) + 16)
        elif kind == "array":
            sizes.append(8 * F.greatest(F.size(f.name), F.lit(0)) + 16)
        else:
            sizes.append(F.lit(16))
    return int(df.agg(F.coalesce(F.sum(sum(sizes, F.lit(16)).cast("long")), F.lit(0))).first()[0])


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", most: int = BROADCAST_BYTES, size: int | None = None) -> DataFrame:
    """``rows`` joined (null keys meet null keys) with ``table``, which has one row a key: a hot key never makes one large task.

    A table of at most ``most`` counted bytes is broadcast. A larger one goes along ``SALTS`` times, and the rows of each key are
    dealt over its copies. ``how`` is inner, left, left_semi or left_anti; ``rows`` keeps its columns, ``table`` adds those that aren't keys.
    Where the bytes of a saved table are known they are given as ``size``.
    """
    table = saved(table) if size is None else table
    mine = {k: free_name(rows, f"_of_{k}") for k in keys}
    right = table.select(*[F.col(q).alias(mine.get(k, k)) for k, q in zip(table.columns, quoted(table.columns), strict=True)])
    match = None
    for k in keys:
        same = rows[k].eqNullSafe(right[mine[k]])
        match = same if match is None else match & same
    if (table_bytes(table) if size is None else size) <= most:
        return rows.join(F.broadcast(right), match, how).drop(*mine.values())
    salt, other = free_name(rows, "_salt"), free_name(rows, "_salted")
    left = rows.withColumn(salt, F.pmod(F.xxhash64(*quoted(rows.columns)), F.lit(SALTS)).cast("int"))
    right = right.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    match = left[salt] == right[other]
    for k in keys:
        match = match & left[k].eqNullSafe(right[mine[k]])
    return left.join(right, match, how).drop(salt, other, *mine.values())


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Numbers (from 0, in ``name``) the rows that are equal in ``keys``; no task gets all rows of a key.

    The rows are saved; each is numbered among those of its key in its own saved partition, after the counts of the partitions before.
    """
    part, at, before = (free_name(rows, c) for c in ("_part", "_at", "_before"))
    kept = saved(rows)
    kept = kept.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id())
    counts = kept.groupBy(*keys, part).agg(F.count("*").alias(before))
    counts = counts.withColumn(before, F.coalesce(F.sum(before).over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = kept.withColumn(name, F.row_number().over(Window.partitionBy(*keys, part).orderBy(at)) - 1)
    mine = {k: free_name(own, f"_of_{k}") for k in [*keys, part]}
    counts = counts.select(*[F.col(k).alias(v) for k, v in mine.items()], before)
    match = None
    for k, v in mine.items():
        same = own[k].eqNullSafe(counts[v])
        match = same if match is None else match & same
    return own.join(counts, match).withColumn(name, (F.col(name) + F.col(before)).cast("long")).select(*quoted(rows.columns), name)


def told_apart(rows: DataFrame, keys: list[str], name: str, among: list[str] | None = None) -> DataFrame:
    """``rows``, which are saved, with a number in ``name``: null where no other row is equal in ``keys``, else from 0 among those equal in ``among``.

    ``among`` are the keys unless given. Which of several rows that are equal in ``among`` has which number follows from where they lie; the
    numbers as a whole don't.
    """
    count = free_name(rows, "_count")
    often = saved(rows.groupBy(*keys).agg(F.count("*").alias(count)).where(F.col(count) > 1).drop(count))
    alone = rows.withColumn(name, F.lit(None).cast("long"))
    size = table_bytes(often)
    if not size:
        return alone
    again = numbered(looked_up(rows, often, keys, "left_semi", size=size), among or keys, name)
    return saved(looked_up(alone, often, keys, "left_anti", size=size).unionByName(again))
