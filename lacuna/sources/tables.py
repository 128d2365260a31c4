"""Parquet and CSV with fixed schemas and defaults, path splits, class dictionaries and file profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Whistle contours as the cleaning expects them.
CONTOURS = T.StructType(
    [
        T.StructField("split", T.StringType()), T.StructField("t", T.ArrayType(T.DoubleType())), T.StructField("f", T.ArrayType(T.DoubleType())), T.StructField("conf", T.ArrayType(T.DoubleType())), T.StructField("f0_ok", T.BooleanType()),
        T.StructField("main_category", T.StringType()), T.StructField("whistle_type", T.LongType()), T.StructField("whistle_name", T.StringType()), T.StructField("session", T.StringType()), T.StructField("snr_db", T.DoubleType()), T.StructField("duration", T.DoubleType()),
    ]
)
#: What an absent column, or a null in it, stands for. A null f0_ok is bad; an absent column means all are good.
CONTOUR_DEFAULTS = {"whistle_type": -1, "whistle_name": "", "session": "unknown"}


def read_wanted(spark: SparkSession, path: str, wanted: list[str], recursive: bool = True) -> DataFrame:
    """The wanted columns that are there, of all Parquet files under the path; others aren't read."""
    df = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.parquet").parquet(path)
    return df.select(*[c for c in wanted if c in df.columns])


def with_defaults(df: DataFrame, schema: T.StructType, defaults: dict | None = None, absent: dict | None = None) -> DataFrame:
    """df in this schema: absent columns are ``absent``'s value or the default; nulls are the default; NaN becomes null."""
    defaults, absent = defaults or {}, absent or {}
    out = []
    for f in schema:
        if f.name not in df.columns:
            value = F.lit(absent.get(f.name, defaults.get(f.name))).cast(f.dataType)
        else:
            value = F.col(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                value = nan_to_null(value.try_cast(f.dataType))
            else:
                value = value.try_cast(f.dataType)
            if f.name in defaults:
                value = F.coalesce(value, F.lit(defaults[f.name]).cast(f.dataType))
        out.append(value.alias(f.name))
    return df.select(*out)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def split_of(path: Column) -> Column:
    """train, validation, test or unknown: from the file name, else from a directory of that name; valid and val are validation."""
    found = F.regexp_extract(F.lower(F.element_at(F.split(path, "/"), -1)), r"(train|validation|valid|val|test)", 1)
    folder = F.regexp_extract(F.lower(path), r"/(train|validation|valid|val|test)/", 1)
    name = F.when(found != "", found).otherwise(folder)
    return F.when(name.isin("valid", "val"), "validation").when(name == "", "unknown").otherwise(name)


def parquet_with_split(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """Rows of all files with the split that their path names."""
    return read_wanted(spark, path, wanted).select("*", split_of(F.col("_metadata.file_path")).alias("split"))


def class_names(metadata: str, column: str) -> list[str]:
    """Names of a ClassLabel column in a dataset's JSON metadata; none if it has none."""
    import json

    feature = json.loads(metadata or "{}").get("info", {}).get("features", {}).get(column, {})
    return list(feature.get("names", []))


def class_names_of(column: Column, feature: str) -> Column:
    """The same as a column expression over JSON strings."""
    return F.from_json(F.get_json_object(column, f"$.info.features.{feature}.names"), "array<string>")


def named_codes(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Codes from 0 on as names; a code without one becomes null. Only whole-number columns are changed."""
    if not isinstance(df.schema[column].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) or not names:
        return df
    at = F.when(F.col(column) >= 0, F.get(F.array(*[F.lit(x) for x in names]), F.col(column).cast("int")))
    return df.withColumn(column, at)


def looked_up(df: DataFrame, codes: DataFrame, on: str) -> DataFrame:
    """A left join with a dictionary table; Spark broadcasts it if it is small."""
    return df.join(codes, on, "left")


def _footer_rows(spark: SparkSession, paths: list[str], rows_of, schema: str, whole: bool = False) -> DataFrame:
    """``rows_of(path, length, footer)`` for each Parquet file; only the footer's bytes are read. ``whole`` hands over the open file instead.

    The paths are opened by pyarrow's file systems, which know local and common remote ones.
    """
    import pandas as pd
    import pyarrow.parquet as pq
    from pyarrow import fs

    names = schema.replace(",", " ").split()[::2]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(paths).select("path", "length")

    def run(batches):
        for batch in batches:
            for path, length in zip(batch["path"], batch["length"], strict=True):
                system, inner = fs.FileSystem.from_uri(path)
                with system.open_input_file(inner) as f:
                    file = pq.ParquetFile(f)
                    made = rows_of(path, length, file if whole else file.metadata)
                    yield pd.DataFrame(made, columns=names, dtype=object)

    count = files.count()
    return files.repartition(max(1, min(count, 1000))).mapInPandas(run, schema)


def profile(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(column, compressed, values) of Parquet files by their footers; largest first."""

    def rows_of(path, length, meta):
        chunks = [meta.row_group(g).column(c) for g in range(meta.num_row_groups) for c in range(meta.num_columns)]
        return [(c.path_in_schema.split(".")[0], c.total_compressed_size, c.num_values) for c in chunks]

    rows = _footer_rows(spark, paths, rows_of, "column string, compressed long, values long")
    return rows.groupBy("column").agg(F.sum("compressed").alias("compressed"), F.sum("values").alias("values")).orderBy(F.desc("compressed"), "column")


def footers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, rows, bytes, row_groups, info) of Parquet files: ``info`` is the JSON that a dataset keeps with its schema, or null."""

    def rows_of(path, length, meta):
        info = (meta.metadata or {}).get(b"huggingface")
        return [(path, meta.num_rows, length, meta.num_row_groups, info.decode() if info else None)]

    return _footer_rows(spark, paths, rows_of, "path string, rows long, bytes long, row_groups long, info string")


def with_payload(df: DataFrame, column: str) -> DataFrame:
    """The rows whose payload isn't null."""
    return df.where(F.col(column).isNotNull())


def peek(df: DataFrame, column: str, rows: int = 3, magic: str = "RIFF", most_bytes: int = 300_000_000) -> DataFrame:
    """The first rows' payload sizes and whether they begin with the magic bytes; payloads above ``most_bytes`` aren't looked into."""
    df = df.withColumn(column, F.when(F.length(column) <= most_bytes, F.col(column)))
    return df.limit(rows).select(F.length(column).alias("bytes"), (F.substring(column, 1, len(magic)) == F.lit(magic).cast("binary")).alias("is_magic"))


def peek_files(spark: SparkSession, paths: list[str], column: str, rows: int = 3, magic: str = "RIFF", most_bytes: int = 300_000_000) -> DataFrame:
    """(path, rows, group_bytes, bytes, is_magic): of each Parquet file its rows, the bytes of the column in its first row group and its first payloads.

    The footer says how large the row group's column is before anything of it is read; above ``most_bytes`` it isn't, and ``bytes`` and
    ``is_magic`` are null, as for a null payload or a file without rows. ``column`` may be nested (``audio.bytes``).
    """

    def rows_of(path, length, file):
        meta = file.metadata
        none = [(path, meta.num_rows, None, None, None)]
        if not meta.num_row_groups:
            return none
        chunks = [meta.row_group(0).column(c) for c in range(meta.num_columns)]
        size = sum(c.total_uncompressed_size for c in chunks if c.path_in_schema == column)
        if size > most_bytes:
            return [(path, meta.num_rows, size, None, None)]
        batch = next(file.iter_batches(rows, row_groups=[0], columns=[column]), None)
        if batch is None or not batch.num_columns:
            return none
        values = batch.column(0)
        for part in column.split(".")[1:]:
            values = values.field(part)
        heads = [(None, None) if v is None else (len(v), v[: len(magic)] == magic.encode()) for v in values.to_pylist()]
        return [(path, meta.num_rows, size, *head) for head in heads] or none

    return _footer_rows(spark, paths, rows_of, "path string, rows long, group_bytes long, bytes long, is_magic boolean", whole=True)


def natural_key(name: Column) -> Column:
    """Names by the number that their digits make."""
    return F.regexp_replace(name, "[^0-9]", "").try_cast("long")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(extension, files, bytes) under a path, from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.groupBy(ext.alias("extension")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV with a header in a given schema: labels stay strings, nothing is inferred."""
    return spark.read.schema(schema).option("header", True).option("nanValue", "nan").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV with a header, a part for each partition."""
    df.write.mode("overwrite").option("header", True).csv(path)


def all_rows(frames: list[DataFrame]) -> DataFrame:
    """Rows of frames with different columns under each other; what one lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
