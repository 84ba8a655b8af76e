"""Readers: dataset files by extension, checks on folders and files, metric and poll logs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.schema import NON_BLANK

# File extension -> reader.
EXTENSION_FORMAT = {
    "arrow": "arrow",
    "csv": "csv",
    "json": "json",
    "jsonl": "json",
    "parquet": "parquet",
    "txt": "text",
}


def format_of(path: str) -> str:
    fmt = EXTENSION_FORMAT.get(path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "")
    if fmt is None:
        raise ValueError("File extension must be txt, csv, json or jsonl.")
    return fmt


def _listing(spark: SparkSession, path: str) -> DataFrame:
    # Only names are read: file contents are pruned from the scan.
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length", F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1).alias("ext"))
    )


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Files with the format their extension stands for (NULL when unknown)."""
    mapping = F.create_map(*[F.lit(x) for pair in EXTENSION_FORMAT.items() for x in pair])
    return _listing(spark, path).withColumn("fmt", F.try_element_at(mapping, F.lower("ext")))


def check_homogeneous(spark: SparkSession, path: str) -> str:
    """SRC-02: the one format of all files below ``path``; an error when they differ or it is unknown."""
    formats = [r[0] for r in file_manifest(spark, path).select("fmt").distinct().limit(2).collect()]
    if not formats:
        raise ValueError(f"no files below {path}")
    if len(formats) > 1:
        raise ValueError(f"files of more than one format below {path}")
    if formats[0] is None:
        raise ValueError("File extension must be txt, csv, json or jsonl.")
    return formats[0]


def _json_arrays(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Files that hold one array, and files of a row per line: by the first character of each that is not blank."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    # rows of a file's first block come in order within their task
    first = lines.where("file_block_start = 0 AND trim(value) <> ''").withColumn("at", F.monotonically_increasing_id())
    heads = first.groupBy("file_path").agg(F.min_by(F.substring(F.ltrim("value"), 1, 1), "at").alias("head")).collect()
    arrays = sorted(r["file_path"] for r in heads if r["head"] == "[")
    return arrays, sorted(r["file_path"] for r in heads if r["head"] != "[")


def read_dataset(
    spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None, multi_line: bool = True
) -> DataFrame:
    """SRC-01: a file or folder; the extension picks the reader. Text gives one ``text`` column, one row per line.

    JSON files may each be an array or a row per line.  ``multi_line`` allows line breaks inside CSV values; without, CSV
    files are split among tasks.  CSV without ``schema`` is read once more to infer it.
    """
    if fmt is None:
        name = path.rstrip("/").rsplit("/", 1)[-1]
        known = "." in name and name.rsplit(".", 1)[-1].lower() in EXTENSION_FORMAT
        fmt = format_of(name) if known else check_homogeneous(spark, path)
    elif fmt not in EXTENSION_FORMAT.values():
        raise ValueError("File extension must be txt, csv, json or jsonl.")
    if fmt == "text":
        return spark.read.text(path).withColumnRenamed("value", "text")
    if fmt == "arrow":
        return read_arrow(spark, path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        return reader.csv(path, header=True, multiLine=multi_line, quote='"', escape='"', inferSchema=schema is None)
    if fmt == "json":
        arrays, lines = _json_arrays(spark, path)
        if not arrays or not lines:
            return reader.json(path, multiLine=bool(arrays))
        return reader.json(arrays, multiLine=True).unionByName(reader.json(lines, multiLine=False), allowMissingColumns=True)
    return reader.parquet(path)


def _open_arrow(content: bytes):
    try:
        return pa.ipc.open_file(pa.BufferReader(content))
    except pa.ArrowInvalid:
        return pa.ipc.open_stream(pa.BufferReader(content))


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files, one file per task; the schema comes from the first file's header."""
    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array([_open_arrow(content.as_py()).schema.serialize().to_pybytes()])], ["h"])

    first = files.select("content").limit(1).mapInArrow(header, "h binary").first()
    if first is None:
        raise ValueError(f"no files below {path}")
    schema = from_arrow_schema(pa.ipc.read_schema(pa.BufferReader(first["h"])))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                reader = _open_arrow(content.as_py())
                if isinstance(reader, pa.ipc.RecordBatchStreamReader):
                    yield from reader
                else:
                    for i in range(reader.num_record_batches):
                        yield reader.get_batch(i)

    return files.select("content").mapInArrow(rows, schema)


def checksum_status(files: DataFrame, registry: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """SRC-03: per dataset ok / missing hash / too many files / mismatch; problems are a status, not an error."""
    hashed = files.groupBy(name).agg(F.count(F.lit(1)).alias("n_files"), F.max(F.sha1(content)).alias("sha1"))
    joined = hashed.join(registry.select(name, "file_sha1"), name, "left")
    return joined.withColumn(
        "status",
        F.when(F.col("file_sha1").isNull(), "missing hash")
        .when(F.col("n_files") != 1, "too many files")
        .when(F.col("sha1") != F.col("file_sha1"), "mismatch")
        .otherwise("ok"),
    )


def verify_checksums(spark: SparkSession, path: str, registry: DataFrame) -> DataFrame:
    """SRC-03 on files: the dataset of a file is the registry entry with its file name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "content")
    return checksum_status(named, registry, "file_name")


def select_split(df: DataFrame, split: str, column: str = "split") -> DataFrame:
    """SRC-07: rows of one split, subset or folder; on a table partitioned by it only its files are read."""
    return df.where(F.col(column) == split)


def read_kv_metrics(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: ``key=value`` lines as (source, metric, value)."""
    return kv_metrics(spark.read.text(path).withColumn("source", F.input_file_name()))


def kv_metrics(lines: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    rows = lines.where(F.instr("value", "=") > 0)
    return rows.select(
        *keys,
        F.split_part("value", F.lit("="), F.lit(1)).alias("metric"),
        F.split_part("value", F.lit("="), F.lit(2)).try_cast("double").alias("value"),
    )


def perf_rows(lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """SRC-12: ``used, free, total`` lines without header; blanks around fields do not count."""

    def part(i: int) -> Column:
        return F.regexp_replace(F.split_part("value", F.lit(","), F.lit(i)), " ", "").try_cast("double")

    return lines.select(*keys, part(1).alias("used"), part(2).alias("free"), part(3).alias("total"))


def read_perf_log(spark: SparkSession, path: str) -> DataFrame:
    return perf_rows(spark.read.text(path).withColumn("source", F.input_file_name()), ["source"])


def inspect(df: DataFrame, text: str) -> DataFrame:
    """SRC-13: entries, non-blank entries, characters in total and on average."""
    return df.agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(F.col(text).rlike(NON_BLANK)).alias("non_empty"),
        F.sum(F.length(text).cast("long")).alias("total_chars"),
        F.try_divide(F.sum(F.length(text)), F.count(F.lit(1))).alias("avg_chars"),
    )


def inspect_head(df: DataFrame, order: str, text: str, n: int = 10, width: int = 80) -> DataFrame:
    """SRC-13: the first n entries with their size and a prefix for display."""
    head = df.orderBy(order).limit(n)
    return head.select(order, F.length(text).alias("chars"), F.substring(text, 1, width).alias("prefix"))
