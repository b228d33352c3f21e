"""Reading the star schema from text and binary column files, and writing results."""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {"int": T.LongType(), "str": T.StringType(), "bool": T.BooleanType(), "date": T.DateType()}


def parse_schema(text: str) -> dict[str, T.StructType]:
    """``table:col(type),...;`` for each table; names without an underscore, such as fillers, are left out."""
    out = {}
    for line in filter(str.strip, text.split(";")):
        table, columns = line.strip().split(":", 1)
        out[table.strip()] = T.StructType([T.StructField(c, TYPES[t]) for c, t in re.findall(r"(\w+_\w+)\((\w+)\)", columns)])
    return out


def read_tbl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Text with ``|`` between and after values, dates as yyyyMMdd; blank lines and those that begin with ``#`` or ``//`` don't count."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#") & ~F.col("value").startswith("//"))
    parts = F.split("value", r"\|")
    columns = []
    for i, f in enumerate(schema.fields):
        c = F.get(parts, F.lit(i))
        if isinstance(f.dataType, T.DateType):
            c = F.to_date(c, "yyyyMMdd")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int") != 0
        else:
            c = c.cast(f.dataType)
        columns.append(c.alias(f.name))
    return lines.select(*columns)


PIECE = 1 << 17  # values in one record of a column's pieces


def _unpack(kind: str):
    dtype = np.dtype("<i1" if kind == "bool" else "<i8")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, content in zip(b.column("pos").to_pylist(), b.column("content"), strict=True):
                values = np.frombuffer(content.as_buffer(), dtype=dtype).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(values))), pa.array(values)], names=["pos", "value"])

    return unpack


def _pieces(spark: SparkSession, path: str, width: int) -> DataFrame:
    """``pos, content``: a file of values of ``width`` bytes in pieces. Tasks read byte ranges, so a file may have any size."""
    values = spark.sparkContext.binaryRecords(path, width)
    counts = dict(values.mapPartitionsWithIndex(lambda i, rows: [(i, sum(1 for _ in rows))]).collect())  # one number a range
    starts, at = {}, 0
    for i in sorted(counts):
        starts[i], at = at, at + counts[i]

    def pack(i: int, rows: Iterator[bytes]) -> Iterator[tuple[int, bytearray]]:
        pos = starts[i]
        while part := list(islice(rows, PIECE)):
            yield pos, bytearray(b"".join(part))
            pos += len(part)

    return spark.createDataFrame(values.mapPartitionsWithIndex(pack), "pos long, content binary")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``word, code`` of a dictionary file: codes are gapless from 0, NULL first, then the words in byte order. Others are refused."""
    code = F.substring_index("value", "\t", -1)
    words = spark.read.text(path).select(F.substring("value", F.lit(1), F.length("value") - F.length(code) - 1).alias("word"), code.cast("long").alias("code"))
    shape = words.agg(F.count("*").alias("n"), F.count_distinct("code").alias("codes"), F.min("code").alias("low"), F.max("code").alias("high"), F.min_by("word", "code").alias("first")).first()
    if shape.n and not (shape.n == shape.codes == shape.high + 1 and shape.low == 0 and shape["first"] == "NULL"):
        raise ValueError(f"{path}: codes are not gapless from NULL at 0")
    # neighbours by code, joined by key, so that no window sorts all words in one task
    after = words.select((F.col("code") - 1).alias("code"), F.col("word").alias("next"))
    if not words.where("code > 0").join(after, "code").where(F.col("word") >= F.col("next")).isEmpty():
        raise ValueError(f"{path}: codes do not follow the order of the words")
    return words


def read_binary_column(spark: SparkSession, folder: str, table: str, column: str, kind: str) -> DataFrame:
    """``pos, <column>`` from a little-endian column file; strings through the dictionary file beside it."""
    path = f"{folder}/{table}/{column}"
    raw = _pieces(spark, f"{path}.bin", 1 if kind == "bool" else 8).mapInArrow(_unpack(kind), "pos long, value long")
    if kind == "str":
        words = read_dictionary(spark, f"{path}_dict.tsv")
        return raw.join(words, raw.value == words.code).select("pos", F.col("word").alias(column))
    value = {"date": F.to_date(F.timestamp_seconds("value")), "bool": F.col("value") != 0}.get(kind, F.col("value"))
    return raw.select("pos", value.alias(column))


def read_binary_table(spark: SparkSession, folder: str, table: str, schema: T.StructType) -> DataFrame:
    """All columns side by side by position. For import only: write the result as Parquet and read that."""
    kinds = {type(v): k for k, v in TYPES.items()}
    frames = [read_binary_column(spark, folder, table, f.name, kinds[type(f.dataType)]) for f in schema.fields]
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, "pos")
    return out.drop("pos")


def load_tables(spark: SparkSession, folder: str, kind: str, views: bool = False) -> dict[str, DataFrame]:
    """All tables that ``schema.txt`` in the folder names, from ``bin`` column files or ``csv`` (``.tbl``) text; as views on request."""
    if kind not in ("bin", "csv"):
        raise ValueError(f"unknown load type {kind}")
    schema = parse_schema(spark.read.text(f"{folder}/schema.txt", wholetext=True).first()[0])
    out = {t: read_binary_table(spark, folder, t, s) if kind == "bin" else read_tbl(spark, f"{folder}/{t}.tbl", s) for t, s in schema.items()}
    if views:
        for name, df in out.items():
            df.createOrReplaceTempView(name)
    return out


def convert(spark: SparkSession, source: str, target: str, kind: str) -> list[str]:
    """Writes every table of the schema as Parquet, ``<target>/<table>.parquet``, and returns their names."""
    tables = load_tables(spark, source, kind)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{target}/{name}.parquet")
    return list(tables)


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """One file through the session's file systems."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def write_binary_table(spark: SparkSession, folder: str, table: str, columns: dict[str, list], schema: T.StructType) -> None:
    """Column files and dictionaries of a small table, such as a dimension, from lists of values; null strings are NULL."""
    day = datetime.date(1970, 1, 1)
    for f in schema.fields:
        values, path = columns[f.name], f"{folder}/{table}/{f.name}"
        if isinstance(f.dataType, T.StringType):
            values = ["NULL" if v is None else v for v in values]
            words = ["NULL", *sorted(set(values) - {"NULL"}, key=str.encode)]
            code = {w: i for i, w in enumerate(words)}
            put(spark, f"{path}_dict.tsv", "".join(f"{w}\t{i}\n" for i, w in enumerate(words)).encode())
            values = [code[v] for v in values]
        elif isinstance(f.dataType, T.DateType):
            values = [(v - day).days * 86400 for v in values]
        put(spark, f"{path}.bin", np.array(values, "<i1" if isinstance(f.dataType, T.BooleanType) else "<i8").tobytes())


def random_column(spark: SparkSession, rows: int, kind: str, seed: int, name: str = "value") -> DataFrame:
    """Seeded uniform values of an integer or floating type."""
    half = float(2 ** {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 62}.get(kind, 0))
    value = F.rand(seed) if kind in ("float", "double") else F.rand(seed) * (2 * half) - half
    return spark.range(rows).select(value.cast(kind).alias(name) if kind in ("float", "double") else F.floor(value).cast(kind).alias(name))


def write_tsv(df: DataFrame, path: str, zero_for_null: bool = False) -> None:
    """One tab-separated file with a header, for results of report size; Spark writes parts of large ones by itself without the coalesce."""
    if zero_for_null:
        df = df.fillna(0)
    df.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def preview(df: DataFrame, column: str, ends: int = 5) -> tuple[list, list]:
    """The first and the last values of a column."""
    one = df.select(column)
    return [r[0] for r in one.head(ends)], [r[0] for r in one.tail(ends)]


def dump_column(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)
