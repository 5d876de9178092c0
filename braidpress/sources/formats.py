"""Spark data sources for containers and tensor files.

``spark.read.format("braid_container").load(path)`` gives one row per chunk;
``spark.read.format("braid_tensors").load(path)`` one row per tensor. Both take the bytes from Spark's own
binary-file reader when used through :func:`read_containers` and :func:`read_tensors`, which work on any
store; the registered formats list local or mounted paths.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.container import split_chunks
from ..plans.session import ship_package

TENSOR_SCHEMA = "name string, dtype string, shape array<bigint>, data binary"
CONTAINER_SCHEMA = "path string, chunk_idx int, n_tokens int, coded binary"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole files; bytes that are no UTF-8 raise when they are read."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.decode("content", "UTF-8").alias("text"))


def read_containers(spark: SparkSession, path: str) -> DataFrame:
    """path, chunk_idx, coded, n_tokens, context_log2, uncompressed_len of container files."""
    raw = spark.read.format("binaryFile").load(path)
    return split_chunks(raw.select("path", F.col("content").alias("container")), ["path"])


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    """path and the tensors of tensor files."""
    ship_package(spark)

    @F.pandas_udf(f"array<struct<{TENSOR_SCHEMA.replace(' ', ':').replace(',:', ',')}>>")
    def run(s: pd.Series) -> pd.Series:
        from .tensors import parse

        return s.map(lambda raw: [{"name": t.name, "dtype": t.dtype, "shape": list(t.shape), "data": t.data} for t in parse(bytes(raw))[0].values()])

    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.explode(run("content")).alias("t")).select("path", "t.*")


def tensor_cells(tensors: DataFrame) -> DataFrame:
    """The relational form of integer tensors: path, name, i (row-major position) and value."""
    ship_package(tensors.sparkSession)

    @F.pandas_udf("array<bigint>")
    def run(d: pd.Series, k: pd.Series) -> pd.Series:
        import numpy as np

        from .tensors import VIEWS

        return pd.Series([np.frombuffer(bytes(a), VIEWS[b]).astype("int64").tolist() for a, b in zip(d, k)], dtype=object)

    whole = tensors.where(F.col("dtype").isin("I8", "U8", "I16", "U16", "I32", "U32", "I64"))
    return whole.select("path", "name", F.posexplode(run("data", "dtype")).alias("i", "value"))


def write_files(df: DataFrame, folder: str, key: str, column: str, suffix: str) -> None:
    """One file per row, KEY.SUFFIX, holding the row's bytes (or text as UTF-8), written by the executors.

    The folder must be one that all executors share. A task that runs again writes the same bytes anew and puts
    them in place at once. A folder in another store gets a Parquet table instead of files.
    """
    local = folder.removeprefix("file://")
    if "://" in local:
        df.select(F.col(key), F.col(column)).write.mode("overwrite").parquet(folder)
        return

    def put(rows) -> None:
        os.makedirs(local, exist_ok=True)
        for r in rows:
            part = os.path.join(local, f".{r[0]}.{os.getpid()}")
            with open(part, "wb") as f:
                f.write(r[1].encode() if isinstance(r[1], str) else bytes(r[1] or b""))
            os.replace(part, os.path.join(local, f"{r[0]}.{suffix}"))

    df.select(F.col(key), F.col(column)).foreachPartition(put)


def write_containers(df: DataFrame, folder: str, key: str = "doc_id", container: str = "container") -> None:
    write_files(df, folder, key, container, "czip")


def write_texts(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> None:
    write_files(df, folder, key, text, "txt")


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


def _files(path: str) -> list[_File]:
    path = path.removeprefix("file://")
    found = sorted(glob.glob(os.path.join(path, "*")) if os.path.isdir(path) else glob.glob(path))
    return [_File(f) for f in found if os.path.isfile(f) and not os.path.basename(f).startswith((".", "_"))]


class TensorSource(DataSource):
    """Tensor files, one partition each."""

    @classmethod
    def name(cls) -> str:
        return "braid_tensors"

    def schema(self) -> str:
        return f"path string, {TENSOR_SCHEMA}"

    def reader(self, schema) -> DataSourceReader:
        path = self.options["path"]

        class Reader(DataSourceReader):
            def partitions(self) -> list[InputPartition]:
                return _files(path)

            def read(self, part: _File) -> Iterator[tuple]:
                from braidpress.sources.tensors import parse

                with open(part.path, "rb") as f:
                    for t in parse(f.read())[0].values():
                        yield part.path, t.name, t.dtype, list(t.shape), t.data

        return Reader()


class ContainerSource(DataSource):
    """Container files, one partition each, one row per chunk."""

    @classmethod
    def name(cls) -> str:
        return "braid_container"

    def schema(self) -> str:
        return CONTAINER_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        path = self.options["path"]

        class Reader(DataSourceReader):
            def partitions(self) -> list[InputPartition]:
                return _files(path)

            def read(self, part: _File) -> Iterator[tuple]:
                from braidpress.operators.container import Container

                with open(part.path, "rb") as f:
                    c = Container.from_bytes(f.read())
                for i, data in enumerate(c.chunks):
                    yield part.path, i, c.chunk_tokens(i), data

        return Reader()


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(TensorSource)
    spark.dataSource.register(ContainerSource)
