"""The training state: binned rows in blocks, and the margins beside them.

The rows are packed in blocks (one table row each: key hashes, folds, labels and bins as arrays) where
they are read, and written once; nothing is shuffled.  Until the first refresh a margin is its model's start.  A refresh
writes the blocks with the margins of the models trained together, each task what it has read, so that a pass reads
one table; the version before is dropped once the next is there.

All tables lie in a database of their own below the session's checkpoint folder: a lost executor
reads its part of them again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions.scalar import col
from ...session import scratch_path
from .bins import FeatureSpec, coded
from .exact import BLOCK_ROWS

#: Bytes of a block at most.
BLOCK_BYTES = 4 << 20
#: Bytes of a Parquet row group of blocks, as good as.
GROUP_BYTES = 8 << 20
#: Bytes of blocks that go to Python at a time.  Spark's limit of 10,000 rows would make all blocks of a task one batch.
BATCH_BYTES, BATCH_CONF = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
NO_FOLD = -(1 << 31)
#: The sampling hash is the first 60 bits of md5("seed:key").
HASH_DIGITS = 15

_BINS = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("kh", pa.binary()), ("fold", pa.binary()),
                   ("y", pa.binary()), ("bins", pa.binary())])
_BINS_TYPES = "block long, n int, kh binary, fold binary, y binary, bins binary"


def key_hash(key: str, seed: int):
    """A row's sampling hash, the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), col(key).cast("string"))), 1, HASH_DIGITS), 16, 10).cast("long")


@contextmanager
def small_batches(spark: SparkSession):
    """Jobs run within hand at most ``BATCH_BYTES`` or so to Python at a time."""
    before = spark.conf.get(BATCH_CONF, None)
    spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_CONF) if before is None else spark.conf.set(BATCH_CONF, before)


@dataclass
class Block:
    """One block's rows: ``bins`` is rows x features, ``margins`` models x rows (None: not refreshed yet)."""
    name: int
    kh: np.ndarray
    fold: np.ndarray
    y: np.ndarray
    bins: np.ndarray
    margins: np.ndarray | None


class State:
    def __init__(self, df: DataFrame, key: str, fold: str, label: str, spec: FeatureSpec, n_models: int, seed: int,
                 sampled: bool = True):
        """Key hashes are taken where rows will be ``sampled``."""
        self.spark, self.n_features, self.n_models = df.sparkSession, len(spec.names), n_models
        self.dtype = np.dtype(np.int8 if spec.max_bins < 1 << 7 else np.int16 if spec.max_bins < 1 << 15 else np.int32)
        self.database = f"canopy_{uuid.uuid4().hex[:16]}"
        self.spark.sql(f"create database {self.database} location '{scratch_path(self.spark, 'state')}'")
        self.version = 0
        width = 20 + self.dtype.itemsize * self.n_features + 8 * n_models
        self.block_rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // width))
        rows = coded(df, spec).select(
            (key_hash(key, seed) if sampled else F.lit(0).cast("long")).alias("_kh"), col(fold).cast("int").alias("_fold"), col(label).cast("double").alias("_y"),
            *[(col(c) if spec.is_cat[i] and i not in spec.tables else col(c).cast("double")).alias(f"f{i}") for i, c in enumerate(spec.names)])
        self._write(rows.mapInArrow(_pack(spec, self.block_rows, self.dtype), _BINS_TYPES), "bins")

    def _write(self, df: DataFrame, name: str) -> None:
        """A block is a megabyte or so: Parquet's usual row group of 128 MB, looked at after a hundred rows, is what a
        task would hold when writing and read as one batch."""
        df.write.format("parquet").option("parquet.block.size", GROUP_BYTES).option("parquet.enable.dictionary", "false").option(
            "parquet.block.size.row.check.min", 1).option("parquet.page.size.row.check.min", 1).saveAsTable(f"{self.database}.{name}")

    def frame(self, *columns: str) -> DataFrame:
        """Blocks with the given columns of the rows and, once refreshed, the margins ``m``."""
        if not self.version:
            return self.spark.table(f"{self.database}.bins").select("block", "n", *columns)
        return self.spark.table(f"{self.database}.margins{self.version}").select("block", "n", *columns, "m")

    def mapped(self, run: Callable[[Iterator[Block]], Iterator[pa.RecordBatch]], schema: str, *columns: str) -> DataFrame:
        nf, models, dtype = self.n_features, self.n_models, self.dtype

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from run(_blocks(batches, nf, models, dtype))

        return self.frame(*columns).mapInArrow(over, schema)

    def refresh(self, margin_of: Callable[[Block, int], np.ndarray]) -> None:
        """Writes all models' margins anew and drops those before."""
        models = self.n_models

        nf, dtype = self.n_features, self.dtype

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, b in enumerate(_blocks([batch], nf, models, dtype)):
                    m = np.stack([margin_of(b, j) for j in range(models)]) if models else np.zeros((0, len(b.bins)))
                    row = batch.slice(i, 1).select(_BINS.names)
                    yield pa.RecordBatch.from_arrays([*row.columns, pa.array([m.tobytes()], pa.binary())], [*_BINS.names, "m"])

        rows = self.frame("kh", "fold", "y", "bins").mapInArrow(over, f"{_BINS_TYPES}, m binary")
        self._write(rows, f"margins{self.version + 1}")
        if self.version:
            self.spark.sql(f"drop table {self.database}.margins{self.version}")
        self.version += 1

    def again(self, n_models: int) -> "State":
        """The same rows for other models, from their start margins."""
        if self.version:
            self.spark.sql(f"drop table {self.database}.margins{self.version}")
        self.version, self.n_models = 0, n_models
        return self

    def close(self) -> None:
        self.spark.sql(f"drop database if exists {self.database} cascade")


def _bins(spec: FeatureSpec, i: int, values: pa.ChunkedArray) -> np.ndarray:
    """``spec.bin_values`` of feature i, text by its place in the dictionary."""
    if spec.is_cat[i] and i not in spec.tables:
        known = pa.array(spec.categories[i], pa.string())
        return pc.fill_null(pc.index_in(values.cast(pa.string()), known, skip_nulls=True), -1).to_numpy().astype(np.int32)
    return spec.bin_values(i, values.to_numpy())


def _pack(spec: FeatureSpec, block_rows: int, dtype: np.dtype):
    nf = len(spec.names)

    def block(rows: pa.Table, name: int) -> pa.RecordBatch:
        bins = np.stack([_bins(spec, i, rows.column(f"f{i}")) for i in range(nf)]).astype(dtype) if nf else \
            np.zeros((0, rows.num_rows), dtype)
        parts = [pc.fill_null(rows.column("_kh"), 0).to_numpy().astype(np.int64), pc.fill_null(rows.column("_fold"), NO_FOLD).to_numpy().astype(np.int32),
                 rows.column("_y").to_numpy().astype(np.float64), bins]
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows.num_rows], pa.int32()),
                                           *[pa.array([p.tobytes()], pa.binary()) for p in parts]], schema=_BINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= block_rows:
                rows = pa.Table.from_batches(held)
                for at in range(0, n - n % block_rows, block_rows):
                    yield block(rows.slice(at, block_rows), name)
                    name += 1
                held, n = rows.slice(n - n % block_rows).to_batches(), n % block_rows
        if n:
            yield block(pa.Table.from_batches(held), name)

    return run


def _blocks(batches: Iterator[pa.RecordBatch], nf: int, models: int, dtype: np.dtype) -> Iterator[Block]:
    for batch in batches:
        names = set(batch.schema.names)

        def array(c: str, i: int, kind) -> np.ndarray | None:
            return np.frombuffer(batch.column(c)[i].as_buffer(), kind) if c in names else None

        for i in range(batch.num_rows):
            n = batch.column("n")[i].as_py()
            bins, m = array("bins", i, dtype), array("m", i, np.float64)
            yield Block(batch.column("block")[i].as_py(), array("kh", i, np.int64), array("fold", i, np.int32),
                        array("y", i, np.float64), bins.reshape(nf, n).T if bins is not None else np.zeros((n, 0), dtype),
                        None if m is None else m.reshape(models, n))
