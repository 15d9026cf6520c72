"""Codes for the levels of text columns, kept as a table.

The levels a column has in training are made distinct with map-side combining and numbered by
their rank, over ranges of the sorted levels where there are many. The table is written once and
joined to whatever is encoded; a column is broadcast only where its measured levels are small.
Nothing of it is held by the driver or by an expression, so a column may have any number of
levels, ids included.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.ml import Transformer
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finops_spark.functions.scalar import require
from finops_spark.operators.ordered import SPLIT_ROWS, with_position
from finops_spark.session import store

# Measured bytes of a column's levels (with 24 for each) up to which they may be broadcast.
BROADCAST_BYTES = 32 << 20


def level_table(train: DataFrame, columns: Sequence[str], split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(column, level, code): the distinct levels of each column that are not NULL, numbered from 0 in code-point order."""
    require(train, columns, "table to encode")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns]))
    distinct = train.select(each.alias("e")).select("e.*").where("level is not null").distinct()
    return store(with_position(distinct, ["column"], ["level"], "code", split_rows=split_rows), "levels", by="column")


class LevelIndexer(Transformer, MLWritable, MLReadable):
    """Adds ``outputs[c]`` for each text column c: its code as a double, ``unseen`` for NULL and for levels not in
    the table. With ``unseen=None`` that is the number of levels, and the output carries it for an encoder."""

    def __init__(self, levels: DataFrame, outputs: Mapping[str, str], sizes: Mapping[str, tuple[int, int]], unseen: float | None = -1.0):
        super().__init__()
        self.levels, self.outputs, self.unseen = levels, dict(outputs), unseen
        self.sizes = {c: tuple(sizes.get(c, (0, 0))) for c in outputs}

    @staticmethod
    def fit_columns(train: DataFrame, outputs: Mapping[str, str], unseen: float | None = -1.0) -> LevelIndexer:
        levels = level_table(train, list(outputs))
        size = F.sum(F.octet_length("level") + 24)
        sizes = {r["column"]: (r["n"], r["bytes"]) for r in levels.groupBy("column").agg(F.count(F.lit(1)).alias("n"), size.alias("bytes")).collect()}
        return LevelIndexer(levels, outputs, sizes, unseen)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        for i, (column, output) in enumerate(self.outputs.items()):
            n, held = self.sizes[column]
            own = self.levels.where(F.col("column") == column).select(F.col("level").alias(f"_level{i}"), F.col("code").cast("double").alias(f"_code{i}"))
            if held <= BROADCAST_BYTES:
                own = F.broadcast(own)
            joined = out.join(own, F.col(column).cast("string") == F.col(f"_level{i}"), "left")
            code = F.coalesce(f"_code{i}", F.lit(float(n) if self.unseen is None else self.unseen))
            about = {"ml_attr": {"type": "nominal", "num_vals": n + 1}} if self.unseen is None else {}
            out = joined.select(*out.columns, code.alias(output, metadata=about))
        return out

    def names(self, column: str) -> list[str]:
        """All levels of a column in the order of their codes, on the driver."""
        return [r["level"] for r in self.levels.where(F.col("column") == column).orderBy("code").collect()]

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, indexer: LevelIndexer):
        super().__init__()
        self.indexer = indexer

    def saveImpl(self, path: str) -> None:
        x = self.indexer
        more = {"outputs": x.outputs, "sizes": {c: list(s) for c, s in x.sizes.items()}, "unseen": x.unseen}
        DefaultParamsWriter.saveMetadata(x, path, self.sparkSession, extraMetadata={"levels": more})
        x.levels.write.partitionBy("column").parquet(f"{path}/levels")


class _Reader(MLReader):
    def load(self, path: str) -> LevelIndexer:
        spark: SparkSession = self.sparkSession
        more = DefaultParamsReader.loadMetadata(path, spark)["levels"]
        levels = spark.read.schema("level string, code bigint, column string").parquet(f"{path}/levels")
        return LevelIndexer(levels, more["outputs"], more["sizes"], more["unseen"])


class SlotNames(Sequence):
    """Names of a vector's slots: numbers first, then ``column=level``. They are read from the table of levels
    when looked at, not when a pipeline is fitted or used."""

    def __init__(self, numeric: Sequence[str], indexer: LevelIndexer | None = None, labels: Mapping[str, str] | None = None):
        self.numeric, self.indexer, self.labels = list(numeric), indexer, dict(labels or {})
        self._all: list[str] | None = None

    def _read(self) -> list[str]:
        if self._all is None:
            self._all = self.numeric + [f"{label}={v}" for column, label in self.labels.items() for v in self.indexer.names(column)]
        return self._all

    def __len__(self) -> int:
        return len(self.numeric) + sum(self.indexer.sizes[c][0] for c in self.labels)

    def __getitem__(self, at):
        return self._read()[at]

    def __iter__(self) -> Iterator[str]:
        return iter(self._read())

    def __eq__(self, other) -> bool:
        return self._read() == list(other)
