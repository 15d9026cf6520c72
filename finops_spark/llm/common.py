"""Helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finops_spark.session import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Java pattern of a word between ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: SHA-256 of nothing.
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later steps start
    from the files, so a lost executor costs no recomputation of what came before."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within, the files of a job's shuffles go as soon as its result is stored, not
    when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII text takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_share(doc_id: Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of the folder. In a purely local session this package is also put on the
    path of the Python workers; a cluster gets it from whoever submits the job."""
    if spark.sparkContext.master.startswith("local["):
        root = str(Path(__file__).resolve().parents[2])
        paths = spark.sparkContext.environment.get("PYTHONPATH", "")
        if root not in paths.split(":"):
            spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{paths}".rstrip(":")
    return spark.read.parquet(f"{folder}/{table}.parquet")


def blocks(texts: Iterable[str | None], chars: int = 1 << 21, most: int = 1_000) -> Iterator[list[str]]:
    """Cut a sequence of texts into lists of about ``chars`` characters and at most ``most`` texts; None is empty."""
    part: list[str] = []
    held = 0
    for text in texts:
        part.append(text or "")
        held += len(part[-1])
        if held >= chars or len(part) >= most:
            yield part
            part, held = [], 0
    if part:
        yield part
