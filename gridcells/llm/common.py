"""Helpers shared by the corpus operators: table access, lineage cuts, block counts."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcells.session import checkpoint_dir, scratch_path

__all__ = ["block_count", "checkpoint_dir", "cut", "drop_path", "let", "read_table", "scan", "scratch_path", "share_code", "spread", "text_bytes", "text_key", "texts"]


PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def share_code(spark: SparkSession) -> None:
    """Python workers look for this package where the driver has it.  (A cluster whose machines
    have no copy there ships it by ``--py-files``.)"""
    there = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if PACKAGE_ROOT not in there:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (PACKAGE_ROOT, *there) if p)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator works on, as ``doc_id bigint, text string``.  Whatever else
    the table has is left behind here, so its names cannot clash with working columns."""
    share_code(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
                     F.col(f"`{text_col}`").cast("string").alias("text"))


def text_key() -> Column:
    """64 bits of the text, which tell apart rows that share a doc_id."""
    return F.coalesce(F.xxhash64(F.col("text")), F.lit(0))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete what a job of this session wrote to a scratch path and nothing reads any more."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def cut(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint in the shared folder: survives a lost executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it.  (Columns of
    an earlier projection would be put in place of their names when a filter is pushed down.)"""
    return F.get(F.transform(F.array(value), body), F.lit(0))


SCAN_BLOCK = 256


def scan(values: Column, zero: Column, step) -> Column:
    """For each value of an array, ``zero`` and the values before it put together by ``step`` (an associative function of two columns,
    as a sum or a maximum).  Blocks are scanned alone and then shifted, so that time hardly grows faster than the array."""
    def along(xs):
        first = F.struct(zero.alias("at"), F.slice(F.array(zero), 1, 0).alias("out"))
        return F.aggregate(xs, first, lambda a, x: F.struct(step(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def shifted(blocks):
        before = along(F.transform(blocks, lambda b: b["at"]))["out"]
        return let(before, lambda o: F.flatten(F.transform(blocks, lambda b, i: F.transform(b["out"], lambda x: step(F.get(o, i), x)))))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(values), F.lit(1)) - 1) / SCAN_BLOCK).cast("int")),
                        lambda b: F.slice(values, b * SCAN_BLOCK + 1, SCAN_BLOCK))
    return let(F.transform(parts, along), shifted)


def text_bytes(df: DataFrame) -> int:
    return df.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def block_count(spark: SparkSession, n_bytes: int, block_bytes: int) -> int:
    """Blocks of about ``block_bytes``; at least one for each shuffle partition."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // block_bytes))


#: More tasks than this are not asked of one shuffle; then a task holds many blocks, one after another.
MOST_TASKS = 1 << 16


def spread(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows moved by their ``key`` (an int from 0 to n-1), one key a task, so that a task's share does not grow with the
    input; grouping by the key then moves nothing more."""
    return df.repartitionById(n, key) if n <= MOST_TASKS else df.repartition(MOST_TASKS, key)
