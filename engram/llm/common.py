"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

#: A word: a maximal run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, as Spark's own reader gives it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Lists that collect the scratch folders written while they are open, the innermost last.
_OPEN: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    path = shared_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def settled(spark: SparkSession, build: Callable[[], DataFrame], name: str, texts: bool = False) -> DataFrame:
    """The result of ``build()`` as a table of its own in the shared folder.  The
    scratch tables that ``build`` wrote, and only those, are deleted then; tables
    that other results read are never touched.  ``texts``: see :func:`text_batches`."""
    mine: list[str] = []
    _OPEN.append(mine)
    try:
        df = build()
    finally:
        _OPEN.remove(mine)
    out = written(df, name, texts)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in mine:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    return out


#: Rows of whole texts that go to Python together.
TEXT_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """For an action that hands whole texts to Python: some TEXT_ROWS at a time,
    as batches of Spark's default size are held several times over."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(min(int(before), TEXT_ROWS) if int(before) > 0 else TEXT_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def written(df: DataFrame, name: str, texts: bool = False, file_rows: int = 0) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read back:
    the lineage ends there, and lost executors cost no recomputation.  ``texts``:
    see :func:`text_batches`.  ``file_rows``: rows of a file at most, for rows of
    many MB, as Parquet's writer and reader hold dozens of rows of a file together."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with text_batches(spark) if texts else nullcontext():
        df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def packed_rows(docs: DataFrame, **columns: Column) -> DataFrame:
    """Every row as one struct ``row``, beside the given columns, so that names
    of the input and of the operator never meet."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       *[c.alias(n) for n, c in columns.items()])


def unpacked_rows(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The input's columns out of ``row``, some of them changed."""
    return df.select(*[(changed[c] if c in changed else F.col("row")[c]).alias(c) for c in columns])
