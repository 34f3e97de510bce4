"""Token counts by separator scan (operator 2).

Flat token files hold ids of fixed width one after the other, each document
ended by a separator id, and no index.  The files are cut into blocks; a task
looks for the separators of its block at once.  A document that crosses blocks
is put together by a prefix scan over one small row per block: how many
separators came before, and where the last one was.

Blocks are read by range, so a task holds one block whatever the file's size.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Encoder, chunks, load_ranks
from .common import scratch, written

#: Bytes of a block; a whole number of ids of 2 or 4 bytes.
BLOCK_BYTES = 1 << 22


def filesystem(uri: str):
    """pyarrow's file system for a folder as Spark names it, and the path in it."""
    from pyarrow import fs
    uri = re.sub(r"^file:/*", "/", uri)
    uri = re.sub(r"^s3[an]://", "s3://", uri)
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, ranks_path: str, folder: str, separator: int | None = None,
                      doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes the texts into flat files in ``folder``, one for each task, and
    returns what lies where: (file, ordinal, doc_id).

    The ids are little-endian, of 2 bytes if the separator (by default the
    first id that the vocabulary leaves free) fits, else 4.  Null and empty
    texts are a separator alone.  A file belongs to one attempt of a task and
    counts only if that attempt's rows were committed with the returned table,
    so a lost task or a second attempt leaves nothing in the result.
    """
    spark = docs.sparkSession
    ranks = load_ranks(ranks_path)
    end = max(ranks.values(), default=-1) + 1 if separator is None else separator
    kind = np.dtype("<u2" if max(end, *ranks.values()) < 1 << 16 else "<u4")
    shared = spark.sparkContext.broadcast((ranks, Encoder(ranks).tables))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, name, n = Encoder(*shared.value), f"tokens-{uuid.uuid4().hex}.bin", 0
        store, path = filesystem(folder)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{name}") as out:
            for pdf in batches:
                texts = pdf["text"].tolist()
                before = 0
                for which, some in chunks(texts):
                    ids, counts = encoder.encode(some)
                    # a separator ends a text where the next one begins, and the last one below
                    begins = np.diff(np.array(which), prepend=before) > 0
                    before = which[-1]
                    flat = np.full(len(ids) + begins.sum(), end, dtype=kind)
                    own = np.ones(len(flat), dtype=bool)
                    own[(np.cumsum(counts) - counts + np.cumsum(begins) - 1)[begins]] = False
                    flat[own] = ids
                    out.write(flat.tobytes())
                if texts:
                    out.write(np.array([end], dtype=kind).tobytes())
                yield pd.DataFrame({"file": name, "ordinal": np.arange(n, n + len(pdf)), "doc_id": pdf["doc_id"]})
                n += len(pdf)

    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = written(rows.mapInPandas(run, "file string, ordinal long, doc_id string"), "placed")
    return placed.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))


def separator_scan(spark: SparkSession, folder: str, separator: int, width: int = 2,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents of all ``*.bin`` files of a folder: file, ordinal (from 0
    within the file), first_token, n_tokens (without the separator) and
    terminated.

    Two separators in a row enclose a document of 0 tokens.  Ids after the last
    separator of a file are one more document, not terminated.  An empty file
    has no documents.  A file that ends within an id is an error.
    """
    kind = np.dtype(f"<u{width}")
    if block_bytes % width:
        raise ValueError("a block must hold whole ids")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select(
        F.regexp_extract("path", r"[^/]+$", 0).alias("file"), F.col("length").alias("n_bytes"))
    blocks = files.where("n_bytes > 0").withColumn("block", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("n_bytes") - 1) / block_bytes))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = filesystem(folder)
        for pdf in batches:
            for file, n_bytes, block in pdf.itertuples(index=False):
                if n_bytes % width:
                    raise ValueError(f"{file}: {n_bytes} bytes are no whole number of ids")
                at = block * block_bytes
                with store.open_input_file(f"{path}/{file}") as f:
                    ids = np.frombuffer(f.read_at(min(block_bytes, n_bytes - at), at), dtype=kind)
                found = np.flatnonzero(ids == separator)
                yield pd.DataFrame({
                    "file": [file], "block": [block], "n_bytes": [n_bytes], "n": [len(found)],
                    "last": [int(found[-1]) + at // width if len(found) else -1],
                    "lengths": [np.diff(found, prepend=-1) - 1]})

    # a block is a few MB to read for each row of this table, so the rows are spread out one by one
    spread = blocks.repartition(max(spark.sparkContext.defaultParallelism,
                                    int(spark.conf.get("spark.sql.shuffle.partitions"))), "file", "block")
    found = written(spread.select("file", "n_bytes", "block").mapInPandas(
        run, "file string, block long, n_bytes long, n long, last long, lengths array<long>"), "separators")

    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
                           F.coalesce(F.max("last").over(before) + 1, F.lit(0)).alias("open_from"))
    first = F.col("block") * (block_bytes // width)
    inner = found.join(carried, ["file", "block"]).select(
        "file", "base", "open_from", first.alias("first"), F.posexplode("lengths").alias("pos", "len"))
    lead = F.when(F.col("pos") == 0, F.col("first") - F.col("open_from")).otherwise(F.lit(0))
    inner = inner.select("file", (F.col("base") + F.col("pos")).alias("ordinal"),
                         (F.col("len") + lead).alias("n_tokens"), F.lit(True).alias("terminated"))
    tail = found.groupBy("file").agg(F.sum("n").alias("ordinal"), (F.max("n_bytes") / width).cast("long").alias("all"),
                                     F.max("last").alias("last"))
    tail = tail.select("file", "ordinal", (F.col("all") - F.greatest(F.col("last"), F.lit(-1)) - 1).alias("n_tokens"),
                       F.lit(False).alias("terminated")).where("n_tokens > 0")
    return inner.unionByName(tail)


def document_token_counts(docs: DataFrame, ranks_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every whole text: written to flat token files,
    counted by :func:`separator_scan`.  Null and empty texts have 0 tokens, a
    null doc_id stays null, repeated rows count each, other columns are
    ignored, and an empty table gives an empty result."""
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")
    ranks = load_ranks(ranks_path)
    end = max(ranks.values(), default=-1) + 1
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    placed = write_token_files(docs, ranks_path, folder, end, doc_id, text)
    counted = separator_scan(spark, folder, end, 2 if end < 1 << 16 else 4).where("terminated")
    return placed.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens")
