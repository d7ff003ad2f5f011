"""Shared pieces of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillveil import lineage

#: What parts words, as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"


def settle(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Cuts the lineage; ``batch_rows`` bounds the rows of an Arrow batch meanwhile, for wide rows."""
    if batch_rows is None:
        return lineage.settle(df)
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    before = conf.get(name)
    conf.set(name, str(batch_rows))
    try:
        return lineage.settle(df)
    finally:
        conf.set(name, before)


def _files(spark: SparkSession, path: str):
    """The file system that a path lies in, and the path in its terms."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def written(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Cuts the lineage with a table in the checkpoint folder, which ``discard`` removes; ``batch_rows`` as in ``settle``."""
    spark = df.sparkSession
    path = f"{lineage.shared_folder(spark)}/{uuid.uuid4().hex}"
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf
    before = conf.get(name)
    try:
        if batch_rows is not None:
            conf.set(name, str(batch_rows))
        df.write.parquet(path)
    finally:
        conf.set(name, before)
    out = spark.read.schema(df.schema).parquet(path)
    _places[id(out)] = path, out
    return out


_places: dict[int, tuple[str, DataFrame]] = {}


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``written`` made, once nothing that reads them is left to run."""
    for table_ in tables:
        path, _ = _places.pop(id(table_), (None, None))
        if path:
            files, where = _files(table_.sparkSession, path)
            files.delete(where, True)


def grows(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it is sorted and merged, as broadcasts of many such tables fill the driver."""
    return df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(doc_id: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``: the fold that held-out rows are told by. A null id has fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod, F.lit(0))


def column(name: str) -> Column:
    """A column by its whole name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(docs: DataFrame, *wanted: str) -> list[str]:
    """Names like those that are wanted which no column of ``docs`` has, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    mark = "_"
    while any(f"{mark}{w}".lower() in taken for w in wanted):
        mark += "_"
    return [f"{mark}{w}" for w in wanted]


def row_key(docs: DataFrame, seed: int = 0) -> Column:
    """64 bits over all columns of a row and which of them are null: rows of the same key and id are taken as equal."""
    nulls = F.concat(*[column(c).isNull().cast("int").cast("string") for c in docs.columns])
    return F.xxhash64(F.lit(seed), nulls, *[column(c) for c in docs.columns])
