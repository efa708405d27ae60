"""The folder that driver and executors share, and files in it that workers write and map."""

import mmap
import os
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.  Only a local session without one gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="gistmeter-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lost executors cost no recomputation."""
    path = fresh_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone, whatever other columns there are; a null text becomes empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def file_system(uri: str):
    """The Arrow file system of a folder and the folder's path in it; any scheme Arrow knows."""
    from pyarrow import fs

    if not urlparse(uri).scheme:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file per array.  A file appears whole or not at all, so a task that is run again does no harm."""
    store, base = file_system(folder)
    store.create_dir(base, recursive=True)
    for key, values in arrays.items():
        partial = f"{base}/.{name}.{key}.{uuid.uuid4().hex}"
        with store.open_output_stream(partial) as out:
            out.write(np.ascontiguousarray(values).view(np.uint8))
        store.move(partial, f"{base}/{name}.{key}")


def mapped_array(folder: str, name: str, key: str, dtype) -> np.ndarray:
    """Map a file of `write_arrays`.  From a remote store it is first copied to a nameless local file."""
    store, base = file_system(folder)
    path = f"{base}/{name}.{key}"
    if store.type_name == "local":
        if os.path.getsize(path) == 0:
            return np.empty(0, dtype)
        with open(path, "rb") as f:
            return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), dtype)
    with tempfile.TemporaryFile() as local, store.open_input_stream(path) as remote:
        while piece := remote.read(1 << 22):
            local.write(piece)
        local.flush()
        if local.tell() == 0:
            return np.empty(0, dtype)
        return np.frombuffer(mmap.mmap(local.fileno(), 0, access=mmap.ACCESS_READ), dtype)
