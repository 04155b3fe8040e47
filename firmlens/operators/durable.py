"""Cutting lineage so that iterative jobs survive lost executors."""
from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see: ``spark.checkpoint.dir``, or one in the warehouse of a local session where that is unset.

    On a cluster the warehouse may be a folder of the driver alone, so there the setting is asked for.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"


_STORED: list[str] = []


def stored(df: DataFrame, name: str = "table", compression: str | None = None) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: computed once, and lost executors cost nothing before it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    _STORED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[None]:
    """Removes, at its end, the tables stored inside it.

    Results must be written or collected inside, as they may read those tables. Nested uses remove their own.
    """
    first = len(_STORED)
    try:
        yield
    finally:
        for path in _STORED[first:]:
            store, where = fs.FileSystem.from_uri(path if ":" in path else os.path.abspath(path))
            if store.get_file_info(where).type == fs.FileType.Directory:
                store.delete_dir(where)
        del _STORED[first:]


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns behind a generator.

    A later filter on such a column is not pushed below it, which would copy the whole
    expression into the filter and evaluate it twice.
    """
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(F.struct(*[e.alias(n) for n, e in columns.items()]))))
