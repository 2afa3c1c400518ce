"""Session helpers shared by every operator: scratch tables, lineage cuts and code shipping.

Iterative plans and multi-pass operators cut their lineage by writing a table to the folder
named in ``spark.checkpoint.dir`` (shared by driver and executors), so a lost executor costs a
re-read and never a recomputation of earlier passes.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_SCRATCH: list[str] = []
#: Arrow batches to Python workers hold so many bytes at most, however long the texts.
ARROW_BYTES = "4m"


def scratch_root(spark: SparkSession) -> str:
    """Shared scratch folder: ``spark.checkpoint.dir``, or a temporary one where it is unset and all
    runs in this process. On a cluster each executor would write to its own disk, so that is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="weft-scratch-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        root = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/weft-{label}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def clean(spark: SparkSession) -> None:
    """Delete every scratch table of this process. Results that are not written yet need theirs, so
    call this once they are."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    while _SCRATCH:
        path = hadoop(_SCRATCH.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def made(since: int = 0) -> list[str]:
    """The scratch folders of this process that are not deleted yet, from the one at ``since`` on."""
    return _SCRATCH[since:]


def release(paths: list[str], reader: DataFrame) -> list[str]:
    """Delete those scratch folders that ``reader`` does not read; returns the others."""
    spark = reader.sparkSession
    leaves = reader._jdf.queryExecution().analyzed().collectLeaves()
    read = " ".join(leaves.apply(k).relation().location().rootPaths().mkString(" ") for k in range(leaves.size()) if leaves.apply(k).getClass().getSimpleName() == "LogicalRelation" and "HadoopFsRelation" in leaves.apply(k).relation().getClass().getSimpleName())
    hadoop, kept = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, []
    for path in paths:
        if os.path.basename(path) in read:
            kept.append(path)
        elif path in _SCRATCH:
            _SCRATCH.remove(path)
            hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop(path), True)
    return kept


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once to the shared scratch folder and return a scan of it.

    Unlike ``checkpoint()`` this runs the plan exactly once and keeps a columnar, prunable copy.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the scratch files behind a table made by :func:`materialize`."""
    spark = df.sparkSession
    root = scratch_root(spark)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/weft-" in name and name.split("://")[-1].lstrip("/").startswith(root.split("://")[-1].lstrip("/")):
            path = hadoop(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that do not have it installed, and bound the
    Arrow batches they get."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    if here.endswith(".zip/weft"):  # already running from a shipped archive
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="weft-code-"), "weft_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("weft", os.path.relpath(full, here)))
    sc.addPyFile(archive)
    atexit.register(shutil.rmtree, os.path.dirname(archive), ignore_errors=True)
    _SHIPPED.add(sc.applicationId)
