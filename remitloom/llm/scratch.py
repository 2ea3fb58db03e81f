"""Tables that a job writes on its way, in the folder the cluster shares.

A frozen table cuts the lineage: if an executor is lost, only the tasks that
read the table run again.  The folder is ``spark.checkpoint.dir``; only a
session whose master is one local process, without that setting, gets a
temporary folder.  ``release`` removes what an application has frozen.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_shipped: set[str] = set()


def folder(spark: SparkSession) -> str:
    """The application's folder for frozen tables."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="llm-")
        base = _own[app]
    return f"{base}/remitloom-llm/{app}"


def freeze(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and go on from what was written."""
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove every frozen table of this application; results that still read one end with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package sent along, so that executors need not have it installed."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(prefix="llm-"), "remitloom_package.zip")
        with zipfile.ZipFile(path, "w") as out:
            for name in ("__init__.py", *(f"llm/{x}" for x in sorted(os.listdir(os.path.join(package, "llm"))) if x.endswith(".py"))):
                out.write(os.path.join(package, name), f"{os.path.basename(package)}/{name}")
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return df.mapInArrow(run, schema)
