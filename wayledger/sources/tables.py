"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: The folders made for applications that set none.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, as in tests, a new local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _own[app]


#: For each thread the tables that the open calls of ``settled`` have stored, the innermost call last.
_scopes = threading.local()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: a plan that uses it several times computes it once."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/wayledger/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if open_ := getattr(_scopes, "open", None):
        open_[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, build: Callable[[], DataFrame], last: bool = False) -> DataFrame:
    """What ``build`` returns, ``stored``; the tables that were stored on the way there are deleted, and their shuffles let go.

    ``build`` must not leave frames over such tables anywhere else.  The result goes with those of an enclosing call, unless it is
    the ``last`` one: that is kept.
    """
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    _scopes.open.append(made := [])
    out = None
    try:
        out = stored(build())
    finally:
        _scopes.open.pop()
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        own = made.pop() if out is not None else None
        for name in made:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
        if own and _scopes.open and not last:
            _scopes.open[-1].append(own)
        jvm.System.gc()  # Spark deletes shuffle files when the driver collects what names them
    return out
