"""Tables between stages, in the folder that all executors share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temp folder of our own only on a local master, where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="inkgrid-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Folders written inside ``temporaries``, in the thread that opened it.
_OPEN: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("open", default=None)


def written(df: DataFrame, name: str, keep: bool = False, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends, a lost executor costs nothing before it.

    Inside ``temporaries`` the table goes at its end, unless ``keep``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    if not keep and (open_ := _OPEN.get()) is not None:
        open_.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _removed(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dropped(df: DataFrame) -> None:
    """Remove a written table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _removed(df.sparkSession, path)


@contextlib.contextmanager
def temporaries(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside go at the end, also after a failure: what reads them must have been written by then."""
    paths: list[str] = []
    token = _OPEN.set(paths)
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path in paths:
            _removed(spark, path)


#: Images whose narrow rows (an id and some numbers) may be broadcast.
MAX_BROADCAST_ROWS = 1 << 17


def beside(pictures: DataFrame, narrow: DataFrame, few: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Pictures, or their bands, each with the narrow row of its image; images without one go.

    Spark takes what Python makes of few table rows, or what compresses well, for small and would broadcast the pictures. So
    the narrow rows are written and counted: up to ``few`` are broadcast, for more both sides are sorted; pictures never are broadcast.
    """
    rows = written(narrow, "narrow")
    return pictures.join(F.broadcast(rows), "image_id") if rows.count() <= few else pictures.hint("merge").join(rows, "image_id")


def by_image(df: DataFrame) -> DataFrame:
    """Deal rows out by image, once: windows and group-bys by image, scanline or column then need no further exchange."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image_id")
