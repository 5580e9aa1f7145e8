"""What the pipeline operators share: tables, word splitting, shared storage and checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but ASCII white space: the "words" that sizes and token counts are stated in.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Words of the shingle operators: runs of letters and digits, compared in lower case.
NOT_WORD = r"[^\p{L}\p{N}]+"
SHINGLE_WORDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_columns(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast; whatever else the table carries cannot clash with helper columns."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in kinds.items()])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where none is set, a folder of this machine serves a local session; on a cluster that would be an error.
    """
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not place:
        if held.isEmpty():
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            own = tempfile.mkdtemp(prefix="lexispark-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            spark.sparkContext.setCheckpointDir(f"file://{own}")
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        place = held.get()
    elif held.isEmpty():
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


#: What this process has written to the shared folder and not removed, in order.
_WRITTEN: list[str] = []


def scratch_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/lexispark-{what}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Cuts the lineage: a Parquet table in the shared folder, which outlives any executor."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_scratch(spark: SparkSession, since: int = 0, upto: int | None = None) -> None:
    """Removes the tables written to the shared folder from number ``since`` on, up to number ``upto``.

    Results that are not yet read may still need such tables, so it is for the caller to say when.
    """
    for path in _WRITTEN[since:upto]:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _WRITTEN.remove(path)


def written() -> int:
    return len(_WRITTEN)


@atexit.register
def _remove_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _WRITTEN:
        with contextlib.suppress(Exception):  # the session may be gone already
            remove_scratch(spark)


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if_small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """A broadcast hint where the counted rows stay within ``most``; beyond that the plain shuffled join."""
    return F.broadcast(df) if rows <= most else df


def space_words(text: Column) -> Column:
    """Number of whitespace-separated words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with value computed once a row, also where ``then`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), then), 1)


def shingle_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; an empty array for null or wordless text."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def word_hashes(text: Column) -> Column:
    """One 64-bit hash per shingle word, as an array of longs."""
    return F.transform(shingle_words(text), lambda w: F.xxhash64(w))


#: Documents, told by id and text hash (24 bytes each), that are broadcast to be filtered out; more are joined by shuffle.
MOST_REJECTED_BROADCAST = 1_000_000


def without_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id and text are not among ``rows`` (doc_id, h: xxhash64 of the text); a null id is an id.

    Up to MOST_REJECTED_BROADCAST different ``rows`` are broadcast, so that the texts are filtered in place.
    """
    gone = materialize(rows.select("doc_id", "h").distinct().select(F.struct("doc_id", "h").alias("gone")), "rejected")
    named = docs.select(F.struct("*").alias("row"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h")).alias("key"))
    gone = broadcast_if_small(gone, gone.count(), MOST_REJECTED_BROADCAST)
    return named.join(gone, F.col("key").eqNullSafe(F.col("gone")), "left_anti").select("row.*")


def beside(df: DataFrame, prefix: str, **values: Column) -> DataFrame:
    """``df`` (row: a struct, ...) -> the columns of row, then ``values`` under their names; a name that row has gets the prefix."""
    taken, out = {f.name.lower() for f in df.schema["row"].dataType.fields}, []
    for name, value in values.items():
        while name.lower() in taken:
            name = f"{prefix}_{name}"
        taken.add(name.lower())
        out.append(value.alias(name))
    return df.select("row.*", *out)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches, as tables; only one run is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
