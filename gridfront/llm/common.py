"""Pieces that the text operators share: lineage cuts, Arrow batch handling, hash folds, components."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one Python step holds at once (a single longer text is still taken whole).
STEP_CHARS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a single-process session (``local[...]``) may go without that setting; it then gets a
    temporary folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    at = "file://" + tempfile.mkdtemp(prefix="gridfront-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


#: Tables of ``cut`` that stand, by path, with what it takes to delete them.
_STANDING: dict[str, tuple] = {}


def cut(df: DataFrame, label: str, kept: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs start from the files.

    A lost executor then costs the tasks of one stage, not the whole history. Shuffle files of the
    writing job are released as soon as it ends. The files go with ``release``, at the end of a ``scratch``
    block (not if they are to be ``kept``), or when the process ends: a result that reads them may be evaluated
    until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridfront/{label}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    if not _STANDING:
        atexit.unregister(at_exit)
        atexit.register(at_exit)
    _STANDING[path] = (spark._jvm, spark._jsc.hadoopConfiguration(), kept)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridfront_path = path
    return out


def delete(path: str) -> None:
    """Delete a table of ``cut``, or do nothing if it is gone."""
    if found := _STANDING.pop(path, None):
        jvm, conf, _ = found
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def release(*frames: DataFrame) -> None:
    """Delete the files of tables made by ``cut`` that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_gridfront_path", None):
            delete(path)


@contextmanager
def scratch():
    """At the end of the block, delete the tables that were cut inside it; its result is to be written by then."""
    before = set(_STANDING)
    try:
        yield
    finally:
        for path in [p for p, (*_, kept) in _STANDING.items() if p not in before and not kept]:
            delete(path)


def at_exit() -> None:
    with suppress(Exception):  # the JVM may be gone already
        for path in list(_STANDING):
            delete(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, led by as many underscores as it takes to differ from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def fold(column: Column, parts: int) -> Column:
    """``crc32`` of the value as text, modulo ``parts``; null values go to 0."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % parts, F.lit(0))


def documents(df: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` (long) and ``text`` (string) alone, so that no other column can clash."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def steps(batch: pa.RecordBatch, column: str = "text", most: int = STEP_CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of a batch whose texts have about ``most`` characters together, with the texts."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    first = held = 0
    for k, n in enumerate(sizes):
        if k > first and held + n > most:
            part = batch.slice(first, k - first)
            yield part, part.column(column).to_pylist()
            first, held = k, 0
        held += n
    part = batch.slice(first)
    yield part, part.column(column).to_pylist()


def small_batches(spark: SparkSession) -> None:
    """Rows of text reach Python 1,000 at a time where the session has the default of 10,000."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, "1000")


def map_steps(df: DataFrame, schema: str, make: Callable[[], Callable], column: str = "text", most: int = STEP_CHARS) -> DataFrame:
    """``mapInArrow`` by bounded slices: ``make()`` runs once a task and gives ``f(slice, texts) -> RecordBatch``."""

    small_batches(df.sparkSession)

    def run(batches):
        f = make()
        for batch in batches:
            for part, texts in steps(batch, column, most):
                yield f(part, texts)

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, label: str) -> DataFrame:
    """Connected components of ``edges(u, v)``: ``(node, component)``, the least node reachable.

    Every round each node takes the least label among itself and its neighbours, then the label of
    its label (pointer jumping), so the rounds grow with the logarithm of a component's diameter.
    Rounds are cut to the shared folder; nothing but a count reaches the driver. Min-aggregates
    combine before the shuffle, so a node with very many edges sends one row a task.
    """
    pairs = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    both = cut(pairs.union(pairs.select("v", "u")).filter("u <> v").distinct(), f"{label}-edges")
    now = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("component")), f"{label}-start")
    while True:
        offers = both.join(now.select(F.col("node").alias("u"), "component"), "u").groupBy(F.col("v").alias("node")).agg(F.min("component").alias("offer"))
        lower = now.join(offers, "node", "left").select("node", F.least("component", F.coalesce("offer", "component")).alias("component"), F.col("component").alias("was"))
        heads = cut(lower, f"{label}-lower")
        jump = heads.select(F.col("node").alias("component"), F.col("component").alias("next"))
        moved = cut(heads.join(jump, "component", "left").select("node", F.least("component", F.coalesce("next", "component")).alias("component"), "was"), f"{label}-round")
        changed = moved.filter("component <> was").limit(1).count()
        release(heads, now)
        now = moved.select("node", "component")
        now._gridfront_path = moved._gridfront_path
        if not changed:
            release(both)
            return now


def quiet_threads() -> None:
    """One thread for each Python worker; Spark's tasks are the parallelism."""
    for k in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "RAYON_NUM_THREADS"):
        os.environ.setdefault(k, "1")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
