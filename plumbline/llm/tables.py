"""Reading input tables and keeping intermediate ones where all executors see them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that go to a Python worker at once. Texts may be long, and a worker holds a batch several times.
BATCH_ROWS = 500


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def for_workers(df: DataFrame) -> DataFrame:
    """``df``; its session sends rows to Python workers in batches of BATCH_ROWS at most from now on."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a local master, whose one
    process is driver and executor, gets a folder of its own where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared folder and read it back: its lineage ends
    there, and a lost executor costs the tasks that read it, not those that made it."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def unused(name: str, columns: list[str]) -> str:
    """``name``, behind as many underscores as tell it from all ``columns``, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Up to this limit Spark cuts each task's share of a window's rows before it shuffles them
#: (spark.sql.optimizer.windowGroupLimitThreshold); tasks whose shares meet in the first cut.
CUT_EARLY, TOGETHER = 1000, 256


def bounded_sample(rows: DataFrame, label: str, per_label: int, key: str = "doc_id") -> DataFrame:
    """At most ``per_label`` rows of each label, the same ones on every run: those whose
    keys have the smallest hashes.

    Three cuts bound what meets in a task. Hashes are dealt to shares, each about half as large
    as CUT_EARLY in the sample, and no share keeps more than CUT_EARLY rows: first of TOGETHER
    neighbouring tasks (each cuts its own rows before the shuffle), then of all, then the shares
    of a label are cut to ``per_label``. A key that is repeated without end fills one share only."""
    from pyspark.sql import Window

    share, part, place = (unused(n, rows.columns) for n in ("_share", "_part", "_place"))
    code = F.xxhash64(key)
    shares, limit = max(1, -(-2 * per_label // CUT_EARLY)), min(CUT_EARLY, per_label)

    def cut(found: DataFrame, groups: list[str], limit: int) -> DataFrame:
        order = Window.partitionBy(*groups).orderBy(code, F.col(key))
        return found.withColumn(place, F.row_number().over(order)).filter(F.col(place) <= limit).drop(place)

    dealt = rows.withColumn(share, F.pmod(code, F.lit(shares))).withColumn(part, F.floor(F.spark_partition_id() / TOGETHER))
    near = cut(dealt, [label, share, part], limit).drop(part)
    if shares > 1:
        near = cut(near, [label, share], limit)
    return cut(near.drop(share), [label], per_label)
