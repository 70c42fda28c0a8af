"""Session helpers shared by every operator: tables, durable cuts of lineage, size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows, and characters of all values, up to which a side counts as small enough to be broadcast.
SMALL_ROWS, SMALL_CHARS = 100_000, 64_000_000
#: Groups with more rows are spread over all tasks; rows of a range partition of such a group.
HOT_ROWS, RANGE_ROWS = 200_000, 200_000
#: Buckets of ids in which a row may occur twice.
COPY_BUCKETS = 1 << 20


def local_session(name: str = "codeseam", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Let the workers import this package wherever they run: Spark hands them an archive of it, once per context."""
    context, package = spark.sparkContext, os.path.dirname(os.path.abspath(__file__))
    if getattr(context, "_codeseam_shipped", False) or not os.path.isdir(package):
        return
    folder = tempfile.mkdtemp(prefix="codeseam-")  # on the driver, which serves it as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "codeseam.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._codeseam_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder in spark.checkpoint.dir; a folder of our own only where none is set and all runs in one process (tests).

    Raises RuntimeError on a cluster without that setting: a folder of one machine would be lost with it.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not configured and not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    spark.sparkContext.setCheckpointDir(configured or os.path.join(tempfile.gettempdir(), "codeseam-checkpoints"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, for tables that live as long as the session."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder: lineage is cut and a lost executor costs nothing.

    With spark.cleaner.referenceTracking.cleanCheckpoints Spark removes the files when the DataFrame is gone.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast hint behind a count of the rows and their characters; above either bound the join is left to Catalyst (shuffle)."""
    size = F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))
    rows, chars = df.limit(max_rows + 1).agg(F.count("*"), size).first()
    return F.broadcast(df) if rows <= max_rows and chars <= SMALL_CHARS else df


def distinct_rows(df: DataFrame, key: str) -> DataFrame:
    """One row for each value of the key (none for null), for wide rows of which few occur twice: the others aren't shuffled.

    Only keys are counted; their hash buckets that hold a key twice, at most COPY_BUCKETS, are broadcast, and the rows
    of these buckets alone meet by key. Which of several rows with a key stays isn't determined, as with dropDuplicates.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(COPY_BUCKETS)).cast("int")
    rows = df.where(F.col(key).isNotNull())
    twice = rows.select(key).groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1").select(bucket.alias("__bucket")).distinct()
    marked = rows.withColumn("__bucket", bucket)
    alone = marked.join(F.broadcast(twice), "__bucket", "left_anti")
    copied = marked.join(F.broadcast(twice), "__bucket", "left_semi").dropDuplicates([key])
    return alone.unionByName(copied).select(*df.columns)


def by_size(df: DataFrame, group: str, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """df's rows of the groups of ordinary size, and those of the large ones (None if there is none).

    A group is large above hot_rows and 1/20000 of all rows, so that fewer than 20 000 are.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    rows, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    bound = max(hot_rows, rows // 20_000)
    if largest <= bound:
        return df, None
    hot = F.broadcast(durable(sizes.where(F.col("n") > bound).select(F.col(group).alias("__hot"))))
    same = F.col(group).eqNullSafe(F.col("__hot"))
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], weight: str, out: str, part_rows: int = RANGE_ROWS) -> DataFrame:
    """df with `out`: the sum of `weight` over the rows before this one in its group (keys), by order (column, descending).

    Rows are unique by keys and order. They are dealt out by range, counted by partition and group, and summed within;
    so a group is cut wherever it has to be, and no task holds more of it than a partition.
    """
    by = [F.col(c).desc() if down else F.col(c).asc() for c, down in order]
    kept = durable(df)
    placed = kept.repartitionByRange(parts_for(kept.count(), part_rows), *keys, *by)
    placed = durable(placed.withColumn("__part", F.spark_partition_id()))  # the partition of a row is fixed from here on
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*keys, "__part").agg(F.sum(weight).alias("__sum"))
    base = sums.select(*keys, "__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy(*keys, "__part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.alias("a").join(small_side(base).alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, "__part")])
    rows = rows.select("a.*", "b.__base")
    return rows.withColumn(out, F.col("__base") + F.coalesce(F.sum(weight).over(within), F.lit(0))).drop("__part", "__base")


def numbered(df: DataFrame, group: str, order: Sequence[tuple[str, bool]], out: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with `out`, the place of a row in its group from 0, by order (column, descending), which is unique in a group.

    Groups of ordinary size are numbered by a window, large ones by running, so that none is one task's work.
    """
    few, many = by_size(df, group, hot_rows)
    by = [F.col(c).desc() if down else F.col(c).asc() for c, down in order]
    rows = few.withColumn(out, (F.row_number().over(Window.partitionBy(group).orderBy(*by)) - 1).cast("long"))
    if many is not None:
        rows = rows.unionByName(running(many.withColumn("__one", F.lit(1).cast("long")), [group], order, "__one", out).drop("__one"))
    return rows


def parts_for(rows: int, rows_per_part: int) -> int:
    """Partitions needed so that no one holds more than about rows_per_part rows."""
    return max(1, -(-rows // rows_per_part))


def salt(column: Column, n: int) -> Column:
    """A stable salt in [0, n) from a column's value."""
    return F.pmod(F.xxhash64(column), F.lit(n))


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], weight: str, item: str, hot_from: int) -> DataFrame:
    """Left join on keys, unique in right, where right's `weight` is the number of left rows with the key (at least 1).

    Keys with more than hot_from left rows are broadcast: of n left rows there are at most n / hot_from of them, so a
    caller who keeps hot_from at n / 2000 or above broadcasts at most 2000 rows. All others meet in a shuffle, to which
    a hot row goes with a salt from its item, so that no task gets them all. `weight` is not in the result.
    """
    values = [c for c in right.columns if c not in {*keys, weight}]
    hot = right.where(F.col(weight) > hot_from).select(*keys, F.struct(*values).alias("__hot"))
    cold = right.where(F.col(weight) <= hot_from).select(*keys, F.lit(0).cast("long").alias("__spread"), F.struct(*values).alias("__cold"))
    placed = left.join(F.broadcast(hot), keys, "left")
    placed = placed.withColumn("__spread", F.when(F.col("__hot").isNotNull(), 1 + salt(F.col(item), 1024)).otherwise(F.lit(0).cast("long")))
    found = placed.join(cold, [*keys, "__spread"], "left")
    return found.select(*left.columns, *(F.coalesce(F.col(f"__hot.{v}"), F.col(f"__cold.{v}")).alias(v) for v in values))
