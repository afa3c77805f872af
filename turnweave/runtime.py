"""Session, checkpoint folder and the helpers that keep plans safe under skew.

``cut`` truncates lineage through a table written to the folder that all executors share (``spark.checkpoint.dir``),
so a lost executor never costs more than the stages since the last cut.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key that holds more than one row in HOT_SHARE counts as hot. There are at most HOT_SHARE such keys, whatever the
#: size of the data, so their list may be broadcast.
HOT_SHARE = 1000


def session(app: str = "turnweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators were planned for; ``conf`` overrides them (dots as ``__``)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): str(v) for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """This package sent to the Python workers, once for each application: they needn't have it on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="turnweave-code-")) / f"turnweave-{sc.applicationId}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in root.rglob("*.py"):
            z.write(f, Path(root.name) / f.relative_to(root))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only in a local session that names none (tests).

    On a cluster a folder of one machine would lose what other machines write, so a session without the setting raises.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not (sc.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="turnweave-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed now, written to the shared folder and read from there from here on.

    A written table rather than ``checkpoint()``: it is columnar and compressed, its size is known to the planner, and
    it carries none of the constraints whose propagation grows with every round of an iterative plan. The tables are
    removed by :func:`release`, or when Python ends.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{checkpoint_dir(spark)}/turnweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._turnweave_path = path
    return out


_written: dict[str, SparkSession] = {}


def release(*dfs: DataFrame) -> None:
    """Removes the tables behind results of :func:`cut` that nothing will read again; any other frame is ignored."""
    for df in dfs:
        path = getattr(df, "_turnweave_path", None)
        if path in _written:
            _remove(_written.pop(path), path)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _remove_written() -> None:
    for path, spark in _written.items():
        try:
            _remove(spark, path)
        except Exception:  # the session ended first; the folder belongs to the cluster
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def hot_keys(df: DataFrame, key: str, share: int = HOT_SHARE) -> DataFrame:
    """The keys that hold more than 1/``share`` of the rows, with their counts: at most ``share`` rows."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    return counts.join(F.broadcast(total), F.col("_n") * share > F.col("_all")).select(key, "_n")


def lookup(big: DataFrame, unique: DataFrame, key: str, how: str = "left", hot: DataFrame | None = None, salts: int = 32) -> DataFrame:
    """``big`` joined with a side that has one row for each key, hot keys of ``big`` spread over ``salts`` tasks.

    Only the rows of hot keys (a broadcast list of bounded length, see :func:`hot_keys`) and those without a key, which
    match nothing, are salted, and only hot keys are repeated on the unique side, so the shuffle grows by at most
    ``HOT_SHARE * salts`` rows.
    """
    hot = (hot if hot is not None else hot_keys(big, key)).select(F.col(key).alias("_hk"))
    b = big.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    b = b.withColumn("_salt", F.when(F.col("_hk").isNotNull() | F.col(key).isNull(), (F.rand(7) * salts).cast("int")).otherwise(0)).drop("_hk")
    u = unique.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    u = u.withColumn("_salt", F.explode(F.when(F.col("_hk").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hk")
    return b.join(u, [key, "_salt"], how).drop("_salt")


def salted_join(left: DataFrame, right: DataFrame, key: str, left_by: Column, right_by: Column) -> DataFrame:
    """Inner join of two sides that both repeat ``key``; the pairs of a hot key are spread over a square grid of tasks.

    A row of a hot key goes to one line of the grid by a hash of ``left_by`` or ``right_by`` and is repeated along it,
    so each pair meets in one cell. The grid has as many cells as the key has thousandths of a side's rows, and a key
    with fewer than four has no grid: what is repeated stays small beside what it spreads. The list of hot keys of both
    sides, HOT_SHARE / 2 at most, is broadcast. Both inputs are read twice and should be written tables.
    """

    def hot_of(df: DataFrame) -> DataFrame:
        n, rows = F.count(F.lit(1)), df.count()
        return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.floor(F.sqrt(n * HOT_SHARE / F.lit(float(max(rows, 1))))).cast("int").alias("_side")).where("_side > 1")

    hot = hot_of(left).unionByName(hot_of(right)).groupBy(F.col(key).alias("_hk")).agg(F.max("_side").alias("_side"))
    along = F.when(F.col("_side").isNotNull(), F.sequence(F.lit(0), F.col("_side") - 1)).otherwise(F.array(F.lit(0)))
    line = lambda by: F.when(F.col("_side").isNotNull(), F.pmod(F.xxhash64(F.lit(3), by), F.col("_side")).cast("int")).otherwise(F.lit(0))
    grid = lambda df, at, over, by: df.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left").withColumn(at, line(by)).withColumn(over, F.explode(along)).drop("_hk", "_side")
    return grid(left, "_g0", "_g1", left_by).join(grid(right, "_g1", "_g0", right_by), [key, "_g0", "_g1"]).drop("_g0", "_g1")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` partitioned by ``by`` in as many partitions as the session has for shuffles, which adaptive execution
    leaves as they are: for rows of compact arrays, whose size says little about the work that unpacks them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where nulls equal nulls; the columns of ``left`` and those of ``right`` that are no keys."""
    r = right.select(*(F.col(k).alias(f"_r{k}") for k in keys), *(c for c in right.columns if c not in keys))
    cond = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys))
    return left.join(r, cond, how).drop(*(f"_r{k}" for k in keys))


def carry_over_buckets(buckets: DataFrame, keys: list[str], bucket: str, exprs: dict[str, tuple[Column, str]]) -> DataFrame:
    """Values handed on between the buckets of one key.

    ``exprs`` gives for each new column an expression over the bucket rows and the direction: ``before`` sums it over
    the earlier buckets, ``max_before`` takes the greatest of the earlier ones, ``last_before`` their last non-null,
    ``first_after`` the first non-null of the later ones. The table has one row for each bucket, so the window is short even for a hot key.
    """
    w = Window.partitionBy(*keys).orderBy(bucket)
    back = w.rowsBetween(Window.unboundedPreceding, -1)
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    new = {}
    for name, (e, how) in exprs.items():
        if how == "before":
            new[name] = F.coalesce(F.sum(e).over(back), F.lit(0))
        elif how == "max_before":
            new[name] = F.max(e).over(back)
        elif how == "last_before":
            new[name] = F.last(e, ignorenulls=True).over(back)
        else:
            new[name] = F.first(e, ignorenulls=True).over(ahead)
    return buckets.withColumns(new).select(*keys, bucket, *new)
