"""Tables in the shared folder, and connected components over shared tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset on one
    machine (tests) a folder of this process is used instead; on a cluster that
    is an error, since executors would write to their own disks.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="histoloom-")
    return f"file://{_own_dir}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/histoloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd", small: bool = False) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder, and read again.

    It cuts the lineage: a lost executor costs only the tasks of later steps.
    A ``small`` table, as of pre-aggregated counts, is written by an eighth of
    a shuffle's tasks, so that it is not cut into as many files.
    """
    spark = df.sparkSession
    if small:
        df = df.coalesce(max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Removes the files of a table made by :func:`written`."""
    spark = df.sparkSession
    marker = f"{shared_dir(spark)}/histoloom/"
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if marker.split("://")[-1].lstrip("/") in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Links of one node that one task may read in a round.
MOST_LINKS = 500


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph.

    ``edges`` has long columns ``a`` and ``b`` (self-loops and repeats allowed).
    Returns ``node, root`` for every node that has an edge to another node;
    root is the smallest node of its component.

    Rounds of large-star and small-star contraction (Kiveris et al., 2014): each
    rewires neighbours to a local minimum, so the number of edges never grows
    and the number of rounds is logarithmic. Each round is a written table. A
    node's neighbours are never gathered into one row: the minimum is a
    pre-aggregated ``min`` that is joined back. Links of a node that has more
    than ``MOST_LINKS`` are dealt over several keys for that join.
    """
    spark = edges.sparkSession
    both = edges.where("a <> b")
    now = written(both.selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "edges")
    mark = None
    edges_now = now.count()
    for _ in range(max_rounds):
        # Large star: every larger neighbour of a node moves to the node's minimum.
        sides = now.union(now.select("b", "a")).toDF("u", "v")
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        # At most 200,000 nodes have this many links each.
        most = max(MOST_LINKS, edges_now // 100_000)
        hubs = written(least.where(F.col("n") > most).select("u", F.ceil(F.col("n") / most).cast("long").alias("deal")), "hubs") if edges_now > most else None
        far = sides.where("v > u")
        if hubs is None or hubs.isEmpty():
            met = far.join(least, "u")
        else:
            dealt = far.join(F.broadcast(hubs), "u", "left").withColumn("key", F.coalesce(F.pmod(F.xxhash64("v"), F.col("deal")), F.lit(0).cast("long")))
            times = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("deal", F.lit(1).cast("long")) - 1))
            targets = least.join(F.broadcast(hubs), "u", "left").select("u", "m", times.alias("key"))
            met = dealt.join(targets, ["u", "key"])
        large = met.selectExpr("v a", "m b").where("a <> b").distinct()
        # Small star: every smaller neighbour, and the node, move to the minimum.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        out = small.selectExpr("b a", "m b").union(low.selectExpr("a", "m b")).where("a <> b").distinct()
        after = written(out, "edges")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(now)
        if hubs is not None:
            drop(hubs)
        now, edges_now = after, seen[0]
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.selectExpr("a node", "b root")
    return roots.union(roots.selectExpr("root", "root").distinct())
