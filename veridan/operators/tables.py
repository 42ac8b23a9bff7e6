"""Tables in the shared folder between steps, and connected components over them."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder that the session names in spark.checkpoint.dir.

    Only where a session on a single machine names none, a local temporary folder is set; on a cluster
    that would scatter tables over machines, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for made in _MADE.get():
        made.append(path)
    return path


#: Of each :func:`passing` that is open, the paths named in it.
_MADE: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("made", default=())
#: While tables are made that nobody outside reads: a shuffle's files go when its step is done, and steps over many columns
#: are cut into methods that the JVM compiles (it never compiles one above 8,000 bytecodes, and runs it many times slower).
_PASSING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.codegen.hugeMethodLimit": "8000"}


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables made inside are deleted at the end, but for those given to the function that this yields.

    So all that is to last must be written inside. Threads started inside take part if they run in a copy of the context.
    """
    made: list[str] = []
    before = {k: spark.conf.get(k, None) for k in _PASSING}
    token = _MADE.set((*_MADE.get(), made))

    def keep(df: DataFrame) -> DataFrame:
        own = {uri.rsplit("/", 2)[1] for uri in df.inputFiles()}
        made[:] = [p for p in made if p.rsplit("/", 1)[1] not in own]
        return df

    try:
        for k, v in _PASSING.items():
            spark.conf.set(k, v)
        yield keep
    finally:
        _MADE.reset(token)
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like :func:`stored`, in buckets by ``key``: reading it, aggregates, windows and joins by the key need no shuffle.

    The files lie in the shared folder. The catalog's entry is only needed to write and read buckets, so it goes at once.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    entry = "veridan_" + path.rsplit("-", 1)[1]
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).format("parquet").saveAsTable(entry)
    out = spark.table(entry)
    out = out.select(*out.columns)
    spark.sql(f"DROP TABLE {entry}")
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`stored` that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        for uri in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(uri.rsplit("/", 1)[0])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b: long); nodes without an edge are absent.

    Large-star and small-star rounds (Kiveris et al., SoCC 2014) as aggregates and joins. The state of each
    round is a written table, so no lineage grows and lost executors cost one round at most; it is deleted
    when the next one stands. A hub's neighbours are never gathered: its least one is a partial aggregate that is
    joined back, and rows of a hub that outgrow a task are split by the adaptive skew join. The rounds end
    when one changes nothing.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    mark = None
    for _ in range(max_rounds):
        # Large star: the larger end of each edge goes to the least neighbour of the smaller end, or to that end itself.
        least = e.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        large = e.join(least, F.col("v") == F.col("k"), "left").select("u", F.coalesce("m", "v").alias("v"))
        # Small star: a node and its smaller neighbours go to the least of these.
        least = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
        new = stored(small.select("p.u", "p.v").where("u <> v").distinct(), "components")
        dropped(e)
        e = new
        # Count and hash of the edges: a round that leaves both alike has changed nothing, so the stars are final.
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
