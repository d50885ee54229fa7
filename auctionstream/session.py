"""Session settings and the shared work folder."""

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(master: str = "local[8]", app: str = "auctionstream", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the operators expect; on a cluster use spark-submit's own."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # A join before work on the same key may be split too, at the price of one more shuffle behind it.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        .config("spark.driver.memory", "8g")
        # The event generator's stages compile to methods above HotSpot's default limit.
        .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _own_base() -> str:
    """A folder of this process, removed when it ends."""
    base = tempfile.mkdtemp(prefix="auctionstream-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder of the cluster (``spark.checkpoint.dir``).

    Only a local session may lack the setting; it then gets a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_base()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write the rows to the shared folder and read them from there.

    For results that several later steps use and that are costly to compute again.
    """
    path = work_folder(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
