"""Session helpers: a local session for tests and the shared scratch folder."""

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession


_LOCAL_ROOT = "depsignal.scratch.dir"
#: What Arrow calls the stores that Hadoop names otherwise (fixed values).
ARROW_NAMES = {"s3a": "s3", "s3n": "s3"}


def local_session(cores: str = "8", app: str = "depsignal") -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share.

    The cluster names the folder in ``spark.checkpoint.dir``. Only a local
    session may fall back to a temporary folder, since there the executors
    live in the same process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_LOCAL_ROOT, None)
    if root is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="depsignal-")
        spark.conf.set(_LOCAL_ROOT, root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in whatever store holds it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a plain path is a local one."""
    if ":/" not in uri:
        return fs.LocalFileSystem(), uri
    store, _, rest = uri.partition(":/")
    return fs.FileSystem.from_uri(f"{ARROW_NAMES.get(store, store)}:/{rest}")
