"""Session helpers: table loading, staged (materialised) tables, size checks."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes a small side may have before it is broadcast by this library.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20

_roots: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so they need no copy on their path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quillspan-code-")) / "quillspan_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    atexit.register(shutil.rmtree, archive.parent, ignore_errors=True)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test or production table, stored as Parquet under ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """Folder for staged tables, visible to every executor.

    It is the folder named by ``spark.checkpoint.dir``. Only where that is unset (tests, a local session) a temporary
    folder of this machine is taken; on a cluster manager without the setting an error is raised instead, since a
    machine-local folder would not be seen by the other executors.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            base = "file://" + tempfile.mkdtemp(prefix="quillspan-")
        elif "://" not in base:
            base = "file://" + os.path.abspath(base) if spark.sparkContext.master.startswith("local") else base
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/quillspan-{uuid.uuid4().hex}")
        _roots[app] = jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(jvm).toString()
        atexit.register(_forget, spark, _roots[app])
    return _roots[app]


def _forget(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001  the session is already gone; the folder's owner cleans it
        pass


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder; any other trouble with the storage is raised."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a staged table through Hadoop's file system, so it works on any storage."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage like ``checkpoint()``, but compressed, with column pruning on every later read and with real sizes
    for the optimiser. A lost executor only repeats its own tasks.
    """
    path = f"{shared_root(df.sparkSession)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_counted(df: DataFrame, label: str, **counts: Column) -> tuple[DataFrame, dict]:
    """:func:`stage`, with aggregates of the rows taken while they are written, so no second job reads them."""
    seen = Observation()
    out = stage(df.observe(seen, *[c.alias(k) for k, c in counts.items()]), label)
    return out, seen.get


def read_file_rows(folder: str, columns: list[str]):
    """The rows of the Parquet files below ``folder`` as an Arrow table, read by the Python worker that calls this; a missing folder has none."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs as arrow_fs

    scheme, _, rest = folder.partition(":") if ":" in folder.split("/", 1)[0] else ("file", "", folder)
    if scheme == "file":
        fs, path = arrow_fs.LocalFileSystem(), "/" + rest.lstrip("/")
    else:
        fs, path = arrow_fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")
    found = fs.get_file_info(arrow_fs.FileSelector(path, allow_not_found=True))
    files = sorted(f.path for f in found if f.path.endswith(".parquet"))
    tables = [pq.ParquetFile(fs.open_input_file(f)).read(columns=columns) for f in files]
    return pa.concat_tables(tables) if tables else pa.table({c: [] for c in columns})


def unstage(df: DataFrame) -> None:
    """Delete a table made by :func:`stage` when no later plan reads it."""
    root = shared_root(df.sparkSession)
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "quillspan-" in path and root.split("://")[-1].lstrip("/") in path:
            delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Deletes all staged tables of this application; for long sessions, between queries whose results have been read or written."""
    root = _roots.pop(spark.sparkContext.applicationId, None)
    if root:
        delete(spark, root)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than that many."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only behind counted bounds of rows and bytes (as JSON text); beyond them the join stays a shuffle join.

    No more than ``rows`` + 1 rows are read for it. Stage a table first that is costly to compute.
    """
    wide = F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    n, held = df.limit(rows + 1).agg(F.count(F.lit(1)), wide).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= size else df


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
