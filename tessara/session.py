"""Session settings shared by tests, bench and scripts."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, app: str = "tessara", **conf: str) -> SparkSession:
    """A local session; a cluster brings its own and needs none of this."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoint() at the shared folder that the cluster names.

    Only where ``spark.checkpoint.dir`` is unset and the session is local (tests, a laptop) is a folder of our own used;
    it goes away with the process. On a cluster, whose executors don't share the driver's disk, that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = context.getConf().get("spark.checkpoint.dir")
    if shared is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import atexit
        import shutil
        import tempfile

        shared = tempfile.mkdtemp(prefix="tessara-checkpoint-")
        atexit.register(shutil.rmtree, shared, True)
    context.setCheckpointDir(shared)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each application.

    Functions that run in Python are pickled by reference to their module, so a worker must be able to import it. The
    package is small; the driver serves it as one archive, wherever the library is installed there.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    import tempfile
    import zipfile
    from pathlib import Path

    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tessara-code-")) / "tessara.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, f"{package.name}/{file.relative_to(package)}")
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
