"""Make this package importable in the Python workers of any cluster."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import SparkSession

import riskmart
from riskmart.sources import shared_dir

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors of this application, once.

    Tasks unpickle functions by their module's name. The archive lies in the shared folder, and Spark hands it to every executor, also to
    those that start later, so nothing has to be installed on the machines.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = Path(riskmart.__file__).parent
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/riskmart-{uuid4().hex}.zip")
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = system.create(place)
    stream.write(bytearray(archive.getvalue()))
    stream.close()
    spark.sparkContext.addPyFile(system.makeQualified(place).toString())
    _shipped.add(application)
