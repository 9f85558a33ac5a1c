"""Ship worker-side code: by value, or the package as a whole.

The vector scorer runs inside Python workers (``mapInArrow``). Its closure
calls helpers defined at module level; cloudpickle would pickle those *by
reference*, and a worker that cannot import this package (a cluster
executor, or a driver that put the package on its own ``sys.path`` only)
would fail. Registering the few worker-side modules makes cloudpickle carry
their functions by value, so nothing has to be installed or distributed.
"""

from __future__ import annotations

import io
import os
import types
import zipfile

from pyspark import SparkFiles
from pyspark.sql import SparkSession


def by_value(*modules: types.ModuleType) -> None:
    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover
        import cloudpickle
    for m in modules:
        try:
            cloudpickle.register_pickle_by_value(m)
        except (ValueError, AttributeError):  # already registered / old cloudpickle
            pass


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package as a zip, once for each Spark application.

    For code with caches at module level (tokenizers, power tables), which
    shipping by value would empty with every task.
    """
    sc = spark.sparkContext
    name = f"{__name__.split('.')[0]}.zip"
    if any(name in path for path in sc._python_includes):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    # the application's own folder on the driver; executors fetch the file from the driver
    folder = os.path.join(SparkFiles.getRootDirectory(), "packages")
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as out:
        out.write(blob.getvalue())
    sc.addPyFile(os.path.join(folder, name))
