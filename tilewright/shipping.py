"""The package on the executors of a cluster."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import SparkSession

_shipped: set[str] = set()


def package_zip(target: str) -> str:
    """This package as a zip file that Python can import from."""
    root = os.path.dirname(os.path.abspath(__file__))
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(root)):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    return target


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application.

    A local master gets it, too: its Python workers find the package only where the driver was
    started in its folder. Where it is installed (``pip install .``), the copy does no harm.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    sc.addPyFile(package_zip(os.path.join(tempfile.mkdtemp(prefix="tilewright-"), "tilewright.zip")))
    _shipped.add(sc.applicationId)


@contextmanager
def by_value(*names: str) -> Iterator[None]:
    """What is pickled inside carries the code of these modules instead of their names.

    Spark starts Python processes of its own for stateful streams and streaming sources; they see none of
    the files sent to executors.
    """
    modules = [sys.modules[n] for n in names]
    for m in modules:
        cloudpickle.register_pickle_by_value(m)
    try:
        yield
    finally:
        for m in modules:
            cloudpickle.unregister_pickle_by_value(m)
