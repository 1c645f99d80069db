"""Functions in Java, compiled in the driver by the compiler that Spark carries and sent to the executors as a jar."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import warnings
import weakref
import zipfile
from collections.abc import Callable
from functools import cache
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_READY: weakref.WeakKeyDictionary[SparkSession, dict[str, str]] = weakref.WeakKeyDictionary()


@cache
def _jar(source: str, jvm) -> str:
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook(Path(__file__).with_name(f"{source}.java").read_text())
    folder = tempfile.mkdtemp(prefix="pageloom-jar-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/pageloom-{source}.jar", "w") as z:
        for name, code in dict(compiler.getBytecodes()).items():
            z.writestr(f"{name.replace('.', '/')}.class", bytes(code))
    return f"{folder}/pageloom-{source}.jar"


def java_function(spark: SparkSession, source: str, name: str, kind: str) -> Callable[..., Column] | None:
    """The function of two columns that class `name` in {source}.java is, giving columns of that type; None, with a warning, where the session takes no Java."""
    own, call = _READY.setdefault(spark, {}), f"pageloom_{source}_{name}".lower()
    if call not in own:
        try:
            jvm, gateway = spark._jvm, spark.sparkContext._gateway
            spark.sql(f"ADD JAR '{_jar(source, jvm)}'")
            made = jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass(f"pageloom.{source}${name}")
            instance = made.getConstructor(gateway.new_array(jvm.java.lang.Class, 0)).newInstance(gateway.new_array(jvm.java.lang.Object, 0))
            spark._jsparkSession.udf().register(call, instance, jvm.org.apache.spark.sql.types.DataType.fromDDL(kind))
            own[call] = call
        except (AttributeError, TypeError, Py4JError, PySparkException, OSError) as e:
            warnings.warn(f"{source}.java can't be used, its Python form is slower: {e}", stacklevel=2)
            own[call] = ""
    return (lambda *columns: F.call_function(call, *columns)) if own[call] else None
