"""What every operator needs from a session: shipped code, a shared scratch folder, sized broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

_PACKAGE = Path(__file__).resolve().parent
_BATCH, _BATCH_DEFAULT, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"
BROADCAST_BYTES = 12 << 20
_SHIPPED: set[str] = set()
_CLASSES: dict[tuple[str, str], object] = {}
_DIRS: list[tuple[SparkSession, str]] = []
_LOCAL_ROOT: list[str] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that they need no shared code folder."""
    if spark.conf.get(_BATCH) == _BATCH_DEFAULT:  # batches are bounded by bytes; a setting of the session's own stays
        spark.conf.set(_BATCH, _BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    out = os.path.join(tempfile.mkdtemp(prefix="quillstone-"), f"{_PACKAGE.name}.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, f"{_PACKAGE.name}/{p.relative_to(_PACKAGE)}")
    spark.sparkContext.addPyFile(out)


def java_function(spark: SparkSession, name: str, kind: DataType, *options: object, data: Callable[[], bytes] | None = None) -> Callable[..., Column]:
    """The class of java/{name}.java as a function of columns, made with options.

    For what goes byte by byte, where Python takes 30 to 100 times as long. Janino compiles it once per application, the
    compiler that Spark itself brings for its generated code; data lies beside the class as {name}.bin.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    key = (spark.sparkContext.applicationId, name)
    if key not in _CLASSES:
        parent = jvm.java.lang.Thread.currentThread().getContextClassLoader()
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(parent)
        compiler.cook((_PACKAGE / "java" / f"{name}.java").read_text())
        out = os.path.join(tempfile.mkdtemp(prefix="quillstone-"), f"{name}.jar")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for c, code in compiler.getBytecodes().items():
                z.writestr(f"{c.replace('.', '/')}.class", bytes(code))
            if data is not None:
                z.writestr(f"{_PACKAGE.name}/{name}.bin", data())
        spark.sparkContext._jsc.addJar(out)
        urls = gateway.new_array(jvm.java.net.URL, 1)
        urls[0] = jvm.java.io.File(out).toURI().toURL()
        _CLASSES[key] = jvm.java.net.URLClassLoader(urls, parent).loadClass(f"{_PACKAGE.name}.{name}")
    given = gateway.new_array(jvm.java.lang.Object, len(options))
    for k, x in enumerate(options):
        given[k] = x
    function = f"{_PACKAGE.name}_{name}_{uuid.uuid4().hex}" if options else f"{_PACKAGE.name}_{name}"
    spark._jsparkSession.udf().register(function, _CLASSES[key].getConstructors()[0].newInstance(given), spark._jsparkSession.parseDataType(kind.json()))
    return lambda *columns: F.call_udf(function, *columns)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only a local master may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(f"file://{tempfile.mkdtemp(prefix='quillstone-shared-')}")
    return _LOCAL_ROOT[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the driver's Python ends."""
    if not _DIRS:
        atexit.register(_clean)
    path = f"{shared_root(spark)}/quillstone/{name}-{uuid.uuid4().hex}"
    _DIRS.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that no later plan reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _DIRS:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended already
            pass


def materialize(df: DataFrame, name: str, codec: str = "zstd", file_rows: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and lost executors lose nothing.

    file_rows: rows a file at most. Parquet writes pages of 100 rows at least and reads 4,096 rows of a file at once, so
    that rows of megabytes need it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", codec)
    if file_rows:
        writer = writer.option("maxRecordsPerFile", file_rows)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path  # type: ignore[attr-defined]
    return out


def drop_scratch(df: DataFrame) -> None:
    """Delete what materialize() wrote; only once nothing lazy depends on it."""
    remove(df.sparkSession, df._scratch_path)  # type: ignore[attr-defined]


def _bytes_of(c: Column, kind: DataType) -> Column:
    """The bytes of a value: what its type fixes, and the lengths of what varies."""
    if isinstance(kind, StructType):
        return sum((_bytes_of(c[f.name], f.dataType) for f in kind.fields), F.lit(8))
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        return F.coalesce(F.aggregate(c, F.lit(24).cast("long"), lambda a, x: a + _bytes_of(x, kind.elementType)), F.lit(24))
    return F.lit(8)


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when df, whose rows are counted, is measured within limit bytes; otherwise Spark shuffles."""
    if rows * 8 * (len(df.columns) + 1) > limit:
        return df
    if not any(isinstance(f.dataType, StructType | StringType | BinaryType | ArrayType) for f in df.schema):
        return F.broadcast(df)
    size = df.select(F.sum(_bytes_of(F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema).cast("long")).alias("b")).first().b or 0
    return F.broadcast(df) if size <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """df dealt out over all cores if it comes in fewer parts, as a small file does; larger tables stay where they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """names, with underscores in front until no column of df has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
