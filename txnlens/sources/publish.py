"""Files put in place by a manifest: readers see the old result or the new one, never a part.

``publish`` writes a table into a folder of its own and then lists its files, with sizes and row counts, in
``manifest.json``, which takes the place of the last one in one step. A job that dies half-way leaves
files that no manifest names. ``read_published`` reads exactly the files of the manifest and stops
if one is missing or has another size.

The run before the last stays for readers that have begun; older ones that manifests have named are removed.
The manifest goes through the driver: a line for each file, no rows.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from txnlens.sources.csv import read_raw, write_csv, write_json

MANIFEST = "manifest.json"


@dataclass(frozen=True)
class File:
    name: str
    size: int
    rows: int


@dataclass(frozen=True)
class Manifest:
    """``schema`` is the table's as JSON; ``run`` the folder of its files, ``before`` that of the last run."""

    kind: str
    run: str
    schema: str
    files: list[File]
    before: str | None = None

    @property
    def rows(self) -> int:
        return sum(f.rows for f in self.files)


def _folder(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """The data files below a folder, by their path from there."""
    folder, files = _folder(spark, path)
    root = files.makeQualified(folder).toString().rstrip("/") + "/"
    found, listed = {}, files.listFiles(folder, True)
    while listed.hasNext():
        file = listed.next()
        if not file.getPath().getName().startswith(("_", ".")):
            found[file.getPath().toString().removeprefix(root)] = file.getLen()
    return found


def read_manifest(spark: SparkSession, path: str) -> Manifest | None:
    """What is published at ``path``; None if nothing is."""
    folder, files = _folder(spark, f"{path.rstrip('/')}/{MANIFEST}")
    if not files.exists(folder):
        return None
    stream = files.open(folder)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    content = json.loads(text)
    return Manifest(**{**content, "files": [File(**f) for f in content["files"]]})


def _put(spark: SparkSession, path: str, manifest: Manifest) -> None:
    """Write the manifest aside and move it over the last one."""
    base = path.rstrip("/")
    aside, files = _folder(spark, f"{base}/_{uuid.uuid4().hex}.json")
    stream = files.create(aside, False)
    stream.write(bytearray(json.dumps(asdict(manifest)).encode()))
    stream.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    over[0] = jvm.Options.Rename.OVERWRITE
    context = jvm.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(aside), files.makeQualified(jvm.Path(f"{base}/{MANIFEST}")), over)


def _read(spark: SparkSession, kind: str, paths: list[str], schema: str) -> DataFrame:
    table = StructType.fromJson(json.loads(schema))
    if not paths:
        return spark.createDataFrame([], table)
    if kind == "parquet":
        return spark.read.schema(table).parquet(*paths)
    if kind == "json":
        return spark.read.schema(table).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(paths)
    text = read_raw(spark, paths)
    return text.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in table])


def publish(df: DataFrame, path: str, kind: str = "csv", by_day: bool = False) -> Manifest:
    """Write a table as csv, json or parquet files and make them what is published at ``path``."""
    spark, base = df.sparkSession, path.rstrip("/")
    last = read_manifest(spark, base)
    run = f"run-{uuid.uuid4().hex}"
    here = f"{base}/{run}"
    if kind == "csv":
        write_csv(df, here, by_day)
    elif kind == "json":
        write_json(df, here)
    elif kind == "parquet":
        df.write.parquet(here)
    else:
        raise ValueError(f"no such kind of file: {kind}")
    sizes, schema = _sizes(spark, here), df.schema.json()
    named = F.regexp_extract(F.col("_metadata.file_path"), f"{run}/(.*)$", 1).alias("name")
    # read back what is written: the counts are those of the files
    written = _read_rows(spark, kind, [f"{here}/{name}" for name in sizes], schema)
    counts = {r["name"]: r["count"] for r in written.groupBy(named).count().collect()} if sizes else {}
    listed = [File(f"{run}/{name}", size, counts.get(name, 0)) for name, size in sorted(sizes.items())]
    manifest = Manifest(kind, run, schema, listed, last.run if last else None)
    _put(spark, base, manifest)
    if last and last.before:
        old, files = _folder(spark, f"{base}/{last.before}")
        files.delete(old, True)
    return manifest


def _read_rows(spark: SparkSession, kind: str, paths: list[str], schema: str) -> DataFrame:
    """The files as they are, for counting."""
    if not paths or kind != "csv":
        return _read(spark, kind, paths, schema)
    return read_raw(spark, paths)


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The table published at ``path``."""
    base = path.rstrip("/")
    manifest = read_manifest(spark, base)
    if manifest is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    sizes = _sizes(spark, f"{base}/{manifest.run}")
    for file in manifest.files:
        if sizes.get(file.name.removeprefix(f"{manifest.run}/")) != file.size:
            raise ValueError(f"{file.name} is missing or isn't the file that was published")
    return _read(spark, manifest.kind, [f"{base}/{f.name}" for f in manifest.files], manifest.schema)
