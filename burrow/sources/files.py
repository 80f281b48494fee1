"""Files as sources: one source per file, in the order of the inputs, read in one scan; CSV in and out.

Missing files are left out and reported, and no file at all is an error; a file that exists but cannot be read, or whose
columns contradict another's, fails the scan. Lists of files are metadata and reach the driver; rows never do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import inputs


@dataclass(frozen=True)
class Listed:
    """A file of an input list, as its file system describes it."""

    source_id: int
    path: str
    bytes: int
    modified: int
    uri: str = ""


def listing(spark: SparkSession, spec: str, suffix: str = ".parquet") -> tuple[list[Listed], list[str]]:
    """The files that a specification names, by the file system of each, and the names of missing ones."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found: dict[str, tuple] = {}
    missing: list[str] = []
    for name in inputs.resolve(spec, suffix):
        at = jvm.org.apache.hadoop.fs.Path(name)
        system = at.getFileSystem(conf)
        held = system.globStatus(at) or []
        if not held:
            missing.append(name)
        for status in sorted(held, key=lambda s: str(s.getPath())):
            inside = system.listStatus(status.getPath()) if status.isDirectory() else [status]
            files = [(str(f.getPath()), f.getLen(), f.getModificationTime(), str(f.getPath().toUri())) for f in inside if f.isFile()]
            files = [f for f in sorted(files) if not status.isDirectory() or f[0].endswith(suffix)]
            found.update({path: rest for path, *rest in files if path not in found})
    if not found:
        raise FileNotFoundError(spec)
    return [Listed(n, path, *rest) for n, (path, rest) in enumerate(found.items())], missing


def read(spark: SparkSession, spec: str, *, union_by_name: bool = False, entry: str | None = "entry_id") -> tuple[DataFrame, list[str]]:
    """Rows of all files with ``source_id``, ``file_path`` and the row's number in its file, and the missing files.

    With ``union_by_name`` columns that a file lacks are null; else all files must have the columns of the first.
    """
    files, missing = listing(spark, spec)
    rows = spark.read.option("mergeSchema", str(union_by_name).lower()).parquet(*[f.path for f in files])
    ids = spark.createDataFrame([(f.source_id, f.path, f.uri) for f in files], "source_id long, file_path string, _file string")
    own = [F.col("_metadata.row_index").alias(entry)] if entry else []
    rows = rows.select(plain("_metadata.file_path").alias("_file"), *own, *[c for c in rows.columns if c not in (entry, "source_id", "file_path")])
    named = ids.withColumn("_file", plain("_file"))
    return rows.join(F.broadcast(named) if len(files) <= 100_000 else named, "_file").drop("_file"), missing


def plain(column: str):
    """An encoded path without the empty authority that is written or left out for local files."""
    return F.regexp_replace(F.col(column), "^file:/+", "/")


def read_csv(spark: SparkSession, spec: str, *, sep: str = ",", header: bool = True, all_text: bool = False, schema: str | None = None) -> DataFrame:
    """CSV files in one relation; types are given, inferred, or all texts. An empty field is null, a quoted empty one an empty text, and a bare ``\\N`` null too."""
    files, _ = listing(spark, spec, ".csv")
    reader = spark.read.option("header", str(header).lower()).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", "true").option("nullValue", "\\N")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", str(not all_text).lower())
    return reader.csv([f.path for f in files])


def write_csv(df: DataFrame, folder: str, *, sep: str = ",", parts: int = 1) -> None:
    """A report as CSV with a header, quoted so that ``read_csv`` gives the same rows; nulls are empty, empty texts are quoted."""
    df.coalesce(parts).write.mode("errorifexists").option("header", "true").option("sep", sep).option("quote", '"').option("escape", '"').option("emptyValue", '""').option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(folder)
