"""JSON sources and sinks: bundle configurations, golden cases, manifests, install markers, benchmark records."""

from __future__ import annotations

import json
import os
import platform
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import service

ENTITY = "span array<int>, text string, type string, tier string, confidence double, attrs map<string,string>"
GOLDEN = f"text string, entities array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in ENTITY.split(', '))}>>"
MANIFEST = "report_version string, artifacts array<struct<file:string,format:string,size_bytes:bigint,sha256:string>>"
MARKER = "name string, repo string, revision string, files array<string>, downloaded_utc string"


def golden(spark: SparkSession, path: str) -> DataFrame:
    """(case_text, start, end, text, type, tier, confidence) of expected entities."""
    cases = spark.read.schema(GOLDEN).json(path, multiLine=True)
    e = cases.select(F.col("text").alias("case_text"), F.explode("entities").alias("e"))
    return e.select("case_text", F.col("e.span")[0].alias("start"), F.col("e.span")[1].alias("end"), "e.text", "e.type", "e.tier", "e.confidence")


def label_space(spark: SparkSession, path: str) -> labels.LabelSpace:
    """The label space of a YAML file anywhere that Spark reads."""
    return labels.parse(spark.read.text(path, wholetext=True).first()[0])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.inline("artifacts"))


def marker(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MARKER).json(path, multiLine=True)


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, sha256) of the files in a folder."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def verified(spark: SparkSession, path: str, entries: DataFrame) -> DataFrame:
    """(file, sha256, verdict) of the files in a folder, against a manifest's entries (file, sha256): verified, or skipped where the manifest has none. A
    file that differs from its entry is an error."""
    m = entries.select("file", F.col("sha256").alias("wanted"))
    both = artifacts(spark, path).join(F.broadcast(m), "file", "left")
    bad = F.raise_error(F.concat(F.lit("SHA-256 differs from the manifest: "), "file")).cast("string")
    return both.select("file", "sha256", F.when(F.col("wanted").isNull(), "skipped").when(F.col("wanted") == F.col("sha256"), "verified").otherwise(bad).alias("verdict"))


def scanned(spark: SparkSession, path: str) -> DataFrame:
    """(file, precision) of the models in a folder, by what their graphs hold. A file is one cell, so up to 2 GB."""
    models = spark.read.format("binaryFile").option("pathGlobFilter", "*.onnx").option("recursiveFileLookup", "true").load(path)
    # Latin-1 maps each byte to a character, so names in the graph stay findable
    return models.select(F.element_at(F.split("path", "/"), -1).alias("file"), service.scanned_precision(F.decode("content", "ISO-8859-1")).alias("precision"))


def append_records(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tessera-")


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Where that is unset, a local master gets a local one; a cluster has to
    name one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = _local_folder()
    return f"{top.rstrip('/')}/tessera/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: it is computed once, and lost executors cost nothing."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    """(file system, path) of the file system that the path names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def put(spark: SparkSession, path: str, content: str | bytes) -> None:
    """Write one small file."""
    fs, p = _path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(content.encode() if isinstance(content, str) else content))
    out.close()


def read(spark: SparkSession, path: str) -> bytes:
    """One small file's content, on the driver."""
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def acquire(spark: SparkSession, source: str, cache: str, name: str, wanted: list[str], revision: str = "main") -> str:
    """The folder of a model's files: cache/name, copied from source unless its marker names the same source, revision and files and they are there.

    The copy is staged beside it and renamed at the end, so a half copy is never taken for a model. A missing file is an error.
    """
    folder, note = f"{cache}/{name}", f"{cache}/{name}/installed.json"
    fs, to = _path(spark, folder)
    if exists(spark, note):
        m = json.loads(read(spark, note))
        if (m["repo"], m["revision"]) == (source, revision) and set(wanted) <= set(m["files"]) and all(exists(spark, f"{folder}/{f}") for f in wanted):
            return folder
    staged = f"{cache}/.{name}-{uuid.uuid4().hex}"
    for f in wanted:
        from_fs, p = _path(spark, f"{source}/{f}")
        _, q = _path(spark, f"{staged}/{f}")
        spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(from_fs, p, fs, q, False, spark.sparkContext._jsc.hadoopConfiguration())
    put(spark, f"{staged}/installed.json", json.dumps({"name": name, "repo": source, "revision": revision, "files": sorted(wanted)}))
    fs.delete(to, True)
    fs.rename(_path(spark, staged)[1], to)
    return folder


def fingerprint(spark: SparkSession) -> dict[str, str]:
    """What a benchmark's figures depend on; not the machine's name."""
    memory = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") // 1_000_000
    return {"system": platform.system(), "machine": platform.machine(), "cpus": str(os.cpu_count()), "memory_mb": str(memory), "python": platform.python_version(), "spark": spark.version}


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.mkdirs(p)


def bundle_config(spark: SparkSession, path: str, block: str) -> DataFrame:
    """(head, head_idx, window, stride, labels_file, temperature) of a model bundle's config.json and, where present, calibration.json.

    block: the key in config.json that holds the heads; a bundle without it is an error. A temperature of 0 counts as 1, as does none.
    """
    text = spark.read.option("pathGlobFilter", "c*.json").text(path, wholetext=True).select("value", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))
    both = text.groupBy().agg(F.max(F.when(F.col("file") == "config.json", F.get_json_object("value", f"$.{block}"))).alias("c"), F.max(F.when(F.col("file") == "calibration.json", F.col("value"))).alias("t"))
    c = F.from_json(F.coalesce("c", F.raise_error(F.lit(f"config.json has no block {block}")).cast("string")), "heads array<string>, max_length int, labels_file string")
    rows = both.select(c.alias("c"), F.from_json("t", "map<string,double>").alias("t")).withColumn("window", F.coalesce(F.nullif("c.max_length", F.lit(0)), F.lit(512)))
    rows = rows.select(F.posexplode("c.heads").alias("head_idx", "head"), "window", "c.labels_file", "t")
    temperature = F.coalesce(F.nullif(F.try_element_at("t", "head"), F.lit(0.0)), F.lit(1.0))
    return rows.select("head", "head_idx", "window", F.greatest(F.lit(32), F.floor(F.col("window") / 8).cast("int")).alias("stride"), F.coalesce("labels_file", F.lit("labels-v2.0.yaml")).alias("labels_file"), temperature.alias("temperature"))


def golden_path(spark: SparkSession, bundle: str, packaged: str, repo: str | None = None) -> str | None:
    """The bundle's own golden file, else the packaged one whose stem is exactly the folder's name or the repository's last part."""
    stems = [bundle.rstrip("/").rsplit("/", 1)[-1], *([repo.rsplit("/", 1)[-1]] if repo else [])]
    for candidate in (f"{bundle}/golden-predictions.json", *(f"{packaged}/{s}.json" for s in stems if s)):
        fs, p = _path(spark, candidate)
        if fs.exists(p):
            return candidate
    return None
