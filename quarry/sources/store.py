"""Written tables: the manifest, the index and its checks, the question set."""

from __future__ import annotations

import atexit
import hashlib
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir`` or ``setCheckpointDir``); a temporary one only where driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            folder = tempfile.mkdtemp(prefix="quarry-work-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _own.append(f"file://{folder}")
        base = _own[0]
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: what several later plans read is computed once, and survives lost executors."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_once: dict[tuple, DataFrame | object] = {}


def _state(spark: SparkSession, files: list[str]) -> tuple:
    """Names, sizes and times of files: what tells that a table has changed."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for f in sorted(files):
        p = jvm.org.apache.hadoop.fs.Path(f)
        s = p.getFileSystem(conf).getFileStatus(p)
        out.append((f, s.getLen(), s.getModificationTime()))
    return tuple(out)


def once(label: str, inputs: list[DataFrame], make: Callable[[], DataFrame | object]) -> DataFrame | object:
    """What ``make`` gives, once a session: a DataFrame as a written table, other things (tables written already) as they are.  Other input files make another one."""
    spark = inputs[0].sparkSession
    key = (label, spark.sparkContext.applicationId, *(_state(spark, t.inputFiles()) for t in inputs))
    if key not in _once:
        made = make()
        _once[key] = written(made, label) if isinstance(made, DataFrame) else made
    return _once[key]


def write_manifest(documents: DataFrame, skipped: DataFrame, path: str, stale: DataFrame | None = None) -> None:
    """Accepted and skipped sources, stale files and the counts of each as JSON lines; a reason is a row, never an exception.  A document without a path is not written."""
    accepted = documents.where("path is not null") if "path" in documents.columns else documents
    parts = {"document": accepted, "skipped": skipped} | ({"stale": stale} if stale is not None else {})
    rows = None
    for kind, df in parts.items():
        told = df.select(F.lit(kind).alias("kind"), F.struct(*df.columns).alias(kind))
        counts = df.agg(F.lit("count").alias("kind"), F.struct(F.lit(kind).alias("of"), F.count("*").alias("n")).alias("count"))
        for x in (told, counts):
            rows = x if rows is None else rows.unionByName(x, allowMissingColumns=True)
    rows.write.json(path)


def read_manifest(spark: SparkSession, path: str, games: list[str] | None = None) -> DataFrame:
    """The documents of a manifest, of some games if ``games`` are given."""
    rows = spark.read.json(path).where("kind = 'document'").select("document.*")
    return rows.where(F.col("game").isin(*games)) if games else rows


def manifest_counts(spark: SparkSession, path: str) -> DataFrame:
    """(of, n) as the manifest states them."""
    return spark.read.json(path).where("kind = 'count'").select("count.*")


def write_stats(chunks: DataFrame, tokens: Column, price: float | None, path: str) -> DataFrame:
    """Writes one row on an index (chunks, books, amendments, tokens, cost or null without a price, path) and reads it back."""
    row = chunks.agg(F.count("*").alias("chunks"), F.countDistinct("game").alias("books"), F.count_if(F.col("scope") == "amendment").alias("amendments"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"))
    cost = F.round(F.col("tokens") * price / 1_000_000, 6) if price is not None else F.lit(None).cast("double")
    row.withColumns({"usd": cost, "built_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "path": F.lit(path)}).coalesce(1).write.mode("overwrite").json(f"{path}/stats")
    return chunks.sparkSession.read.schema("chunks long, books long, amendments long, tokens long, usd double, built_at string, path string").json(f"{path}/stats")


def write_amendments(amendments: DataFrame, skipped: DataFrame, path: str) -> None:
    """Notices that amend and those that do not, with the reason, and the counts of both."""
    write_manifest(amendments, skipped, path)


def read_amendments(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The amendments of a file, none if it is not there."""
    rows = read_or_empty(spark, path, f"kind string, document struct<{', '.join(c.strip().replace(' ', ':', 1) for c in schema.split(','))}>")
    return rows.where("kind = 'document'").select("document.*")


def cached(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (name, url) with ``held``: is there a file (name, content) of that name that is a PDF?  The others are to be fetched."""
    good = files.where(F.substring("content", 1, 5) == F.lit(b"%PDF-")).select("name").distinct().withColumn("held", F.lit(True))
    return wanted.join(good, "name", "left").withColumn("held", F.coalesce("held", F.lit(False)))


def select_cases(cases: DataFrame, ids: list[str] | None = None, buckets: list[str] | None = None) -> DataFrame:
    """The cases with one of the ids, and in one of the buckets, where such are given."""
    out = cases.where(F.col("id").isin(*ids)) if ids else cases
    return out.where(F.col("bucket").isin(*buckets)) if buckets else out


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows on one side only, with repeats counted."""
    cols = sorted(a.columns)
    a, b = a.select(*cols), b.select(*cols)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON source whose absence is a warning, not an error."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """A question set in YAML (or JSON) on the driver: id, bucket, question, game."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml

        cases = yaml.safe_load(text)["cases"]
    except ModuleNotFoundError:
        cases = json.loads(text)["cases"]
    return spark.createDataFrame([(c["id"], c.get("bucket"), c["question"], c.get("game")) for c in cases], "id string, bucket string, question string, game string")


def read_settings(path: str) -> tuple[dict, dict]:
    """The configuration of a question set and its pins: what a corpus is expected to hold."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml

        whole = yaml.safe_load(text)
    except ModuleNotFoundError:
        whole = json.loads(text)
    return whole.get("config") or {}, whole.get("regression") or {}


def check_pins(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, found, expected, ok) of counts (name, value) against the pins (name, value); what is on one side only is not ok."""
    j = found.select("name", F.col("value").alias("found")).join(expected.select("name", F.col("value").alias("expected")), "name", "full")
    return j.withColumn("ok", F.coalesce(F.col("found") == F.col("expected"), F.lit(False)))


def report(measurements: DataFrame) -> str:
    """Measurements (name, value, sd, n, unit) as a table in markdown; a handful of rows by nature."""
    lines = ["| name | value | n |", "|-|-|-|"]
    for r in measurements.orderBy("name").collect():
        spread = f" ± {r['sd']:.4f}" if r["sd"] is not None else " (n=1)"
        lines.append(f"| {r['name']} | {r['value']:.4f}{spread} {r['unit']} | {r['n']} |")
    return "\n".join(lines)


def write_results(summary: DataFrame, details: DataFrame, path: str) -> str:
    """Writes ``summary`` (measurements) and ``details`` as JSON and the report on the first as markdown, which is returned."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    details.write.mode("overwrite").json(f"{path}/details")
    text = report(summary)
    summary.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(f"{path}/report")
    return text


class unchanged:
    """A block during which files must not change: their digests before and after are compared."""

    def __init__(self, *paths: str) -> None:
        self.paths = paths

    def _digests(self) -> list[str]:
        return [hashlib.sha256(Path(p).read_bytes()).hexdigest() for p in self.paths]

    def __enter__(self) -> unchanged:
        self.before = self._digests()
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None and self._digests() != self.before:
            raise RuntimeError("the question set changed while it was run")


def require_fingerprint(found: str, pinned: str) -> None:
    """Refuses to go on over a corpus other than the pinned one, before anything is spent."""
    if found != pinned:
        raise RuntimeError(f"corpus {found} is not the pinned {pinned}")


def require_few_errors(runs: DataFrame, error_col: str = "error", most: float = 0.2) -> None:
    """Refuses a run of which more than ``most`` failed."""
    r = runs.agg(F.count("*").alias("n"), F.count(error_col).alias("bad")).first()
    if r["n"] and r["bad"] > most * r["n"]:
        raise RuntimeError(f"{r['bad']} of {r['n']} cases failed")


def alias_supplement(spark: SparkSession, paths: list[str], catalog: DataFrame) -> DataFrame:
    """(slug, alias) of the first path that exists; slugs that the catalog lacks are left out."""
    for path in paths:
        rows = read_or_empty(spark, path, "slug string, alias string")
        if rows.head(1):
            return rows.join(catalog.select("slug").distinct(), "slug", "left_semi")
    return spark.createDataFrame([], "slug string, alias string")
