"""What a pool of files holds, as order-free digests in a manifest that is replaced as a whole; and pools made in batches.

All folders may be in any store that Spark writes, as everything goes through Spark and Hadoop's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST, ENTRIES = "_manifest.json", "_entries"


def digest(columns: Sequence[str]) -> Column:
    """An aggregate that names a set of rows whatever their order: their number, and sums and xors of two hashes of each.

    Columns count by name order, so their order in the table does not matter; a null differs from an empty text. Repeated
    rows count each time, by the sums.
    """
    by_name = sorted(columns)
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in by_name]), {"ignoreNullFields": "false"})
    one, two = F.xxhash64(row), F.xxhash64(F.lit("second"), row)
    facts = [F.count(F.lit(1)), *[F.coalesce(f(h), F.lit(0)) for h in (one, two) for f in (lambda x: F.sum(x.cast("decimal(38,0)")), F.bit_xor)]]
    return F.sha2(F.concat_ws("|", *[f.cast("string") for f in facts]), 256)


def stable_json(value: object) -> str:
    """SHA-256 of a value as JSON with sorted keys and no blanks."""
    import hashlib

    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that a reader sees the old one or the new one: under another name first, then renamed over it."""
    fs, p, jvm = _hadoop(spark, path)
    hidden = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(hidden, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(hidden, p, options)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p, jvm = _hadoop(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def file_facts(spark: SparkSession, path: str, klass: str) -> DataFrame:
    """(file, class_name, rows, digest) of every Parquet file below path that can be read; broken ones are passed over."""
    rows = spark.read.option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").parquet(path)
    return rows.select("*", F.col("_metadata.file_path").alias("_file")).groupBy(F.col("_file").alias("file"), F.col(klass).cast("string").alias("class_name")).agg(
        F.count(F.lit(1)).alias("rows"), digest(rows.columns).alias("digest")
    )


def _below(path: str) -> Column:
    """A file's path from the pool's folder on, the same whichever way that folder is written."""
    return F.element_at(F.split(F.col("file"), f"/{path.rstrip('/').rsplit('/', 1)[-1]}/"), -1)


def write_manifest(spark: SparkSession, path: str, klass: str, **more: object) -> dict:
    """Digest a pool of Parquet files into its manifest: one entry a file and class as a table, and their totals as JSON.

    The entries are written under a new name and the JSON that names them is then replaced as a whole, so a reader has the
    old manifest or the new one. more is kept with it. Its hash is over all but itself and the name of the entries.
    """
    name = f"{ENTRIES}-{uuid.uuid4().hex}"
    file_facts(spark, path, klass).withColumn("file", _below(path)).write.parquet(f"{path}/{name}")
    found = read_entries(spark, path, name)
    totals = {r.class_name: r.rows for r in found.groupBy("class_name").agg(F.sum("rows").alias("rows")).collect()}  # one row a class
    whole = found.agg(F.count_distinct("file").alias("files"), digest(found.columns).alias("content")).first()
    body = {"schema_version": 1, "files": whole.files, "rows": sum(totals.values()), "per_class": totals, "content_hash": whole.content, **more}
    body |= {"manifest_hash": stable_json(body), "entries": name}
    replace_text(spark, f"{path}/{MANIFEST}", json.dumps(body, indent=2, sort_keys=True) + "\n")
    return body


def read_entries(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema("file string, class_name string, rows bigint, digest string").parquet(f"{path}/{name}")


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest of a pool; none, or one whose hash does not fit it, is an error."""
    text = read_text(spark, f"{path}/{MANIFEST}")
    if text is None:
        raise FileNotFoundError(f"{path} has no manifest")
    body = json.loads(text)
    if stable_json({k: v for k, v in body.items() if k not in ("manifest_hash", "entries")}) != body["manifest_hash"]:
        raise ValueError(f"the manifest of {path} does not fit its hash")
    return body


def reconcile(spark: SparkSession, path: str, klass: str) -> tuple[DataFrame, DataFrame]:
    """(files, classes) of a pool against its manifest.

    files(file, status, rows_then, rows_now): missing, extra, unreadable (there, but nothing can be read of it), changed, or
    same. classes(class_name, rows_then, rows_now): counts by the manifest, and rebuilt from what can be read now.
    """
    entries = read_entries(spark, path, read_manifest(spark, path)["entries"])
    fold = [F.sum("rows").alias("rows"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "class_name", "digest"))), ",").alias("digest")]  # a few classes a file
    then = entries.groupBy("file").agg(*fold)
    present = file_facts(spark, path, klass).withColumn("file", _below(path))
    now = present.groupBy("file").agg(*fold)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select(F.col("path").alias("file")).withColumn("file", _below(path)).filter(~F.col("file").startswith("_"))
    side = lambda df, s: df.select("file", F.col("rows").alias(f"rows_{s}"), F.col("digest").alias(f"digest_{s}"))
    both = listed.withColumn("there", F.lit(True)).join(side(then, "then"), "file", "full").join(side(now, "now"), "file", "left")
    # Names of what a file can be.
    status = (
        F.when(F.col("there").isNull(), "missing").when(F.col("rows_then").isNull(), F.when(F.col("rows_now").isNull(), "unreadable").otherwise("extra"))
        .when(F.col("rows_now").isNull(), "unreadable").when(F.col("digest_then") != F.col("digest_now"), "changed").otherwise("same")
    )
    a, b = (df.groupBy("class_name").agg(F.sum("rows").alias(n)) for df, n in ((entries, "rows_then"), (present, "rows_now")))
    classes = a.join(b, "class_name", "full").select("class_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows_then", "rows_now")])
    return both.select("file", status.alias("status"), "rows_then", "rows_now"), classes


# --- batches ------------------------------------------------------------------------------------------------------


def _rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p, jvm = _hadoop(spark, new)
    if fs.exists(p):
        fs.delete(p, True)
    fs.mkdirs(p.getParent())
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(old), p):
        raise OSError(f"{old} could not be renamed to {new}")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(id, outcome, batch) of all that finished batches have said, the last word on each id."""
    fs, p, _ = _hadoop(spark, f"{path}/registry")
    schema = "id string, outcome string, batch int"
    if not fs.exists(p):
        return spark.createDataFrame([], schema)
    said = spark.read.schema(schema).parquet(f"{path}/registry")
    return said.groupBy("id").agg(F.max(F.struct("batch", "outcome")).alias("last")).select("id", "last.outcome", "last.batch")


def run_batches(
    work: DataFrame, path: str, step: Callable[[DataFrame], tuple[DataFrame, DataFrame]], budget: float, most_rows: int = 10_000, most_batches: int | None = None, order: Sequence[str] = ("id",)
) -> dict:
    """Work through work(id, cost, ...) in batches that a stopped run takes up again; the pool is at path/pool.

    A batch is the first rows, in order, of what has no final outcome, as long as their cost stays within budget (one row
    at least) and they are no more than most_rows. step gives the batch's rows of the pool, and (id, outcome) of its work:
    done, rejected, or deferred; what it does not name is deferred. Deferred work comes again after all other work, once in
    a run and once more after each batch that has brought anything forward; so a run ends. Both tables are written aside and renamed, the registry last: that is the
    commit. A batch that was not committed is made again under the same name, so no row is in the pool twice.

    Returns stop_reason (completed, most_batches, only_deferred_left) and health: outcomes by number, and batches.
    """
    spark = work.sparkSession
    ids = work.withColumn("id", F.col("id").cast("string"))
    made, start = 0, None
    while True:
        said = registry(spark, path)
        last, forward = said.agg(F.max("batch"), F.max(F.when(F.col("outcome") != "deferred", F.col("batch")))).first()
        number = 0 if last is None else last + 1
        start = number if start is None else start
        left = ids.join(said.filter(F.col("outcome") != "deferred").select("id"), "id", "left_anti").join(said.filter("outcome = 'deferred'").select("id", F.col("batch").alias("_seen")), "id", "left")
        # What was deferred last comes last; a batch is cut from the first most_rows rows, so its running total is bounded.
        due = F.col("_seen").isNull() | (F.col("_seen") < max(start, -1 if forward is None else forward))
        first = left.filter(due).orderBy(F.coalesce("_seen", F.lit(-1)), *order).limit(most_rows)
        w = Window.orderBy(F.coalesce("_seen", F.lit(-1)), *order)
        batch = first.withColumns({"_upto": F.sum("cost").over(w), "_place": F.row_number().over(w)}).filter((F.col("_upto") <= budget) | (F.col("_place") == 1)).drop("_upto", "_place")
        batch.write.mode("overwrite").parquet(f"{path}/aside/work")
        taken = spark.read.schema(batch.schema).parquet(f"{path}/aside/work")
        if not taken.limit(1).count():
            reason = "only_deferred_left" if left.limit(1).count() else "completed"
        else:
            reason = "most_batches" if most_batches is not None and made >= most_batches else None
        if reason is None:
            rows, outcomes = step(taken.drop("_seen"))
            rows.write.mode("overwrite").parquet(f"{path}/aside/pool")
            named = outcomes.select(F.col("id").cast("string").alias("id"), "outcome")
            full = taken.select("id").join(named, "id", "left").select("id", F.coalesce("outcome", F.lit("deferred")).alias("outcome"), F.lit(number).alias("batch"))
            full.write.mode("overwrite").parquet(f"{path}/aside/registry")
            _rename(spark, f"{path}/aside/pool", f"{path}/pool/batch={number}")
            _rename(spark, f"{path}/aside/registry", f"{path}/registry/part={number}")
            made += 1
        else:
            health = {r.outcome: r.n for r in registry(spark, path).groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}  # three rows
            return {"stop_reason": reason, "batches": made, "health": health}
