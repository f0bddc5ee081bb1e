"""Run reports: a folder of JSON files, each with where it came from, what is wrong with it, and what it says of its store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.times import parse_iso
from ..operators.alerts import capped, printable

# Shape of a store's id in a report, outcomes, how warnings begin that give a reason, and what is said where there is none.
STORE = r"^[a-z0-9][a-z0-9-]*\z"
OUTCOMES = ("published", "unchanged", "quarantined", "failed")
QUARANTINED, COLLECT_ERROR = "quarantined: ", "collect error: "
NO_STAGE, NO_ERROR, NO_REASON, NO_REPORT = "no stage recorded an error", "no error recorded", "no reason recorded", "the pipeline exited without writing a failure report; see the job log"
SECOND_LOOK = ".failed-run.json"
# The version of a collect record, and the shape of a digest in it.
RECORD_VERSION, DIGEST = 1, r"^[0-9a-f]{64}\z"


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): every file under a folder whole, with its path. Readers pass over files without a byte, so these are taken from the folder's listing."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, empty = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(folder, True), []
    while found.hasNext():
        f = found.next()
        if f.getLen() == 0 and not f.getPath().getName().startswith(("_", ".")):
            empty.append((f.getPath().toString(), ""))
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.unionByName(spark.createDataFrame(empty, "file string, value string")) if empty else whole


def kind(v: Column) -> Column:
    """What a JSON value is: OBJECT, ARRAY, STRING, BIGINT, BOOLEAN, VOID and so on; null where there is none."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def part(v: Column, path: str, to: str = "variant") -> Column:
    return F.try_variant_get(v, path, to)


def checked(files: DataFrame) -> DataFrame:
    """(file, store, outcome, stages, warnings, fault): reports taken apart; a report that can't be used has its first fault and nothing else."""
    v = F.col("__v")
    rows = files.withColumn("__v", F.try_parse_json("value"))
    is_ = lambda path, what: F.coalesce(kind(part(v, path)) == what, F.lit(False))
    store, outcome = part(v, "$.storeId", "string"), part(v, "$.outcome", "string")
    fault = (
        F.when(v.isNull(), "no JSON").when(kind(v) != "OBJECT", "not an object").when(~is_("$.storeId", "STRING") | ~store.rlike(STORE), "invalid store").when(~is_("$.outcome", "STRING") | ~outcome.isin(*OUTCOMES), "invalid outcome")
        .when(~is_("$.stages", "ARRAY"), "stages is no array").when(~is_("$.warnings", "ARRAY"), "warnings is no array")
    )
    text = lambda x, path: F.when(kind(part(x, path)) == "STRING", part(x, path, "string"))
    stages = F.transform(part(v, "$.stages", "array<variant>"), lambda x: F.struct(part(x, "$.name", "string").alias("name"), text(x, "$.status").alias("status"), text(x, "$.error").alias("error")))
    warnings = F.transform(F.filter(part(v, "$.warnings", "array<variant>"), lambda x: kind(x) == "STRING"), lambda x: part(x, "$", "string"))
    rows = rows.withColumn("fault", fault)
    good = F.col("fault").isNull()
    return rows.select("file", F.when(good, store).alias("store"), F.when(good, outcome).alias("outcome"), F.when(good, stages).alias("stages"), F.when(good, warnings).alias("warnings"), "fault")


def verdicts(reports: DataFrame, failed: DataFrame, second_look: Column | None = None) -> DataFrame:
    """(store, verdict, outcome, stage, reasons) from sound reports and the stores (store) whose run failed.

    Of a store's reports the copy from before a repair counts, whose name says so (`second_look`), else the first by name. A failed or quarantined run is an alert with
    its reasons, cut to fit; another is `observed` only if its collect stage went well. A store that failed without a report that says so is an alert too.
    """
    again = F.col("file").endswith(SECOND_LOOK) if second_look is None else second_look
    first = F.row_number().over(Window.partitionBy("store").orderBy(again.desc(), "file"))
    r = reports.where("fault is null").withColumn("__n", first).where("__n = 1")
    bad = F.get(F.filter("stages", lambda s: s["status"] == "failed"), F.lit(0))
    stage = printable(F.coalesce(bad["name"], F.lit("undefined")))
    error = F.coalesce(F.nullif(bad["error"], F.lit("")), F.lit(NO_ERROR))
    said = F.concat(F.transform(F.filter("warnings", lambda w: w.startswith(QUARANTINED)), lambda w: F.substring(w, len(QUARANTINED) + 1, 1 << 30)), F.filter("warnings", lambda w: w.startswith(COLLECT_ERROR)))
    reasons = F.transform(said, printable)
    collect = F.get(F.filter("stages", lambda s: s["name"] == "collect"), F.lit(0))
    is_failed, kept_out = F.col("outcome") == "failed", F.col("outcome") == "quarantined"
    r = r.select(
        "store", F.when(is_failed | kept_out, "alert").when(F.coalesce(collect["status"] == "ok", F.lit(False)), "observed").otherwise("not_attempted").alias("verdict"),
        F.when(is_failed | kept_out, F.col("outcome")).alias("outcome"), F.when(is_failed & bad.isNotNull(), stage).alias("stage"),
        F.when(is_failed & bad.isNull(), F.array(F.lit(NO_STAGE))).when(is_failed, F.array(printable(F.concat(stage, F.lit(": "), error))))
        .when(kept_out & (F.size(reasons) == 0), F.array(F.lit(NO_REASON))).when(kept_out, capped(reasons)).alias("reasons"),
    )
    both = r.join(failed.select("store").distinct().withColumn("__f", F.lit(True)), "store", "full_outer")
    silent = F.col("__f").isNotNull() & ~F.coalesce(F.col("verdict") == "alert", F.lit(False))
    return both.select(
        "store", F.when(silent, "alert").otherwise(F.col("verdict")).alias("verdict"), F.when(silent, "failed").otherwise(F.col("outcome")).alias("outcome"),
        F.when(~silent, F.col("stage")).alias("stage"), F.when(silent, F.array(F.lit(NO_REPORT))).otherwise(F.col("reasons")).alias("reasons"),
    )


def record_fault(text: Column) -> Column:
    """The first field of a collect record (a JSON text) that isn't as it must be, and how it must be; null for a sound record."""
    v = F.try_parse_json(text)
    at = lambda name: part(v, f"$.{name}")
    said = lambda name: F.when(kind(at(name)) == "STRING", part(v, f"$.{name}", "string"))
    number = lambda name: F.when(kind(at(name)).isin("BIGINT", "DECIMAL", "DOUBLE"), part(v, f"$.{name}", "double"))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    texts = lambda name: (kind(at(name)) == "ARRAY") & F.forall(part(v, f"$.{name}", "array<variant>"), lambda x: kind(x) == "STRING")
    metrics = F.map_values(part(v, "$.metrics", "map<string,variant>"))
    rules = [
        (kind(at("recordVersion")) == "BIGINT") & (part(v, "$.recordVersion", "bigint") == RECORD_VERSION), said("storeId") != "", said("snapshotFile") != "", ~said("snapshotFile").rlike(r"[\\/]"), said("rawSha256").rlike(DIGEST), (kind(at("bytes")) == "BIGINT") & (number("bytes") >= 0),
        parse_iso(said("retrievedAt")).isNotNull(), kind(at("complete")) == "BOOLEAN", texts("errors"), texts("warnings"), (kind(at("metrics")) == "OBJECT") & F.forall(metrics, lambda m: F.coalesce(kind(m).isin("BIGINT", "DECIMAL", "DOUBLE"), F.lit(False))), parse_iso(said("startedAt")).isNotNull(), number("durationMs") >= 0,
    ]
    says = [
        f"recordVersion must be {RECORD_VERSION}", "storeId must be a non-empty text", "snapshotFile must be a non-empty text", "snapshotFile must be without a directory", "rawSha256 must be 64 lowercase hex digits", "bytes must be a whole number from 0", "retrievedAt must be a time with an offset", "complete must be true or false",
        "errors must be texts", "warnings must be texts", "metrics must be numbers", "startedAt must be a time with an offset", "durationMs must be a number from 0",
    ]
    out = F.when(v.isNull() | no(kind(v) == "OBJECT"), "the record is not an object")
    for rule, text_ in zip(rules, says):
        out = out.when(no(rule), text_)
    return out
