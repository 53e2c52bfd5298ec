"""Readers and writers of case bundles, result logs, grade maps, traces and summaries."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from .scratch import stored

#: Fixed columns of the summary file, in order.
SUMMARY_COLUMNS = ["case_id", "domain", "status", "passed", "model", "elapsed_s", "generation_latency_s", "prompt_tokens", "completion_tokens", "grader_returncode", "grader_elapsed_s"]
RESULT_SCHEMA = (
    "seq long, case_id string, domain string, status string, passed boolean, model string, elapsed_s double, "
    "generation struct<latency_s:double, prompt_tokens:string, completion_tokens:string>, grader struct<returncode:long, elapsed_s:double>"
)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A result log of JSON lines; lines that are not JSON or lack a text ``case_id`` are skipped."""
    raw = spark.read.text(path)
    parsed = raw.select(F.try_parse_json("value").alias("v"), F.from_json("value", RESULT_SCHEMA).alias("r"))
    is_text = F.schema_of_variant(F.try_variant_get("v", "$.case_id", "variant")) == "STRING"
    return parsed.where(F.col("v").isNotNull() & F.coalesce(is_text, F.lit(False))).select("r.*")


def append_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").json(path)


def flat_results(results: DataFrame) -> DataFrame:
    """The summary columns; token counts that are not whole numbers become null, and so do those of a missing part."""
    whole = lambda c: F.col(c).try_cast("long")
    return results.select(
        "case_id", "domain", "status", "passed", "model", "elapsed_s", F.col("generation.latency_s").alias("generation_latency_s"), whole("generation.prompt_tokens").alias("prompt_tokens"),
        whole("generation.completion_tokens").alias("completion_tokens"), F.col("grader.returncode").alias("grader_returncode"), F.col("grader.elapsed_s").alias("grader_elapsed_s"),
    )


def write_summary(results: DataFrame, path: str) -> None:
    flat_results(results).select(*SUMMARY_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def read_grades(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, grade) from JSON objects of path -> {grade}; entries that are no object or lack a text grade are left out, and of equal names the last entry counts."""
    return grades_of(spark.read.text(path, wholetext=True))


def root_entries(lines: DataFrame, text: str = "value") -> DataFrame:
    """The entries of JSON texts whose root is an object or a list: the columns of ``lines``, then nth, key (null in a list) and entry, a variant. Broken texts, and roots that are neither, have none."""
    parsed = lines.withColumn("root", F.try_parse_json(text)).withColumnsRenamed({c: f"line {c}" for c in lines.columns})
    rooted = F.coalesce(F.schema_of_variant("root").rlike("^(OBJECT|ARRAY)"), F.lit(False))
    exploded = lines.sparkSession.tvf.variant_explode(F.col("root").outer())
    return parsed.where(rooted).lateralJoin(exploded).select(*[F.col(f"line {c}").alias(c) for c in lines.columns], F.col("pos").alias("nth"), "key", F.col("value").alias("entry"))


def settled_type(entries: DataFrame, entry: str = "entry") -> str:
    """The type that fits all entries, as Spark SQL writes it: fields of any of them, numbers widened, and ``variant`` where their kinds differ."""
    found = entries.agg(F.schema_of_variant_agg(entry)).first()[0] or "VOID"
    return re.sub(r"\bVOID\b", "STRING", re.sub(r"\bOBJECT<", "STRUCT<", found)).replace("OBJECT", "STRUCT<>")


def settled(entries: DataFrame, entry: str = "entry") -> DataFrame:
    """``entries`` with the entry read as the type that fits all; ``read_as`` names the column."""
    return entries.withColumn("read_as", F.try_variant_get(F.col(entry), "$", settled_type(entries, entry)))


def grades_of(raw: DataFrame) -> DataFrame:
    """``read_grades`` over rows of ``value``, a grade file each."""
    entries = raw.select(F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("nth", "e")).select("nth", F.col("e.key").alias("key"), F.try_parse_json("e.value").alias("entry"))
    grade = F.try_variant_get("entry", "$.grade", "variant")
    is_text = F.startswith(F.schema_of_variant("entry"), F.lit("OBJECT")) & (F.schema_of_variant(grade) == "STRING")
    graded = entries.where(F.coalesce(is_text, F.lit(False))).select("nth", F.substring_index(F.rtrim("key", F.lit("/")), "/", -1).alias("case_id"), F.try_variant_get("entry", "$.grade", "string").alias("grade"))
    return graded.groupBy("case_id").agg(F.max_by("grade", "nth").alias("grade"))


def discover_cases(spark: SparkSession, root: str) -> DataFrame:
    """Folders below ``root`` that hold a README.md and an evaluation/evaluate.py, by listing only (no content is read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    readme = files.where(F.col("path").endswith("/README.md")).select(F.regexp_replace("path", "/README\\.md$", "").alias("case"))
    scored = files.where(F.col("path").endswith("/evaluation/evaluate.py")).select(F.regexp_replace("path", "/evaluation/evaluate\\.py$", "").alias("case"))
    return readme.distinct().join(scored, "case", "left_semi").orderBy("case")


#: Endings that are text whatever the file holds.
TEXT_EXTENSIONS = ["c", "cc", "cpp", "cxx", "h", "hh", "hpp", "v", "sv", "vhd", "vhdl", "py", "tcl", "md", "txt", "json", "yaml", "yml", "toml", "csv", "tsv", "sdc", "xdc"]
#: What a participant never sees.
PRIVATE_TOP_LEVEL = ["golden", "expert", "tests", "evaluation", "mutants", "reports", "spec", "artifacts"]
PRIVATE_FILES = ["case_manifest.json", "run_manifest.json"]
PUBLIC_ROOTS = ["inputs", "submission"]


def is_text(path: Column, content: Column) -> Column:
    """By extension, else if the first 4096 bytes hold no NUL."""
    head = F.hex(F.substring(content, 1, 4096))
    name = F.substring_index(path, "/", -1)
    ending = F.when(F.regexp_like(name, F.lit(r"^.+\.[^.]*$")), F.lower(F.substring_index(name, ".", -1))).otherwise("")
    return ending.isin(TEXT_EXTENSIONS) | ~F.regexp_like(head, F.lit("^(?:..)*?00"))


def public_files(files: DataFrame) -> DataFrame:
    """Of (case, path, content) those that a participant may see: text below inputs/ and submission/, in the order of their paths."""
    top = F.substring_index("path", "/", 1)
    return files.where(top.isin(PUBLIC_ROOTS) & F.contains("path", F.lit("/")) & is_text(F.col("path"), F.col("content"))).orderBy("case", "path")


def is_private(path: Column) -> Column:
    """Whether a path of a case must not reach a participant: a private folder on top, or a manifest."""
    steps = F.split(path, "/")
    return F.get(steps, F.lit(0)).isin(PRIVATE_TOP_LEVEL) | F.element_at(steps, -1).isin(PRIVATE_FILES)


#: Names that an evaluator never sees, wherever they stand.
KEPT_FROM_EVALUATOR = ["golden", "ground_truth", "expert", "mutants", "reports", "artifacts"]


def evaluator_sees(path: Column) -> Column:
    """Whether no step of a path is a mutant's folder or one of the hidden names."""
    return ~F.exists(F.split(path, "/"), lambda s: s.startswith("mutant_") | s.isin(KEPT_FROM_EVALUATOR))


def text_prefix(content: Column, max_bytes: int) -> Column:
    """(text, truncated) of the first bytes of a file."""
    return F.struct(F.decode(F.substring(content, 1, max_bytes), "UTF-8").alias("text"), (F.length(content) > max_bytes).alias("truncated"))


TRACE_COLUMNS = ["trial_id", "secret_operand", "cycle_index", "mul_en", "done"]


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """A trace of (trial_id, secret_operand, cycle_index, mul_en, done): header names are trimmed, the operand is hexadecimal, blank trials are skipped; a trace without rows fails when it is read."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    missing = set(TRACE_COLUMNS) - set(raw.columns)
    if missing:
        raise ValueError(f"trace lacks columns: {sorted(missing)}")
    return trace_rows(raw)


def trace_rows(raw: DataFrame) -> DataFrame:
    operand = F.conv(F.regexp_replace(F.trim("secret_operand"), "^0[xX]", ""), 16, 10).cast("long")
    number = lambda c: F.trim(c).try_cast("long").alias(c)
    rows = raw.where(F.trim("trial_id") != "").select(F.trim("trial_id").alias("trial_id"), operand.alias("secret_operand"), number("cycle_index"), number("mul_en"), number("done"))
    there = rows.agg(F.assert_true(F.count("*") > 0, F.lit("the trace has no data rows")).alias("fault"))
    return rows.join(F.broadcast(there)).where(F.col("fault").isNull()).drop("fault")


def read_samples(lines: DataFrame, width: int, least: int = 2) -> DataFrame:
    """Rows of exactly ``width`` whole numbers from comma-separated lines; others are skipped, and fewer than ``least`` give none."""
    parts = F.transform(F.split("value", ","), lambda x: F.try_to_number(F.trim(x), F.lit("S999999999999")).cast("long"))
    parsed = lines.withColumn("values", parts)
    good = parsed.where((F.size("values") == width) & ~F.exists("values", lambda x: x.isNull()))
    enough = good.agg((F.count("*") >= least).alias("enough"))
    return good.join(F.broadcast(enough)).where("enough").drop("enough")


def write_files(bundles: DataFrame, root: str) -> DataFrame:
    """Writes the files (array of path, content) of each row's ``task_id`` below ``root``, a new folder, and gives (task_id, path, written, executable) back.

    A path that would leave its folder is not written. Tasks write into a draft beside
    the folder, and a repeated task writes the same files again; when all are
    written, one rename makes the draft the folder. So a failed job leaves no part of
    it, and reading the result again writes nothing.
    """
    spark = bundles.sparkSession
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(path(root)):
        raise FileExistsError(root)
    draft = f"{root.rstrip('/')}-draft-{uuid.uuid4().hex}"
    exploded = bundles.select("task_id", F.explode("files").alias("f")).select("task_id", "f.path", "f.content")
    checked = exploded.withColumn("inside", text.safe_path(F.col("path")) & text.safe_path(F.col("task_id")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(draft)
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                if r["inside"]:
                    place = f"{base}/{r['task_id']}/{r['path']}"
                    store.create_dir(place.rpartition("/")[0], recursive=True)
                    with store.open_output_stream(place, compression=None) as out:
                        out.write((r["content"] or "").encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_pydict({"task_id": [r["task_id"] for r in rows], "path": [r["path"] for r in rows], "written": [r["inside"] for r in rows], "executable": [r["path"].endswith(".sh") for r in rows]}, pa.schema([("task_id", pa.string()), ("path", pa.string()), ("written", pa.bool_()), ("executable", pa.bool_())]))

    written = stored(checked.mapInArrow(write, "task_id string, path string, written boolean, executable boolean"))
    files.mkdirs(path(draft))
    if not files.rename(path(draft), path(root)):
        raise FileExistsError(root)
    return written


def read_yaml(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row per item of the sequences in the YAML files below ``path``; an empty file has none. The files pass through Spark's reader and are parsed in the tasks."""
    import yaml  # an optional package, so absent unless this source is used

    raw = spark.read.text(path, wholetext=True)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = []
            for document in batch.column("value").to_pylist():
                loaded = yaml.safe_load(document) or []
                items += loaded if isinstance(loaded, list) else next((v for v in loaded.values() if isinstance(v, list)), [loaded])
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(x, default=str) for x in items], pa.string())], ["value"])

    return raw.mapInArrow(parse, "value string").select(F.from_json("value", schema).alias("r")).select("r.*")
