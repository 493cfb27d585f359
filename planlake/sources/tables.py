"""Readers and writers of line-delimited and irregular JSON, and of the driver's tables."""

from __future__ import annotations

import json
import math
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planlake.functions.text import strip
from planlake.sources.objects import RANGE_BYTES, read_objects


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict: a bad line raises; blank lines are nothing."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines as text). Blank lines and a byte-order mark are nothing."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("line")).where("trim(line) <> ''")
    parsed = lines.select("line", F.from_json("line", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"}).alias("r"))
    good = parsed.where("r._corrupt_record IS NULL").select("r.*").drop("_corrupt_record")
    return good, parsed.where("r._corrupt_record IS NOT NULL").select("line")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, canonical_query), stripped, without rows that lack either."""
    good, _ = jsonl_tolerant(spark, path, "question_id string, canonical_query string")
    return good.select(strip(F.col("question_id")).alias("question_id"), "canonical_query").where("question_id <> '' AND trim(canonical_query) <> ''")


def two_layouts(records: DataFrame, limit: int | None = None) -> DataFrame:
    """(question_id, profile_index, key, query, learner) from nested question rows (profiles_answers) or from flat plan rows.

    records may have the columns of either layout or of both; a row with canonical_query is nested.
    """
    columns = set(records.columns)
    parts = []
    learner = "struct<about_me:string,top_tags:array<string>,self_description:string,skills:array<string>>"
    if "canonical_query" in columns:
        nested = records.where("canonical_query IS NOT NULL").select("question_id", F.col("canonical_query").alias("query"), F.posexplode("profiles_answers").alias("profile_index", "pa"))
        told = F.struct(F.lit(None).cast("string").alias("about_me"), F.lit(None).cast("array<string>").alias("top_tags"), F.col("pa.profile.self_description").alias("self_description"), F.col("pa.profile.skills").alias("skills"))
        parts.append(nested.select("question_id", "profile_index", "query", told.cast(learner).alias("learner")))
    if "plan" in columns:
        flat = records.where("canonical_query IS NULL") if "canonical_query" in columns else records
        parts.append(flat.select("question_id", "profile_index", F.col("plan.input.query").alias("query"), F.col("plan.input.learner").cast(learner).alias("learner")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = rows.withColumn("key", plan_key(F.col("question_id"), F.col("profile_index")))
    return rows if limit is None else rows.limit(limit)


def plan_key(question_id: Column, profile_index: Column) -> Column:
    return F.concat(question_id.cast("string"), F.lit("__"), profile_index.cast("string"))


def comma_joined(spark: SparkSession, path: str, element: str) -> DataFrame:
    """(path, item) of files that hold JSON objects joined by commas, which is neither JSON nor JSON lines."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json(F.concat(F.lit("["), "value", F.lit("]")), f"array<{element}>").alias("items"))
    return files.select("path", F.posexplode("items").alias("place", "item"))


def comma_joined_ranges(spark: SparkSession, path: str, element: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """comma_joined of files too large for a task each, on file systems that Python opens: byte ranges are read apart, and item's place is the byte where it opens."""
    return read_objects(spark, path, range_bytes).select("path", F.col("at").alias("place"), F.from_json("text", element).alias("item"))


def split_index(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(question_id, split) from an object of lists train_qids, dev_qids, test_qids; a missing list raises if strict."""
    wide = spark.read.option("multiLine", True).json(path)
    missing = [s for s in ("train", "dev", "test") if f"{s}_qids" not in wide.columns]
    if missing and strict:
        raise ValueError(f"split index without {', '.join(missing)}")
    parts = [wide.select(F.explode(F.col(f"{s}_qids").cast("array<string>")).alias("question_id"), F.lit(s).alias("split")) for s in ("train", "dev", "test") if s not in missing]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def split_files(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """Rows of one file to a split, with the split's name."""
    parts = [jsonl(spark, p, schema).withColumn("split", F.lit(s)) for s, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def counterfactuals(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, profile_index, description, skills, cf_plan as JSON text), whether the plan was an object or text."""
    told = jsonl(spark, path, "question_id string, profile_index int, cf_profile_self_description string, cf_profile_skills array<string>, cf_plan string")
    return told.withColumns({"description": F.col("cf_profile_self_description"), "skills": F.col("cf_profile_skills")}).drop("cf_profile_self_description", "cf_profile_skills")


def scalar_params(text: str) -> dict[str, object]:
    """The params block of a configuration text, scalars only: true, false, null, whole and decimal numbers, strings."""
    words = {"true": True, "false": False, "null": None, "~": None, "": None}
    out, inside = {}, False
    for line in text.splitlines():
        if re.match(r"\S", line):
            inside = line.split("#")[0].strip() == "params:"
        elif inside and (m := re.match(r"\s+([\w.-]+)\s*:\s*(.*?)\s*(?:#.*)?$", line)):
            value = m[2].strip("\"'")
            if value.lower() in words:
                out[m[1]] = words[value.lower()]
            elif re.fullmatch(r"[-+]?\d+", value):
                out[m[1]] = int(value)
            else:
                try:
                    out[m[1]] = float(value)
                except ValueError:
                    out[m[1]] = value
    return out


def sections(text: str, banner: str = r"(?m)^=+\s*\n\s*(?:§|SECTION\s*)?(\d+)[.)]?\s+(.+?)\s*\n=+\s*$") -> dict[int, tuple[str, str]]:
    """{number: (title, body)} of a text cut at its banners."""
    found = list(re.finditer(banner, text))
    ends = [m.start() for m in found[1:]] + [len(text)]
    return {int(m[1]): (m[2], text[m.end() : e].strip()) for m, e in zip(found, ends, strict=True)}


def renumbered(text: str, numbers: dict[int, int]) -> str:
    """Cross-references §n rewritten; higher numbers first, so that none is rewritten twice."""
    for old in sorted(numbers, reverse=True):
        text = re.sub(rf"§{old}(?!\d)", f"§\0{numbers[old]}", text)
    return text.replace("\0", "")


def write_jsonl(rows: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> None:
    """One object a line, nulls kept, non-ASCII as it is; by names a column to partition the folder by; mode append adds files."""
    writer = rows.write.mode(mode).option("ignoreNullFields", "false")
    (writer.partitionBy(by) if by else writer).json(path)


def append_results(results: DataFrame, failures: DataFrame, path: str, native: DataFrame | None = None) -> None:
    """Adds to the folders plans, failures and native under path; a task that is repeated adds nothing twice, as Spark commits files whole."""
    write_jsonl(results, f"{path}/plans", mode="append")
    write_jsonl(failures, f"{path}/failures", mode="append")
    if native is not None:
        write_jsonl(native, f"{path}/native", mode="append")


def first_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def stats_document(row: DataFrame) -> str:
    """The single row of row as indented JSON; numbers that are none are null."""

    def plain(x):
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, list | tuple):
            return [plain(v) for v in x]
        return None if isinstance(x, float) and not math.isfinite(x) else x if isinstance(x, int | float | str | bool | None) else str(x)

    return json.dumps(plain(row.first().asDict(recursive=True)), indent=2, ensure_ascii=False)


def metadata_record(spark: SparkSession, path: str, params: dict[str, object], **more: object) -> str:
    """JSON that describes a run: its parameters, and length and SHA-256 of each file of path, by name."""
    files = [{"name": r["path"].rsplit("/", 1)[-1], "length": r["length"], "sha256": r["sha256"]} for r in file_digests(spark, path).orderBy("path").collect()]
    return json.dumps({"params": params, "files": files, **more}, indent=2, ensure_ascii=False, sort_keys=True)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def not_done(rows: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    """Rows whose key has not been written yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def last_of_each(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The row at the last position of each key."""
    latest = F.max_by(F.struct(*rows.columns), F.col(position)).alias("row")
    return rows.groupBy(F.col(key).alias("__key")).agg(latest).select("row.*")


def with_position(rows: DataFrame) -> DataFrame:
    """Rows with their order in the scan: by file name, then place in the file where rows are read from files, else as Spark numbers them."""
    number = F.monotonically_increasing_id()
    try:
        place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), number.alias("row"))
        return rows.withColumn("position", place)
    except AnalysisException:  # not a file source
        return rows.withColumn("position", F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), number.alias("row")))


def batches(rows: DataFrame, size: int, order: str) -> DataFrame:
    """Rows with batch ids of size rows each, in order of a dense whole-number position column."""
    return rows.withColumn("batch", (F.col(order) / F.lit(size)).cast("long"))

