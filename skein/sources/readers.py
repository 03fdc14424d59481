"""Sources: transcripts, robust text, paired cleaned files, work lists, golden queries. All read with Spark's readers and fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SEGMENT = "array<struct<text:string,start:double,end:double,speaker:string>>"
TRANSCRIPT = f"segments {SEGMENT}, _corrupt_record string"


def transcripts(spark: SparkSession, path: str, recursive: bool = True, glob: str = "*.json", with_speakers: bool = True) -> tuple[DataFrame, DataFrame]:
    """(files, rejects): each file's segments with blank ones dropped, speakers kept only where they are meant; files that are no transcript are rejects."""
    read = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).schema(TRANSCRIPT).json(path)
    rows = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"), "segments", "_corrupt_record")
    good = F.transform(
        F.filter("segments", lambda s: F.trim(F.coalesce(s["text"], F.lit(""))) != ""),
        lambda s: F.struct(F.trim(s["text"]).alias("text"), s["start"].alias("start"), s["end"].alias("end"), (s["speaker"] if with_speakers else F.lit(None).cast("string")).alias("speaker")),
    )
    files = rows.where("segments is not null").select(stem(F.col("path")).alias("source_file"), "path", "bytes", good.alias("segments"))
    return files, rows.where("segments is null").select("path", F.lit("not a transcript").alias("reason"))


def stem(path: Column) -> Column:
    """A file's name without folders and endings."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?:\.chunks|\.cleaned|\.whisperx)?\.[A-Za-z0-9]+$", "")


def qualified(path: Column, root: str) -> Column:
    """A file's key below a root, unique in the corpus."""
    return F.regexp_replace(F.substring_index(path, root.rstrip("/") + "/", -1), r"\.[A-Za-z0-9]+$", "")


def texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(path, text, encoding, modified): UTF-8 where the bytes are, else Latin-1; a byte order mark stays."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    ok = F.expr("is_valid_utf8(content)") if _has(spark, "is_valid_utf8") else F.lit(True)
    text = F.when(ok, F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    return raw.select("path", text.alias("text"), F.when(ok, "utf-8").otherwise("latin-1").alias("encoding"), F.col("modificationTime").alias("modified"))


def _has(spark: SparkSession, function: str) -> bool:
    return spark.catalog.functionExists(function)


def size_capped(files: DataFrame, limit: int = 500 * 1024 * 1024) -> tuple[DataFrame, DataFrame]:
    """Files up to a size, and the others as rejects."""
    return files.where(F.col("bytes") <= limit), files.where(F.col("bytes") > limit).select("path", F.lit("oversize").alias("reason"))


def slim(segments: Column) -> Column:
    """Segments for display: blank ones and those without usable times dropped, times to the millisecond."""
    good = F.filter(segments, lambda s: (F.trim(F.coalesce(s["text"], F.lit(""))) != "") & s["start"].isNotNull() & s["end"].isNotNull() & (s["end"] >= s["start"]))
    return F.transform(good, lambda s: F.struct(F.trim(s["text"]).alias("text"), F.round(s["start"], 3).alias("start"), F.round(s["end"], 3).alias("end"), s["speaker"].alias("speaker")))


def paired(raw: DataFrame, cleaned_text: DataFrame, cleaned_json: DataFrame) -> DataFrame:
    """Raw texts (stem, text) beside their cleaned versions, which may be missing."""
    j = raw.join(cleaned_text.select("stem", F.col("text").alias("cleaned_text")), "stem", "left")
    return j.join(cleaned_json.select("stem", F.col("text").alias("cleaned_json")), "stem", "left")


def catalog_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A catalog exported as CSV with a header; all cells are text, empty ones null."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def golden(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Golden queries given as records (parsed YAML or JSON), a small table."""
    return spark.createDataFrame([(r.get("id"), r.get("type"), r.get("query"), list(r.get("expected_source_files") or filter(None, [r.get("expected_source_file")])), r.get("expected_chunk_contains"), r.get("match", "any")) for r in rows], "query_id string, type string, text string, expected_files array<string>, contains string, match string")
