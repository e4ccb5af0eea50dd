"""File scan, admission, format classification and text decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import normalize_text, trim_all
from ..plans.analyze import complete_documents

# File signatures (hex) and extensions
OLE2, ZIP, PDF = "D0CF11E0A1B11AE1", "504B0304", "255044462D"
TEXT_EXTENSIONS = ("txt", "md")
# windows-1252 leaves these bytes undefined; they decode to control characters, which are dropped later
UNDEFINED_1252 = "[\x81\x8d\x8f\x90\x9d]"
# Windows-1252 characters of the bytes 0x80-0x9F that differ from Latin-1
CP1252 = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹",
    0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™",
    0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ",
}


ROW_GROUP = 128 << 20


def tasks(spark: SparkSession) -> int:
    """Tasks for work that is heavy for its bytes: one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """A table too small to give each task a row group of its own, dealt out over all tasks; larger ones stay as they are.

    A row group is read by one task, so a small file keeps one core busy whatever is computed from it.  The shuffle this costs
    is bounded by that size.
    """
    n = tasks(df.sparkSession)
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(n) if int(str(size)) < n * ROW_GROUP else df


def read_files(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """``(path, length, content)`` of every file below ``path``.

    Lengths are compared in the scan: the content of a file over ``max_bytes``, where the caller sets that, is never read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    full = found.select("path", "length", "content")
    if max_bytes is not None:
        large = found.filter(F.col("length") > max_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"))
        full = full.filter(F.col("length") <= max_bytes).unionByName(large)
    return full.unionByName(_empty_files(found))


def _empty_files(found: DataFrame) -> DataFrame:
    """Files that the scan passes over because they hold nothing, from the paths in its file index."""
    spark = found.sparkSession
    listed = spark.createDataFrame([(p,) for p in found.inputFiles()], "path string")
    plain = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))  # listed as URIs, scanned as paths
    local = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    listed = listed.select(local(plain).alias("path"))
    empty = listed.join(found.select(local(F.col("path")).alias("path")), "path", "left_anti")
    return empty.select("path", F.lit(0).cast("bigint").alias("length"), F.lit(None).cast("binary").alias("content"))


def admit(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Adds ``error_code`` for empty files, and for those over ``max_bytes`` where the caller sets it."""
    large = F.col("length") > max_bytes if max_bytes is not None else F.lit(False)
    return files.withColumn("error_code", F.when(F.col("length") == 0, "empty_file").when(large, "too_large"))


def scan(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Files below ``path``, admitted and classified: ``(path, length, content, format, error_code)``."""
    return classify(admit(read_files(spark, path, max_bytes), max_bytes))


def pasted(texts: DataFrame) -> DataFrame:
    """Pasted or written texts; all-blank ones, of whatever kind of white space, carry ``empty_text``."""
    blank = trim_all(F.coalesce("text", F.lit(""))) == ""
    return texts.withColumn("error_code", F.when(blank, "empty_text"))


def extension(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.lower(F.when(F.contains(name, F.lit(".")), F.regexp_extract(name, r"\.([^.]*)$", 1)).otherwise(""))


def classify(files: DataFrame) -> DataFrame:
    """Adds ``format`` (pdf, docx, txt) or ``error_code``, from magic bytes and extension."""
    head = F.hex(F.substring("content", 1, 1024))
    ext = extension(F.col("path"))
    # the signature must start on a byte: an even offset in the hex text
    has_pdf = head.rlike(f"^(?:..)*?{PDF}")
    kind = (
        F.when(F.col("error_code").isNotNull(), F.col("error_code"))
        .when(F.col("length") == 0, "empty_file")
        .when(head.startswith(OLE2), "legacy_doc")
        .when(has_pdf, F.when(ext.isin("pdf", ""), "=pdf").otherwise("extension_mismatch"))
        .when(head.startswith(ZIP), F.when(ext.isin("docx", "", "doc"), "=docx").otherwise("extension_mismatch"))
        .when(ext.isin("pdf", "docx"), "extension_mismatch")
        .when(ext.isin(*TEXT_EXTENSIONS), "=txt")
        .when(ext == "doc", "legacy_doc")
        .otherwise("unsupported_type")
    )
    return files.withColumn("kind", kind).select(
        *[c for c in files.columns if c != "error_code"],
        F.when(F.col("kind").startswith("="), F.substring("kind", 2, 8)).alias("format"),
        F.when(~F.col("kind").startswith("="), F.col("kind")).alias("error_code"),
    )


def decode_text(content: Column) -> Column:
    """UTF-16 by its mark, then strict UTF-8, then windows-1252; NULL for binary content."""
    head = F.hex(F.substring(content, 1, 2))
    body = F.substring(content, 3, 2_147_483_000)
    latin = F.decode(content, "ISO-8859-1")
    source = "".join(chr(b) for b in CP1252)
    western = F.regexp_replace(F.translate(latin, source, "".join(CP1252.values())), UNDEFINED_1252, "")
    utf8 = content.cast("string")
    return (
        F.when(head == "FFFE", F.decode(body, "UTF-16LE"))
        .when(head == "FEFF", F.decode(body, "UTF-16BE"))
        .when(F.instr(latin, "\x00") > 0, F.lit(None).cast("string"))
        .when(F.is_valid_utf8(utf8), F.regexp_replace(utf8, r"^\x{FEFF}", ""))
        .otherwise(western)
    )


def text_documents(classified: DataFrame) -> DataFrame:
    """Text files as documents; undecodable ones carry ``invalid_text``."""
    rows = classified.filter("format = 'txt'").withColumn("text", decode_text(F.col("content")))
    return rows.drop("content").withColumn("error_code", F.when(F.col("text").isNull(), "invalid_text"))


def quarantine(*tables: DataFrame) -> DataFrame:
    """``(doc_id, error_code)`` of everything that could not be read."""
    out = None
    for t in tables:
        bad = t.filter("error_code IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), "error_code")
        out = bad if out is None else out.unionByName(bad)
    return out


def assemble(*branches: DataFrame) -> DataFrame:
    """One ``documents`` table from the text, package and page-run branches."""
    out = None
    for b in branches:
        ok = b.filter("error_code IS NULL") if "error_code" in b.columns else b
        part = complete_documents(ok)
        out = part if out is None else out.unionByName(part)
    return out.withColumn(
        "header_footer_text", normalize_text(F.col("header_footer_text"))
    )
