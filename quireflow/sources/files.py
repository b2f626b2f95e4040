"""File formats: newline-delimited requests, manifests, ground truth, model manifests, state files, directory listings."""

from __future__ import annotations

import hashlib

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.arrow import map_rows

WORKER = "request_id string, document_id string, page_index int, blocks array<struct<block_id:string,text:string,x:double,y:double,w:double,h:double,confidence:double>>, error struct<code:string,message:string>"
MANIFEST = "schema_version int, entries array<struct<id:string,role:string,file:string,sha256:string,byte_size:long,language:string,required:boolean,distributable:boolean,page_count:int,pages_evaluated:array<int>,classification:struct<layout:string,content:string>>>"
TRUTH = "document_id string, revision int, pages array<struct<page_index:int,blocks:array<struct<block_id:string,`order`:int,text:string,region:array<double>,degradation:string,paragraphs:array<struct<paragraph_id:string,sentences:array<struct<sentence_id:string,text:string>>>>>>>>"
MODEL = "id string, model_revision string, purpose string, languages array<string>, voices array<string>, artifacts array<struct<relative_path:string,role:string,source_url:string,size_bytes:long,sha256_hex:string>>"
MIB = 1 << 20


def read_worker(spark: SparkSession, path: str) -> DataFrame:
    """Worker responses, one JSON object a line; malformed lines are kept aside in ``_corrupt``."""
    return spark.read.schema(WORKER + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def _limited(spark: SparkSession, path: str, schema: str, most: int, lines: bool = False) -> DataFrame:
    """Documents that are a file each, of at most ``most`` bytes; or one a line of a file, then ``most`` holds for a line."""
    if lines:
        raw = spark.read.text(path).where(F.octet_length("value") <= most)
        return raw.select(F.from_json("value", schema).alias("d")).select("d.*")
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return df.where(F.col("_metadata.file_size") <= most)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Corpus entries; files over 1 MiB are not read."""
    return _limited(spark, path, MANIFEST, MIB).select(F.explode("entries").alias("e")).select("e.*")


def read_truth(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per ground-truth sentence, four levels flattened; documents over 8 MiB are not read."""
    d = _limited(spark, path, TRUTH, 8 * MIB, lines).select("document_id", F.explode("pages").alias("p"))
    d = d.select("document_id", "p.page_index", F.explode("p.blocks").alias("b"))
    d = d.select("document_id", "page_index", "b.block_id", F.posexplode_outer("b.paragraphs").alias("paragraph_no", "para"))
    return d.select("document_id", "page_index", "block_id", "paragraph_no", F.posexplode_outer("para.sentences").alias("sentence_no", "s")).select("document_id", "page_index", "block_id", "paragraph_no", "sentence_no", F.col("s.text").alias("text"))


def read_models(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Artifacts of model manifests; ``valid``: a hash of 64 hexadecimal digits, a size, and a relative path without dot segments."""
    d = _limited(spark, path, MODEL, MIB, lines).select("id", "model_revision", "purpose", F.explode_outer("artifacts").alias("a")).select("id", "model_revision", "purpose", "a.*")
    path_ok = F.col("relative_path").isNotNull() & ~F.col("relative_path").rlike("^/|(^|/)\\.{1,2}(/|$)|//")
    return d.withColumn("valid", F.coalesce(F.col("sha256_hex").rlike("^[0-9a-f]{64}$"), F.lit(False)) & (F.coalesce("size_bytes", F.lit(0)) > 0) & path_ok)


def _sha256(path: str) -> str:
    """Of a file of any size, a piece at a time."""
    digest = hashlib.sha256()
    if path.startswith("file:"):
        opened = open("/" + path[5:].lstrip("/"), "rb")  # noqa: SIM115
    else:
        fs, name = pafs.FileSystem.from_uri(path)
        opened = fs.open_input_stream(name, compression=None)
    with opened as f:
        while piece := f.read(MIB):
            digest.update(piece)
    return digest.hexdigest()


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Every file under a directory with size and SHA-256. The listing reads no content; each file is hashed as a stream."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return map_rows(found, ["path", "length"], "path string, length long, sha256_hex string", lambda ps, ns: ((p, n, _sha256(p)) for p, n in zip(ps, ns)))


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """State files named by page; malformed ones are skipped."""
    d = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return d.select("*", F.regexp_extract(F.col("_metadata.file_name"), "^(\\d+)", 1).cast("int").alias("page_key"))


def write_state(df: DataFrame, path: str) -> None:
    """One folder per document and version; only the folders written are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "document_id").parquet(path)


def write_documents(df: DataFrame, path: str, parts: int) -> None:
    """One JSON object a file: the rows are dealt to as many tasks, each of which starts a new file with every row."""
    df.repartition(parts).write.option("maxRecordsPerFile", 1).mode("overwrite").json(path)


def write_rows(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)
