"""Readers and writers: JSON lines, archives, PDFs with their pages given, reference tables, stores and reports."""

from __future__ import annotations

import hashlib
import io
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentlake.operators.integrity import is_safe_path


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped, a broken one is an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def reference_csv(spark: SparkSession, path: str) -> DataFrame:
    """A quoted CSV table with a header, whose first name may stand behind a byte order mark."""
    out = spark.read.csv(path, header=True, quote='"', escape='"')
    return out.toDF(*[c.lstrip("﻿") for c in out.columns])


#: Bytes of a file that are held at a time; bytes of an archive's member up to which its content is returned.
CHUNK, MOST_MEMBER = 1 << 20, 64 << 20
#: What reading a member may raise: broken data, a wrong checksum, a method or password that is not supported.
_BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError)


class _Stream(io.RawIOBase):
    """An Arrow file as a stream whose bad positions are the errors that readers of archives expect."""

    def __init__(self, file):
        self._file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        return self._file.readinto(buffer)

    def tell(self) -> int:
        return self._file.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        try:
            return self._file.seek(offset, whence)
        except pa.ArrowInvalid as bad:
            raise OSError(str(bad)) from bad

    def close(self) -> None:
        self._file.close()
        super().close()


def _opened(path: str) -> io.BufferedReader:
    """A seekable stream of a file, by its path as Spark lists it, which is not percent-encoded."""
    scheme, rest = path.split(":", 1)
    if scheme == "file":
        system, name = pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    else:
        host, inner = rest.lstrip("/").split("/", 1)
        system, root = pafs.FileSystem.from_uri(f"{scheme}://{host}/")
        name = f"{root.rstrip('/')}/{inner}"
    return io.BufferedReader(_Stream(system.open_input_file(name)), CHUNK)


def _chunks(stream) -> Iterator[bytes]:
    while chunk := stream.read(CHUNK):
        yield chunk


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path in b["path"]:
            digest, size = hashlib.sha256(), 0
            with _opened(path) as f:
                for chunk in _chunks(f):
                    digest.update(chunk)
                    size += len(chunk)
            yield pd.DataFrame({"path": [path], "size": [size], "sha256": [digest.hexdigest()]})


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """The paths of files as Spark lists them, which leaves out empty ones; no content is read, and files come to tasks by
    their size."""
    return spark.read.format("binaryFile").load(path).select("path")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, sha256) of files, each read in pieces of CHUNK bytes, so that no file is held whole. Empty files
    give no row, as Spark lists none; files of equal names in several folders give a row each."""
    rows = _listed(spark, path).mapInPandas(_hashed, "path string, size bigint, sha256 string")
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), "size", "sha256")


def _member(z: zipfile.ZipFile, info: zipfile.ZipInfo, most: int) -> tuple:
    """(size, sha256, content, broken) of a member: all of it is read and checked, content only kept up to `most` bytes."""
    digest, kept, size = hashlib.sha256(), [], 0
    try:
        with z.open(info) as f:
            for chunk in _chunks(f):
                digest.update(chunk)
                size += len(chunk)
                kept = [*kept, chunk] if size <= most else []
    except _BROKEN:
        return info.file_size, None, None, True
    return size, digest.hexdigest(), b"".join(kept) if size <= most else None, False


def zip_members(spark: SparkSession, path: str, most_bytes: int = MOST_MEMBER) -> DataFrame:
    """(archive, name, size, sha256, content, broken) of each member of archives; one row without a name for what is no archive.

    Archives are read through a seekable stream and members in pieces of CHUNK bytes. The content of a member of over
    most_bytes is null, its size and hash are there. A member that can't be read is broken, with the size that the archive
    tells; those after it are read none the less."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["archive", "name", "size", "sha256", "content", "broken"]
        for b in batches:
            for p in b["path"]:
                try:
                    with _opened(p) as f, zipfile.ZipFile(f) as z:
                        for info in z.infolist():  # a frame each, so that one content is held at a time
                            yield pd.DataFrame([(p, info.filename, *_member(z, info, most_bytes))], columns=columns)
                except zipfile.BadZipFile:
                    yield pd.DataFrame([(p, None, None, None, None, True)], columns=columns)

    return _listed(spark, path).mapInPandas(members, "archive string, name string, size bigint, sha256 string, content binary, broken boolean")


def archive_problems(members: DataFrame, required: list[str]) -> DataFrame:
    """(archive, problem): broken, repeated or unsafe members, more than one root, required members missing (below the root)."""
    rows = members.withColumn("root", F.split("name", "/")[0]).withColumn("inner", F.regexp_replace("name", "^[^/]*/", ""))
    by = rows.groupBy("archive").agg(
        F.bool_or("broken").alias("broken"), (F.count("name") > F.countDistinct("name")).alias("repeated"), F.bool_or(~is_safe_path(F.col("name"))).alias("unsafe"),
        (F.countDistinct("root") > 1).alias("roots"), F.collect_set("inner").alias("have"),
    )
    lacking = F.array_except(F.array(*[F.lit(x) for x in required]).cast("array<string>"), "have")
    found = F.array_compact(F.concat(F.array(*[F.when(F.coalesce(F.col(k), F.lit(False)), F.lit(k)) for k in ("broken", "repeated", "unsafe", "roots")]), F.transform(lacking, lambda x: F.concat(F.lit("missing:"), x))))
    return by.select("archive", F.explode(found).alias("problem"))


def pdf_files(spark: SparkSession, path: str, pages_of: Callable[[bytes], list[dict]], most_bytes: int = 6 << 20) -> tuple[DataFrame, DataFrame]:
    """(pages, rejected) of PDF files. pages_of, a PDF reader's function from bytes to pages (page_no, native_text, ocr_text,
    width, dark_ratio, blocks), runs on executors; files without the PDF mark or above most_bytes are rejected unread."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), F.col("length").alias("size"), "content")
    why = F.when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "no PDF").when(F.col("size") > most_bytes, "too large")
    marked = files.withColumn("problem", why)
    blocks = "array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"doc_id": d, **p} for d, c in zip(b["doc_id"], b["content"], strict=True) for p in pages_of(c)]
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "native_text", "ocr_text", "width", "dark_ratio", "blocks"])

    good = marked.where("problem is null").select("doc_id", "content")
    pages = good.mapInPandas(read, f"doc_id string, page_no int, native_text string, ocr_text string, width double, dark_ratio double, blocks {blocks}")
    return pages, marked.where("problem is not null").select("doc_id", "problem")


def decoded_pdfs(rows: DataFrame, column: str, most_bytes: int = 6 << 20) -> DataFrame:
    """rows with content decoded from base64 and problem: invalid, no PDF, too large or null."""
    content = F.try_to_binary(F.col(column), F.lit("base64"))
    out = rows.withColumn("content", content)
    return out.withColumn("problem", F.when(F.col("content").isNull(), "invalid").when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "no PDF").when(F.length("content") > most_bytes, "too large"))


def job_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Job documents of a folder, one JSON object a file; files that can't be read or parsed are skipped."""
    out = spark.read.option("ignoreCorruptFiles", "true").option("mode", "PERMISSIVE").option("multiLine", "true").option("columnNameOfCorruptRecord", "_bad").schema(schema + ", _bad string").json(path)
    return out.where("_bad is null").drop("_bad")


def write_csv(rows: DataFrame, path: str) -> None:
    """A CSV table with a header; nested columns as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", "true").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines; Spark's committer shows all or nothing."""
    rows.write.mode("overwrite").json(path)


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def without_keys(store: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """A store without the rows of given keys, to be written as its next version."""
    return store.join(gone.select(key).distinct(), key, "left_anti")


def report(summary: DataFrame) -> DataFrame:
    """A summary row as a Markdown table, one line a column."""
    lines = [F.concat(F.lit(f"| {c} | "), F.coalesce(F.col(c).cast("string"), F.lit("-")), F.lit(" |")) for c in summary.columns]
    return summary.select(F.concat_ws("\n", F.lit("| metric | value |\n|---|---|"), *lines).alias("value"))
