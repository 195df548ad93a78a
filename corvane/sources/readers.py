"""Readers: capped scans, mail, XML rows, JSON records, answer files, tar members."""

from __future__ import annotations

import email
import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import letter_anywhere, strip_bom


def capped(rows: DataFrame, by: str, order: list[str | Column], most: int) -> DataFrame:
    """The first `most` rows of each group in order."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_rn") <= most).drop("_rn")


def census(rows: DataFrame, by: str) -> DataFrame:
    """by, n: groups by size, the largest first."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def parsed_mail(raw: DataFrame, keys: list[str], text: str = "raw") -> DataFrame:
    """keys, frm, subject, body of RFC 822 texts; what cannot be read or has parts is left out."""
    schema = ", ".join(f"{k} {raw.schema[k].dataType.simpleString()}" for k in keys)

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, source in zip(frame[keys].itertuples(index=False), frame[text]):
                if source is None:
                    continue
                message = email.message_from_string(source)
                body = message.get_payload()
                if isinstance(body, str):
                    rows.append((*key, message.get("From") or "", (message.get("Subject") or "").strip(), body))
            yield pd.DataFrame(rows, columns=[*keys, "frm", "subject", "body"])

    return raw.select(*keys, text).mapInPandas(parse, f"{schema}, frm string, subject string, body string")


def tar_members(spark: SparkSession, path: str, pattern: str = "") -> DataFrame:
    """path, member, text of the files in tar archives whose names match; an archive is read whole by one task, so it must fit one (`archives.mail_archive` reads larger ones)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                with tarfile.open(fileobj=io.BytesIO(content)) as archive:
                    for member in archive:
                        if member.isfile():
                            data = archive.extractfile(member).read()
                            yield pd.DataFrame({"path": [name], "member": [member.name], "text": [data.decode("utf-8", "replace")]})

    out = files.mapInPandas(unpack, "path string, member string, text string")
    return out.filter(F.col("member").rlike(pattern)) if pattern else out


def xml_rows(spark: SparkSession, path: str, schema: str, row_tag: str = "row") -> DataFrame:
    """Rows of an XML file by their tag, as a splittable scan; attributes are columns with the prefix _."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def json_records(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """key, value of files that hold one JSON object {key: value}."""
    whole = spark.read.text(path, wholetext=True).select(strip_bom(F.col("value")).alias("value"))
    return whole.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias("key", "value"))


def answer_files(spark: SparkSession, path: str, pattern: str = r"^ans_(\d+)\.json$", default_conf: float = 50.0) -> DataFrame:
    """file, place, pid, choice (null: not readable), conf of answer files; names that do not match are left out."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    raw = spark.read.text(path, wholetext=True).select(name.alias("file"), strip_bom(F.col("value")).alias("value")).filter(F.col("file").rlike(pattern))
    each = raw.select("file", F.posexplode(F.from_json("value", "array<struct<pid string, choice string, conf double>>")).alias("place", "r"))
    return each.select("file", "place", "r.pid", letter_anywhere(F.col("r.choice")).alias("choice"), F.coalesce("r.conf", F.lit(default_conf)).alias("conf")).filter(F.col("pid").isNotNull())


def malformed_files(spark: SparkSession, path: str) -> DataFrame:
    """file, good: whether each file is a JSON array of objects with a pid."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    raw = spark.read.text(path, wholetext=True).select(name.alias("file"), F.from_json(strip_bom(F.col("value")), "array<struct<pid string>>").alias("r"))
    return raw.select("file", F.coalesce(F.forall("r", lambda r: r["pid"].isNotNull()), F.lit(False)).alias("good"))
