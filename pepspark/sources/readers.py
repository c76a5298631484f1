"""Sources: FASTA, mzML (plain or gzip), library tables, and the reader chosen by a file's extension."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pepspark.functions import columns as K
from pepspark.operators.spectra import clean_peaks, isolation_bounds, seconds


def parse_fasta_records(records: DataFrame, text: str = "value") -> DataFrame:
    """``fasta_id, description, sequence`` of records without their leading ``>``; one trailing X is dropped."""
    head, body = F.substring_index(F.col(text), "\n", 1), F.expr(f"substring({text}, instr({text}, '\n') + 1)")
    body = F.when(F.instr(text, "\n") > 0, body).otherwise("")
    words = F.split(F.trim(F.regexp_replace(head, r"^>|\r", "")), " ", 2)
    sequence = F.regexp_replace(F.regexp_replace(body, r"\s", ""), "X$", "")
    return records.where(F.length(F.trim(text)) > 0).select(words[0].alias("fasta_id"), F.coalesce(F.try_element_at(words, F.lit(2)), F.lit("")).alias("description"), sequence.alias("sequence"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Proteins of FASTA files, split among tasks at the records' marks."""
    lines = spark.read.option("lineSep", "\n>").text(path)
    return parse_fasta_records(lines.select(F.regexp_replace("value", "^>", "").alias("value")))


def decode_binary(text: str | None, bits: int, compressed: bool) -> np.ndarray:
    """Base64 (and zlib) coded little-endian floats; nothing if they can't be read."""
    try:
        data = base64.b64decode(text or "")
        return np.frombuffer(zlib.decompress(data) if compressed else data, "<f4" if bits == 32 else "<f8").astype(float)
    except (ValueError, zlib.error):
        return np.empty(0)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def decode_arrays(text: pd.Series, bits: pd.Series, compressed: pd.Series) -> pd.Series:
    return pd.Series([decode_binary(t, b, c) for t, b, c in zip(text, bits, compressed, strict=True)])


# Accessions of the terms that are read from mzML.
LEVEL, START, MZ, INTENSITY, ZLIB, FLOAT32 = "MS:1000511", "MS:1000016", "MS:1000514", "MS:1000515", "MS:1000574", "MS:1000521"
TARGET, LOWER, UPPER, SCAN_LOW, SCAN_HIGH = "MS:1000827", "MS:1000828", "MS:1000829", "MS:1000501", "MS:1000500"

_PARAM = "array<struct<_accession:string,_value:string,_unitName:string>>"
MZML_SCHEMA = (
    f"_index long, _id string, cvParam {_PARAM}, "
    f"scanList struct<scan:array<struct<cvParam:{_PARAM},scanWindowList:struct<scanWindow:array<struct<cvParam:{_PARAM}>>>>>>, "
    f"precursorList struct<precursor:array<struct<isolationWindow:struct<cvParam:{_PARAM}>>>>, "
    f"binaryDataArrayList struct<binaryDataArray:array<struct<cvParam:{_PARAM},binary:string>>>"
)


def _term(params, accession: str):
    return F.try_element_at(F.filter(F.coalesce(params, F.array().cast(_PARAM)), lambda p: p["_accession"] == accession), F.lit(1))


def _number(params, accession: str):
    return _term(params, accession)["_value"].try_cast("double")


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """One row a spectrum: ``run_name, frame_num, ms_level, time_in_seconds, isolation bounds, scan bounds, mz, ab``.

    The XML source splits plain files at spectrum elements; gzip files are one task each.
    """
    rows = spark.read.format("xml").option("rowTag", "spectrum").schema(MZML_SCHEMA).load(path)
    scan = F.try_element_at(F.col("scanList.scan"), F.lit(1))
    start = _term(scan["cvParam"], START)
    level = F.coalesce(_number(F.col("cvParam"), LEVEL), F.lit(1)).cast("int")
    window = F.try_element_at(F.col("precursorList.precursor"), F.lit(1))["isolationWindow"]["cvParam"]
    scan_window = F.try_element_at(scan["scanWindowList"]["scanWindow"], F.lit(1))["cvParam"]
    bounds = isolation_bounds(_number(window, TARGET), _number(window, LOWER), _number(window, UPPER), level)

    def values(accession: str):
        found = F.try_element_at(F.filter("binaryDataArrayList.binaryDataArray", lambda a: F.exists(a["cvParam"], lambda p: p["_accession"] == accession)), F.lit(1))
        has = lambda a: F.exists(F.coalesce(found["cvParam"], F.array().cast(_PARAM)), lambda p: p["_accession"] == a)
        return decode_arrays(found["binary"], F.when(has(FLOAT32), 32).otherwise(64), has(ZLIB))

    return rows.select(
        K.run_name(F.input_file_name()).alias("run_name"),
        (F.col("_index") + 1).alias("frame_num"),
        level.cast("smallint").alias("ms_level"),
        F.coalesce(seconds(start["_value"].try_cast("double"), F.coalesce(start["_unitName"], F.lit("minute"))), F.lit(0.0)).alias("time_in_seconds"),
        bounds["low"].alias("isolation_min_mz"),
        bounds["high"].alias("isolation_max_mz"),
        _number(scan_window, SCAN_LOW).alias("mz_lo"),
        _number(scan_window, SCAN_HIGH).alias("mz_hi"),
        values(MZ).alias("mz"),
        values(INTENSITY).alias("ab"),
    )


def peaks_of(frames: DataFrame) -> DataFrame:
    """Long peaks ``run_name, frame_num, mz, ab`` of frames with array columns."""
    return clean_peaks(frames.select("run_name", "frame_num", "mz", "ab"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """The reader for a file's extension: mzML, or Parquet tables of frames."""
    name = path.lower().removesuffix(".gz")
    if name.endswith(".mzml"):
        return read_mzml(spark, path)
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"no reader for {path}; vendor formats need a converter")


def library_slice(spark: SparkSession, path: str, key: str, first: int, last: int, columns: list[str]) -> DataFrame:
    """Rows first..last of a library table sorted by ``key``: bounds and columns reach the Parquet scan."""
    return spark.read.parquet(path).select(*columns).where(F.col(key).between(first, last))
