"""Readers for delimited text and for the community tables.

Cells are read as text under a stated schema, trimmed, empty and ``NA`` cells
become NULL, and typing uses the forgiving casts: a malformed cell is NULL
instead of a failed job. There is no schema inference, hence no extra pass.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from dyadspark.functions import parse_day
from dyadspark.operators.community import Community, assemble
from dyadspark.operators.reshape import counts_from_wide
from dyadspark.sources.schemas import SAMPLE_METADATA, text_schema


def clean_text(c: Column | str, missing: Sequence[str] = ("", "NA")) -> Column:
    c = F.trim(F.col(f"`{c}`") if isinstance(c, str) else c)
    return F.when(~c.isin(list(missing)), c)


def _typed(c: Column, kind: str) -> Column:
    if kind == "string":
        return c
    if kind == "day":
        return parse_day(c)
    if kind == "flag":
        return F.when(F.upper(c) == "TRUE", True).when(F.upper(c) == "FALSE", False)
    return c.try_cast(kind)


def header_of(spark: SparkSession, path: str, options: dict) -> list[str]:
    """Column names of a delimited file as its first line has them."""
    return spark.read.options(**options).csv(path).columns


def read_delimited(
    spark: SparkSession, path: str, columns: Sequence[tuple[str, str, str]], sep: str = ",", row_number: str | None = None,
    by_position: bool = False,
) -> DataFrame:
    """A delimited file with header; ``columns`` lists (file name, own name, type).

    Columns are found by the names in the header, in any order; a missing one is an error, and so is a further file of
    the path with another header. With ``by_position`` the names are the caller's and the file's order counts.
    ``row_number`` adds a column that orders rows by file, then place in the file, for rules that depend on file order.
    """
    names = [c for c, _, _ in columns]
    options = {"header": True, "sep": sep, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    if by_position:
        schema, options["enforceSchema"] = text_schema(columns), True
    else:
        found = header_of(spark, path, options)
        clean = [c.lstrip("\ufeff").strip() for c in found]
        missing = [n for n in names if n not in clean]
        if missing:
            raise ValueError(f"{path} has no columns {missing}")
        # names Spark makes up for empty header cells cannot be compared with the header
        options["enforceSchema"] = any(re.fullmatch(r"_c\d+", c) for c in found)
        schema = T.StructType([T.StructField(c, T.StringType()) for c in found])
    raw = spark.read.schema(schema).options(**options).csv(path)
    if row_number:
        place = F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"))
        raw = raw.select("*", place.alias("__row_number"))
    at = {n: i for i, n in enumerate(names if by_position else clean)}
    if not by_position:
        raw = raw.toDF(*[f"__c{i}" for i in range(len(found))], *(["__row_number"] if row_number else []))
    out = [
        _typed(clean_text(file_name if by_position else f"__c{at[file_name]}"), kind).alias(name)
        for file_name, name, kind in columns
    ]
    return raw.select(*out, *([F.col("__row_number").alias(row_number)] if row_number else []))


def read_csv(spark: SparkSession, path: str, columns, row_number: str | None = None) -> DataFrame:
    return read_delimited(spark, path, columns, ",", row_number)


def read_tsv(spark: SparkSession, path: str, columns, row_number: str | None = None) -> DataFrame:
    return read_delimited(spark, path, columns, "\t", row_number)


def read_sample_metadata(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, SAMPLE_METADATA)


def read_annotation(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """An annotation CSV, all text, with the given column names in file order."""
    return read_delimited(spark, path, [(n, n, "string") for n in names], by_position=True)


def read_genotype_text(spark: SparkSession, path: str, loci: Sequence[str], sep: str = " ") -> DataFrame:
    """Headerless ``id a b a b ...`` by position, as long ``(ind, locus, a, b)``."""
    names = ["ind"] + [f"{l}_{p}" for l in loci for p in ("a", "b")]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    wide = spark.read.schema(schema).option("sep", sep).option("header", False).csv(path)
    cell = {n: clean_text(n).try_cast("int") for n in names[1:]}
    per_locus = [
        F.struct(F.lit(l).alias("locus"), cell[f"{l}_a"].alias("a"), cell[f"{l}_b"].alias("b")) for l in loci
    ]
    return wide.select(clean_text("ind").try_cast("bigint").alias("ind"), F.inline(F.array(*per_locus)))


def read_wide_counts(spark: SparkSession, path: str, taxon: str, samples: Sequence[str], sep: str = "\t") -> DataFrame:
    """A taxon-by-sample count file as long non-zero counts; sample columns are named by the caller."""
    columns = [(taxon, taxon, "string")] + [(s, s, "bigint") for s in samples]
    return counts_from_wide(read_delimited(spark, path, columns, sep, by_position=True), taxon, samples)


def read_community(spark: SparkSession, folder: str) -> Community:
    """Counts, taxonomy and samples from parquet, restricted to ids all three share."""
    parts = (spark.read.parquet(f"{folder}/{name}") for name in ("abundance", "taxonomy", "samples"))
    return assemble(*parts)
