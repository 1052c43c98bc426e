"""Delimited text, spectra, annotations, genotypes and replicate rows as DataFrames, and back.

Gzipped files are read as they are; a gzip file can't be split, so many of them
are read in parallel, not one.  Paths go to Spark's readers, so any file system works.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Columns of the known headerless and headed tables.
SCHEMAS = {
    "site_parts": "chrom string, pos long, A double, B double",
    "degeneracy": "pos long, degen int, tx string",
    "counts": "pos long, ref string, alt string, ac long, an long",
    "genes": "c string, s long, e long",
    "exons": "c string, s long, e long, tx string, score double, strand string",
    "mafs": "position long, major string, minor string, knownEM double, nInd int",
    "rates": "chrom string, start long, end long, recombRate double",
    "windows": "region string, window_start long, window_stop long, n_variants long, pi_AA double, pi_BB double, dxy double, fst double, chrom string, center double, window_id long",
    "go": "query_sequence string, go_id string, go_term string, category string",
}


def read_tsv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """A headerless tab-separated table, or a directory of them, gzipped or not; lines that don't fit the schema fail."""
    table = spark.read.schema(SCHEMAS.get(schema, schema)).csv(path, sep="\t", header=False, mode="FAILFAST", nullValue="NA")
    return table.select(*columns) if columns else table


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """A table with a header, which must have the schema's names in its order."""
    return spark.read.schema(SCHEMAS.get(schema, schema)).csv(path, sep=sep, header=True, mode="FAILFAST", enforceSchema=False, nullValue="")


def region(table: DataFrame, chrom: str | None, left: int, right: int, pos: str = "pos") -> DataFrame:
    """Rows of [left, right), by plain columns, so that the filter reaches the scan."""
    inside = (F.col(pos) >= left) & (F.col(pos) < right)
    return table.filter(inside if chrom is None else inside & (F.col("chrom") == chrom))


def read_gff(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("gene", "mRNA")) -> DataFrame:
    """Features of some kinds: chrom, kind, s (0-based), e, strand, id and parent from the attributes."""
    names = "chrom string, source string, kind string, s long, e long, score string, strand string, phase string, attributes string"
    rows = spark.read.schema(names).csv(path, sep="\t", comment="#", quote="").filter(F.col("kind").isin(*kinds))
    attribute = lambda key: F.nullif(F.regexp_extract("attributes", rf"(?:^|;)\s*{key}=([^;]+)", 1), F.lit(""))
    return rows.select("chrom", "kind", (F.col("s") - 1).alias("s"), "e", "strand", attribute("ID").alias("id"), attribute("Parent").alias("parent"))


def read_vcf(spark: SparkSession, path: str, populations: DataFrame) -> DataFrame:
    """Biallelic SNP calls in long form: chrom, pos, ref, alt, sample, population, hap (0, 1, ...), allele (null: missing).

    ``populations`` has sample and population; samples that it lacks are left out.
    """
    lines = spark.read.text(path)
    header = lines.filter(F.col("value").startswith("#CHROM")).first()
    if header is None:
        raise ValueError(f"{path} has no #CHROM line")
    samples = header[0].split("\t")[9:]
    fields = F.split("value", "\t")
    rows = lines.filter(~F.col("value").startswith("#")).select(fields.alias("f"))
    snp = rows.filter(F.col("f")[3].rlike("^[ACGTacgt]$") & F.col("f")[4].rlike("^[ACGTacgt]$"))
    genotype = F.posexplode(F.slice("f", 10, len(samples)))
    calls = snp.select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("pos"), F.col("f")[3].alias("ref"), F.col("f")[4].alias("alt"), genotype.alias("column", "call"))
    names = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "column int, sample string")
    mine = F.broadcast(names.join(populations.select("sample", "population"), "sample"))  # one row for each column of the file
    alleles = F.posexplode(F.split(F.substring_index("call", ":", 1), "[/|]"))
    long = calls.join(mine, "column").select("chrom", "pos", "ref", "alt", "sample", "population", alleles.alias("hap", "a"))
    return long.withColumn("allele", F.when(F.col("a").isin("0", "1"), F.col("a").cast("int"))).drop("a")


def allele_counts(calls: DataFrame) -> DataFrame:
    """ac and an by site and population; missing calls count in neither, and sites without a call are left out."""
    sums = calls.groupBy("chrom", "pos", "ref", "alt", "population").agg(F.sum("allele").alias("ac"), F.count("allele").alias("an"))
    return sums.filter("an > 0")


def read_spectrum(spark: SparkSession, path: str, size: int | None = None, square: bool = False) -> DataFrame:
    """Whitespace-separated spectra, one a line: line, i, v (or i, j, v if ``square``).

    A spectrum that has not ``size`` values, or is not square, is an error.
    """
    values = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), values.cast("array<double>").alias("v")).filter(F.size("v") > 0)
    side = F.sqrt(F.size("v")).cast("int")
    wrong = F.size("v") != size if size else side * side != F.size("v") if square else F.lit(False)
    checked = rows.select("file", F.when(wrong, F.raise_error(F.concat(F.lit("a spectrum of "), F.size("v").cast("string"), F.lit(" values")))).otherwise(F.col("v")).alias("v"))
    long = checked.select("file", F.posexplode("v").alias("at", "v"), F.size("v").alias("n"))
    if not square:
        return long.select("file", F.col("at").alias("i"), "v")
    return long.select("file", F.floor(F.col("at") / F.sqrt("n")).cast("int").alias("i"), (F.col("at") % F.sqrt("n").cast("int")).alias("j"), "v")


def read_replicates(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Replicate rows as JSON lines, gzipped or not; lines that are not JSON fail."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def write_replicates(rows: DataFrame, path: str) -> None:
    """As Parquet by engine and replicate; replicates written before stay, and one written again is replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("engine", "rep").parquet(path)


def stacked(rows: DataFrame) -> DataFrame:
    """Of replicate rows (engine, rep, stat, value): the statistics that all replicates of their engine have."""
    reps = rows.groupBy("engine").agg(F.count_distinct("rep").alias("reps"))
    full = rows.groupBy("engine", "stat").agg(F.count_distinct("rep").alias("n")).join(reps, "engine").filter("n = reps")
    return rows.join(full.select("engine", "stat"), ["engine", "stat"], "left_semi")


def write_tsv(table: DataFrame, path: str, header: bool = True, compress: bool = False) -> None:
    """A directory of tab-separated parts."""
    table.write.mode("overwrite").csv(path, sep="\t", header=header, compression="gzip" if compress else "none", nullValue="NA")


def append_tsv(table: DataFrame, path: str) -> None:
    """Appends parts with a header each, as tasks that finish one by one do; ``read_tsv_parts`` reads them as one table."""
    table.write.mode("append").csv(path, sep="\t", header=True, nullValue="NA")


def read_tsv_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All parts of a directory as one table; each part's header is left out."""
    return spark.read.schema(SCHEMAS.get(schema, schema)).csv(path, sep="\t", header=True, mode="FAILFAST", nullValue="NA")


def write_report(spark: SparkSession, facts: dict, path: str) -> None:
    """A small JSON report and the same as lines of text, through Spark's writers, so that any file system works."""
    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.json")
    lines = [(f"{k}\t{v}",) for k, v in sorted(facts.items())]
    spark.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(f"{path}.txt")


def rescaled(nodes: DataFrame, size: float, time: Column | str = "time") -> DataFrame:
    """Node times in coalescent units as generations: times 2 N."""
    return nodes.withColumn("time", F.col(time) * 2 * size if isinstance(time, str) else time * 2 * size)
