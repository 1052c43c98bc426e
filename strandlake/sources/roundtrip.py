"""Given tables written out by the sinks and read back by the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from strandlake.functions.ordered import shared_folder
from strandlake.sources import tables


def _path(df: DataFrame, name: str) -> str:
    """A new place in the folder that the cluster shares."""
    return f"{shared_folder(df)}/{name}-{uuid.uuid4().hex}"


def tsv(sites: DataFrame) -> DataFrame:
    """Counts of sites as gzipped parts without a header; two columns and a region are read."""
    rows, path = sites.select("chrom", "pos", "grp", "ac", "an"), _path(sites, "tsv")
    tables.write_tsv(rows, path, header=False, compress=True)
    back = tables.read_tsv(sites.sparkSession, path, "chrom string, pos long, grp string, ac long, an long", ["chrom", "pos", "grp", "ac", "an"])
    return tables.region(back, None, 40_000, 160_000).select(F.col("chrom").cast("long").alias("chrom"), "pos", "grp", "ac", "an")


def tsv_parts(sims: DataFrame) -> DataFrame:
    """Rows appended in three goes, each with its headers, read as one table; missing values come back as such."""
    rows, path = sims.select("sim", F.when(F.col("sim") % 5 > 0, F.col("status")).alias("status"), F.col("theta").cast("double").alias("theta")), _path(sims, "parts")
    for k in range(3):
        tables.append_tsv(rows.filter(F.col("sim") % 3 == k), path)
    return tables.read_tsv_parts(sims.sparkSession, path, "sim long, status string, theta double").select("sim", "status", F.round("theta", 2).alias("theta"))


def csv(genes: DataFrame) -> DataFrame:
    """Genes with a header, by names in their order."""
    rows, path = genes.select(F.col("chrom").cast("string").alias("c"), F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), F.col("term")), _path(genes, "csv")
    rows.write.csv(path, header=True)
    back = tables.read_csv(genes.sparkSession, path, "c string, s long, e long, term string")
    return back.groupBy("c", "term").agg(F.count("*").alias("n"), F.sum(F.col("e") - F.col("s")).alias("bp"))


def json_lines(reps: DataFrame) -> DataFrame:
    """Replicate rows as gzipped JSON lines; of these, the statistics that all replicates of an engine have."""
    path = _path(reps, "json")
    reps.select("engine", "rep", "stat", "value").write.json(path, compression="gzip")
    full = tables.stacked(tables.read_replicates(reps.sparkSession, path, "engine int, rep long, stat string, value double"))
    return full.groupBy("engine", "stat").agg(F.count_distinct("rep").alias("n_reps"), F.round(F.avg("value"), 6).alias("mean"))


def spectrum(sites: DataFrame) -> DataFrame:
    """Spectra of four groups of sites as lines of numbers, each of n + 1 values, read and added up."""
    most = sites.agg(F.max("n")).first()[0]
    counts = sites.groupBy((F.col("site") % 4).alias("line"), "k").agg(F.count("*").alias("c"))
    value = F.map_from_entries(F.collect_list(F.struct("k", "c")))
    lines = counts.groupBy("line").agg(value.alias("m")).select(F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(most).cast("long")), lambda k: F.coalesce(F.col("m")[k], F.lit(0)).cast("string")), " ").alias("value"))
    path = _path(sites, "spectrum")
    lines.write.text(path)
    return tables.read_spectrum(sites.sparkSession, path, most + 1).groupBy(F.col("i").cast("long").alias("k")).agg(F.sum("v").alias("n"))


def vcf(haps: DataFrame) -> DataFrame:
    """Calls of 25 haploid samples as VCF lines, a seventh of them missing, read into long form and counted by population."""
    call = F.when((F.col("site") + F.col("hap")) % 7 == 0, ".").otherwise(F.col("allele").cast("string"))
    row = F.transform(F.array_sort(F.collect_list(F.struct("hap", call.alias("c")))), lambda x: x["c"])
    body = haps.groupBy("site").agg(row.alias("calls")).select(F.concat_ws("\t", F.lit("1"), F.col("site").cast("string"), F.lit("."), F.lit("A"), F.lit("C"), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), F.array_join("calls", "\t")).alias("value"))
    samples = haps.select("hap", "pop").distinct()
    names = samples.agg(F.array_join(F.transform(F.array_sort(F.collect_list("hap")), lambda h: F.concat(F.lit("h"), h.cast("string"))), "\t").alias("names"))
    head = names.select(F.concat_ws("\t", F.lit("#CHROM"), F.lit("POS"), F.lit("ID"), F.lit("REF"), F.lit("ALT"), F.lit("QUAL"), F.lit("FILTER"), F.lit("INFO"), F.lit("FORMAT"), "names").alias("value"))
    path = _path(haps, "vcf")
    head.union(body).write.text(path)
    populations = samples.select(F.concat(F.lit("h"), F.col("hap").cast("string")).alias("sample"), F.col("pop").cast("string").alias("population"))
    calls = tables.read_vcf(haps.sparkSession, path, populations)
    return tables.allele_counts(calls).select(F.col("pos"), F.col("population").cast("long").alias("pop"), "ac", "an")


#: Query -> (function, views that it reads).
FRAMES = {
    "roundtrip_tsv": (tsv, ["v_site"]),
    "roundtrip_tsv_parts": (tsv_parts, ["v_sim"]),
    "roundtrip_csv": (csv, ["v_gene"]),
    "roundtrip_json_lines": (json_lines, ["v_rep"]),
    "roundtrip_spectrum": (spectrum, ["v_hsite"]),
    "roundtrip_vcf": (vcf, ["v_hap"]),
}
