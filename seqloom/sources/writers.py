"""Writers of text formats: frames of one column ``value`` and how to write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.assign import STATUSES, printed


def write_lines(lines: DataFrame, path: str, header: list[str] = (), single: bool = False) -> None:
    """Lines (column value) as text files in a folder, header lines first.

    The header is the first partition, the lines follow in their own
    partitions and order. single: one file (for small results).
    """
    if header:
        head = lines.sparkSession.createDataFrame([("\n".join(header),)], "value string").coalesce(1)
        lines = head.union(lines.select("value"))
    (lines.coalesce(1) if single else lines).write.mode("overwrite").text(path)


def tab_line(*cols: Column | str) -> Column:
    return F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("*")) for c in cols])


def sam_lines(df: DataFrame) -> DataFrame:
    """Alignment columns as lines; null numbers are 0, null texts ``*``."""
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    text = lambda c: F.coalesce(F.col(c), F.lit("*"))
    cols = [text("qname"), number("flag"), text("rname"), number("pos"), number("mapq"), text("cigar"), text("rnext"), number("pnext"), number("tlen"), text("seq"), text("qual"), F.col("tags")]
    return df.select(F.concat_ws("\t", *cols).alias("value"))


def fastq_lines(df: DataFrame, name: str, seq: str, qual: str) -> DataFrame:
    return df.select(F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), qual).alias("value"))


def fasta_lines(df: DataFrame, name: str, seq: str, width: int = 70) -> DataFrame:
    body = F.trim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"))
    return df.select(F.concat(F.lit(">"), name, F.lit("\n"), F.rtrim(body)).alias("value"))


def collapsed(values: Column) -> Column:
    """An array as one value if all are equal, else joined by semicolons."""
    return F.when(F.size(F.array_distinct(values)) == 1, F.element_at(values, 1)).otherwise(F.array_join(values, ";"))


def gene_table(features: DataFrame, lengths: DataFrame, counts: DataFrame, files: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    """Gene counts: Geneid, Chr, Start, End, Strand, Length, extra, and a column
    a file. counts: gene and a count65536 column a file."""
    by = features.groupBy("gene").agg(F.min("feature_id").alias("first"), F.sort_array(F.collect_list(F.struct("feature_id", "chr", "start", "stop", "strand", *extra))).alias("f"))
    sign = lambda s: F.when(s == 0, "+").when(s == 1, "-").otherwise(".")
    joined = lambda name: F.array_join(F.transform("f", lambda x: x[name].cast("string")), ";")
    out = by.join(lengths, "gene").join(counts, "gene", "left")
    cols = [F.col("gene").alias("Geneid"), joined("chr").alias("Chr"), joined("start").alias("Start"), joined("stop").alias("End"), F.array_join(F.transform("f", lambda x: sign(x.strand)), ";").alias("Strand"), F.col("length").alias("Length")]
    cols += [collapsed(F.transform("f", lambda x, e=e: x[e])).alias(e) for e in extra]
    return out.orderBy("first").select(*cols, *[printed(F.coalesce(f, F.lit(0))).alias(f) for f in files])


def summary_table(statuses: DataFrame, files: list[str]) -> DataFrame:
    """(Status, one column a file) from rows (file, status, n)."""
    wide = statuses.groupBy("status").pivot("file", files).agg(F.sum("n"))
    names = statuses.sparkSession.createDataFrame(list(enumerate(STATUSES)), "no int, status string")
    return names.join(wide, "status", "left").orderBy("no").select(F.col("status").alias("Status"), *[F.coalesce(f, F.lit(0)).alias(f) for f in files])


def vcf_lines(variants: DataFrame) -> DataFrame:
    """Variant calls as lines with DP, MMsum, BGTOTAL and BGMM."""
    info = F.concat(F.lit("DP="), F.col("total"), F.lit(";MMsum="), F.col("mismatches"), F.lit(";BGTOTAL="), F.col("bg_total"), F.lit(";BGMM="), F.col("bg_mismatches"))
    return variants.select(F.concat_ws("\t", "chr", F.col("pos").cast("string"), F.lit("."), "ref", "alts", F.format_string("%.4f", "quality"), F.lit("."), info).alias("value"))


def bed_lines(spans: DataFrame, chr: str, start: str, stop: str, *more: str) -> DataFrame:
    return spans.select(tab_line(chr, F.col(start) - 1, stop, *more).alias("value"))


def matrix_lines(entries: DataFrame) -> tuple[DataFrame, list[str]]:
    """MatrixMarket lines of (gene_no, cell_no, n), and their header."""
    size = entries.agg(F.coalesce(F.max("gene_no"), F.lit(0)).alias("g"), F.coalesce(F.max("cell_no"), F.lit(0)).alias("c"), F.count(F.lit(1)).alias("n")).first()
    lines = entries.orderBy("cell_no", "gene_no").select(F.concat_ws(" ", "gene_no", "cell_no", "n").alias("value"))
    return lines, ["%%MatrixMarket matrix coordinate integer general", f"{size.g} {size.c} {size.n}"]
