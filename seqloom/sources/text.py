"""Readers of text formats, as lazy frames over splittable text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of alignment lines, and of annotation lines.
SAM_COLUMNS = (("qname", "string"), ("flag", "int"), ("rname", "string"), ("pos", "long"), ("mapq", "int"), ("cigar", "string"), ("rnext", "string"), ("pnext", "long"), ("tlen", "long"), ("seq", "string"), ("qual", "string"))
GTF_COLUMNS = ("seqname", "source", "feature", "start", "end", "score", "strand", "frame", "attributes")


def _number(c: Column, kind: str) -> Column:
    """Whole number, or null where another text (such as ``*``) stands."""
    return F.when(c.rlike(r"^-?\d{1,18}$"), c).cast(kind)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment lines: the eleven columns, ``tags`` (tab-separated text) and
    ``input_file``. Header lines and lines of fewer columns are left out; text
    in number columns gives null."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).filter(~F.col("value").startswith("@") & (F.size(parts) >= 11))
    cols = [(parts[i] if kind == "string" else _number(parts[i], kind)).alias(name) for i, (name, kind) in enumerate(SAM_COLUMNS)]
    tags = F.when(F.size(parts) > 11, F.array_join(F.slice(parts, 12, 10_000), "\t"))
    return lines.select(*cols, tags.alias("tags"), F.input_file_name().alias("input_file"))


def read_sam_references(spark: SparkSession, path: str) -> DataFrame:
    """(name, length) of the header's reference lines."""
    lines = spark.read.text(path).filter(F.col("value").startswith("@SQ"))
    return lines.select(F.regexp_extract("value", r"\tSN:([^\t]*)", 1).alias("name"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("length")).distinct()


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) of each contig, in capitals; the name ends at a blank."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^>|\r", "").alias("v"))
    head = F.substring_index("v", "\n", 1)
    body = F.when(F.instr("v", "\n") > 0, F.upper(F.regexp_replace(F.expr("substring(v, instr(v, '\n') + 1)"), r"\s", ""))).otherwise("")
    return records.filter(F.trim("v") != "").select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), body.alias("seq"))


def attribute(name: str, of: str = "attributes") -> Column:
    """Value of an annotation attribute: ``k "v";``, ``k=v;`` or ``k v``."""
    value = F.regexp_extract(of, rf'(?:^|;)\s*{name}(?:\s+|\s*=\s*)"?([^";]*)"?', 1)
    return F.nullif(F.trim(value), F.lit(""))


def read_gtf(spark: SparkSession, path: str, feature_types: tuple[str, ...] = ("exon",), gene: str = "gene_id", extra: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """Features of the given types: feature_id, gene, chr, start, stop, strand
    (0, 1, -1 unknown) and extra attributes. strict: a feature without its
    gene attribute or with bad coordinates is an error."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.size(parts) >= 9) & parts[2].isin(*feature_types)).select(*[parts[i].alias(c) for i, c in enumerate(GTF_COLUMNS)])
    start, stop, name = _number(F.col("start"), "long"), _number(F.col("end"), "long"), attribute(gene)
    ok = name.isNotNull() & start.isNotNull() & stop.isNotNull() & (start >= 1) & (start <= stop) & (stop <= 2**31 - 1)
    if strict:
        name = F.when(ok, name).otherwise(F.raise_error(F.concat(F.lit("bad feature: "), F.concat_ws(" ", "seqname", "start", "end", "attributes"))))
    else:
        rows = rows.filter(ok)
    strand = F.when(F.col("strand") == "+", 0).when(F.col("strand") == "-", 1).otherwise(-1)
    return rows.select(F.monotonically_increasing_id().alias("feature_id"), name.alias("gene"), F.col("seqname").alias("chr"), start.alias("start"), stop.alias("stop"), strand.alias("strand"), *[attribute(x).alias(x) for x in extra])


def read_saf(spark: SparkSession, path: str) -> DataFrame:
    """Features of five columns; a header is known by its names in any case,
    lines of fewer than four tabs are comments; no strand means plus."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).filter((F.size(parts) >= 5)).filter(~F.lower("value").startswith("geneid\tchr\tstart"))
    strand = F.when(F.trim(parts[4]).isin("+", ""), 0).when(F.trim(parts[4]) == "-", 1).otherwise(-1)
    return lines.select(F.monotonically_increasing_id().alias("feature_id"), parts[0].alias("gene"), parts[1].alias("chr"), _number(parts[2], "long").alias("start"), _number(F.trim(parts[3]), "long").alias("stop"), strand.alias("strand"))


def read_alias(spark: SparkSession, path: str) -> DataFrame:
    """(annotation_chr, read_chr) of a comma-separated file, ``#`` comments."""
    parts = F.split("value", ",")
    return spark.read.text(path).filter(~F.col("value").startswith("#") & (F.size(parts) >= 2)).select(F.trim(parts[0]).alias("annotation_chr"), F.trim(parts[1]).alias("read_chr"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(chr, pos, id, ref, alt, quality, filter, info) of variant lines."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.size(parts) >= 8))
    quality = F.when(parts[5].rlike(r"^[-+0-9.eE]+$"), parts[5]).cast("double")
    return lines.select(parts[0].alias("chr"), _number(parts[1], "long").alias("pos"), parts[2].alias("id"), parts[3].alias("ref"), parts[4].alias("alt"), quality.alias("quality"), parts[6].alias("filter"), parts[7].alias("info"))


def known_snps(vcf: DataFrame) -> DataFrame:
    """Places of variants that aren't indels: some alternative is as long as
    the reference."""
    same = F.exists(F.split("alt", ","), lambda a: F.length(a) == F.length("ref"))
    return vcf.filter(~F.col("info").startswith("INDEL") & same).select("chr", "pos").distinct()


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chr, start, stop, name, score, strand), 1-based and inclusive."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).filter(~F.col("value").rlike("^(#|track|browser)") & (F.size(parts) >= 3))
    return lines.select(parts[0].alias("chr"), (_number(parts[1], "long") + 1).alias("start"), _number(parts[2], "long").alias("stop"), F.get(parts, F.lit(3)).alias("name"), F.get(parts, F.lit(4)).alias("score"), F.get(parts, F.lit(5)).alias("strand"))


def read_junction_table(spark: SparkSession, path: str) -> DataFrame:
    """(name, chr, left, right); chromosome names of fewer than three letters
    get ``chr`` before them."""
    parts = F.split("value", "\t")
    chr_ = F.when(F.length(parts[1]) < 3, F.concat(F.lit("chr"), parts[1])).otherwise(parts[1])
    return spark.read.text(path).filter(F.size(parts) >= 4).select(parts[0].alias("name"), chr_.alias("chr"), _number(parts[2], "long").alias("left"), _number(parts[3], "long").alias("right")).filter("left is not null and right is not null")


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """(barcode), each cut at the first sign that isn't a letter."""
    return spark.read.text(path).select(F.regexp_extract("value", r"^([A-Za-z]*)", 1).alias("barcode")).filter("barcode <> ''")


def read_sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, sample, fields): lines of the sheet's data part by the names
    of its header line. The sheet must say EMFileVersion,4."""
    text = spark.read.text(path, wholetext=True)
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    checked = F.when(F.exists(lines, lambda x: x.startswith("EMFileVersion,4")), lines).otherwise(F.raise_error(F.lit("the sample sheet must say EMFileVersion,4")))
    data = text.select(checked.alias("l")).withColumn("at", F.array_position(F.transform("l", lambda x: x.startswith("[Data]")), True).cast("int")).filter("at > 0")
    rows = data.select(F.split(F.element_at("l", F.col("at") + 1), ",").alias("names"), F.posexplode(F.slice(F.col("l"), F.col("at") + 2, F.size("l"))))
    fields = F.map_from_arrays("names", F.transform(F.sequence(F.lit(0), F.size("names") - 1), lambda i: F.coalesce(F.get(F.split("col", ","), i), F.lit(""))))
    out = rows.filter("trim(col) <> ''").select(F.col("pos").alias("row_no"), fields.alias("fields"))
    sample = F.coalesce(F.try_element_at("fields", F.lit("SampleName")), F.try_element_at("fields", F.lit("Sample_Name")), F.try_element_at("fields", F.lit("SampleID")))
    return out.select("row_no", sample.alias("sample"), "fields")


def sniff(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind) of files by their first bytes: bam, gzip, fasta, fastq,
    sam, empty or unknown. Only the head of each file is looked at."""
    files = spark.read.format("binaryFile").load(path)
    head = F.substring("content", 1, 64)
    text = F.decode(head, "ISO-8859-1")
    bgzf = F.hex(F.substring("content", 13, 2)) == "4243"
    kind = (
        F.when(F.col("length") == 0, "empty")
        .when((F.hex(F.substring("content", 1, 2)) == "1F8B") & bgzf, "bam")
        .when(F.hex(F.substring("content", 1, 2)) == "1F8B", "gzip")
        .when(text.startswith(">"), "fasta")
        .when(text.rlike(r"^@(HD|SQ|PG|RG|CO)\t") | (F.size(F.split(F.substring_index(text, "\n", 1), "\t")) >= 6), "sam")
        .when(text.startswith("@"), "fastq")
        .otherwise("unknown")
    )
    return files.select("path", kind.alias("kind"))
