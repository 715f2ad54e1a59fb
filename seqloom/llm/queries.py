"""Queries of the operators for training data, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import qdigest
from seqloom.llm.leaks import corpus_index, exact_phrases, leaked
from seqloom.llm.neardup import NearDuplicates
from seqloom.llm.packing import pack, token_counts
from seqloom.llm.spans import shared_spans
from seqloom.llm.split import split_by_topic, split_oversized
from seqloom.llm.truncation import truncated
from seqloom.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# 2: percentiles


def _stacked(df: DataFrame, dims: dict) -> DataFrame:
    """Each row once a dimension, as (dim, key, v)."""
    tags = F.array(*[F.struct(F.lit(d).alias("dim"), k.cast("string").alias("key")) for d, k in dims.items()])
    return df.select(F.explode(tags).alias("t"), "v").select("t.dim", "t.key", "v")


def _read(digests: DataFrame) -> DataFrame:
    out = qdigest.percentiles(digests)
    k = F.from_json("g", "dim string, key string")
    return out.select(k.dim.alias("dim"), k.key.alias("key"), *[c for c in out.columns if c != "g"])


def p2_length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of read_log per run, per sample and per day."""
    log = table(spark, sf_dir, "read_log").filter("read_length >= 1").select("run_id", "sample_id", "logged_at", F.col("read_length").alias("v"))
    rows = _stacked(log, {"run_id": F.col("run_id"), "sample_id": F.col("sample_id"), "day": F.to_date("logged_at")})
    return _read(qdigest.join(qdigest.build(rows, [F.col("dim"), F.col("key")], F.col("v"))))


def p2_run_from_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per run, joined from the digests of the single days."""
    log = table(spark, sf_dir, "read_log").filter("read_length >= 1")
    days = qdigest.join(qdigest.build(log, [F.col("run_id"), F.to_date("logged_at").alias("day")], F.col("read_length")))
    run = F.to_json(F.struct(F.lit("run_id").alias("dim"), F.from_json("g", "run_id string").run_id.alias("key")), {"ignoreNullFields": "false"})
    return _read(qdigest.join(days.withColumn("g", run)))


def p2_long_read_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of long_reads per run and per sample."""
    reads = table(spark, sf_dir, "long_reads").filter("read_length >= 1").select("run_id", "sample_id", F.col("read_length").alias("v"))
    rows = _stacked(reads, {"run_id": F.col("run_id"), "sample_id": F.col("sample_id")})
    return _read(qdigest.join(qdigest.build(rows, [F.col("dim"), F.col("key")], F.col("v"))))


def p2_coarse_within_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of read_log per run from digests of some 64 nodes a level,
    and whether each answer's rank is as near as its digest proves."""
    log = table(spark, sf_dir, "read_log").filter("read_length >= 1").select("run_id", F.col("read_length").alias("v"))
    answers = qdigest.percentiles(qdigest.join(qdigest.build(log, [F.col("run_id")], F.col("v"), 64, 64), 64, 64))
    picks = [f"p{p:03d}" for p in qdigest.PERMILLE]
    answers = answers.select(F.from_json("g", "run_id string").run_id.alias("r"), "n", "rank_error", *picks)
    counts = [c for p in picks for c in (F.count_if(F.col("v") < F.col(p)).alias(f"{p}_below"), F.count_if(F.col("v") <= F.col(p)).alias(f"{p}_upto"))]
    ranks = log.join(answers, F.col("run_id").eqNullSafe(F.col("r"))).groupBy("run_id", "n", "rank_error").agg(*counts)
    want = {p: F.greatest(F.lit(1), F.ceil(F.lit(m) * F.col("n") / 1000)) for p, m in zip(picks, qdigest.PERMILLE)}
    near = [F.struct(F.lit(m).alias("permille"), ((want[p] > F.col(f"{p}_below") - F.col("rank_error")) & (want[p] <= F.col(f"{p}_upto") + F.col("rank_error"))).alias("near_enough")) for p, m in zip(picks, qdigest.PERMILLE)]
    small = F.col("rank_error") <= F.greatest(F.lit(1), F.col("n") / 4)
    return ranks.select("run_id", "n", F.explode(F.array(*near)).alias("x"), small.alias("bound_is_small")).select("run_id", "n", "x.permille", "x.near_enough", "bound_is_small")


def p2_score_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base scores of long_reads.qual_text per run."""
    reads = table(spark, sf_dir, "long_reads").select("run_id", "qual_text")
    return _read(qdigest.join(qdigest.build_scores(reads, F.col("run_id"), "qual_text")))


# 4: splitting


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "index_blocks")
    return split_oversized(blocks, "block_id", "base_values", 4000, 100, classes={"gap": "Nn"}, closing="gap", block=1, origin="start_base_offset")


def p4_piece_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all blocks, oversized or not, by chromosome."""
    blocks = table(spark, sf_dir, "index_blocks")
    pieces = split_oversized(blocks, "block_id", "base_values", 4000, 100, classes={"gap": "Nn"}, closing="gap", block=1, origin="start_base_offset", only_oversized=False, keep=["chro_name"])
    size = F.col("piece_stop") - F.col("piece_start") + 1
    return pieces.groupBy("chro_name").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum(size).alias("letters"), F.max(size).alias("longest"))


def p4_topic_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of over 150 words in pieces of at most 150 that overlap by 15,
    cut where the words change most."""
    return split_by_topic(table(spark, sf_dir, "documents"), "doc_id", "text", 150, 15)


# 5: near-duplicates


def _near(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    return NearDuplicates(table(spark, sf_dir, "long_reads"), "read_id", {"read_text": True, "qual_text": False})


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).pairs()


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).groups()


# 6: shared spans


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(table(spark, sf_dir, "long_reads"), "read_id", "read_text", 50)


def p6_read_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every read with a text: how many letters of it stand elsewhere too."""
    reads = table(spark, sf_dir, "long_reads").filter("read_text is not null").select("read_id", F.length("read_text").cast("long").alias("letters"))
    spans = p6_found(spark, sf_dir).groupBy("read_id").agg(F.sum(F.col("span_stop") - F.col("span_start") + 1).alias("n"), F.count(F.lit(1)).alias("k"))
    return reads.join(spans, "read_id", "left").select("read_id", "letters", F.coalesce("k", F.lit(0)).alias("n_spans"), F.coalesce("n", F.lit(0)).alias("shared"))


# 7: packing


def _packed(spark: SparkSession, sf_dir: str, capacity: int) -> DataFrame:
    counts = materialize(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return pack(counts, capacity).withColumnRenamed("id", "doc_id")


def p7_pack_2048(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir, 2048)


def p7_pack_512(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir, 512)


def p7_pack_8192(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir, 8192)


def p7_letters_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a packing by letters must hold to, document by document: all its
    letters placed, in as many pieces as needed, in no overfull container."""
    docs = table(spark, sf_dir, "documents")
    placed = materialize(pack(docs.select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n")), 4096))
    full = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("fill"))
    over = placed.join(full.filter("fill > 4096"), "container_id", "left_semi").select("id").distinct().withColumn("over", F.lit(True))
    return placed.groupBy(F.col("id").alias("doc_id")).agg(F.sum("n_tokens").alias("letters"), F.count(F.lit(1)).alias("pieces")).join(over.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("fits", F.col("over").isNull()).drop("over")


# 8: leaks


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the documents. These are read in pieces of a few megabytes:
    a vectored read holds a whole row group's texts twice, as one array each."""
    docs = spark.read.option("parquet.hadoop.vectored.io.enabled", "false").parquet(f"{sf_dir}/documents.parquet")
    return corpus_index(docs, "doc_id", "text")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(_corpus(spark, sf_dir), table(spark, sf_dir, "eval_items"), "item_id", "passage")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per test item: in how many documents it leaked, and how much at most."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("share").alias("greatest_share"))


def p8_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold some eight words of a passage letter by letter, by
    the number of the phrase in the passage."""
    words = F.filter(F.split("passage", r"\s+"), lambda w: w != "")
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.size("w") / 8).cast("int") - 1), lambda n: F.struct((n + 1).alias("no"), F.array_join(F.slice("w", n * 8 + 1, F.lit(8)), " ").alias("p")))
    items = table(spark, sf_dir, "eval_items").select("item_id", words.alias("w")).filter("size(w) >= 8").select("item_id", F.explode(cut).alias("x"))
    rows = items.select(F.concat_ws("/", "item_id", "x.no").alias("phrase_id"), "x.p")
    found = exact_phrases(_corpus(spark, sf_dir), rows, "phrase_id", "p")
    part = F.split("phrase_id", "/")
    return found.select("doc_id", part[0].cast("long").alias("item_id"), part[1].cast("int").alias("phrase_no"))


# 9: cut-off texts


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir).select("doc_id")


def p9_source_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each source's documents that were cut."""
    cut = _cut(spark, sf_dir).groupBy("source").agg(F.count_if(F.col("reason") == "limit").alias("n_limit"), F.count_if(F.col("reason") != "limit").alias("n_broken"))
    docs = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("n_docs"))
    zero = F.lit(0)
    return docs.join(cut, F.col("s").eqNullSafe(F.col("source")), "left").select(
        F.col("s").alias("source"), "n_docs", F.coalesce("n_limit", zero).alias("n_limit"), F.coalesce("n_broken", zero).alias("n_broken"), ((F.coalesce("n_limit", zero) + F.coalesce("n_broken", zero)) / F.col("n_docs")).alias("share_cut")
    )


def queries() -> dict:
    own = (
        p2_length_percentiles, p2_run_from_days, p2_long_read_percentiles, p2_coarse_within_bound, p2_score_percentiles, p4_found, p4_piece_sizes, p4_topic_pieces, p5_found, p5_groups,
        p6_found, p6_read_share, p7_pack_2048, p7_pack_512, p7_pack_8192, p7_letters_placed, p8_found, p8_items, p8_phrases, p9_found, p9_source_share,
    )
    return {f.__name__: f for f in own}


_RANKED = """
with x as ({rows}),
r as (select *, row_number() over (partition by dim, key order by v) i, count(*) over (partition by dim, key) n from x)
select dim, key, n, {picks}, 0::bigint rank_error from r group by dim, key, n"""

_PIECES = """
with recursive b as (select block_id, chro_name, start_base_offset o, base_values t, length(base_values) size from index_blocks where {which}),
p as (
  select block_id, 1::bigint piece_no, 0::bigint s, {cut0} e from b
  union all
  select p.block_id, piece_no + 1, e - 100, case when size - (e - 100) <= 4000 then size else (e - 100) + coalesce(nullif(length(regexp_extract(substr(t, (e - 100) + 1, 4001), '(?s)^(.{{100,}}[Nn])[^Nn]', 1)), 0), 4000) end
  from p join b using (block_id) where e < size
)
"""
_CUT0 = "case when size <= 4000 then size else coalesce(nullif(length(regexp_extract(substr(t, 1, 4001), '(?s)^(.{100,}[Nn])[^Nn]', 1)), 0), 4000) end"


_NEAR = """
with f as (select 'read_text' field, read_id, upper(read_text) t from long_reads where length(read_text) >= 12 union all select 'qual_text', read_id, qual_text from long_reads where length(qual_text) >= 12),
w as (select distinct field, read_id, substr(t, i, 12) w from (select *, unnest(range(1, length(t) - 10)) i from f)),
n as (select field, read_id, count(*) n from w group by all),
c as (select a.field, a.read_id a, b.read_id b, count(*) c from w a join w b on a.field = b.field and a.w = b.w and a.read_id < b.read_id group by all)
select c.field, a read_id_a, b read_id_b from c join n x on x.field = c.field and x.read_id = a join n y on y.field = c.field and y.read_id = b where c.c >= 0.6 * (x.n + y.n - c.c)"""

_SPANS = """
with w as (select read_id, i, substr(read_text, i, 50) w from (select read_id, read_text, unnest(range(1, length(read_text) - 48)) i from long_reads where length(read_text) >= 50)),
s as (select w from w group by w having min(read_id) <> max(read_id)),
h as (select read_id, i, i - 50 > coalesce(lag(i) over (partition by read_id order by i), -1000) fresh from w join s using (w)),
g as (select read_id, i, sum(fresh::int) over (partition by read_id order by i rows unbounded preceding) g from h),
p as (select read_id, min(i) span_start, max(i) + 49 span_stop from g group by read_id, g)
"""


def _ranked(rows: str) -> str:
    picks = ", ".join(f"max(case when i = greatest(1, ({p} * n + 999) // 1000) then v end) p{p:03d}" for p in qdigest.PERMILLE)
    return _RANKED.format(rows=rows, picks=picks)


def oracle_sql() -> dict[str, str]:
    """Digests are exact while a group has fewer than ``cap`` values, so plain
    ranks are the same at the size the comparison is made at."""
    lengths = "read_log where read_length >= 1"
    return {
        "p2_length_percentiles": _ranked(
            f"select 'run_id' dim, run_id \"key\", read_length v from {lengths} union all select 'sample_id', sample_id, read_length from {lengths} union all select 'day', cast(cast(logged_at as date) as varchar), read_length from {lengths}"
        ),
        "p2_run_from_days": _ranked(f"select 'run_id' dim, run_id \"key\", read_length v from {lengths}"),
        "p2_long_read_percentiles": _ranked(
            "select 'run_id' dim, run_id \"key\", read_length::bigint v from long_reads where read_length >= 1 union all select 'sample_id', sample_id, read_length from long_reads where read_length >= 1"
        ),
        "p2_coarse_within_bound": f"with r as (select run_id, count(*) n from {lengths} group by run_id) select run_id, n, p::int permille, true near_enough, true bound_is_small from r, (select unnest({list(qdigest.PERMILLE)}) p)",
        "p2_score_percentiles": _ranked("select 'run_id' dim, run_id \"key\", (unicode(substr(qual_text, i, 1)) - 33)::bigint v from (select run_id, qual_text, unnest(range(1, length(qual_text) + 1)) i from long_reads where qual_text is not null)"),
        "p4_found": _PIECES.format(which="length(base_values) > 4000", cut0=_CUT0) + "select block_id, piece_no, o + s piece_start, o + e - 1 piece_stop from p join b using (block_id)",
        "p4_piece_sizes": _PIECES.format(which="length(base_values) > 0", cut0=_CUT0) + "select chro_name, count(*) n_pieces, cast(sum(e - s) as bigint) letters, max(e - s) longest from p join b using (block_id) group by chro_name",
        "p5_found": _NEAR,
        "p5_groups": f"""with recursive p as ({_NEAR}),
t as (select 'read_text' field, read_id, upper(read_text) t from long_reads where length(read_text) >= 12 union all select 'qual_text', read_id, qual_text from long_reads where length(qual_text) >= 12),
m as (select field, read_id, min(read_id) over (partition by field, t) class_id from t),
l as (select distinct p.field, x.class_id a, y.class_id b from p join m x on x.field = p.field and x.read_id = read_id_a join m y on y.field = p.field and y.read_id = read_id_b where x.class_id <> y.class_id),
u as (select field, a, b from l union select field, b, a from l),
r as (select distinct field, class_id x, class_id g from m union select r.field, r.x, u.b from r join u on u.field = r.field and u.a = r.g),
k as (select field, x, min(g) g from r group by all), n as (select field, a, count(*) n from u group by all)
select m.field, m.read_id, m.class_id, coalesce(n.n, 0) n_links, k.g group_id from m join k on k.field = m.field and k.x = m.class_id left join n on n.field = m.field and n.a = m.class_id""",
        "p7_letters_placed": 'select doc_id, length("text") letters, (length("text") + 4095) // 4096 pieces, true fits from documents where length("text") > 0',
        "p8_phrases": """
with d as (select doc_id, regexp_replace(lower(strip_accents("text")), '[^\\p{L}]', '', 'g') t from documents where "text" is not null),
w as (select item_id, list_filter(regexp_split_to_array(passage, '\\s+'), lambda x: x <> '') w from eval_items where passage is not null),
q as (select item_id, n::int phrase_no, regexp_replace(lower(strip_accents(array_to_string(w[8 * n - 7 : 8 * n], ' '))), '[^\\p{L}]', '', 'g') p from (select *, unnest(range(1, len(w) // 8 + 1)) n from w))
select doc_id, item_id, phrase_no from d join q on p <> '' and contains(t, p)""",
        "p6_found": _SPANS + "select * from p",
        "p6_read_share": _SPANS + """
select r.read_id, length(read_text) letters, count(p.read_id) n_spans, cast(coalesce(sum(span_stop - span_start + 1), 0) as bigint) shared
from long_reads r left join p using (read_id) where read_text is not null group by r.read_id, read_text""",
    }
