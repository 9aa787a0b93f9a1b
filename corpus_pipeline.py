"""A corpus cleaned in stages, each written as Parquet and read again as the next one's documents.

Low quality goes, repeated lines go, one document of each group of near-duplicates (linked by SimHash fingerprints of three-word
shingles that differ in at most three bits) stays, documents that hold benchmark items go, and what is left is encoded. All stages but the last return the columns they were given; a stage that
changes a text sets ``n_chars`` to its length. Columns that bear the name of an operator's output keep their own
values. A document whose lines all go stays, with an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsframe.llm import decontaminate, line_runs, pieces, quality, simhash_bytes
from obsframe.llm.registry import table
from obsframe.session import scratch_path

def _packed(docs: DataFrame) -> DataFrame:
    """Id and text, and all other columns out of the way of the operators' names."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(1).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("row"))


def _unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"row.`{c}`") for c in columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = quality.classify_quality(_packed(docs), table(spark, sf_dir, "labels"))
    return _unpacked(scored.where("predicted = 1"), docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_runs.dedup_lines(_packed(docs))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        left = left.withColumn("row", F.col("row").withField("n_chars", F.when(F.col("n_dropped") > 0, length).otherwise(F.col("row.n_chars"))))
    return _unpacked(left, docs.columns)


def keep_first_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each component: the smallest id's (null last), of its texts the one with the smallest hash, of equal rows one."""
    linked = simhash_bytes.link_near_duplicates(docs, shingle=3, max_bits=3, carried=[F.xxhash64("text").alias("version")])
    path = scratch_path(spark, "linked")
    linked.select("id", "version", "root").write.parquet(path)
    keys = spark.read.parquet(path).groupBy("id", "version").agg(F.first("root").alias("root"), F.count(F.lit(1)).alias("rows"))
    key = F.struct(F.col("id").isNull().alias("unknown"), "id", "version")
    firsts = keys.groupBy("root").agg(F.min(key).alias("first"))
    marked = keys.join(firsts, "root").select("id", "version", "rows", key.eqNullSafe(F.col("first")).alias("stays"))
    path = scratch_path(spark, "marked")
    marked.where("not stays or rows > 1").write.parquet(path)
    marked = spark.read.parquet(path)

    def own(rows: DataFrame) -> Column:
        return docs["doc_id"].eqNullSafe(rows["id"]) & (F.xxhash64(docs["text"]) == rows["version"])

    alone = docs.join(marked, own(marked), "left_anti")
    repeated = marked.where("stays")
    repeated = docs.join(repeated, own(repeated), "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = repeated.groupBy("doc_id", F.xxhash64("text")).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return alone.unionAll(one.select(*[F.col(f"row.`{c}`") for c in docs.columns]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_packed(docs), table(spark, sf_dir, "benchmark"))
    return _unpacked(found.where(F.size("matches") == 0), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(docs.select("doc_id", "text"), drop=["text"])
    return encoded.select("doc_id", "ids", F.size("ids").alias("n_ids"), "parity", "round_trip")


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("simhash", keep_first_near_duplicate),
    ("decontaminate", drop_contaminated),
    ("pieces", encode),
]

# The quality score is a learned model and the fingerprints use a hash that SQL lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
