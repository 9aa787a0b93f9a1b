"""Line dedup over levelled sorted runs of line hashes.

Documents are taken in batches of ascending id. The line keys of a batch are merged with the
sorted runs of all keys seen before (an anti join on the 128-bit hash): a key in a run was held by a
smaller id, so the batch loses it everywhere; a new key stays in the smallest id of the batch that holds it, and
joins the store as a run of level 0. When a level has ``fan_in`` runs they are merged into one run of the level
above, so a batch meets few runs however many came before. Runs hold disjoint keys.

Defined results: a null or empty text is one empty line; a null id neither drops lines nor makes others drop
them; rows with one id are one document for the count of holders, each keeps or loses its own lines; an empty
table gives no rows; extra columns stay, those named as the outputs are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsframe.llm.frames import free_names
from obsframe.session import scratch_path

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h1", "h2"]


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged; ``lower`` is the faster way where all is ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


@dataclass
class RunStore:
    """Disjoint runs of line hashes by level, each a sorted Parquet table in the shared folder."""

    spark: object
    fan_in: int = 2
    levels: list[list[str]] = field(default_factory=list)

    def seen(self) -> DataFrame | None:
        runs = [self.spark.read.parquet(p).where("fresh").select(*HASH) for level in self.levels for p in level]
        out = None
        for run in runs:
            out = run if out is None else out.unionAll(run)
        return out

    def add(self, path: str, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fan_in:
            merged = scratch_path(self.spark, f"run-level{level + 1}")
            runs = self.spark.read.parquet(*self.levels[level]).where("fresh").select(*HASH, "fresh")
            runs.repartitionByRange(*HASH).sortWithinPartitions(*HASH).write.parquet(merged)
            self.levels[level] = []
            self.add(merged, level + 1)


def _ranges(docs: DataFrame, id_col: str, batches: int) -> list[Column]:
    """Conditions that cut the ids into ascending ranges of about equal counts."""
    shares = [i / batches for i in range(1, batches)]
    cuts = sorted({int(c) for c in docs.stat.approxQuantile(id_col, shares, 0.01)}) if shares else []
    i = F.col(id_col)
    lows, highs = [None, *cuts], [*cuts, None]
    return [
        i.isNotNull() & (F.lit(True) if lo is None else i > lo) & (F.lit(True) if hi is None else i <= hi)
        for lo, hi in zip(lows, highs)
    ]


def dedup_lines(
    docs: DataFrame, min_chars: int = 10, batches: int = 4, fan_in: int = 2, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``docs`` with the text that is left, ``n_lines`` (before) and ``n_dropped``."""
    spark = docs.sparkSession
    store = RunStore(spark, fan_in)
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    dropped = None
    conditions = _ranges(source, "id", batches)
    for b, batch in enumerate(conditions):
        lines = (
            source.where(batch)
            .select("id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
            .select("id", "version", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
            .select("id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
        )
        hashed = scratch_path(spark, f"lines-{b}")
        lines.write.parquet(hashed)
        lines = spark.read.parquet(hashed)
        keys = lines.groupBy(*HASH).agg(F.min("id").alias("first"), F.max("id").alias("last"))
        seen = store.seen()
        if seen is None:
            keys = keys.withColumn("fresh", F.lit(True))
        else:
            old = keys.join(seen, HASH, "left_semi").withColumn("fresh", F.lit(False))
            keys = keys.join(seen, HASH, "left_anti").withColumn("fresh", F.lit(True)).unionAll(old)
        run = scratch_path(spark, f"run-{b}")
        keys.sortWithinPartitions(*HASH).write.parquet(run)
        losing = spark.read.parquet(run).where("not fresh or first < last").select(*HASH, "fresh", "first")
        gone = lines.join(losing, HASH).where("not fresh or id > first").select("id", "version", "pos")
        dropped = gone if dropped is None else dropped.unionAll(gone)
        if b + 1 < len(conditions):
            store.add(run)
    own_id, version, gone, own, parts, at = free_names(docs.columns, "_id", "_version", "_gone", "_text", "_parts", "_kept")
    per_doc = dropped.groupBy(F.col("id").alias(own_id), F.col("version").alias(version)).agg(F.collect_set("pos").alias(gone))
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
    left = F.array_join(F.transform(at, lambda i: F.element_at(parts, i + 1)), "\n")
    return (
        docs.withColumn(own, text)
        .join(per_doc, (F.col(id_col) == F.col(own_id)) & (F.xxhash64(own) == F.col(version)), "left")
        .withColumn(parts, F.split(own, "\n")).withColumn(at, kept)
        .withColumns({
            text_col: F.when(F.col(gone).isNull(), F.col(own)).otherwise(left),
            "n_lines": F.size(parts).cast("long"),
            "n_dropped": F.coalesce(F.size(gone), F.lit(0)).cast("long"),
        })
        .drop(own_id, version, gone, own, parts, at)
    )
