"""Four stages over ``documents``: toxic documents go, one document of each near-duplicate group stays, the sources are mixed
to their target weights, and the mix is packed into sequences.

Each stage takes what the one before it kept. Labels are read for the toxicity classifier alone, beside the tables that a
stage is given. Null ids and texts, repeated rows and empty tables are treated as the operators define them; the near-duplicate
stage decides for each row, also where several rows have one id or none, and keeps a row with a null id only where its component has
no id at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from folioscope.llm import jaccard_join, mixing, packing, toxicity
from folioscope.llm.common import discard, scratch, written
from folioscope.llm.wavelet import tokenizer_file

#: Near duplicates of the stage: words of a shingle, and least similarity in per cent.
SHINGLE, PERCENT = 5, 80


def by_number(docs: DataFrame) -> tuple[DataFrame, list]:
    """``docs`` with columns other than doc_id and text named by number, so that none meets a name that a stage uses itself; and the
    expressions that give the old names back."""
    names = {c: c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(docs.columns)}
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return docs.select([quoted(c).alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    docs, names = by_number(docs)
    return toxicity.score(docs, model, docs.columns).filter("predicted = 0").select(*names)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: of the smallest id, and of several texts with that id the one of the smallest set. An empty text is
    a component by itself; of several with the same id one stays, and all without id."""
    docs, names = by_number(docs)
    with scratch() as made:
        linked = written(jaccard_join.link(docs, SHINGLE, PERCENT, counted=True)[0].select("doc_id", "n_shingles", "set", "label"), "pipeline-linked")
        made.pop()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "set")).alias("f")
    firsts = linked.filter("n_shingles > 0").groupBy("label").agg(least).select("f.doc_id", "f.set")
    empty = linked.filter("n_shingles = 0 and doc_id is not null").select("doc_id", "set").distinct()
    shared = written(linked.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_id")), "pipeline-shared-ids")
    kept = firsts.union(empty).select(F.col("doc_id").alias("_id"), F.col("set").alias("_set"))
    kept = written(kept.join(shared.withColumn("_many", F.lit(True)), "_id", "left").select("_id", "_set", (F.col("_id").isNull() | F.col("_many").isNotNull()).alias("_many")), "pipeline-kept")
    discard(linked)
    single = docs.join(kept.filter("not _many").select("_id"), F.col("doc_id") == F.col("_id"), "left_semi")

    def with_set(stream):
        with np.errstate(over="ignore"):
            for batch in stream:
                sets = [jaccard_join.shingles(t.as_py(), SHINGLE) for t in batch.column("text")]
                batch = batch.append_column("_s", pa.array([jaccard_join.fingerprint(x) for x in sets], pa.int64()))
                yield batch.append_column("_n", pa.array([len(x) for x in sets], pa.int64()))

    # rows without an id of their own are told apart by their sets
    several = docs.join(shared, F.col("doc_id") == F.col("_id"), "left_semi").unionByName(docs.filter("doc_id is null"))
    several = several.mapInArrow(with_set, StructType([*docs.schema.fields, StructField("_s", LongType()), StructField("_n", LongType())]))
    order = Window.partitionBy("doc_id", "_s").orderBy(F.xxhash64("text"), *[c for c in docs.columns if c not in ("doc_id", "text")])
    once = several.filter("_n > 0 or doc_id is not null").withColumn("_r", F.row_number().over(order)).filter("_r = 1")
    once = once.join(kept.filter("_many").select("_id", "_set"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_s") == F.col("_set")), "left_semi")
    nameless = docs.filter("doc_id is null").filter(F.coalesce(F.regexp_replace("text", r"[\x20\x09-\x0D]+", ""), F.lit("")) == "")
    return single.select(*docs.columns).unionByName(once.select(*docs.columns)).unionByName(nameless).select(*names)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often, and at last as far, as the mix takes it."""
    return mixing.materialised(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    return packing.digest(packing.pack(docs, tokenizer_file("word_bpe_49k.json")))


STAGES = [("toxicity", toxic_out), ("near_duplicates", near_duplicates_out), ("mixing", mixed), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            made.pop()
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
