"""The corpus pipeline: five stages over documents, each applying one operator of gridloom.llm to all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one the packed pieces:

* quality: documents that the classifier rejects go;
* lines: of each group of like lines one occurrence stays; a document whose words are all gone goes, ``n_chars`` follows the text;
* near_duplicates: of each group of near-duplicate documents the one with the smallest id stays (empty ones stay);
* decontaminate: documents that hold a benchmark window go;
* pack: the texts that are left, as token sequences of 2048.

Rows with a null id can't be judged and go in the first stage; a null text is an empty one.
"""

import uuid

from pyspark.sql import functions as F

from gridloom.llm.cluster import remove, shared_dir
from gridloom.llm.decontaminate import drop_contaminated
from gridloom.llm.jaccard_join import keep_one
from gridloom.llm.line_dedup import dedup_lines, free_name
from gridloom.llm.packing import pack, public_tokenizer
from gridloom.llm.quality import keep_good


def quality(spark, docs, sf_dir):
    return keep_good(docs.where("doc_id IS NOT NULL"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark, docs, sf_dir):
    counts = tuple(free_name(docs.columns, c) for c in ("_n_lines", "_n_removed"))
    kept = dedup_lines(docs, counts=counts).where((F.col(counts[1]) == 0) | F.col("text").rlike("[0-9A-Za-z\u0080-\U0010ffff]"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_duplicates(spark, docs, sf_dir):
    return keep_one(docs)


def decontaminate(spark, docs, sf_dir):
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark, docs, sf_dir):
    return pack(docs, public_tokenizer)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pack", packing)]

#: The classifier and the approximate candidates of the line stage can't be said in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows, read from the shared folder; each other stage's documents go as soon as the next one is written."""
    docs, folder, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{i}-{name}"
    return docs
