"""Documents to training data in five stages, each an operator of outflow.llm.

Every stage takes the documents its predecessor kept, and all but the last return the columns of documents (doc_id,
text, lang, source, n_chars). n_chars follows the text.

Defined cases, in every stage: empty tables give empty results; a null text counts as an empty one; rows with a null id or with an id that
other rows share are rows of their own; ties go to the smaller id, then to a hash or the number of the row; columns of documents beyond the
five are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outflow.llm.catalog import ready, table
from outflow.llm.cotraining import classify
from outflow.llm.mixing import WORD, mix
from outflow.llm.ngram_join import link_classes
from outflow.llm.pieces import encode
from outflow.llm.substring_dedup import remove_repeats
from outflow.session import durable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return classify(docs, table(spark, sf_dir, "labels")).where("keep").select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by five-word shingles at a similarity of 0.8 the one with the smallest id stays, one without an id only if none has one.

    Rows are told apart by a hash of all their columns, so that nothing is written down to number them; null and repeated ids are linked like
    any other. Of rows that share the smallest id one stays, of equal rows one; rows without words are linked with nothing and all stay.
    The documents are read several times and must be the same each time, as rows of a table are.
    """
    ready(spark)
    # A hash skips nulls, so it is told where they are.
    docs = docs.select(*COLUMNS, F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS]).alias("uid"))
    linked = link_classes(docs, doc_id="uid", width=5, percent=80).withColumnRenamed("doc_id", "uid")
    # Equal rows are in one class, unless they have no words.
    linked = linked.groupBy("uid").agg(F.max("n_shingles").alias("n"), F.min("component_id").alias("component_id"), F.count("*").alias("copies"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "uid", ((F.col("n") > 0) & (F.col("copies") > 1)).alias("thin")))
    stays = linked.join(docs.select("uid", "doc_id").distinct(), "uid").groupBy("component_id").agg(first.alias("f")).select("f.uid", "f.thin")
    kept = docs.join(stays, "uid")
    # One of equal rows, which are few: the rest is not shuffled for it.
    thinned = kept.where("thin").dropDuplicates(["uid"])
    return kept.where("NOT thin").unionByName(thinned).select(COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of words that occur earlier are cut out; a document of which nothing is left goes."""
    ready(spark)
    cut = remove_repeats(docs, carry=("lang", "source"), verbatim=True).where("n_removed = 0 OR n_removed < n_words")
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("bigint").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each whole copy of a document, and one of the words picked beyond."""
    ready(spark)
    # Ids may be null or repeated; the plan belongs to rows.
    docs = durable(docs.withColumn("uid", F.monotonically_increasing_id()))
    joined = docs.join(mix(docs, row="uid").where("taken > 0").select("uid", "passes", "ranges"), "uid")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    picked = F.array_join(F.flatten(F.transform("ranges", lambda r: F.slice(words, (r["from"] + 1).cast("int"), (r["to"] - r["from"]).cast("int")))), " ")
    part = F.when(F.size("ranges") > 0, F.array(picked)).otherwise(F.array().cast("array<string>"))
    copies = F.concat(F.array_repeat("text", F.col("passes").cast("int")), part)
    rows = joined.select("doc_id", F.explode(copies).alias("text"), "lang", "source")
    return rows.withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and whether decoding them gives the text back (a null text is read as an empty one)."""
    ready(spark)
    coded = encode(docs, decoded="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select(*COLUMNS, "ids", F.size("ids").cast("bigint").alias("n_ids"), same.alias("round_trip"))


STAGES = [
    ("quality classifier", quality), ("n-gram Jaccard join", near_copies), ("substring dedup", repeats),
    ("mixing sources to target weights", mixture), ("SentencePiece encoding", pieces),
]

# The classifier, the seeded choices and the piece ids cannot be stated in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        if stage is near_copies:
            # Not the classifier's fit anew for each reading.
            docs = durable(docs)
        docs = stage(spark, docs, sf_dir)
    return docs
