"""A corpus made ready for training: five stages, each written as Parquet and read again by the next."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from embgauge.llm import decontaminate, line_dedup, ngram_join, piece_bpe, queries, toxicity
from embgauge.llm.shared import free_name, stored


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic; it is fitted on the labelled ones.

    Each row is judged by its own text; null and empty texts stay, an empty table stays empty.
    """
    model = toxicity.train(docs, queries.category_labels(spark, sf_dir), list(queries.CATEGORIES))
    return toxicity.reject(docs, model, "toxic")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier one; a document that loses all its text goes.

    Null and blank texts and rows without an id stay as they are; rows that share an id keep the same lines.
    ``n_chars`` follows the text where lines went. Columns with names of the operator's own stay.
    """
    left = line_dedup.dedup_lines(docs)
    removed = F.col(left.columns[-1])
    emptied = (removed > 0) & (F.trim(F.col("text"), F.lit(line_dedup.BLANKS)) == "")
    left = left.where(~F.coalesce(emptied, F.lit(False)))
    count = F.when(removed > 0, F.length("text")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", count.cast("long")).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each class of near-duplicate documents: five-word shingles, similarity 0.8 or more.

    Rows that share an id are one document: one of them stays, also if their texts differ (the one of the smallest
    hash, then text). Null and empty texts are in no class; rows without an id stay as they are.
    """
    classes = ngram_join.jaccard_components(docs, n=5, num=80, den=100)
    gone = classes.where("id <> component_id").select("id").distinct()
    left = docs.join(gone, docs["doc_id"] == gone["id"], "left_anti")
    # rows without an id stay as they are, and out of the window, where they would be one group
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    at = free_name(docs.columns, "nth")
    named = left.where("doc_id is not null").withColumn(at, nth).where(F.col(at) == 1).drop(at)
    return named.unionByName(left.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item. Null and empty texts hold none; each row is judged alone."""
    return decontaminate.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token ids, with a digest of what they decode to. A null text is an empty one: the end id alone."""
    found = piece_bpe.round_trip(docs, queries.model_path(), columns=("ids", "n_tokens", "decoded_sha256"))
    return found.withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

#: Trained models and near-duplicate classes of several stages are not one SQL statement; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
