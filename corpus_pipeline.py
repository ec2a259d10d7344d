"""From raw documents to token ids: quality, near copies, secrets, mixture, tokens.

Every stage takes what the one before kept, by the operators of ``ledgerloom.llm`` with
their production parameters. All but the last return the columns of ``documents``;
``n_chars`` follows the text where a stage changes it. Null texts, empty tables, repeated
rows and further columns are treated as the operators say.
"""

import public_tokenizers
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, mixing, quality, secrets, simhash
from ledgerloom.llm.places import numbered
from ledgerloom.operators.scale import materialise


def _counted(docs):
    """``n_chars`` anew, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def good_quality(spark, docs, sf_dir):
    """Documents that the trees, fitted on the labels of ``sf_dir``, score 0.5 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    trees = quality.train(docs, labels)
    # The whole row goes along as one column, so the score meets no name of its own.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    return quality.scored(rows, trees, name="_score").filter("_score >= 0.5").select("_row.*")


def without_copies(spark, docs, sf_dir):
    """One document of each group whose five-word shingles are similar by 0.8 or more."""
    return simhash.deduplicate_similar(docs)


def without_secrets(spark, docs, sf_dir):
    """All documents; spans of secrets are replaced."""
    return _counted(secrets.redact(docs)).select(*docs.columns)


def mixed(spark, docs, sf_dir):
    """Documents as often as the mixture takes them, in training order."""
    return _counted(mixing.mixture(docs)).select(*docs.columns)


def tokens(spark, docs, sf_dir):
    """``place`` in the mixture, ``doc_id``, ``n_tokens`` and ``ids`` of each of its documents.

    The ids are decoded again; bytes that differ from those of the text are an error.
    """
    def print_(column):
        return F.xxhash64(F.coalesce(column, F.lit("")).cast("binary"))

    # The mixture was written in training order, so a row's place is its number in the files.
    rows, _ = numbered(docs)
    text = F.col("_all")["text"]
    marked = rows.select(F.struct(F.col("_number").alias("place"), F.col("_all")["doc_id"].alias("doc_id"),
                                  print_(text).alias("print")).alias("_row"), text.alias("text"))
    coded = bpe.encode(marked, public_tokenizers.path("byte_bpe_50k.tiktoken"), key="_row", decode=True)
    ids = F.when(F.xxhash64("decoded") == F.col("_row.print"), F.col("ids")).otherwise(
        F.raise_error(F.lit("decoded ids differ from the text")).cast("binary"))
    return coded.select("_row.place", "_row.doc_id", "n_tokens", ids.alias("ids"))


STAGES = [
    ("quality classifier", good_quality),
    ("simhash near-dedup", without_copies),
    ("secret scan", without_secrets),
    ("source mixture", mixed),
    ("byte-level bpe", tokens),
]
# The classifier, fingerprints and merges are beyond SQL; a test follows all stages by hand.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Rows of the last stage over the documents of ``sf_dir``."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        rows = materialise(stage(spark, rows, sf_dir), name.replace(" ", "_"))
    return rows
