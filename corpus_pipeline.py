"""The corpus pipeline: toxicity, language ID, MinHash near-dedup, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All but the last return
the columns of `documents`. Models are fitted on the stage's own input.

Defined cases: those of the operators; a null text passes toxicity, is rejected by language ID (`und`), and so goes no further;
repeated rows are copies to near-dedup, which keeps a row of the smallest id; rows that share an id but not their text are documents of
their own there, and rows without an id stay; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.llm import langid, minhash, mixing, pieces, toxicity
from tarnfold.llm.common import Scratch, owned, table
from tarnfold.llm.queries import model_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=COLUMNS).where(F.col("score") < threshold).select(*COLUMNS)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Documents without letters, or where no language has the given share of the letters, go."""
    model = langid.fit(docs)
    out = langid.identify(docs, model, keep=COLUMNS)
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id."""
    scratch = Scratch(spark, "pipeline")
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        return one_row_of_each(docs, scratch)
    gone = minhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    gone = scratch.save(gone, "gone")
    few = gone.count() <= minhash.MOST_BROADCAST
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col("_gone"), "left_anti").select(*COLUMNS)


def one_row_of_each(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The same where ids repeat: rows are compared by a key of their own. Blank texts link with nothing, so they are copies only under one id."""
    rows = scratch.save(docs.where("doc_id is not null").select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), "rows")
    ids = rows.select("_row", F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    found = minhash.near_duplicates(rows, doc_id="_row").join(ids, F.col("doc_id") == F.col("_row"))
    blank = F.col("n_shingles") == 0
    groups = found.groupBy(F.when(~blank, F.col("component_id")).alias("a"), F.when(blank, F.col("_id")).alias("b"), F.when(blank, F.col("_hash")).alias("c"))
    first = scratch.save(groups.agg(F.min(F.struct("_id", "_row")).alias("m")).select("m._row"), "first")
    return rows.join(first, "_row", "left_semi").select(*COLUMNS).union(docs.where("doc_id is null").select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str, max_repeats: float = 2.0) -> DataFrame:
    """Documents as often as the sources' target weights ask for, within the corpus's own number of tokens, block after block: what is written
    holds a block's rows together, blocks in order and each in its permuted order. (A stage returns the columns of `documents`, so the block's number isn't one.)
    """
    out, _ = mixing.mix(docs.select(*COLUMNS), max_repeats=max_repeats)
    order = ["mix_block", "mix_key", "doc_id"]
    return out.repartitionByRange(*order).sortWithinPartitions(*order).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, piece ids and their number."""
    return pieces.encode(docs, model_file(), keep=("doc_id", "source")).withColumn("n_pieces", F.coalesce(F.size("ids"), F.lit(0)).cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", known_language),
    ("MinHash near-dedup", one_of_each),
    ("mixing", mix_sources),
    ("SentencePiece", encode_pieces),
]

#: Learned models and hash orders: no SQL. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage came from is deleted once its result is written."""
    scratch = Scratch(spark, "corpus")
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with owned() as made:
            docs = scratch.save(stage(spark, before, sf_dir), name.replace(" ", "-"))
        for used in made:
            used.clear()
        scratch.keep(docs)
        before = docs
    return docs
