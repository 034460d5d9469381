"""From raw documents to token ids, one operator of ``flagloom.llm`` a stage.

Each stage takes what the one before it kept, written as Parquet and read
again; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flagloom.llm import mixing, pieces, quality, simhash, substring
from flagloom.llm.common import read, settle
from flagloom.llm.queries import PIECE_MODEL


def _aside(docs: DataFrame, names: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ``docs``, whose own columns called ``names`` keep out of its way and come back."""
    clash = {c: f"_own_{c}" for c in docs.columns if c in names}
    done = work(docs.withColumnsRenamed(clash))
    return done.select(*(F.col(clash.get(c, c)).alias(c) for c in docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the rated documents among ``docs``; rejected documents go."""
    model = quality.fit(docs, quality.grades_of_labels(read(spark, sf_dir, "labels")))
    return _aside(docs, ("expected_grade", "tail_prob", "accepted"), lambda d: quality.grade(d, model).where("accepted"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates (3-word shingles, 3 bits) the smallest doc_id stays."""
    return simhash.keep_one(docs, shingle=3, max_bits=3)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has are cut out of the later ones."""
    cut = substring.cut_repeats(docs, window=50)
    return cut.withColumn("n_chars", F.length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once for each pass of its source's blocks; none is dropped."""
    return _aside(docs, ("mix_pass", "mix_order", "mix_weight"), mixing.mix_sources)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row."""
    return pieces.encode(docs, pieces.load_model(PIECE_MODEL))


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", simhash_stage),
    ("substring dedup", substring_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]

#: SQL cannot state the fitted classifier, XXH64 fingerprints or piece merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; the last one's rows."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
