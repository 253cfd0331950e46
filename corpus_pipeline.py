"""A training-data pipeline of five operators; each stage's table is the next one's ``docs``.

Every stage takes any extra columns along, whatever their names. Null and repeated ids, null and empty texts, repeated
rows and empty tables have a defined result, which each stage's docstring states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridgeline.llm import language, mixing, pieces, pii, simhash
from ridgeline.llm.common import Stored, documents
from ridgeline.llm.queries import tokenizer

#: Documents whose language is less sure are rejected, as are those without a letter.
LEAST_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognised language; learns from the languages that ``docs`` states.

    Null and empty texts and texts without a letter go; a null language or id is no reason to go. Repeated rows are
    judged alike. Where no row states a language, none can be recognised and all go."""
    model = language.fit(docs, where=~language.held_out(docs["doc_id"]))
    return language.recognised(docs, model, LEAST_SCORE)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, one of its smallest id; a group of null ids keeps one too.

    Rows count, not ids: unrelated texts of one id, or of none, all stay. Null and empty texts are near-duplicates of
    one another, as their fingerprints are equal; wholly equal rows keep one."""
    return simhash.distinct(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms in the text and counts its characters anew; all rows stay, null texts as
    null. Only the text is read, so ids may be null or repeat. Without a key in ``spark.ridgeline.pii.key`` one is derived from
    the corpus, so that repeated runs give equal texts, and the mix, which draws by row hashes, equal rows."""
    key = pii.session_key(spark) if spark.conf.get("spark.ridgeline.pii.key", None) else pii.corpus_key(docs)
    return pii.replaced(docs, key, length_col="n_chars")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of sources takes it. Null is a source; rows without words are taken by no mix, and
    go. Each row of a null or repeated id, and each of equal rows, has its own due."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of every row; null texts count as empty."""
    return pieces.encode_digest(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("language ID", known_language),
    ("SimHash near-dedup", distinct_documents),
    ("PII", without_personal_data),
    ("mixing", mixed),
    ("SentencePiece", encoded),
]

#: Language models, hashes and tokenizers can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each table is written to the shared folder and read again, and deleted once the
    next one is written."""
    store, docs, before = Stored(spark, "pipeline"), documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        docs, path = store.put(stage(spark, docs, sf_dir))
        if before:
            store.drop(before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
