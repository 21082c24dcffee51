"""From raw documents to token ids in five stages; each calls one operator of ``tidewheel.llm``.

Every stage takes (spark, docs, sf_dir). All but the last return the columns they were given, extra
ones included. Empty tables pass through. What nulls do is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import jaccard, mixing, quality, repeats, sentencepieces
from tidewheel.llm.scratch import Scratch, read_table, small_side
from tidewheel.llm.textblocks import WORD

#: Documents with a lower quality score are rejected.
LEAST_QUALITY = 0.5
#: Segments of a generation of the encoder's cache, and characters of its blocks: here workers share an executor with a JVM that earlier stages have filled.
CACHE, BLOCK_CHARS = 40_000, 1 << 18


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row as one struct, so that no name can clash with an operator's."""
    return docs.select(docs["doc_id"], docs["text"].cast("string").alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))


def _row(docs: DataFrame, **new) -> list:
    """The columns of the packed rows, some of them replaced."""
    return [new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that the classifier, learned from ``labels``, scores under LEAST_QUALITY. A null text scores as empty."""
    weights = quality.train(docs, read_table(spark, sf_dir, "labels"))
    told = quality.scorer(spark, weights)(F.col("text"))
    return _packed(docs).withColumn("_score", told).filter(F.col("_score") >= LEAST_QUALITY).select(*_row(docs))


def keep_one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join (Jaccard 0.8 on five-word shingles) the one with the smallest id stays.

    Of rows equal in id and text one stays. Rows without an id stay, as no id can name them;
    empty texts link with nothing and stay.
    """
    found = jaccard.jaccard_components(docs, n=5, num=80, den=100, with_text_hash=True)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct()
    gone = Scratch(spark, "alike").save(gone, "gone")
    # rows may share an id and differ in text: only the text that has a like one goes
    kept = docs.join(small_side(gone, 24), (docs["doc_id"] == F.col("_gone")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_hash")), "left_anti")
    twice = docs.groupBy("doc_id", F.xxhash64("text")).count().filter(F.col("count") > 1)
    return kept.dropDuplicates(["doc_id", "text"]) if twice.head(1) else kept


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts 13-word windows that a document with a smaller id has too; documents without any keep their text as it is.

    A document of nothing else stays, with an empty text. n_chars follows the text.
    """
    told = repeats.substring_dedup(_packed(docs), keep=("_row",))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("_row")["text"])
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast(dict(docs.dtypes).get("n_chars", "bigint")))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = n_chars.otherwise(F.col("_row")["n_chars"])
    return told.select(*_row(docs, **new))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; where it takes a part, the last copy has only so many words.

    Documents of which nothing is taken go, among them those without words. Rows equal in id, source
    and size share what they take evenly, rounded down: a source then takes a word less for each such row at most.
    """
    taken = mixing.mix(docs.select("doc_id", "text", "source"))
    taken = taken.groupBy("doc_id", "source", "size").agg(F.floor(F.sum("taken") / F.count("*")).alias("taken")).filter(F.col("taken") > 0)
    taken = Scratch(spark, "taken").save(taken.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_n"), "taken"), "taken")
    own = F.col("_row")
    rows = _packed(docs).select("_row").withColumn("_size", mixing.n_words(own["text"]))
    rows = rows.join(small_side(taken, 48, F.octet_length("_s")), own["doc_id"].eqNullSafe(F.col("_d")) & own["source"].eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_n")))
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("_size")))))
    left = F.col("taken") - (F.col("_copy") - 1) * F.col("_size")
    part = F.array_join(F.slice(F.regexp_extract_all(own["text"], F.lit(f"({WORD})")), F.lit(1), left.cast("int")), " ")
    text = F.when(left < F.col("_size"), part).otherwise(own["text"])
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(left < F.col("_size"), F.length(part).cast(dict(docs.dtypes)["n_chars"])).otherwise(own["n_chars"])
    return rows.select(*_row(docs, **new))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each copy; a null text has no ids."""
    return sentencepieces.encode_documents(docs, with_ids=True, cache=CACHE, block_chars=BLOCK_CHARS)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_alike),
    ("repeated_passages", cut_repeats),
    ("source_mix", mix_sources),
    ("token_ids", encode),
]
#: The classifier and the encoding are beyond SQL: tests hold each stage's rows, and run()'s, against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
