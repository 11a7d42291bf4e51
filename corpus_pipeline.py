"""A corpus pipeline of five stages; it belongs to the corpus operators in ``twinsieve.llm``.

Each stage takes what its predecessor kept, as Parquet, and all but the last return
the columns of ``documents``. A stage hands an operator the id and the text under the
names that it knows, and the rest of the row as one column beside them, so further columns
of any names, those of the operators' results included, come through unchanged, and a text
goes to a task once. An
empty table gives an empty one at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.llm import decontaminate, minhash, packing, secrets_crf, toxicity
from twinsieve.llm.shared import settle, table

#: What stands in a text for a secret.
SECRET = "[SECRET]"


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the row without its text, which no operator looks into."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row"))


def _whole(carried: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return carried.select(*[F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go.

    A null or empty text is scored like one without known words. Rows without doc_id and
    repeated rows are scored like others; each goes or stays by its own text.
    """
    rated = toxicity.rate_toxicity(_carried(docs), table(spark, sf_dir, "labels"))
    return _whole(rated.where("predicted = 0"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the document with the least doc_id stays.

    Texts that are null or have no words are linked with nothing and all stay. If a
    doc_id is null or repeated, every row is a document of its own and is compared with
    all others; of those with the same doc_id the least text comes first, and rows
    without doc_id come last.
    """
    named = docs.where("doc_id is not null")
    if docs.where("doc_id is null").isEmpty() and named.groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = minhash.near_duplicates(docs.select("doc_id", "text"), shingle=5, percent=80).where("not kept").select("doc_id")
        return docs.join(settle(gone, "gone"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    # Ids in the order of the rows stand for the doc_ids.
    ordered = _carried(docs).orderBy(F.col("doc_id").asc_nulls_last(), "text")
    rows = settle(ordered.select(F.monotonically_increasing_id().alias("_key"), "text", "_row"), "rows")
    gone = minhash.near_duplicates(rows.select(F.col("_key").alias("doc_id"), "text"), shingle=5, percent=80).where("not kept")
    return _whole(rows.join(settle(gone.select(F.col("doc_id").alias("_key")), "gone"), "_key", "left_anti"), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go.

    Null and empty texts have no windows and stay. Rows without doc_id and repeated
    rows go or stay by their own texts. Without benchmark items all stay.
    """
    found = decontaminate.contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keyed=True)
    bad = settle(found.where("contaminated").select(F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_key")).distinct(), "contaminated")
    same = (F.xxhash64("text") == F.col("_bad_key")) & F.col("doc_id").eqNullSafe(F.col("_bad_id"))
    return _whole(_carried(docs).join(bad, same, "left_anti"), docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; in their texts ``SECRET`` stands for each secret, and n_chars is the new length.

    Null and empty texts stay as they are, and so does all of a row whose text has no
    secret. Overlapping secrets are one.
    """
    found = secrets_crf.find_secrets(_carried(docs), mark=SECRET, replace=True)
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    if "n_chars" not in kinds:
        return _whole(found, docs)
    n = F.when(F.col("spans") != "", F.length("text").cast(kinds["n_chars"])).otherwise(F.col("_row").getField("n_chars"))
    return _whole(found.withColumn("_row", F.col("_row").withField("n_chars", n)), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences: one row per piece of a document.

    A null or empty text is the end id alone; rows without doc_id and repeated rows are
    packed like others; further columns are ignored.
    """
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", hide_secrets),
    ("packing", pack),
]

#: SQL cannot express the classifiers and the tokenizer; a brute-force test stands for it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
