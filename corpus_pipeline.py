"""The corpus pipeline: toxicity, near-duplicates, repeated substrings, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.
Stages are written as Parquet and reread before the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm import near, packing, pii, substring, toxicity
from quern.llm.common import read, shared_folder

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(c).cast(k).alias(c) for c, k in COLUMNS.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject. It is trained on all documents' labels, kept or not.

    Null and empty texts are scored as such, and stay unless the chain rejects them; repeated rows are scored alike; a long
    text is scored whole; an empty table gives no rows; without labels nothing is rejected; columns besides those of
    `documents` are dropped.
    """
    docs = _documents(docs)
    chain = toxicity.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain, carry=tuple(COLUMNS)).where("not rejected").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of least doc_id.

    Null and empty texts are no duplicates. Of repeated rows (one doc_id, one text) and of rows without doc_id all stay; of an
    id with several texts each is judged by itself. A long text is compared whole; an empty table gives no rows; columns
    besides those of `documents` are dropped.
    """
    docs = _documents(docs).withColumn("words_md5", F.unhex(F.md5(near.normal("text"))))
    gone = near.near_duplicates(docs).where("not kept and doc_id is not null").select("doc_id", "words_md5").distinct()
    return docs.join(gone, ["doc_id", "words_md5"], "left_anti").select(*COLUMNS)


#: Bytes of a repeated string. A passage of over fifty words is longer (fifty words of four letters have 250 bytes); lines of
#: boilerplate are shorter. op2 has its contract's 400.
REPEAT_BYTES = 240


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of REPEAT_BYTES bytes that the remaining corpus repeats, narrowed to whole characters.

    Null texts become empty, as empty ones stay; repeated rows that earlier stages left lose what they share; a long text
    is treated like any other; an empty table gives no rows; columns besides those of `documents` are dropped.
    """
    rest = tuple(c for c in COLUMNS if c not in ("doc_id", "text", "n_chars"))
    done = substring.remove_repeats(_documents(docs), least=REPEAT_BYTES, carry=rest)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data, by the session's key (see `pii.session_key`). Collisions are warned of.

    Null texts stay null; repeated rows get the same surrogates; a long text is scanned whole; an empty table gives no rows;
    columns besides those of `documents` are dropped.
    """
    docs, key = _documents(docs), pii.session_key(spark)
    pii.report(docs, key=key)
    done = pii.surrogates(docs, key=key, carry=("doc_id", "lang", "source"))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; ids as in the operator. Null texts are packed as empty ones, repeated rows as often as they
    occur; a long text is cut into windows; an empty table gives no rows; columns besides those of `documents` are ignored.
    """
    return packing.pack(_documents(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_array", drop_repeats),
    ("private_data", replace_private),
    ("packing", pack_sequences),
]

#: SQL can't express the classifier; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the cluster's shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
