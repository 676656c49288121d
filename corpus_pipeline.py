"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, contaminated documents go,
personal data is replaced, and what remains is packed into sequences.

Each stage is a function of (spark, docs, sf_dir). docs is what the stage before kept, with the columns of documents;
the last stage returns pieces of sequences. run() writes each stage's result and reads it back as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm.common import discard, materialize, table
from kelpie.llm.decontaminate import decontaminate
from kelpie.llm.ngram_join import jaccard_groups
from kelpie.llm.packing import pack_documents
from kelpie.llm.pii import redact
from kelpie.llm.toxicity import THRESHOLD, held_out, toxicity


def plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with doc_id, text and numbered names for all other columns, so that no operator's own column meets one of them;
    and the names to put back."""
    names = {f"column_{k}": c for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return docs.withColumnsRenamed({c: k for k, c in names.items()}), names


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least THRESHOLD go. Labels of the held-out fold are not learnt from.

    A null or empty text scores as an empty window and stays; rows that repeat stay or go alike. Columns of any name stay
    as they are; an empty table gives no rows.
    """
    slim, names = plain(docs)
    scored = toxicity(slim, table(spark, sf_dir, "labels"), may_learn=~held_out())
    return scored.filter(F.col("toxicity_score") < THRESHOLD).select(*slim.columns).withColumnsRenamed(names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row stays: that of the least id, a null id being the largest.

    Texts are linked, whatever their ids: rows that share an id, or have none, stay or go by their own text. Rows without
    words link with nothing: they stay, one of those that repeat an id and a text; all where the id is null. Columns of any
    name stay as they are; an empty table gives no rows.
    """
    docs, names = plain(docs)
    key, id_ = F.xxhash64("text").alias("text_key"), F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.filter(worded).select(*docs.columns, key)
    texts = materialize(keyed.select("text_key", "text").dropDuplicates(["text_key"]), "texts")
    groups = jaccard_groups(texts, id_col="text_key").select(F.col("doc_id").alias("text_key"), "component_id")
    firsts = keyed.groupBy("text_key").agg(F.min(id_).alias("id")).join(groups, "text_key")
    stay = firsts.groupBy("component_id").agg(F.min(F.struct("id", "text_key")).alias("first")).select("first.id.doc_id", "first.text_key")
    stay = materialize(stay, "first-of-group")
    discard(texts)
    once = keyed.dropDuplicates(["doc_id", "text_key"]).alias("d")
    named = once.join(stay.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_key") == F.col("s.text_key")), "left_semi")
    blank = docs.filter(~worded).select(*docs.columns, key)
    blank = blank.filter("doc_id is not null").dropDuplicates(["doc_id", "text_key"]).unionByName(blank.filter("doc_id is null"))
    return named.unionByName(blank).select(*docs.columns).withColumnsRenamed(names)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up a twentieth or more of the words go; the others stay whole.

    Null and empty texts have no words and stay, and so does everything where the benchmark is empty. Rows that repeat stay
    or go alike. Columns of any name stay as they are; an empty table gives no rows.
    """
    slim, names = plain(docs)
    judged = decontaminate(slim, table(spark, sf_dir, "benchmark"))
    return judged.filter(~F.col("contaminated")).select(*slim.columns).withColumnsRenamed(names)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; spans of personal data become their kind in brackets, and n_chars follows the text.

    Null texts stay null, with their n_chars, and empty ones empty. Columns of any name stay as they are; an empty table
    gives no rows.
    """
    slim, names = plain(docs)
    clean = redact(slim).withColumnsRenamed(names)
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a sequence; a null or empty text is one id long, rows that repeat are packed each on its own,
    other columns are left behind, and an empty table gives no rows."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("packing", pack),
]

#: The scores of the first stage come from a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
