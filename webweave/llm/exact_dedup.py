"""Exact duplicates of texts by content-defined chunk recipes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webweave.llm.common import id_and_text, plain_names
from webweave.session import materialize

#: A chunk ends at the first vowel and blank after 512 characters, at 4,096, or at the text's end.
CHUNK = r"(?s).{512,4095}?(?:(?<=[aeiou])[ \n]|\z)|.{4096}|.{1,4095}"


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per row of ``docs``.

    Each text is cut where its own content says, so equal texts have equal chunks, and the chunks
    in order make up the whole text. Every distinct chunk is compared by content once, to prove that
    its 64-bit identifier names it alone; a document with a chunk whose identifier is shared carries
    its chunks' contents along. Texts are then equal exactly if their lists of identifiers are, and
    only these short lists move from there on.

    Null text: the empty text, whose list is empty. Of rows that repeat both id and text one is kept.
    A null id ranks below all others; it stays only in a group without any id. Empty table: no rows.
    """
    texts = id_and_text(docs, id_col, text_col)
    chunk = F.explode(_chunks(F.col("text"))).alias("chunk")
    shared = materialize(
        texts.select(chunk).select(F.xxhash64("chunk").alias("id"), "chunk").distinct()
        .groupBy("id").agg(F.count("*").alias("contents")).where("contents > 1").select("id")
    )
    recipes = materialize(texts.select(
        "doc_id", F.sha2("text", 256).alias("text_sha256"),
        F.transform(_chunks(F.col("text")), lambda c: F.xxhash64(c)).alias("ids"),
    ))
    doubtful = materialize(
        recipes.select("doc_id", "text_sha256", F.explode("ids").alias("id")).join(shared, "id", "left_semi")
        .select("doc_id", "text_sha256").distinct()
    )
    contents = (
        texts.select("doc_id", "text", F.sha2("text", 256).alias("text_sha256"))
        .join(doubtful.select(F.col("doc_id").alias("_d"), F.col("text_sha256").alias("_s")),
              F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_sha256") == F.col("_s")))
        .select("_d", "_s", _chunks(F.col("text")).alias("_chunks")).dropDuplicates(["_d", "_s", "_chunks"])
    )
    members = materialize(
        recipes.join(contents, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_sha256") == F.col("_s")), "left")
        .select("doc_id", "text_sha256", "ids", F.coalesce("_chunks", F.array().cast("array<string>")).alias("chunks"))
        .groupBy("ids", "chunks", "doc_id", "text_sha256").agg(F.count("*").alias("copies"))
    )
    groups = materialize(
        members.groupBy("ids", "chunks").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    )
    return members.join(groups, ["ids", "chunks"]).select(
        "doc_id", "keep_id", "group_size", "text_sha256",
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy"),
    ).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"), "text_sha256",
    )


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns."""
    found = exact_duplicates(docs, id_col, text_col)
    stays = materialize(found.groupBy(F.col("doc_id").alias("_d"), F.col("text_sha256").alias("_s")).agg(
        F.max("kept").alias("_kept"), F.count("*").alias("_copies")
    ).where("_kept").select("_d", "_s", "_copies"))
    renamed, at = plain_names(docs)
    digest = F.sha2(F.coalesce(F.col(at[text_col]), F.lit("")), 256)

    def rows(of: DataFrame) -> DataFrame:
        return renamed.join(of, F.col(at[id_col]).cast("long").eqNullSafe(F.col("_d")) & (digest == F.col("_s")), "left_semi")

    once, repeated = rows(stays.where("_copies = 1")), rows(stays.where("_copies > 1"))
    single = repeated.withColumn("_s", digest).dropDuplicates([at[id_col], "_s"]).drop("_s")
    return once.unionByName(single).toDF(*docs.columns)
