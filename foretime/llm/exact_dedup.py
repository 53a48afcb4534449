"""Exact dedup: group by 128-bit content hash, compare bytes inside the groups, keep the smallest id.

Built of DataFrame functions only. Two texts are equal when they are identical
after each run of `[\\x20\\x09-\\x0D]` became one space; runs at the ends stay as
one space too.

Cases: a null text counts as empty, so null and empty texts are one group. A
null id is never the smallest unless all ids of the group are null. Rows that
repeat both id and text are one document and share one decision. An empty
table gives an empty result. Other columns of the input are ignored by
`duplicate_groups` and carried along unchanged by `drop_duplicates`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise, released, small, text_of


def normalised(text: Column) -> Column:
    """Each run of white space as one space. Single spaces, by far the most frequent runs, need no replacement."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs.

    Digests are counted first; a text whose 128-bit hash no other row has is a group of its own, and its bytes go nowhere. The others
    are read again by their ids, which are broadcast if they are counted to be few, and come to one hash aggregation on (hash, text): rows meet by
    hash and are told apart by their bytes, and copies are combined before the shuffle, so a group of any size sends one row
    from each task. What follows is narrow: rows find their group by the two digests.
    """
    rows = docs.select("doc_id", normalised(text_of()).alias("norm"))
    rows = materialise(rows.select("doc_id", F.unhex(F.md5("norm")).alias("hash"), F.unhex(F.sha2("norm", 256)).alias("sha")), "exact-rows")
    shared = materialise(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"), "exact-shared")
    ids = materialise(rows.join(small(shared), "hash", "left_semi").select(F.col("doc_id").alias("its_id")).distinct(), "exact-ids")
    again = docs.join(small(ids), docs["doc_id"].eqNullSafe(ids["its_id"]), "left_semi")
    keyed = again.select("doc_id", normalised(text_of()).alias("norm")).withColumn("hash", F.unhex(F.md5("norm")))
    groups = keyed.groupBy("hash", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # an id may have other texts too, which are alone
    groups = materialise(groups.filter("group_size > 1").select("hash", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size"), "exact-groups")
    out = rows.join(small(groups), ["hash", "sha"], "left")
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text no row of a smaller id has; all columns stay as they are.

    A row is told by its id and its text: other texts under the same id, or without an
    id, stay. Only the dropped rows are joined: broadcast if they are counted to be few, so that texts aren't shuffled.
    """
    with released(docs.sparkSession):
        dropped = duplicate_groups(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("dropped_id"), F.unhex("text_sha256").alias("dropped_sha")).distinct()
        dropped = materialise(dropped, "exact-dropped")
    same = docs["doc_id"].eqNullSafe(dropped["dropped_id"]) & (F.unhex(F.sha2(normalised(text_of()), 256)) == dropped["dropped_sha"])
    return docs.join(small(dropped), same, "left_anti")
