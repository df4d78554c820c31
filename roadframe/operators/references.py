"""References to records that do not exist (problem 1).

A Bloom filter of all parent keys proves most orphans; only references that pass
it meet the parents in an exact join.

The filter is register-blocked: a key sets four bits of one 64-bit word, and 1,024
words form a block, one row with an array. Its size follows the number of keys, so
its power to prove does not fade as the data grow. Up to ``BROADCAST_WORDS`` (64
MB, some 30 million keys) it is broadcast; a larger one stays a table of blocks
that references meet by the number of their block, hash-partitioned like any other
join, so no executor ever holds all of it.

Defined cases: null references inside an array, and members without type or ref,
are no references; null or empty arrays have none; a referring row without
``ingested_at`` has a null period and is never ``late``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadframe.session import materialize
from roadframe.sources.tables import current_elements, current_versions

BITS_PER_KEY = 16
BLOCK_WORDS = 1 << 10
BROADCAST_WORDS = 1 << 23


def filter_words(keys: int) -> int:
    """Number of 64-bit words for so many keys: a power of two, one block at least."""
    need = max(1, keys * BITS_PER_KEY // 64)
    return max(BLOCK_WORDS, 1 << (need - 1).bit_length())


def _word_and_mask(columns: list[str], words: int) -> tuple[Column, Column]:
    hashed = F.xxhash64(*columns)
    mask = F.lit(0).cast("long")
    for k in range(4):
        bit = F.shiftrightunsigned(hashed, 40 + 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return hashed.bitwiseAND(F.lit(words - 1)), mask


def bloom_filter(keys: DataFrame, columns: list[str], words: int) -> DataFrame:
    """``(_block, _bits)`` of all key rows: ``words`` words in arrays of ``BLOCK_WORDS``."""
    word, mask = _word_and_mask(columns, words)
    filled = keys.select(word.alias("_word"), mask.alias("_mask"))
    every = keys.sparkSession.range(words).select(F.col("id").alias("_word"), F.lit(0).cast("long").alias("_mask"))
    per_word = filled.unionByName(every).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))
    inner = F.array_sort(F.collect_list(F.struct(F.pmod("_word", F.lit(BLOCK_WORDS)).alias("at"), "_bits")))
    return per_word.groupBy(F.floor(F.col("_word") / BLOCK_WORDS).alias("_block")).agg(inner.alias("w")).select(
        "_block", F.transform("w", lambda w: w["_bits"]).alias("_bits"))


def with_membership(refs: DataFrame, columns: list[str], bloom: DataFrame, words: int) -> DataFrame:
    """Add ``_maybe``: false where the filter proves that the key was never inserted."""
    word, mask = _word_and_mask(columns, words)
    probed = refs.withColumn("_word", word).withColumn("_mask", mask).withColumn("_block", F.floor(F.col("_word") / BLOCK_WORDS))
    if words <= BROADCAST_WORDS:  # eight bytes a word: a proven bound
        bloom = F.broadcast(bloom)
    bits = F.get("_bits", F.pmod("_word", F.lit(BLOCK_WORDS)).cast("int"))
    hit = F.coalesce(bits.bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))
    return probed.join(bloom, "_block", "left").withColumn("_maybe", hit).drop("_word", "_mask", "_block", "_bits")


def element_references(elements: DataFrame) -> DataFrame:
    """Distinct references ``(src_type, src_id, ref_type, ref_id, seen)`` of current, undeleted ways and relations."""
    parents = elements.where(F.col("type").isin("way", "relation"))
    current = current_elements(parents, "nodes", "members").where("visible")
    to_nodes = F.transform(F.coalesce("nodes", F.array().cast("array<bigint>")),
                           lambda n: F.struct(F.lit("node").alias("ref_type"), n.alias("ref_id")))
    to_members = F.transform(F.coalesce("members", F.array().cast("array<struct<type:string,ref:bigint,role:string>>")),
                             lambda m: F.struct(m["type"].alias("ref_type"), m["ref"].alias("ref_id")))
    refs = F.array_distinct(F.when(F.col("type") == "way", to_nodes).otherwise(to_members))
    return (current.select(F.col("type").alias("src_type"), F.col("id").alias("src_id"),
                           F.col("ingested_at").alias("seen"), F.explode(refs).alias("_r"))
            .select("src_type", "src_id", "seen", "_r.ref_type", "_r.ref_id")
            .where(F.col("ref_type").isNotNull() & F.col("ref_id").isNotNull()))


def orphan_references(elements: DataFrame) -> DataFrame:
    """``(src_type, src_id, ref_type, ref_id, reason, period)``: references that are missing, deleted or late.

    The parents are written to the shared folder once; the filter is built from
    them, and both sides of the exact join are plain scans, so adaptive execution
    can split a hot parent.
    """
    parents = materialize(current_versions(elements).select(
        F.col("type").alias("ref_type"), F.col("id").alias("ref_id"), "visible", "first_seen"), "parents")
    words = filter_words(parents.count())  # answered from Parquet footers
    bloom = materialize(bloom_filter(parents, ["ref_type", "ref_id"], words), "bloom")
    refs = element_references(elements)
    if words > BROADCAST_WORDS:
        refs = materialize(refs, "listed")
    refs = materialize(with_membership(refs, ["ref_type", "ref_id"], bloom, words), "refs")
    period = F.date_format("seen", "yyyy-MM").alias("period")
    names = ["src_type", "src_id", "ref_type", "ref_id"]
    proven = refs.where(~F.col("_maybe")).select(*names, F.lit("missing").alias("reason"), period)
    reason = (F.when(F.col("visible").isNull(), "missing").when(~F.col("visible"), "deleted")
              .when(F.col("first_seen") > F.col("seen"), "late"))
    verified = (refs.where("_maybe").join(parents, ["ref_type", "ref_id"], "left")
                .select(*names, reason.alias("reason"), period).where(F.col("reason").isNotNull()))
    return proven.unionByName(verified)


def orphan_report(elements: DataFrame) -> DataFrame:
    """Orphans counted per referring kind, referred kind, reason and month."""
    return (orphan_references(elements).groupBy("src_type", "ref_type", "reason", "period")
            .agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("src_id").alias("n_sources")))
