"""Benchmark decontamination by size-partitioned MinHash containment search, DataFrame operations only.

Benchmark items are partitioned by the size of their shingle set (powers of two).  An item's MinHash
sketch is its smallest shingle hashes; the partition fixes how many are kept: with n shingles of which a
share t must occur in the document, any n - ceil(t n) + 1 of them hold at least one that occurs, so a
sketch of that length misses no document whatever its length.  (Signatures of equal length on both sides
can't do that: a 30-shingle item in a 20,000-shingle document has Jaccard similarity 0.0015.)  Document
shingles meet the sketches of the partitions that the document is large enough for, each meeting pair
is taken up once, and exact containment of the shingle strings decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_key, words

#: Sketch rows in a broadcast block of items; larger benchmarks take several passes over the documents.
BLOCK_ROWS = 200_000


def _grams(k: int) -> str:
    """SQL: the word shingles of array ``w`` as strings (fewer than k words: the whole sequence)."""
    return (f"CASE WHEN size(w) >= {k} THEN transform(sequence(1, size(w) - {k - 1}), i -> concat_ws(' ', slice(w, i, {k}))) "
            "WHEN size(w) > 0 THEN array(concat_ws(' ', w)) ELSE CAST(array() AS array<string>) END")


def _hashes(k: int) -> str:
    """SQL: the 64-bit hashes of the same shingles, without building the strings."""
    gram = ", ".join(f"get(w, i + {j})" for j in range(k))
    return (f"CASE WHEN size(w) >= {k} THEN transform(sequence(0, size(w) - {k}), i -> xxhash64({gram})) "
            "WHEN size(w) > 0 THEN array(xxhash64(concat_ws(' ', w))) ELSE CAST(array() AS array<bigint>) END")


def _items(benchmark: DataFrame, k: int, share: float) -> DataFrame:
    """``(item_id, grams, n, need, sketch, floor)``; ``floor``: shingles a document must have for the partition."""
    q = f"CAST({share!r} AS decimal(10, 9))"
    return (benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.lower("text")).alias("w"))
            .select("item_id", F.array_distinct(F.expr(_grams(k))).alias("grams"),
                    F.array_sort(F.array_distinct(F.expr(_hashes(k)))).alias("hashes"))
            .withColumn("n", F.size("grams")).where("n > 0")
            .withColumn("need", F.expr(f"CAST(ceil({q} * n) AS int)"))
            .withColumn("top", F.expr("CAST(shiftleft(2L, CAST(floor(log2(n)) AS int)) - 1 AS int)"))
            .withColumn("floor", F.expr(f"CAST(ceil({q} * ((top + 1) div 2)) AS int)"))
            .withColumn("keep", F.expr(f"least(size(hashes), greatest(n - need + 1, CAST(top - ceil({q} * top) + 1 AS int)))"))
            .select("item_id", "grams", "n", "need", "floor", F.expr("slice(hashes, 1, keep)").alias("sketch")))


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, share: float = 0.8) -> DataFrame:
    """Pairs ``doc_id, text_key, item_id, n_shingles, n_shared, containment`` of at least ``share``.

    Words are lower-cased; a shingle is k words, sets not bags.  An item or document of fewer words has its
    whole sequence as one shingle; null and blank texts match nothing.  Repeated documents or items each
    give their pairs; a null id is carried.  Empty tables give no pairs; other columns are not read.
    """
    items = materialize(_items(benchmark, k, share), "items")
    blocks = max(1, -(-(items.agg(F.sum(F.size("sketch"))).first()[0] or 0) // BLOCK_ROWS))
    d = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"),
                     words(F.lower("text")).alias("w"))
         .withColumn("h", F.array_distinct(F.expr(_hashes(k)))))
    found = []
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "grams"), F.lit(blocks)) == b)
        number = F.xxhash64("item_id", "grams").alias("item_key")
        sketch = part.select(number, "floor", F.explode("sketch").alias("hash"))
        full = part.select(number, "item_id", "grams", "n", "need", "sketch")
        # explode_outer: from a plain explode Spark infers a filter that would compute the shingles again
        met = (d.select("doc_id", "text_key", "w", "h", F.explode_outer("h").alias("hash"))
               .join(F.broadcast(sketch.distinct()), "hash").where(F.size("h") >= F.col("floor"))
               .join(F.broadcast(full), "item_key")
               .where(F.col("hash") == F.array_min(F.array_intersect("sketch", "h"))))
        found.append(met.withColumn("n_shared", F.size(F.array_intersect("grams", F.expr(_grams(k)))))
                     .where("n_shared >= need")
                     .select("doc_id", "text_key", "item_id", F.col("n").cast("long").alias("n_shingles"),
                             F.col("n_shared").cast("long").alias("n_shared"),
                             (F.col("n_shared") / F.col("n")).alias("containment")))
    return reduce(DataFrame.unionByName, found)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, share: float = 0.8) -> DataFrame:
    """``docs`` without the texts that contain a benchmark item; the columns of ``docs``."""
    bad = materialize(contaminated(docs, benchmark, k, share).select("text_key").distinct(), "leaks")
    return docs.join(bad, text_key() == bad["text_key"], "left_anti").select(*docs.columns)
