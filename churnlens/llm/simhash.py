"""SimHash near-dedup by meet-in-the-middle ball hashing.

Each distinct fingerprint emits every variant within half the radius; two fingerprints within
the radius share a variant.  Variants are shuffled, the fingerprints that meet on one are
deduplicated and verified by their bit distance, and the verified links give components.
The whole search runs on distinct fingerprints, so a group of copies counts once.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, prepare_python, text_key
from .components import connected_components

BITS = 64
#: Shingles hashed at once within one text, so that a very long text needs bounded memory.
CHUNK = 1 << 15


def fingerprint(text: bytes | None, shingle: int, seed: int = 42) -> int:
    """Signed 64-bit SimHash of a text's word shingles, repeats included; no words give 0."""
    ws = (text or b"").lower().split()
    if not ws:
        return 0
    h, join = xxhash.xxh64_intdigest, b" ".join
    total = max(1, len(ws) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for a in range(0, total, CHUNK):
        part = ws[a:a + CHUNK + shingle - 1]
        grams = zip(*(part[i:] for i in range(shingle))) if len(ws) >= shingle else [ws]
        hs = np.array([h(join(g), seed) for g in grams], dtype="<u8")
        ones += np.unpackbits(hs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > total, bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprint_batches(batches, shingle: int):
    for b in batches:
        texts = pc.cast(b.column(b.schema.get_field_index("text")), pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([fingerprint(t, shingle) for t in texts], pa.int64())],
            names=["doc_id", "text_key", "fp"])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, text_key, fp)`` for every row of ``docs``; a null text counts as empty."""
    prepare_python(docs.sparkSession)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
            .mapInArrow(partial(_fingerprint_batches, shingle=shingle),
                        "doc_id long, text_key long, fp long"))


def _masks(radius: int) -> list[int]:
    out = [0]
    for r in range(1, radius + 1):
        out += [sum(1 << i for i in c) for c in combinations(range(BITS), r)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in out]


def _ball(fps: DataFrame, radius: int) -> DataFrame:
    """Every fingerprint with each variant at ``radius`` or fewer flipped bits."""
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(radius)])
    return (fps.select("fp", F.explode(masks).alias("mask"))
            .select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp"))


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Verified links ``(u, v)`` that connect all distinct ``fps`` within ``max_bits`` (0–5).

    With an even limit, all that meet on a variant lie within the limit of each other (the triangle
    inequality) and number at most a ball's volume, so a chain through them connects what all pairs
    would.  With an odd limit the smaller half-ball meets the larger one and each meeting is a link.
    """
    if not 0 <= max_bits <= 5:
        raise ValueError("max_bits must be 0 to 5: a half-ball of radius 3 has 43,745 members")
    low, high = max_bits // 2, max_bits - max_bits // 2
    if low == high:
        w = Window.partitionBy("variant").orderBy("fp")
        pairs = _ball(fps, low).select("fp", F.lag("fp").over(w).alias("other"))
    else:
        a, b = _ball(fps, low), _ball(fps, high).withColumnRenamed("fp", "other")
        pairs = a.join(b, "variant").select("fp", "other")
    return (pairs.where(F.col("other").isNotNull() & (F.col("fp") != F.col("other")))
            .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= max_bits)
            .select(F.col("fp").alias("u"), F.col("other").alias("v")))


def assign_components(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """Stored ``(doc_id, text_key, fp)`` → the same rows plus ``root``, ``component_id``.

    ``component_id`` is the smallest ``doc_id`` of the component (null only if all its ids are null).
    """
    fps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fps")
    labels = materialize(connected_components(links(fps.select("fp"), max_bits)), "labels")
    member = labels.join(fps, labels["node"] == fps["fp"]).select("node", "root", "rep")
    least = member.groupBy("root").agg(F.min("rep").alias("least"))
    linked = labels.join(least, "root").select(F.col("node").alias("fp"), "root", "least")
    of = (fps.join(linked, "fp", "left")
          .select("fp", F.coalesce("root", "fp").alias("root"),
                  F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id")))
    of = materialize(of, "of")         # a plain table on this side lets a hot fingerprint's rows be split
    return prints.join(of, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_key, fp, root, component_id``.

    Null and blank texts have fingerprint 0 and link like any other; repeated rows each get a row;
    an empty table gives an empty table; further columns of ``docs`` are not read.
    """
    return assign_components(materialize(fingerprints(docs, shingle), "fp"), max_bits)


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each component: the smallest ``doc_id`` (nulls last), then text digest.

    A row repeated whole (same id and text) stays once.  Keeps the columns of ``docs``.
    """
    cols = docs.columns
    near = near_duplicates(docs, shingle, max_bits)
    first = (near.groupBy("root")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")).alias("k"))
             .select(F.col("k.doc_id").alias("__id"), F.col("k.text_key").alias("__key")))
    keyed = docs.withColumn("__id0", F.col("doc_id").cast("long")).withColumn("__key0", text_key())
    kept = keyed.join(materialize(first, "kept"), F.col("__id0").eqNullSafe(F.col("__id"))
                      & (F.col("__key0") == F.col("__key")), "left_semi")
    return kept.dropDuplicates(["__id0", "__key0"]).select(*cols)
