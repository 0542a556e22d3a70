"""Substring dedup by relative Lempel-Ziv parsing against content-anchored reference blocks.

Every document is cut by anchors: the word 8-gram with the smallest hash in each run of 43 of them
(winnowing), so that each window of 50 words has one anchor and equal windows have the same.  The block
of an anchor is the text around it that windows of 50 words holding the anchor can reach.  All blocks of all documents are
the reference index, keyed by anchor.  Parsing goes by the longest factor first: a block that equals a
block of a document with a smaller id is one factor.  Where blocks of one anchor differ, the factor ends
inside them; there the windows of the differing blocks are compared, which fixes the border to the word.
Runs of matched words of 50 or more are the duplicate spans.

Texts are never collected by key: equal blocks and equal windows meet as group-by minima and joins.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare_python, text_key

GRAM = 8
#: Columns that the cut adds.
NEW = ("n_words", "n_removed", "kept_text")
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out) if n else out


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads a polynomial hash over all its bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of all runs of a word sequence in constant time each, from prefix sums modulo 2**64."""

    def __init__(self, words: list[bytes]):
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        self.n = len(words)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_BASE, self.n), dtype=np.uint64)])
        self.back = _powers(_INVERSE, self.n + 1)

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def anchors(h: Hashes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchor positions of a document, their 8-gram hashes, and for each window its anchor's position."""
    if h.n < window:
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none
    at = np.arange(h.n - GRAM + 1)
    grams = h.runs(at, at + GRAM)
    view = np.lib.stride_tricks.sliding_window_view(grams, window - GRAM + 1)
    step = 1 << 16                                    # bounds the index arrays of very long texts
    of = np.concatenate([view[i:i + step].argmin(axis=1) + np.arange(i, min(i + step, len(view)))
                         for i in range(0, len(view), step)])
    pos = np.unique(of)
    return pos, grams[pos], of


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _binary(col: pa.Array) -> list[bytes | None]:
    return pc.cast(col, pa.binary()).to_pylist()


def _anchor_batches(batches, window: int):
    for b in batches:
        ids, keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), _binary(b.column(2))
        out = []
        for i, key, text in zip(ids, keys, texts):
            words = (text or b"").split()
            if i is None or len(words) < window:
                continue
            h = Hashes(words)
            pos, grams, _ = anchors(h, window)
            start, end = np.maximum(pos + GRAM - window, 0), np.minimum(pos + window, h.n)
            out.append((grams, h.runs(start, end), np.full(len(pos), i),
                        pos << 32 | (key & 0xFFFFFFFF)))
        if out:
            a, k, d, at = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([_signed(a), _signed(k), pa.array(d), pa.array(at)],
                                             names=["anchor", "block", "doc_id", "at"])


def _window_batches(batches, window: int):
    """The windows of the wanted anchors of each document."""
    for b in batches:
        for i, key, text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _binary(b.column(2)),
                                        b.column(3).to_pylist()):
            h = Hashes((text or b"").split())
            pos, grams, of = anchors(h, window)
            start = np.flatnonzero(np.isin(of, np.array(wanted)))
            if len(start):
                own = grams[np.searchsorted(pos, of[start])]
                yield pa.RecordBatch.from_arrays(
                    [_signed(own), _signed(h.runs(start, start + window)), pa.array(np.full(len(start), i)),
                     pa.array(start << 32 | (key & 0xFFFFFFFF))], names=["anchor", "win", "doc_id", "at"])


def _cut(text: bytes | None, spans) -> tuple[int, int, bytes]:
    """Words, removed words, and the words left, joined by one space."""
    words = (text or b"").split()
    if not spans:
        return len(words), 0, b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    s = np.array(spans, np.int64).reshape(-1, 2)
    np.add.at(edge, s[:, 0], 1)
    np.add.at(edge, np.minimum(s[:, 1], len(words)), -1)
    keep = np.cumsum(edge[:-1]) == 0
    left = [w for w, k in zip(words, keep.tolist()) if k]
    return len(words), len(words) - len(left), b" ".join(left)


def _cut_batches(batches):
    for b in batches:
        names = b.schema.names
        texts, spans = _binary(b.column(names.index("text"))), b.column(names.index("spans")).to_pylist()
        done = [_cut(t, [(s["a"], s["b"]) for s in sp or ()]) for t, sp in zip(texts, spans)]
        kept = pa.array([d[2] for d in done], pa.binary()).cast(pa.string())
        keep = [i for i, n in enumerate(names) if n != "spans"]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(i) for i in keep), pa.array([d[0] for d in done], pa.int64()),
             pa.array([d[1] for d in done], pa.int64()), kept],
            names=[*(names[i] for i in keep), "n_words", "n_removed", "kept_text"])


def spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """Duplicate spans ``doc_id, key, a, b`` (words a to b-1) of every document; spans may overlap.

    ``key`` is the low half of the text's digest: rows that repeat an id are told apart by it.
    """
    prepare_python(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    found = materialize(rows.mapInArrow(partial(_anchor_batches, window=window),
                                        "anchor long, block long, doc_id long, at long"), "anchors")
    # anchors met more than once, and whether their blocks or their documents differ
    often = (found.groupBy("anchor")
             .agg(F.count("*").alias("n"), F.min("block").alias("b0"), F.max("block").alias("b1"),
                  F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"))
             .where("n > 1 and d0 < d1").select("anchor", (F.col("b0") != F.col("b1")).alias("differ")))
    # stored before the join: both sides are then plain exchanges, and a hot anchor's rows can be split
    met = materialize(found.join(materialize(often, "often"), "anchor"), "met")
    first = materialize(met.groupBy("anchor", "block").agg(F.min("doc_id").alias("first"), F.first("differ").alias("differ")),
                        "first")
    tied = met.drop("differ").join(first, ["anchor", "block"])
    place = F.shiftright("at", 32)
    key = F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))
    whole = (tied.where("doc_id > first")
             .select("doc_id", key.alias("key"), F.greatest(place + (GRAM - window), F.lit(0)).alias("a"),
                     (place + window).alias("b")))
    wanted = (tied.where("doc_id = first and differ").groupBy("doc_id", key.alias("key"))
              .agg(F.collect_set(place).alias("wanted")))          # at most one text's anchors
    wanted = wanted.withColumnsRenamed({"doc_id": "wid", "key": "wkey"})
    windows = materialize(
        rows.join(wanted, (F.col("doc_id") == F.col("wid")) & (F.col("text_key").bitwiseAND(F.lit(0xFFFFFFFF)) == F.col("wkey")))
        .select("doc_id", "text_key", "text", "wanted")
        .mapInArrow(partial(_window_batches, window=window), "anchor long, win long, doc_id long, at long"), "windows")
    early = windows.groupBy("anchor", "win").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    inner = (windows.join(materialize(early.where("first < last"), "early"), ["anchor", "win"]).where("doc_id > first")
             .select("doc_id", key.alias("key"), place.alias("a"), (place + window).alias("b")))
    return whole.unionByName(inner)


def remove_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """``docs`` plus ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space).

    Windows are judged on the input.  A null text has no words.  Rows with a null id are neither changed
    nor a source; rows that repeat an id are parts of one document: no source for each other.  An empty
    table gives an empty table; a text of fewer words than the window is kept.  All columns of ``docs`` are kept,
    but for those named as the new ones, whose place these take.
    """
    per = (spans(docs, window).groupBy("doc_id", "key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
           .withColumnsRenamed({"doc_id": "__id", "key": "__key"}))
    per = materialize(per, "spans")
    names = {c: f"__u{i}" for i, c in enumerate(docs.columns) if c not in NEW and c != "text"}
    rows = docs.select(*[F.col(f"`{c}`").alias(u) for c, u in names.items()], "text", F.col("doc_id").cast("long").alias("__doc"),
                       text_key().bitwiseAND(F.lit(0xFFFFFFFF)).alias("__own"))
    joined = (rows.join(per, (F.col("__doc") == F.col("__id")) & (F.col("__own") == F.col("__key")), "left")
              .select(*names.values(), "text", "spans"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema.fields if f.name != "spans")
    prepare_python(docs.sparkSession)
    cut = joined.mapInArrow(_cut_batches, f"{kinds}, n_words long, n_removed long, kept_text string")
    return cut.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns if c not in NEW], *NEW)


def drop_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """``docs`` with the duplicate spans cut out of ``text`` and ``n_chars`` counted anew where it changed.

    Documents without a duplicate span keep their text as it is; all other columns stay, whatever their names.
    """
    aside = {c: f"__aside{i}" for i, c in enumerate(NEW) if c in docs.columns}
    cut = remove_spans(docs.withColumnsRenamed(aside), window)
    changed = F.col("n_removed") > 0
    cut = cut.withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(changed, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cut.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])
