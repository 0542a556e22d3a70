"""Repeated byte strings by the Burrows-Wheeler transform of a document collection, built column by column.

Bauer, Cox and Rosone, "Lightweight algorithms for constructing and inverting the BWT of string collections"
(2013), with common prefixes as in Cox et al. (2016): each round puts one more symbol in front of every
document's suffix.  The symbols in suffix order are the round's part of the transform; a stable count by
symbol (the last-first mapping) gives the next order, and the common prefix of two neighbours grows from
the least one between their places before.  A round needs the last order, its common prefixes and one column
of symbols, which are read and written in sequence; nothing is sorted by comparing strings.

Spark cuts the collection so that every construction is bounded.  The sampled place of a window is its 32-byte
gram of smallest hash (winnowing), so equal windows have the same place at the same distance.  The windows of
one place form a read, the bytes that they cover.  Reads of equal grams, aligned at the gram, are a collection
of its own, and suffixes of different columns can't share a window; so each column's order stands alone.  Only
grams that occur more than once matter; equal reads count as one document with a number.  All steps between
are Parquet tables in the shared folder.  A gram with more different reads than ``MAX_READS`` is not put
into one construction: its windows meet one by one under their 128-bit digests instead.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, prepare_python

#: Bytes of a gram, and starts of a text that are sampled at once (places fit the low 20 bits of a hash).
GRAM, CHUNK = 32, 1 << 19
#: Different reads of one gram in a construction at most, and reads that a task puts into one.
MAX_READS, TASK_READS = 8192, 16384
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 20) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads a polynomial hash over all its bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Sampler:
    """The sampled place of every window of a text."""

    def __init__(self, window: int):
        self.window, n = window, CHUNK + window
        self.symbol = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
        self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)

    def reads(self, text: bytes):
        """``(gram hash, place, first window, last window)`` arrays, chunk by chunk; every window is in one read."""
        b = np.frombuffer(text, np.uint8)
        for at in range(0, max(len(b) - self.window + 1, 0), CHUNK):
            part = b[at:at + CHUNK + self.window - 1]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.symbol[part] * self.up[:len(part)], dtype=np.uint64)])
            grams = _mix((sums[GRAM:] - sums[:-GRAM]) * self.down[:len(part) - GRAM + 1])
            least = grams & ~_LOW | np.arange(len(grams), dtype=np.uint64)       # the leftmost of equal ones
            width, done = self.window - GRAM + 1, 1
            n = len(least) - width + 1
            while 2 * done <= width:
                least = np.minimum(least[:-done], least[done:])
                done *= 2
            least = np.minimum(least[:n], least[width - done:width - done + n])
            place = (least & _LOW).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            last = np.append(first[1:], n) - 1
            yield grams[place[first]], place[first] + at, first + at, last + at


def _pack(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Place, its distance from the first window and the number of further windows in one long."""
    return place << 16 | (place - first) << 8 | (last - first)


def _read_batches(batches, window: int):
    """Per read its gram's hash, the hash of its bytes, the document and the packed place."""
    sampler = Sampler(window)
    for b in batches:
        ids, d1, d2 = (b.column(i) for i in (0, 1, 2))
        for i, text in enumerate(pc.cast(b.column(3), pa.binary()).to_pylist()):
            for gram, place, first, last in sampler.reads(text or b""):
                own = [xxhash.xxh64_intdigest(text[x:y]) for x, y in zip(first.tolist(), (last + window).tolist())]
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(np.array(own, np.uint64).view(np.int64)), pa.repeat(ids[i], n),
                     pa.repeat(d1[i], n), pa.repeat(d2[i], n), pa.array(_pack(place, first, last))],
                    names=["gram", "read", "doc_id", "d1", "d2", "at"])


def _byte_batches(batches, window: int):
    """The bytes of the wanted reads of each document."""
    for b in batches:
        for text, wanted in zip(pc.cast(b.column(0), pa.binary()).to_pylist(), b.column(1).to_pylist()):
            rows = []
            for w in wanted:
                before = w["at"] >> 8 & 255
                first = (w["at"] >> 16) - before
                rows.append((w["gram"], w["read"], before, w["single"], w["hot"], text[first:first + (w["at"] & 255) + window]))
            cols = zip(*rows)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=["gram", "read", "before", "single", "hot", "bytes"])


def _least_between(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of ``values[a..b]``, both ends included, for many ranges."""
    out, size = values[b].copy(), b - a + 1
    level, step, wide = values, 1, np.flatnonzero(size > 1)
    while len(wide):
        level = np.minimum(level[:-step], level[step:])                 # of 2 * step values from each place
        step *= 2
        now = wide[size[wide] < 2 * step]
        out[now] = np.minimum(level[a[now]], level[b[now] - step + 1])
        wide = wide[size[wide] >= 2 * step]
    return out


class Collection:
    """The column-wise construction over groups of aligned documents.

    ``symbols`` is documents x columns (-1: none), documents of a group in a run; :meth:`insert` takes the columns
    from right to left.
    """

    def __init__(self, symbols: np.ndarray, group: np.ndarray):
        self.symbols, self.group, n = symbols, group.astype(np.uint16), len(group)
        self.order, self.common = np.arange(n), np.zeros(n, np.int16)   # common prefix with the one before
        self.inner = np.concatenate([[False], group[1:] == group[:-1]])

    def insert(self, column: int) -> np.ndarray:
        """One symbol more in front of each suffix; returns the column's part of the transform."""
        bwt = self.symbols[self.order, column]
        by = np.argsort((bwt + 1).astype(np.uint16), kind="stable")     # radix: a count by symbol,
        by = by[np.argsort(self.group[by], kind="stable")]              # within the groups
        symbol = bwt[by]
        grown = np.zeros_like(self.common)
        same = np.flatnonzero(self.inner & (symbol >= 0) & np.concatenate([[False], symbol[1:] == symbol[:-1]]))
        if len(same):
            grown[same] = 1 + _least_between(self.common, by[same - 1] + 1, by[same])
        self.order, self.common = self.order[by], grown
        return bwt

    def shared(self, length: int) -> np.ndarray:
        """Documents whose present suffix has ``length`` symbols in common with a neighbour's."""
        with_last = self.common >= length
        return self.order[with_last | np.append(with_last[1:], False)]


def repeated_windows(reads: list[bytes], before: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """For each read and window of it (by distance from the gram, falling) whether another read has it too."""
    reach = window - GRAM                                               # the gram's farthest place in a window
    lens = np.array([len(r) for r in reads])
    symbols = np.full((len(reads), reach + window), -1, np.int16)
    flat = np.frombuffer(b"".join(reads), np.uint8)
    row = np.repeat(np.arange(len(reads)), lens)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(reach - before, lens)
    symbols[row, col] = flat
    work = Collection(symbols, group)
    out = np.zeros((len(reads), reach + 1), bool)
    for column in range(symbols.shape[1] - 1, -1, -1):
        work.insert(column)
        if column <= reach:
            out[work.shared(window), column] = True
    return out


def _construct_batches(batches, window: int):
    """Runs of repeated windows ``gram, read, a, b`` (bytes of the read) of the reads that occur once.

    The rows come sorted by gram; whole grams go into one construction until it is full.
    """
    kept: list[tuple] = []

    def runs():
        gram, read, before, single, data = zip(*kept)
        gram, before = np.array(gram), np.array(before)
        group = np.cumsum(np.concatenate([[0], gram[1:] != gram[:-1]]))
        reach = window - GRAM
        hit = repeated_windows(list(data), before, group, window) & np.array(single)[:, None]
        edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, a = np.nonzero(edge == 1)
        _, b = np.nonzero(edge == -1)
        shift = reach - before[row]                                     # column of the read's first byte
        return pa.RecordBatch.from_arrays(
            [pa.array(gram[row]), pa.array(np.array(read)[row]), pa.array(a - shift, pa.int32()),
             pa.array(b - 1 + window - shift, pa.int32())], names=["gram", "read", "a", "b"])

    for b in batches:
        for x in zip(*(c.to_pylist() for c in b.columns)):
            if len(kept) >= TASK_READS and kept[-1][0] != x[0]:
                yield runs()
                kept = []
            kept.append(x)
    if kept:
        yield runs()


def _digest_batches(batches, window: int):
    """Each window of a read by its digest."""
    for b in batches:
        gram, read, single, data = (c.to_pylist() for c in b.columns)
        for g, r, s, text in zip(gram, read, single, data):
            d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[i:i + window]) for i in range(len(text) - window + 1)), np.int64)
            n = len(d) // 2
            yield pa.RecordBatch.from_arrays(
                [pa.array([g] * n), pa.array([r] * n), pa.array([s] * n), pa.array(np.arange(n), pa.int32()),
                 pa.array(d[::2]), pa.array(d[1::2])], names=["gram", "read", "single", "a", "h1", "h2"])


def _cut_batches(batches):
    """Texts without the spans: their bytes, the bytes and runs removed, and what is left."""
    for b in batches:
        names = b.schema.names
        size, gone, runs, left = [], [], [], []
        for text, spans in zip(pc.cast(b.column(names.index("__text")), pa.binary()).to_pylist(), b.column(names.index("__spans")).to_pylist()):
            text = text or b""
            edge = np.zeros(len(text) + 1, np.int64)
            if spans:
                s = np.array([(x["a"], x["b"]) for x in spans])
                np.add.at(edge, s[:, 0], 1)
                np.add.at(edge, s[:, 1], -1)
            covered = np.cumsum(edge[:-1]) > 0
            size.append(len(text))
            gone.append(int(covered.sum()))
            runs.append(int((covered & ~np.concatenate([[False], covered[:-1]])).sum()) if len(text) else 0)
            left.append(np.frombuffer(text, np.uint8)[~covered].tobytes())
        keep = [i for i, n in enumerate(names) if not n.startswith("__")]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(i) for i in keep), *(pa.array(x, pa.int64()) for x in (size, gone, runs)), pa.array(left, pa.binary())],
            names=[*(names[i] for i in keep), "n_bytes", "n_removed", "n_spans", "kept"])


def _digests():
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.xxhash64(text).alias("d1"), F.xxhash64(F.lit("repeat"), text).alias("d2")


def spans(docs: DataFrame, window: int = 200) -> DataFrame:
    """``d1, d2, spans``: for each text (by two digests) the bytes that repeated windows cover, as runs that may overlap."""
    if not GRAM <= window <= 255 + GRAM:
        raise ValueError(f"windows of {GRAM} to {255 + GRAM} bytes")
    prepare_python(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), *_digests(), "text")
    found = materialize(rows.where(F.octet_length("text") >= window)
                        .mapInArrow(partial(_read_batches, window=window), "gram long, read long, doc_id string, d1 long, d2 long, at long"), "reads")
    often = materialize(found.groupBy("gram").count().where("count > 1").select("gram"), "often")
    met = materialize(found.join(often, "gram"), "met")
    discard(found, often)
    classes = materialize(met.groupBy("gram", "read").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "d1", "d2", "at")).alias("one")), "classes")
    kinds = materialize(classes.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
    wanted = (classes.join(kinds, "gram").groupBy("one.doc_id", "one.d1", "one.d2")
              .agg(F.collect_list(F.struct("gram", "read", "one.at", (F.col("n") == 1).alias("single"),
                                           (F.col("kinds") > MAX_READS).alias("hot"))).alias("wanted")))    # a text's own reads
    wanted = wanted.withColumnsRenamed({"doc_id": "__id", "d1": "__d1", "d2": "__d2"})
    known = (F.col("d1") == F.col("__d1")) & (F.col("d2") == F.col("__d2")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    parts = materialize(rows.join(wanted, known).select("text", "wanted")
                        .mapInArrow(partial(_byte_batches, window=window), "gram long, read long, before int, single boolean, hot boolean, bytes binary"), "bytes")
    runs = "gram long, read long, a int, b int"
    marks = (parts.where("not hot").select("gram", "read", "before", "single", "bytes").dropDuplicates(["gram", "read"])
             .repartition("gram").sortWithinPartitions("gram", "read").mapInArrow(partial(_construct_batches, window=window), runs))
    if kinds.where(F.col("kinds") > MAX_READS).limit(1).count():
        alone = materialize(parts.where("hot").select("gram", "read", "single", "bytes").dropDuplicates(["gram", "read"])
                            .mapInArrow(partial(_digest_batches, window=window), "gram long, read long, single boolean, a int, h1 long, h2 long"), "windows")
        again = materialize(alone.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2"), "again")
        marks = marks.unionByName(alone.where("single").join(again, ["h1", "h2"]).select("gram", "read", "a", (F.col("a") + window).alias("b")))
    # a read that occurs twice is repeated as a whole
    whole = classes.where("n > 1").select("gram", "read", F.lit(0).alias("a"), F.lit(None).cast("int").alias("b"))
    marks = materialize(marks.unionByName(whole), "marks")
    start = F.shiftright("at", 16) - F.shiftright("at", 8).bitwiseAND(F.lit(255))
    hit = (met.select("gram", "read", "d1", "d2", "at").join(marks, ["gram", "read"])
           .select("d1", "d2", (start + F.col("a")).alias("a"),
                   (start + F.coalesce("b", F.col("at").bitwiseAND(F.lit(255)) + window)).alias("b")))
    out = materialize(hit.groupBy("d1", "d2").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")   # of one text
    discard(met, classes, kinds, parts, marks)
    return out


def remove_repeats(docs: DataFrame, window: int = 200) -> DataFrame:
    """``docs`` plus ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (binary: the bytes left).

    Removed is every byte of ``text`` (UTF-8) that a string of ``window`` bytes covers which starts at another
    place too, in any row, the same one included; strings are judged on the input and don't cross rows.  A null or
    empty text has no byte; a text shorter than the window stays whole.  Every row counts, also one that repeats
    another's id or text, and with a null id.  Columns of ``docs`` whose names clash with the new ones, or start
    with two underscores, are left out.  An empty table gives an empty table.
    """
    new = ("n_bytes", "n_removed", "n_spans", "kept")
    own = [f for f in docs.schema.fields if f.name not in new and not f.name.startswith("__")]
    found = spans(docs, window).withColumnsRenamed({"d1": "__d1", "d2": "__d2", "spans": "__spans"})
    one, two = _digests()
    keyed = docs.select(*(F.col(f"`{f.name}`") for f in own), F.col("text").alias("__text"), one.alias("__k1"), two.alias("__k2"))
    joined = keyed.join(found, (F.col("__k1") == F.col("__d1")) & (F.col("__k2") == F.col("__d2")), "left").drop("__k1", "__k2", "__d1", "__d2")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own)
    return joined.mapInArrow(_cut_batches, f"{kinds}n_bytes long, n_removed long, n_spans long, kept binary")
