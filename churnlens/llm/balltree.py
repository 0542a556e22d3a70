"""Ranked lexical search by exact inner products over sparse ball trees.

A document is a sparse vector of integer term weights, a query one of integer term counts times idf; the
score is their inner product.  Documents enter by their weights on the terms that the queries hold, since
the others add nothing to any product.  One pass over the texts stores these counts; a range shuffle by
the first such terms puts like documents side by side, and runs of them become blocks, each a row that
holds a tree: every node has its documents' centroid c and the radius r around it, so that no document
below scores above q.c + |q|r.  Coordinates are scaled by the root of the term's idf (queries by its
inverse), which leaves products as they are and keeps frequent words from filling the radius.  All that
is not an integer is rounded upwards.

A search visits a block's nodes best bound first and ends where the bound falls below the query's floor;
leaves are scored in exact 64-bit integers.  A first pass over the blocks visits one leaf of each, whose k
best documents over all blocks give every query a floor for the second, which then opens only subtrees
that can still matter.  Queries go in blocks of bounded size against all documents.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, prepare_python

#: Documents and stored numbers of a block at most (one document may hold more), and documents of a leaf.
BLOCK_DOCS, BLOCK_CELLS, LEAF = 2048, 1 << 20, 32
#: Bytes of text in a block of queries; a larger single query is a block of its own.
QUERY_BYTES = 16 << 20
_NO_ID = 2 ** 63 - 1
_SLACK = 1e-9

#: Lower-cases A-Z and turns every other byte that is no term's into a space; bytes from 128 on are terms'.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return (text or b"").translate(_TERM_BYTES).split()


def _count_batches(batches, place: dict[bytes, int]):
    """Per document its id, number of terms, and counts of the queries' terms by ascending place."""
    for b in batches:
        ids, texts = b.column(0), pc.cast(b.column(1), pa.binary()).to_pylist()
        sizes, lens, at, tf = [], [], [], []
        for text in texts:
            words = terms(text)
            known = {place[w]: n for w, n in Counter(words).items() if w in place}
            keys = sorted(known)
            sizes.append(len(words))
            lens.append(len(keys))
            at += keys
            tf += [known[p] for p in keys]
        offsets = pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(at, pa.int32())),
             pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))], names=["doc_id", "n", "at", "tf"])


def weights(tf: np.ndarray, n: np.ndarray, cells: np.ndarray, docs: int, total: int) -> np.ndarray:
    """Integer weights of terms by their counts; ``n`` and ``cells`` are the documents' lengths and numbers of them."""
    wide = n.astype(object) if 25 * int(n.max(initial=0)) * docs >= 2 ** 63 else n
    m = np.repeat((100 - 25 + 25 * wide * docs // total).astype(np.int64), cells)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def idf(docs: int, df: int) -> int:
    """floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))"""
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _cells(start: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of several runs one after another, and where each ends among them."""
    ends = np.cumsum(lens)
    return ends, np.arange(int(lens.sum())) + np.repeat(start - ends + lens, lens)


class Tree:
    """A block's documents as rows of a sparse matrix in tree order, and the nodes over them."""

    def __init__(self, ids, null, ptr, at, x, scale):
        self.ids, self.null, self.ptr, self.at, self.x = ids, null, ptr, at, x
        self.y = x * scale[at]                                          # scaled coordinates
        self.norm = np.add.reduceat(np.append(self.y ** 2, 0), ptr[:-1]) * (np.diff(ptr) > 0)
        self.build(len(scale))


    def build(self, width: int):
        """Halves by the nearer of two far documents, down to leaves; nodes in an order of parents first."""
        order, dense = np.arange(len(self.ids)), np.zeros(width)
        spans, kids, centres, radii = [(0, len(order))], [], [], []
        node = 0
        while node < len(spans):
            a, b = spans[node]
            rows = order[a:b]
            lens = self.ptr[rows + 1] - self.ptr[rows]
            ends, cells = _cells(self.ptr[rows], lens)
            at, y, owner = self.at[cells], self.y[cells], np.repeat(np.arange(b - a), lens)

            def dots():                                                 # of the node's documents with ``dense``
                return np.bincount(owner, y * dense[at], b - a)

            sums = np.bincount(at, y, width)
            cols = np.flatnonzero(sums)
            centre = sums[cols] / len(rows)
            dense[cols] = centre
            to = self.norm[rows] - 2 * dots() + centre @ centre
            slack = 1e-10 * (self.norm[rows].max(initial=0) + centre @ centre) + 1e-6
            radii.append(float(np.sqrt(max(to.max(), 0) + slack) * (1 + _SLACK)))
            centres.append((cols, centre))
            dense[cols] = 0
            if b - a > LEAF and to.max() > slack:
                far = rows[to.argmax()]
                gap = []
                for pole in (far, None):
                    pole = rows[gap[0].argmax()] if pole is None else pole
                    own = slice(self.ptr[pole], self.ptr[pole + 1])
                    dense[self.at[own]] = self.y[own]
                    gap.append(self.norm[rows] - 2 * dots())
                    dense[self.at[own]] = 0
                split = np.argsort(gap[0] - gap[1] + self.norm[far] - self.norm[pole], kind="stable")
                order[a:b] = rows[split]
                mid = (a + b) // 2
                kids.append(len(spans))
                spans += [(a, mid), (mid, b)]
            else:
                kids.append(-1)
            node += 1
        self.spans, self.kids, self.radii = np.array(spans), np.array(kids), np.array(radii)
        lens = [len(c) for c, _ in centres]
        self.c_node = np.repeat(np.arange(len(centres)), lens)
        c_at = np.concatenate([c for c, _ in centres])
        c_val = np.concatenate([v for _, v in centres])
        by = np.argsort(c_at, kind="stable")                            # the centroids' cells by coordinate
        self.c_node, self.c_at, self.c_val = self.c_node[by], c_at[by], c_val[by]
        # documents in tree order, so that every node is a run of rows
        ends, cells = _cells(self.ptr[order], np.diff(self.ptr)[order])
        self.at, self.x = self.at[cells], self.x[cells]
        self.ids, self.null = self.ids[order], self.null[order]
        self.ptr = np.concatenate([[0], ends])

    FIELDS = ("ids", "null", "ptr", "at", "x", "spans", "kids", "radii", "c_node", "c_at", "c_val")
    KINDS = ("i8", "?", "i8", "i4", "i8", "i8", "i8", "f8", "i4", "i4", "f8")

    def row(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, f), k).tobytes() for f, k in zip(self.FIELDS, self.KINDS)]

    @classmethod
    def of_row(cls, values) -> "Tree":
        self = cls.__new__(cls)
        for f, k, v in zip(cls.FIELDS, cls.KINDS, values):
            setattr(self, f, np.frombuffer(v, k))
        self.spans = self.spans.reshape(-1, 2)
        return self

    def bounds(self, cols: np.ndarray, q: np.ndarray) -> np.ndarray:
        """For every node a number that no document below scores above."""
        a, b = np.searchsorted(self.c_at, cols), np.searchsorted(self.c_at, cols, side="right")
        _, cells = _cells(a, b - a)
        dots = np.bincount(self.c_node[cells], self.c_val[cells] * np.repeat(q, b - a), len(self.kids))
        return (dots + np.sqrt(q @ q) * self.radii) * (1 + _SLACK) + 1e-3

    def score(self, node: int, dense: np.ndarray) -> np.ndarray:
        a, b = self.spans[node]
        lo, hi = self.ptr[a], self.ptr[b]
        sums = np.concatenate([[0], np.cumsum(self.x[lo:hi] * dense[self.at[lo:hi]])])
        return sums[self.ptr[a + 1:b + 1] - lo] - sums[self.ptr[a:b] - lo]


def _tree_batches(batches, scale: np.ndarray, docs: int, total: int):
    """Blocks of the documents in their order, each with its tree."""
    ids, null, lens, at, x, cells = [], [], [], [], [], 0

    def block():
        ptr = np.concatenate([[0], np.cumsum(np.concatenate(lens))]).astype(np.int64)
        tree = Tree(np.concatenate(ids), np.concatenate(null), ptr, np.concatenate(at).astype(np.int64), np.concatenate(x), scale)
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in tree.row()], names=list(Tree.FIELDS))

    for b in batches:
        own = np.diff(b.column(2).offsets.to_numpy())
        cols, tf = (b.column(i).flatten().to_numpy() for i in (2, 3))
        w = weights(tf, b.column(1).to_numpy(), own, docs, total)
        edge = np.concatenate([[0], np.cumsum(own)])
        done = 0
        while done < b.num_rows:
            room = max(0, BLOCK_CELLS - cells)
            take = int(np.searchsorted(edge, edge[done] + room, side="right")) - 1 - done
            take = min(take, b.num_rows - done, BLOCK_DOCS - sum(map(len, lens)))
            if take <= 0 and lens:
                yield block()
                ids, null, lens, at, x, cells = [], [], [], [], [], 0
                continue
            take = max(take, 1)
            part = b.column(0).slice(done, take)
            ids.append(part.fill_null(_NO_ID).to_numpy())
            null.append(part.is_null().to_numpy(zero_copy_only=False))
            lens.append(own[done:done + take])
            at.append(cols[edge[done]:edge[done + take]])
            x.append(w[edge[done]:edge[done + take]])
            cells += int(edge[done + take] - edge[done])
            done += take
    if lens:
        yield block()


def visit(tree: Tree, cols: np.ndarray, q: np.ndarray, scaled: np.ndarray, dense: np.ndarray, best: list, floor: int,
          k: int, first_leaf: bool = False) -> tuple[list, int, int]:
    """The best ``k`` of ``best`` and a tree's documents that reach ``floor``, the new floor, and documents scored.

    Entries are (-score, whether the id is null, id).  ``dense`` is all zeros, before and after.
    """
    bound, n = tree.bounds(cols, scaled), 0
    heap = [(-bound[0], 0)]
    dense[cols] = q
    while heap and -heap[0][0] >= floor:
        node = heapq.heappop(heap)[1]
        kid = tree.kids[node]
        if kid >= 0:
            for c in (kid, kid + 1):
                heapq.heappush(heap, (-min(bound[c], bound[node]), int(c)))
            continue
        score = tree.score(node, dense)
        n += len(score)
        hit = np.flatnonzero(score >= floor)
        if len(hit):
            at = tree.spans[node][0] + hit
            best = heapq.nsmallest(k, [*best, *zip((-score[hit]).tolist(), tree.null[at].tolist(), tree.ids[at].tolist())])
            if len(best) == k:
                floor = max(floor, -best[-1][0])
        if first_leaf:
            break
    dense[cols] = 0
    return best, floor, n


def _search_batches(batches, queries, width: int, k: int, floors, first_leaf: bool):
    """The best k documents of a task for each query that reach its floor, ties to the smaller id.

    ``queries``: for each its places, exact integer weights and scaled weights.
    """
    best, low, dense = [[] for _ in queries], list(floors), np.zeros(width, np.int64)
    for b in batches:
        for i in range(b.num_rows):
            tree = Tree.of_row([c[i].as_py() for c in b.columns])
            for j, (cols, q, scaled) in enumerate(queries):
                if len(cols):
                    best[j], low[j], _ = visit(tree, cols, q, scaled, dense, best[j], low[j], k, first_leaf)
    flat = [(j, *x) for j, part in enumerate(best) for x in part]
    yield pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in flat], pa.int32()), pa.array([None if x[2] else x[3] for x in flat], pa.int64()),
         pa.array([-x[1] for x in flat], pa.int64())], names=["query", "doc_id", "score"])


def count(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``doc_id, n, at, tf``: terms of every text, and the places and counts of those in the vocabulary."""
    prepare_python(docs.sparkSession)
    place = {w: i for i, w in enumerate(vocabulary)}
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(partial(_count_batches, place=place), "doc_id long, n long, at array<int>, tf array<long>"))


def index(counted: DataFrame, scale: np.ndarray, docs: int, total: int) -> DataFrame:
    """One row per block of documents: the documents' sparse vectors in tree order, and the tree's nodes."""
    first = lambda i: F.try_element_at("at", F.lit(i))
    order = [first(1), first(2), first(3), F.col("n"), F.xxhash64("doc_id", "at", "tf")]
    ranged = counted.where(F.size("at") > 0).repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = ", ".join(f"{f} binary" for f in Tree.FIELDS)
    return ranged.mapInArrow(partial(_tree_batches, scale=scale, docs=docs, total=total), kinds)


def _merged(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _query_blocks(items: DataFrame) -> int:
    """Into how many hashed blocks the queries go, so that each holds at most ``QUERY_BYTES`` or is one text."""
    n = 1
    while True:
        per = (items.groupBy(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("b"))
               .agg(F.sum(F.octet_length("text")).alias("s"), F.count("*").alias("n")))
        if not per.where(f"s > {QUERY_BYTES} and n > 1").limit(1).count():
            return n
        n *= 2


def rank(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents with a score above 0.

    ``docs`` is ``(doc_id, text)`` and ``items`` ``(item_id, text)``; other columns don't matter.  Equal scores
    go by ascending id, a null id last.  Every row of ``docs`` is a document, repeated or not.  Items that
    repeat id and text count once; items that share an id only are ranked one by one.  Null and blank texts hold
    no term: such documents don't count among the documents, such items have no rows.  Empty tables give none.
    """
    spark = docs.sparkSession
    prepare_python(spark)
    asked = materialize(items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
                        .distinct(), "items")
    parts, out = _query_blocks(asked), None
    for part in range(parts):
        some = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()    # QUERY_BYTES or one text
        got = _rank_block(docs, sorted(((r["item_id"], terms(r["text"].encode())) for r in some), key=lambda r: (r[0] is None, r[0] or 0, r[1])), k)
        out = got if out is None else out.unionByName(got)
    discard(asked)
    return out


def _rank_block(docs: DataFrame, asked: list[tuple[int, list[bytes]]], k: int) -> DataFrame:
    spark = docs.sparkSession
    held = {}
    for i, (_, ws) in enumerate(asked):
        for w in filter(None, ws):
            per = held.setdefault(w, {})
            per[i] = per.get(i, 0) + 1
    vocabulary = sorted(held, key=lambda w: (len(held[w]), w))          # rare among the queries first
    counted = materialize(count(docs, vocabulary), "counts")
    n_docs, total = counted.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in counted.select(F.explode("at").alias("at")).groupBy("at").count().collect():     # as long as the vocabulary
        df[r["at"]] = r["count"]
    w = np.array([idf(n_docs, int(d)) for d in df], np.int64)
    scale = np.sqrt(np.maximum(w, 1).astype(np.float64))
    queries = []
    for cells in _by_query(held, vocabulary, len(asked)):
        cols = np.array(sorted(cells), np.int64)
        q = np.array([cells[c] for c in cols.tolist()], np.int64) * w[cols]
        use = (q > 0) & (df[cols] > 0)
        queries.append((cols[use], q[use], q[use] / scale[cols[use]]))
    blocks = materialize(index(counted, scale, max(n_docs, 1), max(total, 1)), "balltree")
    kind = "query int, doc_id long, score long"
    find = partial(_search_batches, queries=queries, width=len(vocabulary), k=k)
    floors = [1] * len(queries)
    probe = _merged(blocks.mapInArrow(partial(find, floors=floors, first_leaf=True), kind), k).where(F.col("rank") == k)
    for r in probe.collect():                                           # a row for each query
        floors[r["query"]] = max(1, r["score"])
    found = materialize(_merged(blocks.mapInArrow(partial(find, floors=floors, first_leaf=False), kind), k), "found")
    discard(counted, blocks)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(asked)], "query int, item_id long")
    return (found.join(F.broadcast(names), "query")                     # the block of queries, bounded above
            .select("item_id", "rank", "doc_id", "score"))


def _by_query(held: dict, vocabulary: list[bytes], n: int) -> list[dict[int, int]]:
    out = [{} for _ in range(n)]
    for p, w in enumerate(vocabulary):
        for i, times in held[w].items():
            out[i][p] = times
    return out
