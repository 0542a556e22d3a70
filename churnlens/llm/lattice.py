"""Language-model scores by subword lattice likelihood.

An existing vocabulary gives the pieces and, by its scores, first weights.  A text is the sequence of its
words, each opened by the vocabulary's word mark, and one end; every way to segment it into pieces counts.
The pieces' weights are fitted to the distinct training words by expectation-maximisation.  Each training
word is also one arc across its lattice, weighted by its own count less a discount; the discounts are the
weight with which the paths over pieces are entered, so the weights of all words and the end add up to one.
A document's score is its marginal log10 probability over all paths.  None crosses a word mark, so that is
a sum over words, each computed once by a forward recursion in log space.
"""

from __future__ import annotations

from collections import Counter
from functools import partial
from math import exp, inf, log, log1p
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare_python, text_key

#: Most frequent words kept by every worker (the others meet their counts by a join), rounds of fitting,
#: and words a worker counts before it hands them on.
HEAD, ROUNDS, FLUSH = 150_000, 2, 400_000
MARK = b" "
LOG10 = log(10.0)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def pieces(model_path: str) -> list[tuple[bytes, float]]:
    """The vocabulary's pieces as bytes with log weights from its scores.

    The file's scores are negative ranks, so weights follow Zipf's law; single bytes rank last.  Pieces
    with a mark after their first character can't occur in a word and are left out.
    """
    import sentencepiece as sp

    m = sp.SentencePieceProcessor(model_file=model_path)
    out: dict[bytes, float] = {}
    for i in range(m.get_piece_size()):
        if m.is_byte(i):
            raw, rank = bytes([int(m.id_to_piece(i)[3:-1], 16)]), m.get_piece_size()
        elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
            continue
        else:
            raw, rank = m.id_to_piece(i).replace("▁", " ").encode(), -m.get_score(i)
        if MARK not in raw[1:]:
            out[raw] = out.get(raw, 0.0) + 1.0 / (rank + 2.0)
    total = sum(out.values())
    return [(p, log(w / total)) for p, w in out.items()]


class Lattice:
    """Pieces with their log weights, and every prefix of a piece (to end a search early).

    What a word's lattice holds up to a position depends on the characters before it alone, so the part
    that a word shares with the one before is kept; words in sorted order share most.
    """

    def __init__(self, names: list[bytes], weights):
        self.table: dict[bytes, tuple[int, float] | None] = {}
        for i, (p, w) in enumerate(zip(names, weights)):
            for n in range(1, len(p)):
                self.table.setdefault(p[:n], None)
            self.table[p] = (i, float(w))
        self.word = b""
        #: by position: log of the summed weights of all segmentations up to it; the pieces that end there, as
        #: start, piece and log weight of the paths through it; the starts from which a piece may go on
        self.alpha: list[float] = [0.0]
        self.ends: list[list[tuple[int, int, float]]] = [[]]
        self.live: list[list[int]] = [[]]

    def forward(self, word: bytes) -> float:
        """Log of the summed weights of all segmentations of a word, its mark in front."""
        word, last, get = MARK + word, self.word, self.table.get
        alpha, ends, live = self.alpha, self.ends, self.live
        same = 0
        for x, y in zip(word, last):
            if x != y:
                break
            same += 1
        del alpha[same + 1:], ends[same + 1:], live[same + 1:]
        for b in range(same + 1, len(word) + 1):
            on, here, total = [], [], -inf
            for a in (*live[b - 1], b - 1):
                hit = get(word[a:b], 0)
                if hit == 0:
                    continue
                on.append(a)
                if hit is not None:
                    x = alpha[a] + hit[1]
                    here.append((a, hit[0], x))
                    if total == -inf:
                        total = x
                    elif x > total:
                        total = x + log1p(exp(total - x))
                    elif x > -inf:
                        total += log1p(exp(x - total))
            alpha.append(total)
            ends.append(here)
            live.append(on)
        self.word = word
        return alpha[-1]

    def log10(self, word: bytes, arc: float = 0.0, enter: float = 1.0) -> float:
        """Marginal log10 weight of a word, its mark in front: its own arc, and the paths over pieces."""
        paths = log(enter) + self.forward(word)
        if arc <= 0.0:
            return paths / LOG10
        return (log(arc) + log1p(exp(min(paths - log(arc), 700.0)))) / LOG10

    def expect(self, word: bytes, into) -> None:
        """Adds the expected uses of each piece in a word."""
        self.forward(word)
        alpha, ends = self.alpha, self.ends
        n = len(alpha) - 1
        share = [0.0] * n + [1.0]                       # expected segmentations through each position
        for b in range(n, 0, -1):
            here = share[b]
            if here > 0.0:
                if len(ends[b]) == 1:
                    a, i, _ = ends[b][0]
                    share[a] += here
                    into[i] += here
                else:
                    top = alpha[b]
                    for a, i, x in ends[b]:
                        part = here * exp(x - top)
                        share[a] += part
                        into[i] += part


def _binary(col: pa.Array) -> list[bytes | None]:
    return pc.cast(col, pa.binary()).to_pylist()


def _count_batches(batches):
    """Words of training documents counted, words of held-out ones noted with 0."""
    counts: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                          names=["word", "c"])

    for b in batches:
        for text, held in zip(_binary(b.column(0)), b.column(1).to_pylist()):
            ws = (text or b"").lower().split()
            if held:
                for w in ws:
                    if w not in counts:
                        counts[w] = 0
            else:
                counts.update(ws)
        if len(counts) >= FLUSH:
            yield out()
            counts.clear()
    yield out()


def _expect_batches(batches, names, weights):
    lattice, into = Lattice(names.value, weights), [0.0] * len(names.value)
    for b in batches:
        for word in b.column(0).to_pylist():
            lattice.expect(word, into)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(into), dtype=np.int32)), pa.array(into, pa.float64())], names=["piece", "uses"])


def _score_batches(batches, names, weights, rates):
    lattice = Lattice(names.value, weights)
    for b in batches:
        lp = [lattice.log10(w, (c - rates.discount) / rates.total if c else 0.0, rates.enter)
              for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lp, pa.float64())], names=["word", "c", "lp"])


def _split_batches(batches, head):
    """A row for each rare word of a document, and one with the sums over its frequent words."""
    table = head.value
    for b in batches:
        out: list[tuple] = []
        for i, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _binary(b.column(2))):
            ws = (text or b"").lower().split()
            base = model = 0.0
            known, rare = 0, Counter()
            for w, n in Counter(ws).items():
                hit = table.get(w)
                if hit is None:
                    rare[w] = n
                else:
                    base += n * hit[0]
                    model += n * hit[1]
                    known += n * hit[2]
            # no word holds a blank, so this name meets none; it spreads these rows over the join's tasks
            out.append((i, key, b" %d" % key, 1, len(ws) + 1, known, base, model))
            out.extend((i, key, w, n, 0, 0, 0.0, 0.0) for w, n in rare.items())
        cols = list(zip(*out)) if out else [[]] * 8
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                         names=["doc_id", "key", "word", "tf", "n", "known", "base", "model"])


class Rates(NamedTuple):
    """Share of a word's count that its arc gives up, the sum of all counts (two added), and the weights
    of the paths over pieces and of the end."""

    discount: float
    total: float
    enter: float
    end: float


def rates(tokens: int, words: int, once: int, twice: int, ends: int) -> Rates:
    """Absolute discounting, the discount estimated from the numbers of words seen once and twice.

    One added to the paths' and to the end's count keeps both possible without training text.
    """
    discount = min(once / (once + 2.0 * twice), 0.95) if once else 0.0
    return Rates(discount, tokens + 2.0, (discount * words + 1.0) / (tokens + 2.0), (ends + 1.0) / (tokens + 2.0))


def fit(counts: DataFrame, model_path: str, rounds: int = ROUNDS):
    """``counts(word, c)`` of the training text → the pieces (broadcast) and their log weights.

    Each distinct word counts once: the pieces stand for words yet unseen.  The E-step runs over the words
    in tasks; one row for each piece of the fixed vocabulary reaches the driver.
    """
    start = pieces(model_path)
    names = counts.sparkSession.sparkContext.broadcast([p for p, _ in start])
    weights = np.array([w for _, w in start])
    for _ in range(rounds):
        uses = np.full(len(weights), 0.01)             # keeps unseen pieces possible
        rows = (counts.where("c > 0").select("word").mapInArrow(partial(_expect_batches, names=names, weights=weights), "piece int, uses double")
                .groupBy("piece").agg(F.sum("uses").alias("uses")).collect())
        for r in rows:
            uses[r["piece"]] += r["uses"]
        weights = np.log(uses / uses.sum())
    return names, weights


def score(docs: DataFrame, model_path: str, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    A null or empty text has the end as its one token.  Without training text the pieces keep their first
    weights and the end has one half.  A null id counts as training.  Rows that repeat
    id and text each get a row; an empty table gives an empty table; other columns are not read.
    """
    spark = docs.sparkSession
    prepare_python(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    counts = materialize(rows.select("text", held_out().alias("held")).mapInArrow(_count_batches, "word binary, c long")
                         .groupBy("word").agg(F.sum("c").alias("c")).sortWithinPartitions("word"), "counts")
    n_train = docs.select(held_out().alias("h")).where("not h").count()
    seen = [F.count(F.when(x, 1)) for x in (F.col("c") > 0, F.col("c") == 1, F.col("c") == 2)]
    total, n_words, once, twice = counts.agg(F.sum("c"), *seen).first()
    total, distinct = (total or 0) + n_train, n_words + (n_train > 0)
    names, weights = fit(counts, model_path, rounds if n_words else 0)
    rate = rates(total, n_words, once, twice, n_train)
    scored = materialize(counts.mapInArrow(partial(_score_batches, names=names, weights=weights, rates=rate), "word binary, c long, lp double")
                         .select("word", F.log10(F.col("c") + 1.0).alias("lc"), "lp", (F.col("c") > 0).cast("int").alias("seen"), "c"),
                         "words")
    # frequent words by size class of their count: whole classes, from the top, while HEAD words hold them
    grade = F.floor(F.log2(F.col("c") + 1.0) * 16).cast("int")
    classes = sorted(scored.where("c > 0").groupBy(grade.alias("g")).count().collect(), reverse=True)
    lowest, room = 1 << 30, HEAD
    for g, n in classes:
        if n > room:
            break
        lowest, room = g, room - n
    head = {bytes(r["word"]): (r["lc"], r["lp"], r["seen"]) for r in
            scored.where((F.col("c") > 0) & (grade >= lowest)).select("word", "lc", "lp", "seen").collect()}
    head = spark.sparkContext.broadcast(head)
    split = rows.mapInArrow(partial(_split_batches, head=head), "doc_id long, key long, word binary, tf long, n long, "
                                                                "known long, base double, model double")
    # a document's own row has n > 0 and stands for itself; a rare word's row takes its numbers from the join
    own = F.col("n") > 0
    parts = (split.join(scored.select("word", "lc", "lp", "seen"), "word", "left")
             .groupBy("doc_id", "key").agg(
                 F.sum(F.when(own, 1).otherwise(0)).alias("copies"), F.sum("n").alias("n"),
                 F.sum(F.when(own, F.col("known")).otherwise(F.col("tf") * F.coalesce("seen", F.lit(0)))).alias("known"),
                 F.sum(F.when(own, F.col("base")).otherwise(F.col("tf") * F.coalesce("lc", F.lit(0.0)))).alias("base"),
                 F.sum(F.when(own, F.col("model")).otherwise(F.col("tf") * F.coalesce("lp", F.lit(0.0)))).alias("model")))
    end_base = float(np.log10(n_train + 1.0))
    norm = float(np.log10(total + distinct + 1.0))
    end_model = float(np.log10(rate.end))
    each = lambda c: F.col(c) / F.col("copies")
    n_tokens = each("n").cast("long")
    return (parts.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("doc_id", held_out().alias("held_out"), n_tokens.alias("n_tokens"),
                    (each("known").cast("long") + F.lit(int(n_train > 0))).alias("n_known"),
                    F.lit(int(total)).cast("long").alias("train_tokens"),
                    (each("base") + F.lit(end_base) - n_tokens * F.lit(norm)).alias("base_score"),
                    (each("model") + F.lit(end_model)).alias("score")))
