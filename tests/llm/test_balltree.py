"""Ball-tree search against every document scored for every item."""

import heapq
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from churnlens.llm import balltree

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, score string, rank int, n int, at string, query string"
ITEMS = "item_id long, text string, doc_id string, score int"


def _terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(low)


def _plain(docs, items, k):
    counts = [(i, Counter(_terms(t))) for i, t in docs]
    n_docs = sum(1 for _, c in counts if c)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            n = sum(c.values())
            s = 0
            for t in _terms(text):
                if t in c:
                    m = 100 - 25 + 25 * n * n_docs // total
                    s += weight[t] * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(heapq.nsmallest(k, scored))]
    return out


def _corpus(seed, n=400):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["É", "ÀB", "naïve", "x1", "Grün"]
    draw = lambda m: " ".join(rng.choices(vocab, [1 / (i + 1) for i in range(len(vocab))], k=m))
    docs = [(i, draw(rng.randint(1, 120))) for i in range(n)]
    docs += [(1000 + i, docs[5][1]) for i in range(90)] + [(2000, None), (2001, ""), (2002, " \t!?."), (None, docs[6][1]), (None, draw(4))]
    docs += [(7, docs[7][1]), (7, draw(9)), (3000, draw(30000)), (3001, "W1 w1-W1_w2|É\x7fé w3"), (3002, "a b  w5")]
    items = [(i, draw(rng.randint(1, 25))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "nowhere at all"), (103, docs[5][1]), (103, docs[5][1]), (104, "W5 w5 w5, É"), (None, "w9 w8")]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_every_document_scored(spark, seed):
    docs, items = _corpus(seed)
    d = spark.createDataFrame([(i, t, "s", 3, 4, "a", "q") for i, t in docs], DOCS).repartition(4)
    q = spark.createDataFrame([(i, t, "d", 1) for i, t in items], ITEMS)
    got = balltree.rank(d, q, k=20).collect()
    distinct = list(dict.fromkeys(items))
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got) == Counter(_plain(docs, distinct, 20))


def test_queries_in_several_blocks_give_the_same(spark, monkeypatch):
    docs, items = _corpus(3, 120)
    monkeypatch.setattr(balltree, "QUERY_BYTES", 300)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items[:12], "item_id long, text string")
    got = balltree.rank(d, q, k=5).collect()
    assert Counter(map(tuple, got)) == Counter(_plain(docs, items[:12], 5))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert balltree.rank(none, items).count() == 0
    assert balltree.rank(spark.createDataFrame([(1, "w1 w2")], "doc_id long, text string"), items.limit(0)).count() == 0


def test_tree_prunes_groups_and_keeps_ties():
    rng = np.random.default_rng(4)
    width, rows = 400, []
    for g in range(20):                                                 # groups of like documents over terms of their own
        for _ in range(100):
            rows.append({20 * g + int(c): int(rng.integers(400_000, 410_000)) for c in rng.choice(20, 12, replace=False)})
    rows += [dict(rows[0]) for _ in range(50)]                          # exact ties
    ids = rng.permutation(len(rows)).astype(np.int64)
    lens = [len(r) for r in rows]
    at = np.concatenate([sorted(r) for r in rows]).astype(np.int64)
    x = np.concatenate([[r[c] for c in sorted(r)] for r in rows]).astype(np.int64)
    tree = balltree.Tree(ids, np.zeros(len(rows), bool), np.concatenate([[0], np.cumsum(lens)]), at, x, np.full(width, 50.0))
    again = balltree.Tree.of_row(tree.row())
    seen = 0
    for g in (0, 3, 11):
        cols = np.arange(20 * g, 20 * g + 9)
        q = np.full(9, 2500, np.int64)
        want = heapq.nsmallest(5, ((-sum(2500 * v for c, v in r.items() if c in cols), False, int(i)) for r, i in zip(rows, ids)))
        dense = np.zeros(width, np.int64)
        best, floor, n = balltree.visit(again, cols, q, q / 50.0, dense, [], 1, 5)
        assert best == want and floor == -want[-1][0] and not dense.any()
        bounds = tree.bounds(cols, q / 50.0)
        for node, (a, b) in enumerate(tree.spans):
            dense[cols] = q
            assert tree.score(node, dense).max() <= bounds[node]
            dense[cols] = 0
        seen += n
    assert seen < 0.5 * 3 * len(rows)
