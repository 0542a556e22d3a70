"""Repeated byte strings against a dictionary of every window."""

import random
from collections import Counter

import numpy as np
import pytest

from churnlens.llm import columnwise

SCHEMA = "doc_id long, text string, kept string, n_bytes int, n_spans string, source string, spans string"


def _plain(texts, window):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + window] for b in data for i in range(len(b) - window + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i:i + window]] > 1:
                gone[i:i + window] = b"\1" * window
        runs = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def _texts(seed, window):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice("abcdefgh  é") for _ in range(n))
    passage, long = say(3 * window), say(20 * window)
    base = say(4 * window)
    texts = [None, "", " ", say(window - 1), say(window), base, base, base[:250] + "X" + base[251:], long, "tail " + long + " end"]
    texts += [say(rng.randint(0, 90)) + passage + say(rng.randint(0, 90)) for _ in range(12)]
    texts += [say(40) + passage[i:i + window + d] + say(30) for i, d in ((5, -1), (5, 0), (9, 1), (50, 60))]
    texts += ["a" * (window + 40), "ab" * window, say(60) + "a" * (window // 2) + say(60), base[10:10 + window] + "|" + base[10:10 + window]]
    return texts


@pytest.mark.parametrize("seed,window", [(1, 200), (2, 64), (3, 33)])
def test_equals_a_dictionary_of_windows(spark, seed, window):
    texts = _texts(seed, window)
    rows = [(i if i % 7 else None, t, "k", 1, "n", "s", "p") for i, t in enumerate(texts)] + [(5, texts[5], "k", 1, "n", "s", "p")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = columnwise.remove_repeats(df, window)
    assert got.columns == ["doc_id", "text", "source", "spans", "n_bytes", "n_removed", "n_spans", "kept"]
    want = Counter(zip([r[0] for r in rows], _plain([r[1] for r in rows], window)))
    assert Counter((r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))) for r in got.collect()) == want


def test_grams_with_many_reads_give_the_same(spark, monkeypatch):
    texts = _texts(4, 64)
    monkeypatch.setattr(columnwise, "MAX_READS", 3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in columnwise.remove_repeats(df, 64).collect()}
    assert got == dict(enumerate(_plain(texts, 64)))


def test_empty_table_and_window_range(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert columnwise.remove_repeats(none).count() == 0
    with pytest.raises(ValueError):
        columnwise.spans(none, 20)


def test_chunks_of_a_long_text_join(monkeypatch):
    rng = random.Random(6)
    text = bytes(rng.randrange(97, 102) for _ in range(5000))
    whole = columnwise.Sampler(64)
    one = np.concatenate([place for _, place, _, _ in whole.reads(text)])
    monkeypatch.setattr(columnwise, "CHUNK", 700)
    parts = list(columnwise.Sampler(64).reads(text))
    windows = np.concatenate([np.arange(a, b + 1) for _, _, first, last in parts for a, b in zip(first, last)])
    assert len(parts) > 1 and (windows == np.arange(5000 - 63)).all()
    assert set(np.concatenate([p[1] for p in parts])) == set(one)


@pytest.mark.parametrize("seed", range(4))
def test_collection_keeps_suffix_order_common_prefixes_and_transform(seed):
    rng = random.Random(seed)
    group = np.sort(np.array([rng.randrange(4) for _ in range(40)]))
    reads = [bytes(rng.choice(b"ab") for _ in range(rng.randint(3, 12))) for _ in group]
    symbols = np.full((40, 12), -1, np.int16)
    for i, r in enumerate(reads):
        symbols[i, 12 - len(r):] = list(r)
    work = columnwise.Collection(symbols, group)
    for column in range(11, -1, -1):
        before = work.order.copy()
        bwt = work.insert(column)
        assert (bwt == symbols[before, column]).all()
        suffix = lambda i: bytes(int(x) for x in symbols[i, column:] if x >= 0) if symbols[i, column] >= 0 else None  # noqa: B023, E731
        for g in range(4):
            own = [i for i in work.order.tolist() if group[i] == g and suffix(i) is not None]
            assert [suffix(i) for i in own] == sorted(suffix(i) for i in own)
        for k in range(1, 40):
            a, b = work.order[k - 1], work.order[k]
            if group[a] == group[b] and suffix(a) is not None and suffix(b) is not None:
                same = 0
                for x, y in zip(suffix(a), suffix(b)):
                    if x != y:
                        break
                    same += 1
                assert work.common[k] == same
