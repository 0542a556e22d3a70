"""Each training-data operator against a brute-force version on small rows with nulls, blanks, ties,
repeats, long texts, empty tables and columns whose names clash."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from churnlens.llm import bpe, decontam, hilbert, importance, lattice, linedist, rlz, simhash, toxicity, voronoi
from churnlens.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, rank int, key string, shard string"
VOCAB = public_tokenizers.path("byte_bpe_50k.json")


def _texts():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, long = say(70), say(9000)
    base = say(120)
    near = base.split()
    near[60] = "other"
    return [None, "", "  \t\n ", "one", "one two", base, base, " ".join(near), say(30) + " " + passage + " " + say(25),
            passage + "\n" + say(12), long, long + " tail", "É " + base.upper(), say(49), say(50), "a b  c\x0bd <|endoftext|> x"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i else None, len(t) if t else None, "x", 1, "k", "s") for i, t in enumerate(_texts())]
    rows += [(None, _texts()[5], None, None, None, "x", 1, "k", "s"), (3, "one", "en", "s0", 3, "x", 1, "k", "s")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _print(text):
    ws = (text or "").encode().lower().split()
    grams = [b" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else ([b" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def test_simhash(spark, docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    prints = [(r["doc_id"], r["fp"] & (1 << 64) - 1) for r in got]
    assert Counter(prints) == Counter((r["doc_id"], _print(r["text"])) for r in docs.collect())
    group = list(range(len(prints)))
    for _ in prints:
        for i, (_, a) in enumerate(prints):
            for j, (_, b) in enumerate(prints):
                if (a ^ b).bit_count() <= 2:
                    group[i] = group[j] = min(group[i], group[j])
    least = {}
    for g, (i, _) in zip(group, prints):
        least[g] = min(x for x in (least.get(g), i) if x is not None) if i is not None or g in least else None
    assert Counter(r["component_id"] for r in got) == Counter(least[g] for g in group)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_ball_links_connect_what_all_pairs_do(spark, bits):
    rng = random.Random(bits)
    fps = [rng.getrandbits(63) for _ in range(12)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 4))) for f in fps for _ in range(3)]
    fps = sorted(set(fps))
    found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), bits).collect()
    def classes(pairs):
        of = {f: f for f in fps}
        for _ in fps:
            for a, b in pairs:
                of[a] = of[b] = min(of[a], of[b])
        return of
    assert classes([(r["u"], r["v"]) for r in found]) == classes(
        [(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= bits])


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(200, 260)]}


def test_bpe_equals_the_library(spark, docs, empty):
    lib = Tokenizer.from_file(VOCAB)
    got = bpe.decode(bpe.encode(docs, VOCAB), VOCAB).collect()
    want = Counter()
    for r in docs.collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"], tuple(ids), lib.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got) == want
    assert bpe.encode(empty, VOCAB).count() == 0
    assert bpe.round_trip(empty, VOCAB).count() == 0
    both = bpe.round_trip(docs, VOCAB).collect()
    assert sorted(map(str, both)) == sorted(map(str, got))


def test_bpe_forgets_words_but_not_results(monkeypatch):
    lib, codec = Tokenizer.from_file(VOCAB), bpe.Codec(open(VOCAB, encoding="utf-8").read())
    monkeypatch.setattr(bpe, "MAX_KNOWN", 3)
    texts = ["one two  three", "two four.\nfive", " ", None, "one\tsix two", "\x1c x", "five five"] * 3
    got = [codec.encode_all(texts[i:i + 2]) for i in range(0, len(texts), 2)]
    want = [e.ids for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [g.tolist() for part in got for g in part] == want


def test_bpe_on_random_text():
    lib, codec = Tokenizer.from_file(VOCAB), bpe.Codec(open(VOCAB, encoding="utf-8").read())
    rng = random.Random(2)
    for alphabet in ("abcdeht \n'.19é", "aehint ", "日本語🙂  \t\x1ca࢏՘"):
        for _ in range(1500):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            ids = lib.encode(t, add_special_tokens=False).ids
            assert list(codec.encode(t)) == ids


def test_hilbert_shards(spark, docs, empty):
    rows = docs.select("doc_id", "source", "lang", "n_chars")
    got = hilbert.assign_shards(rows, ["source", "lang", "n_chars"], 5, ["doc_id"]).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == docs.count() and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    assert hilbert.assign_shards(empty.select("doc_id", "source", "n_chars"), ["source", "n_chars"], 5, ["doc_id"]).count() == 0


def _cells(values, bits):
    """Number of quantile cuts at or below each value; the cuts by sorting whole columns."""
    some = sorted((v for v in values if v is not None), key=lambda v: v.encode() if isinstance(v, str) else v)
    n, parts = len(some), 1 << bits
    cuts = sorted({some[max(math.ceil(i * n / parts), 1) - 1] for i in range(1, parts)}) if n else []
    return [0 if v is None else sum(c <= v for c in cuts) for v in values]


def _curve(point, bits):
    """Hilbert index by Skilling's transform, one point at a time."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        t ^= (q - 1) if x[n - 1] & q else 0
        q >>= 1
    x = [v ^ t for v in x]
    return sum((x[i] >> b & 1) << (b * n + n - 1 - i) for b in range(bits) for i in range(n))


def test_hilbert_shards_equal_a_plain_version_and_keep_all_columns(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice([None, "a", "b", "Zé", "crawl-1", "crawl-2"]), rng.choice([None, *range(40)]), i % 7, "r", "t", "x", "v", "s") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_chars long, rank int, total string, x0 string, part string, v string, slot string")
    got = hilbert.assign_shards(df, ["source", "n_chars"], 7, ["doc_id"], bits=3)
    assert got.columns == [*(c for c in df.columns if c != "slot"), "curve", "shard", "slot"]
    curve = [_curve(p, 3) for p in zip(_cells([r[1] for r in rows], 3), _cells([r[2] for r in rows], 3))]
    order = sorted(range(300), key=lambda i: (curve[i], i))
    want = {}
    for place, i in enumerate(order):
        shard = place * 7 // 300
        want[i] = (curve[i], shard, place - -(-shard * 300 // 7))
    assert {r["doc_id"]: (r["curve"], r["shard"], r["slot"]) for r in got.collect()} == want
    assert all(r["rank"] == r["doc_id"] % 7 and r["total"] == "r" and r["x0"] == "t" for r in got.collect())


def test_hilbert_curve_steps_to_neighbours(spark):
    cells = spark.range(8 ** 3).selectExpr("CAST(id % 8 AS int) x0", "CAST(id div 8 % 8 AS int) x1", "CAST(id div 64 AS int) x2",
                                           "id % 8 a", "id div 8 % 8 b", "id div 64 c")
    path = [(r["a"], r["b"], r["c"]) for r in hilbert.hilbert_index(cells, 3, 3).orderBy("curve").collect()]
    assert all(sum(abs(p - q) for p, q in zip(s, t)) == 1 for s, t in zip(path, path[1:]))


def test_shard_files_prune(spark, docs, tmp_path):
    rows = docs.select("doc_id", "source", "lang", "n_chars").where("doc_id is not null")
    sharded = hilbert.assign_shards(rows, ["source", "n_chars"], 4, ["doc_id"])
    hilbert.write_shards(sharded, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.count()
    assert hilbert.zone_map(sharded, ["n_chars"]).agg(F.sum("n_rows")).first()[0] == rows.count()


def _grams(text):
    ws = (text or "").lower().split()
    return {" ".join(ws[i:i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({" ".join(ws)} if ws else set())


def test_decontamination(spark, docs, empty):
    passage = docs.where("doc_id = 9").first()["text"].split("\n")[0].split()
    items = [(1, " ".join(passage[:40])), (2, " ".join(passage[:20] + ["zz"] + passage[20:60])), (3, "one"), (4, None),
             (5, "never seen words in any of these documents at all"), (6, " ".join(passage[:12]).upper()), (1, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in decontam.contaminated(docs, bench).collect())
    want = Counter()
    for d in docs.collect():
        for i, t in items:
            g = _grams(t)
            shared = len(g & _grams(d["text"]))
            if g and shared * 5 >= len(g) * 4:
                want[d["doc_id"], i, len(g), shared] += 1
    assert got == want and len(want) > 5
    clean = decontam.drop_contaminated(docs, bench)
    bad = {k[0] for k in want}
    assert clean.columns == docs.columns and not bad & {r["doc_id"] for r in clean.where("doc_id is not null").collect()}
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_substring_dedup(spark, docs, empty):
    rows = [r for r in docs.collect()]
    first = {}
    for r in rows:
        ws = (r["text"] or "").encode().split()
        for i in range(len(ws) - 49):
            if r["doc_id"] is not None:
                k = tuple(ws[i:i + 50])
                first[k] = min(first.get(k, r["doc_id"]), r["doc_id"])
    want = Counter()
    for r in rows:
        ws = (r["text"] or "").encode().split()
        hit = [False] * len(ws)
        for i in range(len(ws) - 49):
            if r["doc_id"] is not None and first[tuple(ws[i:i + 50])] < r["doc_id"]:
                hit[i:i + 50] = [True] * 50
        kept = b" ".join(w for w, h in zip(ws, hit) if not h)
        want[r["doc_id"], len(ws), sum(hit), kept.decode()] += 1
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in rlz.remove_spans(docs).collect())
    assert got == want and sum(k[2] for k in want) > 9000
    cut = rlz.drop_repeats(docs)
    assert cut.columns == docs.columns and cut.where("doc_id = 15").first()["text"] == rows[15]["text"]
    assert rlz.remove_spans(empty).count() == 0


def test_toxicity_on_held_out_rows(spark, empty):
    rng = random.Random(1)
    say = lambda: [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(5, 80))]
    rows, labels = [], []
    for i in range(600):
        ws, bad = say(), i % 6 == 0
        if bad:
            ws += rng.sample(["idiot", "moron", "scum", "trash", "clown"], 3)
        rng.shuffle(ws)
        rows.append((i, " ".join(ws), 1.0))
        if i < 300:
            labels.append((i, int(bad) if i % 25 else 1 - int(bad)))      # some labels are wrong
    rows += [(None, None, 0.0), (601, "", 0.0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, probability double")
    lab = spark.createDataFrame(labels + [(None, 1), (2, None)], "doc_id long, toxic int")
    out = toxicity.score(d, lab).collect()
    assert len(out) == len(rows)
    assert all((r["__p_toxic"] >= 0.5) == (r["doc_id"] % 6 == 0) for r in out if r["doc_id"] is not None and 300 <= r["doc_id"] < 600)
    assert all(r["__p_toxic"] < 0.5 for r in out if not r["text"])
    kept = toxicity.drop_toxic(d, lab)
    assert kept.columns == d.columns
    assert toxicity.drop_toxic(d, lab.limit(0)).count() == len(rows)
    assert toxicity.score(empty, lab).count() == 0


def test_importance_resampling(spark, docs, empty):
    labels = spark.createDataFrame([(5, 1), (8, 1), (13, 0), (15, 0)], "doc_id long, quality int")
    got = importance.resample(docs, labels, keep=0.5).collect()
    n = docs.count()
    assert len(got) == n and sum(r["selected"] for r in got) == round(n / 2)
    assert sorted(r["rank"] for r in got) == list(range(n))
    def counts(texts):
        c = np.ones(importance.BUCKETS)
        for t in texts:
            for x in importance.buckets((t or "").encode()):
                np.add.at(c, x, 1)
        return np.log(c / c.sum())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ratio = counts([texts[5], texts[8]]) - counts([r["text"] for r in docs.collect()])
    for r in got:
        t = texts[r["doc_id"]] if r["doc_id"] is not None else texts[5]
        assert abs(r["log_weight"] - sum(ratio[x].sum() for x in importance.buckets((t or "").encode()))) < 1e-6
    assert importance.resample(empty, labels).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><article>x</article>";</script><style>p{}</style></head><body>
<header><a href="/">Home</a> Site name</header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- <p>gone</p> -->
<div class="cookie-notice">We use cookies and this notice is rather long, long enough to be taken for text by its length alone, or so.</div>
<article><h1>Head &amp; line</h1><p><b>First  para
graph &eacute;&#33; %s<br><p>a &lt; b</p><p>End.</p><form><input><p>Sign</p></form>
<div class="ad">Buy</div><p>After.</p></article><aside>Side</aside><div id="comments"><p>Nice post, I would say, though it could be longer than it is now, and it is long already.</p></div>
<footer>&copy; x</footer></body></html>"""


def test_html_extraction(spark):
    body = "word " * 40
    rows = [(1, "u", PAGE % body), (1, "u", PAGE % body), (2, "u", None), (3, None, ""), (4, "u", "just text &amp; more"),
            (5, "u", "<div><p>" + body + "</p><p>tail</p></div><div class='sidebar'>" + body + "</div>"),
            (6, "u", "<nav>only <a>menus"), (7, "u", "<p>" + "x " * 200000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in linedist.extract(d).collect()}
    assert got[1]["text"] == "\n\n".join(["Head & line", "First para graph é! " + body.strip(), "a < b", "End.", "After."])
    assert (got[2]["text"], got[3]["text"], got[4]["text"], got[6]["text"]) == ("", "", "just text & more", "")
    assert got[5]["text"] == body.strip() + "\n\ntail"
    assert got[7]["n_chars"] == 399999 and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert linedist.extract(d.limit(0)).count() == 0


def test_voronoi_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in rng.normal(size=6).round(2)], "c") for i in range(400)]
    rows += [(i, rows[7][1], "c") for i in range(400, 480)]                      # ties
    rows += [(500, None, "c"), (501, [1.0, None], "c"), (502, [float("nan")] * 6, "c"), (None, rows[0][1], "c"),
             (550, [0.0] * 6, "c"), (551, [], "c"), (7, rows[7][1], "c")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell string")
    v = voronoi.quantise(d, "vec_id", "embedding")
    data = [(r["vec_id"], np.array(list(r["v"]) + [0] * (6 - len(r["v"])))) for r in v.collect()]      # every row is a candidate
    got = voronoi.top_k(v, v.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect()
    want = []
    for q, x in sorted((i, y) for i, y in data if i % 50 == 0):
        best = sorted((-int(x @ y), i) for i, y in data if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == want
    assert voronoi.top_k(v.limit(0), v.limit(0)).count() == 0


def test_lattice_scores(spark, docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = lattice.score(docs, path, rounds=1).collect()
    rows = docs.collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [r["text"] or "" for r in rows if not held(r["doc_id"])]
    c = Counter(w for t in train for w in t.encode().lower().split())
    n, v = sum(c.values()) + len(train), len(c) + 1
    start = lattice.pieces(path)
    uses, first = np.full(len(start), 0.01), lattice.Lattice([p for p, _ in start], [w for _, w in start])
    for w in c:
        first.expect(w, uses)
    model = {p: x for (p, _), x in zip(start, uses / uses.sum())}
    once, twice = (sum(k == j for k in c.values()) for j in (1, 2))
    give = min(once / (once + 2 * twice), 0.95)
    def marginal(word):
        f = [1.0] + [0.0] * len(word)
        for b in range(1, len(word) + 1):
            f[b] = sum(f[a] * model.get(word[a:b], 0.0) for a in range(b))
        own = (c[word[1:]] - give) / (n + 2) if c[word[1:]] else 0.0
        return math.log10(own + (give * len(c) + 1) / (n + 2) * f[-1])
    want = []
    for r in rows:
        ws = (r["text"] or "").encode().lower().split()
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) + math.log10((len(train) + 1) / (n + v + 1))
        want.append((-1 if r["doc_id"] is None else r["doc_id"], held(r["doc_id"]), len(ws) + 1, sum(c[w] > 0 for w in ws) + 1, n, base,
                     sum(marginal(b" " + w) for w in ws) + math.log10((len(train) + 1) / (n + 2))))
    have = [(-1 if r["doc_id"] is None else r["doc_id"], *r[1:]) for r in got]
    for a, b in zip(sorted(have), sorted(want), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)
    assert lattice.score(empty, path).count() == 0


def test_pipeline_runs_and_keeps_clean_rows(spark, tmp_path, docs):
    import corpus_pipeline
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "no such item in here at all today")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lib = Tokenizer.from_file(VOCAB)
    assert {r["doc_id"] for r in out} >= {0, 3, 4, 5, 8, 9, 10, 13, 14, 15}
    assert all(list(r["ids"]) == lib.encode(r["text"], add_special_tokens=False).ids for r in out)
    assert [hashlib.md5(r["text"].encode()).hexdigest() for r in out if r["doc_id"] == 5] == [hashlib.md5(_texts()[5].encode()).hexdigest()]


def test_toxicity_does_not_depend_on_the_order_of_rows(spark):
    rows = [(i, ("you idiot trash " if i % 3 == 0 else "a calm text ") + f"word{i % 40}") for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0 or i % 50 == 7)) for i in range(240)], "doc_id long, toxic int")
    def run(order):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(len(order) % 5 + 2)
        return sorted(tuple(r) for r in toxicity.score(docs, labels).select("doc_id", "__p_toxic").collect())
    assert run(rows) == run(rows[::-1]) == run(rows[100:] + rows[:100])


@pytest.mark.parametrize("attrs", ['style="overflow:hidden"', 'title="a hidden gem"', 'data-hidden="false"', "data-id=sidebar",
                                   'title="class=menu"', "data-role='navigation'", 'alt="" x-class="ads"'])
def test_values_and_other_names_are_no_attributes(attrs):
    text = "The body of the article stands here. " * 5
    assert linedist.main_text(f"<body><div {attrs}><p>{text}</p></div></body>") == text.strip()


@pytest.mark.parametrize("attrs", ["hidden", "HIDDEN=''", "class=sidebar", 'title="x" CLASS="a menu"', "aria-hidden = 'true'", "a=b id='nav'/"])
def test_hidden_and_side_elements_are_left_out(attrs):
    text = "The body of the article stands here. " * 5
    assert linedist.main_text(f"<body><p>{text}</p><div {attrs}><p>{text} aside</p></div></body>") == text.strip()


@pytest.mark.parametrize("head", ["<head><title>x</title><body>", "<head><meta charset=utf-8><style>p {}</style><title>x</title></head><body>",
                                  "<HEAD><title>x</title><script>var a = '<p>no</p>';</script><BODY class=page>"])
def test_a_head_without_its_end_tag_hides_no_page(head):
    text = "The body of the article stands here. " * 5
    assert linedist.main_text(f"<html>{head}<article><p>{text}</p></article></body></html>") == text.strip()


def test_short_lines_of_an_article_stay():
    body, short, link = "word " * 59 + "words", "The short end of it", "<p><a href=x>See the rest</a></p>"
    aside = "<aside>Buy this</aside>"
    # no article element: a short run after the body and in the same parent, not one elsewhere
    page = f"<body><div><p>{body}</p>{aside}<p>{short}.</p><ul><li>One</ul>{aside}<p>{short}</p></div><nav>Menu</nav><div><p>Legal note</p></div></body>"
    assert linedist.main_text(page) == "\n\n".join([body, short + ".", "One", short])
    cells = f"<table><tr><td><p>{body}</p>{aside}<p>{short}</p><td><form>x</form><p>Other cell</p></table>"
    assert linedist.main_text(cells) == f"{body}\n\n{short}"
    # within an article links are text, wherever they stand
    assert linedist.main_text(f"<article><p>{body}</p>{link}</article>") == f"{body}\n\nSee the rest"
    got = linedist.main_text(f"<main><p>{body}</p>{link * 4}<p>{short}</p></main><p>{body}</p>")
    assert got == "\n\n".join([body, *["See the rest"] * 4, short])
    assert linedist.main_text(f"<nav>x</nav><main>{link}</main>") == "See the rest"
    # an article of links alone doesn't hide the body beside it
    assert linedist.main_text(f"<div><p>{body}</p></div><article>{link}</article>") == body


def test_voronoi_with_many_vectors_of_one_id(spark):
    rng = random.Random(4)
    rows = [(0, [1000 + i, 3]) for i in range(12)] + [(i, [10 + i, -i]) for i in range(1, 8)]
    rows += [(100 + i % 5, [rng.randint(-500, 500), rng.randint(-500, 500)]) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, v array<long>")
    for data in (v.where("vec_id < 100"), v):
        got = Counter(tuple(r) for r in voronoi.top_k(data, data, 5).select("query_id", "vec_id", "score").collect())
        have, exp = [tuple(r) for r in data.collect()], Counter()
        for q in {i for i, _ in have}:
            met = sorted((-sum(a * b for a, b in zip(x, y)), j) for i, x in have if i == q for j, y in have if j != q)
            exp.update((q, j, -s) for s, j in met[:5])
        assert got == exp


def test_strings_are_quantised_by_their_whole_value(spark):
    names = sorted(["https://example.org/%03d" % i for i in range(40)] + ["crawl-2024-01", "crawl-2024-02", "", "é", "zebra"], key=str.encode)
    rows = [(n, float(i)) for i, n in enumerate(names) for _ in range(1 + i % 3)] + [(None, None)] * 2
    df = spark.createDataFrame(rows, "s string, place double")
    got = hilbert.quantise(df, ["s", "place"], 3).collect()
    # a string's cell is that of its place in the order
    assert all(r["x0"] == r["x1"] for r in got) and {r["x0"] for r in got if r["s"]} == set(range(8))
    assert all(r["x0"] == 0 for r in got if r["s"] is None)
    assert hilbert.quantise(df.limit(0), ["s"], 3).count() == 0


def test_voronoi_every_row_is_a_candidate(spark):
    rows = [(1, [3])] * 3 + [(2, [2])] * 2 + [(3, [1]), (50, [1]), (50, [1])]
    v = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = voronoi.top_k(v, v.where("vec_id = 50"), 5).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 2, 2), (5, 2, 2)]


def test_spans_beside_columns_of_the_same_names(spark):
    words = " ".join(f"w{i}" for i in range(80))
    rows = [(1, words, "a", 1, "k", "t"), (2, "x " + words, "b", 2, "l", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_words int, kept_text string, __own string")
    cut = rlz.remove_spans(df)
    assert cut.columns == ["doc_id", "text", "spans", "__own", "n_words", "n_removed", "kept_text"]
    assert [(r["spans"], r["__own"], r["n_words"], r["n_removed"]) for r in cut.orderBy("doc_id").collect()] == [("a", "t", 80, 0), ("b", "u", 81, 80)]
    left = rlz.drop_repeats(df).orderBy("doc_id").collect()
    assert [tuple(r) for r in left] == [rows[0], (2, "x", "b", 2, "l", "u")]


def test_bodies_equal_a_plain_reading_of_the_distribution():
    rng = random.Random(3)
    for _ in range(300):
        size = [rng.choice([0, 0, 0, 5, 40, 200]) for _ in range(rng.randint(0, 30))]
        length = lambda i: sum(size[i:i + linedist.WINDOW]) if 0 <= i < len(size) else 0  # noqa: B023, E731
        surges = [i for i in range(len(size)) if length(i) and not length(i - 1)]
        want = []
        for a in surges:
            b = next((j for j in range(a, len(size)) if not length(j)), len(size))
            want.append((a, b, max(length(j) for j in range(a, b))))
        assert linedist.bodies(size) == want
        kept = {i for a, b, _ in want for i in range(a, b)}
        assert all((i in kept) == any(size[i:i + linedist.WINDOW]) for i in range(len(size)))


def test_article_text_is_kept_whatever_it_is_named():
    body = "A paragraph of reading text that is long enough to pass the threshold of a body, by some margin, for sure."
    link = '<a href="/x">another page</a> <a href="/y">and one more</a>'
    page = lambda inner: f"<nav>menu</nav><article>{inner}</article><div class='ad'>buy</div>"
    for inner, want in (
            (f'<h2 id="social-history">Head</h2><p>{body}</p>', f"Head\n\n{body}"),
            (f'<section id="related-work"><h3>Work</h3><p>{body}</p></section>', f"Work\n\n{body}"),
            (f'<h2 id="alert">T</h2><p class="foot">{body}</p>', f"T\n\n{body}"),
            (f"<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold.</p><p>{body}</p>", f"Let x=1 hold.\n\n{body}"),
            (f"<p>{body}</p><object data=a><p>tail", f"{body}\n\ntail"),
            (f"<p>{body}</p><video><p>tail", f"{body}\n\ntail"),
            (f'<p>{body}</p><div class="related">{link}</div><p>tail</p>', f"{body}\n\ntail"),
            (f'<div class="recommendations"><p>{body}</p><div>{link}</div></div><p>tail</p>', f"{body}\n\nanother page and one more\n\ntail"),
            (f'<p>{body}</p><div class="comments"><p>{body}</p></div>', body),
            (f"<p>{body}</p><noscript>turn it on</noscript><script>var a = '<p>'", body)):
        assert linedist.main_text(page(inner).removesuffix("<div class='ad'>buy</div>")) == want, inner
    # the same marks outside an article
    assert linedist.main_text(f'<div class="social">{link}</div><p>{body}</p>') == body


def test_the_distribution_decides_on_marked_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for r in pages:
        rows = linedist.lines(r["html"])
        size, marked = linedist.weights(rows)
        text = [rows[i][0] for a, b, _ in linedist.bodies(size) for i in range(a, b) if rows[i][2] and rows[i][0]]
        assert marked and linedist.main_text(r["html"]) == "\n\n".join(text) != ""
