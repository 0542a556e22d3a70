"""Queries ``opN_<name>`` over the given tables, with the digest columns of their contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import balltree, bpe, columnwise, decontam, hilbert, importance, lattice, linedist, rlz, shallot, simhash, toxicity, voronoi
from .common import table

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash_dedup(spark, sf_dir):
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op2_bpe(spark, sf_dir):
    path = vocabulary("byte_bpe_50k.json")
    full = bpe.round_trip(table(spark, sf_dir, "documents"), path)
    return full.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op3_hilbert_sharding(spark, sf_dir):
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", "n_chars", (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    out = hilbert.assign_shards(rows, ["source", "lang", "n_chars"], 24, ["text_crc32", "size", "doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "curve", "source", "lang", "n_chars")


@query
def op4_decontamination(spark, sf_dir):
    pairs = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=5, share=0.8)
    return pairs.select("doc_id", "item_id", "n_shingles", "n_shared", F.round("containment", 9).alias("containment"))


@query
def op5_substring_dedup(spark, sf_dir):
    cut = rlz.remove_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), window=50)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op6_toxicity(spark, sf_dir):
    scored = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", *[F.round(f"__p_{c}", 6).alias(f"p_{c}") for c in (*toxicity.SEEDS, "toxic")],
                         (F.col("__p_toxic") >= 0.5).cast("int").alias("toxic"))


@query
def op7_importance_resampling(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_key")


@query
def op8_html_extraction(spark, sf_dir):
    return linedist.extract(table(spark, sf_dir, "pages"))


@query
def op9_voronoi_topk(spark, sf_dir):
    vectors = voronoi.quantise(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", scale=256)
    return voronoi.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


@query
def op10_lattice_lm(spark, sf_dir):
    return lattice.score(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op11_shallot_clustering(spark, sf_dir):
    vectors = shallot.quantise(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", dims=64, scale=64)
    out = shallot.cluster(vectors, k=16, rounds=3, dims=64, seed=1)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                      shallot.centroid_digest().alias("centroid_sha256"))


@query
def op12_columnwise_bwt(spark, sf_dir):
    cut = columnwise.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=200)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op13_balltree_search(spark, sf_dir):
    return balltree.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)
