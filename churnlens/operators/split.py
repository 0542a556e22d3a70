"""Deterministic train / validation / test assignment and class weights.

The split is stratified exactly: of each class as many rows go to the test set as the share asks (largest
remainders), those with the smallest seeded md5 of their key; the validation set is taken likewise from the
rest.  No row is sorted or ranked: the k-th smallest hash of a class is found by refining a histogram over hash
prefixes, one aggregate of at most ``16**STEP`` counts per class and round, and the split itself is a plain
comparison per row that needs no shuffle and is portable to SQL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S

STEP = 3                                     # hex digits that a round of refinement looks at


def hash_of(key: str, seed: int, part: str = "") -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}{part}")))


def stratified(sizes: dict, share: float) -> dict:
    """How many of each class make up ``ceil(share * all)`` rows in the classes' proportions (largest remainders,
    ties in the order of the classes)."""
    total = sum(sizes.values())
    wanted = math.ceil(share * total)
    exact = {c: wanted * n / total for c, n in sizes.items()}
    out = {c: math.floor(x) for c, x in exact.items()}
    rest = sorted(sizes, key=lambda c: (-(exact[c] - out[c]), c is not None, c or 0))[:wanted - sum(out.values())]
    return {c: n + (c in rest) for c, n in out.items()}


def _cells(rows: DataFrame, at: int) -> dict:
    """Per class the rows by the hash digits behind the first ``at``: at most ``16**STEP`` counts each."""
    cells: dict = {}
    for r in rows.groupBy("c", F.substring("h", at + 1, STEP).alias("cell")).count().collect():
        cells.setdefault(r["c"], []).append((r["cell"], r["count"]))
    return cells


def smallest(rows: DataFrame, wanted: dict, first: dict | None = None) -> dict:
    """For each class the hash prefix up to which (itself included) it has exactly the wanted number of rows.

    ``rows`` are classes ``c`` and hashes ``h``, ``first`` the counts of the first digits if known.  ``None`` where no
    row is wanted.  Rows of equal hash can't be parted and go together.
    """
    cuts = {c: None for c in wanted}
    looked = {c: ("", n) for c, n in wanted.items() if n > 0}
    while looked:
        open_ = F.lit(False)
        for c, (prefix, _) in looked.items():
            open_ = open_ | (F.col("c").eqNullSafe(F.lit(c)) & F.col("h").startswith(prefix))
        cells = first or _cells(rows.where(open_), len(next(iter(looked.values()))[0]))
        first = None
        for c, (prefix, left) in list(looked.items()):
            del looked[c]
            cuts[c] = "g"                                                       # all rows, should they not suffice
            for cell, n in sorted(cells.get(c, [])):
                if n < left:
                    left -= n
                    continue
                cuts[c] = prefix + cell
                if n > left and len(cuts[c]) < 32:
                    looked[c] = (cuts[c], left)                                 # the cut lies inside this cell
                break
    return cuts


def _upto(hashed: Column, label: str, cuts: dict) -> Column:
    cond = F.lit(False)
    for c, cut in cuts.items():
        if cut is not None:
            cond = cond | (F.col(label).eqNullSafe(F.lit(c)) & (F.substring(hashed, 1, len(cut)) <= cut))
    return cond


def split_cuts(df: DataFrame, key: str = "loyalty_number", seed: int = S.SPLIT_SEED, label: str = "churn") -> tuple[dict, dict]:
    """The cuts of the test and of the validation set over the whole table, a prefix for each class."""
    rows = df.select(F.col(label).alias("c"), hash_of(key, seed).alias("h"), hash_of(key, seed, "-val").alias("h2"))
    first = _cells(rows, 0)
    sizes = {c: sum(n for _, n in cells) for c, cells in first.items()}         # a number per class
    if not sizes:
        return {}, {}
    take = stratified(sizes, S.TEST_SHARE)
    test = smallest(rows, take, first)
    rest = rows.where(~_upto(F.col("h"), "c", test)).select("c", F.col("h2").alias("h"))
    left = {c: n - take[c] for c, n in sizes.items()}
    return test, smallest(rest, stratified(left, S.VALIDATION_SHARE) if sum(left.values()) else {})


def assign_split(df: DataFrame, key: str = "loyalty_number", seed: int = S.SPLIT_SEED, label: str = "churn",
                 cuts: tuple[dict, dict] | None = None) -> DataFrame:
    """ML1 — add ``split`` ∈ {train, validation, test}.  ``cuts`` are :func:`split_cuts` of the whole table, for parts of it."""
    test, validation = cuts or split_cuts(df, key, seed, label)
    return df.withColumn("split", F.when(_upto(hash_of(key, seed), label, test), "test")
                         .when(_upto(hash_of(key, seed, "-val"), label, validation), "validation").otherwise("train"))


def class_weights(train: DataFrame, label: str = "churn", ratio: float = S.OVERSAMPLE_RATIO) -> DataFrame:
    """ML3 — counts before / after minority oversampling and the positive weight.

    synthetic = int(ratio · n_neg − n_pos) (0 if the minority is already there);
    weight = n_neg / (n_pos + synthetic).
    """
    c = train.agg(F.count_if(F.col(label) == 0).alias("n_neg"), F.count_if(F.col(label) == 1).alias("n_pos"))
    synthetic = F.greatest((F.lit(ratio) * F.col("n_neg") - F.col("n_pos")).cast("long"), F.lit(0))
    c = c.withColumn("synthetic_rows", synthetic)
    c = c.withColumn("n_pos_resampled", F.col("n_pos") + F.col("synthetic_rows"))
    return c.withColumn("scale_pos_weight", F.when(F.col("n_pos_resampled") > 0,
                                                    F.col("n_neg") / F.col("n_pos_resampled")))
