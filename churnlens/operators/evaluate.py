"""Classifier evaluation over any (label, score) DataFrame.

* Threshold metrics, confusion matrix, class report and the 16-point sweep are
  conditional counts in one partial aggregate — one pass, no row blow-up.
* ROC / PR curves, their areas and the best-F1 threshold need cumulative
  counts in global score order: scores are first reduced to one row per
  distinct score, then :func:`ranking.running_totals` computes the prefix
  sums without a single-task window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from .ranking import running_totals
from .segments import _stack, attach_scalar


def _threshold_col(df: DataFrame, threshold) -> tuple[DataFrame, F.Column]:
    if isinstance(threshold, DataFrame):
        return attach_scalar(df, threshold.select(F.col("threshold").alias("_t"))), F.col("_t")
    return df, F.lit(float(threshold))


def confusion_counts(df: DataFrame, threshold, label: str = "churn",
                     score: str = "churn_probability") -> DataFrame:
    """One row: threshold, tp, fp, fn, tn (prediction = score ≥ threshold)."""
    df, t = _threshold_col(df, threshold)
    y, pred = F.col(label) == 1, F.col(score) >= t
    return df.agg(F.first(t).alias("threshold"),
                  F.count_if(y & pred).alias("tp"), F.count_if(~y & pred).alias("fp"),
                  F.count_if(y & ~pred).alias("fn"), F.count_if(~y & ~pred).alias("tn"))


def _rates(c: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    c = c.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))) \
          .otherwise(F.lit(0.0))
    return c.withColumn("f1", f1).withColumn("accuracy", F.when(n > 0, (tp + tn) / n))


def threshold_metrics(df: DataFrame, threshold, label: str = "churn",
                      score: str = "churn_probability") -> DataFrame:
    """EV1 / EV6 — accuracy, precision, recall, F1 (zero denominators → 0) + counts."""
    return _rates(confusion_counts(df, threshold, label, score))


def confusion_matrix(df: DataFrame, threshold, label: str = "churn",
                     score: str = "churn_probability") -> DataFrame:
    """EV2 — the four cells with counts and percent of all rows."""
    c = confusion_counts(df, threshold, label, score)
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    c = c.select("*", *[F.when(n > 0, F.col(k) / n * 100).alias(f"{k}_pct") for k in ("tp", "fp", "fn", "tn")])
    return c.select(F.expr("stack(4, 0, 0, tn, tn_pct, 0, 1, fp, fp_pct, 1, 0, fn, fn_pct, 1, 1, tp, tp_pct) "
                           "as (actual, predicted, count, pct)"))


def class_report(df: DataFrame, threshold, label: str = "churn",
                 score: str = "churn_probability") -> DataFrame:
    """EV3 — per-class precision / recall / F1 / support, macro and weighted averages."""
    c = confusion_counts(df, threshold, label, score)

    def prf(tp, fp, fn):
        p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
        r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
        f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
        return p, r, f

    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p1, r1, f1 = prf(tp, fp, fn)
    p0, r0, f0 = prf(tn, fn, fp)
    s1, s0 = tp + fn, tn + fp
    c = c.select(p0.alias("p0"), r0.alias("r0"), f0.alias("f0"), s0.alias("s0"),
                 p1.alias("p1"), r1.alias("r1"), f1.alias("f1"), s1.alias("s1"))
    tot = F.col("s0") + F.col("s1")

    def wavg(a, b):
        return F.when(tot > 0, (F.col(a) * F.col("s0") + F.col(b) * F.col("s1")) / tot).otherwise(F.lit(0.0))

    c = c.select("*",
                 ((F.col("p0") + F.col("p1")) / 2).alias("pm"), ((F.col("r0") + F.col("r1")) / 2).alias("rm"),
                 ((F.col("f0") + F.col("f1")) / 2).alias("fm"), tot.alias("st"),
                 wavg("p0", "p1").alias("pw"), wavg("r0", "r1").alias("rw"), wavg("f0", "f1").alias("fw"))
    return c.select(_stack([("0", ["p0", "r0", "f0", "s0"]), ("1", ["p1", "r1", "f1", "s1"]),
                            ("macro avg", ["pm", "rm", "fm", "st"]),
                            ("weighted avg", ["pw", "rw", "fw", "st"])],
                           ["class", "precision", "recall", "f1", "support"]))


def threshold_sweep(df: DataFrame, label: str = "churn", score: str = "churn_probability",
                    thresholds: list[float] = S.SWEEP_THRESHOLDS) -> DataFrame:
    """EV7 — precision / recall / F1 at each sweep threshold, all in one pass."""
    y, s = F.col(label) == 1, F.col(score)
    aggs = [F.count_if(y).alias("P"), F.count_if(~y).alias("N")]
    for i, t in enumerate(thresholds):
        aggs += [F.count_if(y & (s >= F.lit(t))).alias(f"tp{i}"),
                 F.count_if(~y & (s >= F.lit(t))).alias(f"fp{i}")]
    one = df.agg(*aggs)
    one = one.select("*", *[F.lit(t).alias(f"t{i}") for i, t in enumerate(thresholds)])
    rows = one.select(F.expr(
        f"stack({len(thresholds)}, " + ", ".join(f"t{i}, tp{i}, fp{i}, P, N" for i in range(len(thresholds)))
        + ") as (threshold, tp, fp, P, N)"))
    rows = rows.select("threshold", "tp", "fp", (F.col("P") - F.col("tp")).alias("fn"),
                       (F.col("N") - F.col("fp")).alias("tn"))
    return _rates(rows).drop("accuracy")


def score_curve(df: DataFrame, label: str = "churn", score: str = "churn_probability",
                buckets: int | None = None) -> DataFrame:
    """One row per distinct score: tp / fp among rows scoring ≥ it, and totals P, N."""
    y = F.col(label) == 1
    per = df.groupBy(F.col(score).alias("threshold")).agg(F.count_if(y).alias("pos"),
                                                         F.count_if(~y).alias("neg"))
    rt = running_totals(per, "threshold", ["pos", "neg"], descending=True, buckets=buckets)
    totals = per.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return (attach_scalar(rt, totals)
            .withColumnRenamed("cum_pos", "tp").withColumnRenamed("cum_neg", "fp"))


def roc_curve(df: DataFrame, label: str = "churn", score: str = "churn_probability") -> DataFrame:
    """EV4 — (threshold, fpr, tpr) per distinct score (collinear points kept)."""
    c = score_curve(df, label, score)
    return c.select("threshold", "tp", "fp",
                    F.when(F.col("N") > 0, F.col("fp") / F.col("N")).alias("fpr"),
                    F.when(F.col("P") > 0, F.col("tp") / F.col("P")).alias("tpr"))


def pr_curve(df: DataFrame, label: str = "churn", score: str = "churn_probability") -> DataFrame:
    """EV5 — (threshold, precision, recall) per distinct score."""
    c = score_curve(df, label, score)
    return c.select("threshold", "tp", "fp",
                    (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                    F.when(F.col("P") > 0, F.col("tp") / F.col("P")).alias("recall"))


def auc_summary(df: DataFrame, label: str = "churn", score: str = "churn_probability") -> DataFrame:
    """ROC area (trapezoids over distinct scores), average precision Σ ΔR·P, base rate."""
    c = score_curve(df, label, score)
    P, N = F.col("P"), F.col("N")
    roc_term = (F.col("neg") / N) * ((2 * F.col("tp") - F.col("pos")) / (2 * P))
    ap_term = (F.col("pos") / P) * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return c.agg(F.sum(F.when((P > 0) & (N > 0), roc_term)).alias("roc_auc"),
                 F.sum(F.when(P > 0, ap_term)).alias("average_precision"),
                 F.first("P").alias("n_pos"), (F.first("P") + F.first("N")).alias("n"),
                 (F.first("P") / (F.first("P") + F.first("N"))).alias("baseline_rate"))


def best_f1_threshold(df: DataFrame, label: str = "churn", score: str = "churn_probability") -> DataFrame:
    """ML9 — the distinct score maximising 2PR/(P+R+1e-10); the lowest wins a tie."""
    c = score_curve(df, label, score)
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    rec = F.col("tp") / F.col("P")
    c = c.where(F.col("P") > 0).select("threshold", prec.alias("precision"), rec.alias("recall"))
    c = c.withColumn("f1", 2 * (F.col("precision") * F.col("recall"))
                     / (F.col("precision") + F.col("recall") + F.lit(1e-10)))
    return c.orderBy(F.desc("f1"), F.asc("threshold")).limit(1)


def best_f1_thresholds(df: DataFrame, by: list[str], label: str = "churn", score: str = "churn_probability") -> DataFrame:
    """ML9 for many models at once: ``by``, the threshold and its F1, as :func:`best_f1_threshold` finds them for each.

    F1 is reported with zero denominators as 0; a group without a positive row has F1 0 at its lowest score.
    """
    y = F.col(label) == 1
    per = df.groupBy(*by, F.col(score).alias("threshold")).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    c = running_totals(per, "threshold", ["pos", "neg"], descending=True, by=by)
    whole = c.groupBy(*by).agg(F.sum("pos").alias("P"))
    tp, fp, P = F.col("cum_pos"), F.col("cum_neg"), F.col("P")
    prec, rec = tp / (tp + fp), F.when(P > 0, tp / P).otherwise(F.lit(0.0))
    c = c.join(whole, by).select(*by, "threshold", (2 * prec * rec / (prec + rec + F.lit(1e-10))).alias("_rank"),
                                 F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0)).alias("f1"))
    best = c.groupBy(*by).agg(F.max(F.struct("_rank", -F.col("threshold"), "f1")).alias("_b"))
    return best.select(*by, (-F.col("_b.col2")).alias("threshold"), "_b.f1")


def model_comparison(named_scores: dict[str, tuple[DataFrame, object]], label: str = "churn",
                     score: str = "churn_probability") -> DataFrame:
    """EV8 — one row per model: threshold metrics + ROC area + AP (union of EV1/4/5)."""
    out = None
    for name, (df, threshold) in named_scores.items():
        m = threshold_metrics(df, threshold, label, score).select(
            "threshold", "accuracy", "precision", "recall", "f1")
        m = attach_scalar(m, auc_summary(df, label, score).select("roc_auc", "average_precision"))
        m = m.select(F.lit(name).alias("model"), "*")
        out = m if out is None else out.unionByName(m)
    return out
