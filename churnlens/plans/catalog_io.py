"""Source / sink round trips, exports, the text report and the single-customer view."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import status_label
from ..operators import ensemble as EN
from ..operators import explain as EX
from ..operators import retention as RT
from ..operators import scoring as SC
from ..operators import segments as SG
from ..operators.features import missing_features, model_matrix
from ..session import ensure_checkpoint_dir
from ..sources import readers, sinks
from ..sources.store import ArtifactStore
from . import tables as TB
from .catalog import query
from .catalog_scoring import linear_rows, scored, scored_split

R = TB.round_doubles


@query("activity_csv_round_trip")
def q_activity_csv_round_trip(spark, d):
    """IO4 → IO1: the activity table written as header CSV (original column
    headers) under the shared checkpoint directory and read back with the
    explicit schema."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/churnlens-io/{uuid.uuid4().hex}/activity"
    inverse = {v: k for k, v in S.ACTIVITY_HEADERS.items()}
    a = TB.activity_store(spark, d)
    sinks.write_csv(a.select([F.col(c).alias(inverse[c]) for c in a.columns]), path)
    return readers.read_activity(spark, path, fmt="csv")


@query("scoring_report")
def q_scoring_report(spark, d):
    """IO14 — the plain-text scoring summary (volatile date / elapsed lines omitted)."""
    return sinks.format_summary_report(SC.scoring_summary(scored(spark, d)))


@query("action_list_export")
def q_action_list_export(spark, d):
    """IO13 — High band action list exported with the original's names and display formats, and read back."""
    path = _io_path(spark, "actions")
    sinks.export_action_list(RT.action_list(scored(spark, d)), path)
    back = spark.read.option("header", True).csv(path)
    return back.withColumn("Customer ID", F.col("Customer ID").cast("long"))


@query("action_list_preview")
def q_action_list_preview(spark, d):
    """SO6 — the first ten rows of the export: largest probability first, ties by key."""
    return sinks.format_action_list(SG.top_k(RT.action_list(scored(spark, d)), "churn_probability", 10, "customer_id"))


def _io_path(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/churnlens-io/{uuid.uuid4().hex}/{name}"


@query("loyalty_csv_round_trip")
def q_loyalty_csv_round_trip(spark, d):
    """IO2 — the loyalty table as header CSV (original headers), read with the explicit schema."""
    path = _io_path(spark, "loyalty")
    inverse = {v: k for k, v in S.LOYALTY_HEADERS.items()}
    table = TB.loyalty(spark, d)
    sinks.write_csv(table.select([F.col(c).alias(inverse.get(c, c)) for c in table.columns]), path)
    back = readers.read_loyalty(spark, path)
    return back.withColumn("cancellation_year", F.col("cancellation_year").cast("double"))


_EXPORTED = ["loyalty_number", "clv", "churn_probability", "risk_level", "predicted_churn"]


def _exported(spark, path: str):
    types = dict(churn_probability="double", predicted_churn="int")
    back = readers.read_scoring_input(spark, path)
    return R(back.select(*[F.col(c).cast(types[c]).alias(c) if c in types else c for c in _EXPORTED]))


@query("scored_export_round_trip")
def q_scored_export_round_trip(spark, d):
    """IO11 — the whole scored table exported as CSV and read back as an upload is (IO9)."""
    path = _io_path(spark, "scored")
    sinks.export_scored(scored(spark, d).select(*_EXPORTED), path)
    return _exported(spark, path)


@query("high_risk_export_round_trip")
def q_high_risk_export_round_trip(spark, d):
    """IO12 — the High band alone."""
    path = _io_path(spark, "high-risk")
    sinks.export_high_risk(scored(spark, d).select(*_EXPORTED), path)
    return _exported(spark, path)


@query("attribution_store_round_trip")
def q_attribution_store_round_trip(spark, d):
    """IO8 — attributions as one array per customer and their base value, written as a run of the artifact store,
    published and read back: each customer's margin, summed inside the row."""
    m = TB.with_split(spark, d, model_matrix(TB.feature_store(spark, d)))
    values, base = EX.linear_arrays(m.where(F.col("split") == "test"), m.where(F.col("split") == "train"),
                                    S.FIXTURE_WEIGHTS, S.FIXTURE_INTERCEPT)
    store = ArtifactStore(spark, _io_path(spark, "store"))
    run = store.begin()
    sinks.write_attributions(values, base, run.path("attributions"))
    store.publish(run)
    values, base = readers.read_attributions(spark, store.latest().path("attributions"))
    margin = F.col("base_value") + F.aggregate("phi", F.lit(0.0), lambda s, x: s + x)
    return R(SG.attach_scalar(values, base).select("loyalty_number", "base_value", margin.alias("margin")))


@query("test_set_round_trip")
def q_test_set_round_trip(spark, d):
    """IO5 — the held-out rows written as a run of the artifact store, published and read back."""
    m = TB.with_split(spark, d, model_matrix(TB.feature_store(spark, d)))
    store = ArtifactStore(spark, _io_path(spark, "store"))
    run = store.begin()
    sinks.write_parquet(m.where(F.col("split") == "test").drop("split"), run.path("test_set"))
    store.publish(run)
    return R(readers.read_features(spark, store.latest().path("test_set")))


@query("metadata_round_trip")
def q_metadata_round_trip(spark, d):
    """IO6 — thresholds tuned on the validation rows, parameters and feature names, written as JSON documents, published
    and read back; a model without a stored threshold has the default one."""
    from . import catalog_models as CM

    tuned = spark.createDataFrame([("gbt", CM._tuned(CM.ensemble_scores(spark, d))), ("lr", CM._tuned(scored_split(spark, d)))],
                                  "model string, threshold double")
    store = ArtifactStore(spark, _io_path(spark, "store"))
    run = store.begin()
    sinks.write_json_table(tuned, run.path("thresholds"))
    sinks.write_json_table(spark.createDataFrame([(k, float(v)) for k, v in S.STORED_PARAMS.items()], "name string, value double"),
                           run.path("parameters"))
    sinks.write_json_table(spark.createDataFrame([(f, float(i)) for i, f in enumerate(S.FEATURES)], "name string, value double"),
                           run.path("feature_names"))
    store.publish(run)
    found = store.latest()
    out = None
    for name in ("gbt", "lr", "other"):
        row = readers.read_threshold(spark, found.path("thresholds"), name).select(F.lit("threshold").alias("document"), F.lit(name).alias("name"),
                                                                                   F.col("threshold").alias("value"))
        out = row if out is None else out.unionByName(row)
    for document in ("parameters", "feature_names"):
        out = out.unionByName(readers.read_json_table(spark, found.path(document)).select(F.lit(document).alias("document"), "name", F.col("value").cast("double")))
    return R(out)


@query("partial_upload_scores")
def q_partial_upload_scores(spark, d):
    """IO9, IO10, PR5 — customers uploaded with the template's columns only: the other inputs default to 0, are
    reported, and the ensemble scores what is there."""
    header = sinks.scoring_template(spark).columns
    path = _io_path(spark, "template")
    m = model_matrix(TB.feature_store(spark, d), label=None)
    sinks.write_csv(m.select(F.col("loyalty_number").alias(header[0]), *header[1:]), path)
    upload = readers.read_scoring_input(spark, path)
    missing = missing_features(upload.columns)
    scored_rows = EN.score(model_matrix(upload, label=None), S.FIXTURE_TREES)
    return R(scored_rows.select("loyalty_number", "churn_probability", F.lit(len(missing)).alias("n_defaulted"),
                                F.lit(",".join(missing)).alias("defaulted")))


@query("rejected_cells")
def q_rejected_cells(spark, d):
    """IO9 — malformed cells and unknown columns of an upload: some salaries and lifetime values of the feature
    table are written as texts that are no numbers, beside a column that scoring doesn't know."""
    path = _io_path(spark, "malformed")
    f = TB.feature_store(spark, d)
    key = F.col("loyalty_number")
    spoilt = f.select("loyalty_number", F.when(key % 50 == 7, F.lit("n/a")).otherwise(F.col("salary").cast("string")).alias("Salary"),
                      F.when(key % 40 == 3, F.concat(F.lit("$"), F.floor("clv").cast("string"))).otherwise(F.col("clv").cast("string")).alias("CLV"),
                      "tenure_months", F.col("province").alias("comment"))
    sinks.write_csv(spoilt, path)
    return readers.rejected_cells(spark, path).select("loyalty_number", "column", "raw", "reason").distinct()


@query("customer_view")
def q_customer_view(spark, d):
    """FI8 + SC4 — one customer (the first key, the view's default) with profile,
    score, band, decision, enrollment label and actual outcome."""
    s = scored(spark, d)
    first = s.agg(F.min("loyalty_number").alias("_k"))
    one = SG.attach_scalar(s, first).where(F.col("loyalty_number") == F.col("_k"))
    return R(one.select(
        "loyalty_number",
        F.col("loyalty_card").alias("tier"),
        "clv", "tenure_months",
        F.when(F.col("is_promotion_enrollee") == 1, "Promotion").otherwise("Standard").alias("enrollment"),
        "churn_probability", "risk_level", "predicted_churn",
        status_label("churn").alias("actual_outcome")))


@query("customer_report")
def q_customer_report(spark, d):
    """SC4 in full — the customer view's row with that customer's factors (EX2), texts (EX3), waterfall (EX4)
    and recommendations (RE1), each as an array in its order."""
    view = q_customer_view(spark, d)
    key = F.broadcast(view.select("loyalty_number"))                       # one row
    rows = linear_rows(spark, d).join(key, "loyalty_number", "left_semi")
    parts = {"factors": (R(EX.top_of(rows)), "rank"), "explanations": (R(EX.explanations_of(rows)), "rank"),
             "waterfall": (R(EX.waterfall_of(rows)), "position"),
             "recommendations": (R(RT.recommendations(scored(spark, d).join(key, "loyalty_number", "left_semi"))), "rank")}
    for name, (part, order) in parts.items():
        rest = [c for c in part.columns if c not in ("loyalty_number", order)]
        part = part.groupBy("loyalty_number").agg(F.sort_array(F.collect_list(F.struct(order, *rest))).alias(name))
        view = view.join(part, "loyalty_number", "left")
    return view


def customer_report(spark, d, key) -> list:
    """SC4 of one customer (``key``: a one-row table) as rows: the profile, factors, waterfall bars and recommendations."""
    own = lambda df: df.join(F.broadcast(key), "loyalty_number", "left_semi")  # noqa: E731  one row
    none = F.lit(None)
    rows = own(linear_rows(spark, d))
    one = own(scored(spark, d))
    text, number = none.cast("string"), none.cast("double")
    profile = one.select("loyalty_number", F.expr(
        "inline(array(named_struct('position', 1, 'label', 'tier', 'text', loyalty_card, 'value', CAST(NULL AS DOUBLE)),"
        " named_struct('position', 2, 'label', 'clv', 'text', CAST(NULL AS STRING), 'value', CAST(clv AS DOUBLE)),"
        " named_struct('position', 3, 'label', 'tenure_months', 'text', CAST(NULL AS STRING), 'value', CAST(tenure_months AS DOUBLE)),"
        " named_struct('position', 4, 'label', 'enrollment', 'text', IF(is_promotion_enrollee = 1, 'Promotion', 'Standard'), 'value', CAST(NULL AS DOUBLE)),"
        " named_struct('position', 5, 'label', 'churn_probability', 'text', risk_level, 'value', churn_probability),"
        " named_struct('position', 6, 'label', 'predicted_churn', 'text', CAST(NULL AS STRING), 'value', CAST(predicted_churn AS DOUBLE)),"
        " named_struct('position', 7, 'label', 'actual_outcome', 'text', IF(churn = 1, 'Churned', 'Active'), 'value', CAST(NULL AS DOUBLE))))"))
    parts = {"profile": profile,
             "factor": EX.explanations_of(rows).select("loyalty_number", F.col("rank").alias("position"), F.col("feature").alias("label"), "text",
                                                       F.col("shap_value").alias("value")),
             "waterfall": EX.waterfall_of(rows).select("loyalty_number", "position", "label", text.alias("text"), F.col("end").alias("value")),
             "recommendation": RT.recommendations(one).select("loyalty_number", F.col("rank").alias("position"), F.col("priority").alias("label"),
                                                              F.concat_ws(" | ", "action", "cost", "reason").alias("text"), number.alias("value"))}
    out = None
    for name, part in parts.items():
        part = part.select("loyalty_number", F.lit(name).alias("section"), F.col("position").cast("int").alias("position"), "label", "text", "value")
        out = part if out is None else out.unionByName(part)
    return out


@query("riskiest_customer_report")
def q_riskiest_customer_report(spark, d):
    """FI8, SC4 — the customer with the highest probability, looked up by key, as rows of the report."""
    top = SG.top_k(scored(spark, d), "churn_probability", 1, "loyalty_number").select("loyalty_number").collect()   # one row
    one = SG.customer_lookup(TB.feature_store(spark, d), top[0][0] if top else None)
    return R(customer_report(spark, d, one.select("loyalty_number")))


@query("showcase_ids")
def q_showcase_ids(spark, d):
    """SA2 / SE2 — top 5 customers by CLV ∪ up to 5 seeded churned customers."""
    return SG.showcase_ids(TB.feature_store(spark, d))
