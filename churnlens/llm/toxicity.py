"""Toxicity by a classifier chain.

Toxicity categories are predicted one after another; each category's linear model sees the words of the
text and the probabilities of the categories before it.  While training, those earlier probabilities are
out-of-fold predictions, so a later model does not learn from fits to its own rows.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .sample import MAX_LABELLED, labelled_sample

#: Words that the models look at, at most; the rows such a word must occur in and the chi-squared it must
#: reach, so that wrong labels bring in no chance words; and the folds.
TERMS, MIN_ROWS, MIN_CHI2, FOLDS = 256, 5, 30.0, 2

# ---- FIXED VALUES: seed words that name the category of a text labelled toxic ----
SEEDS = {
    "insult": ["idiot", "moron", "stupid", "dumb", "fool", "clown", "loser", "jerk"],
    "contempt": ["trash", "scum", "worthless", "pathetic", "disgusting", "garbage", "filth", "vermin"],
}
# ---- end of fixed values ----


def _terms(text: str):
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def choose_terms(labelled: DataFrame, categories: list[str]) -> list[str]:
    """The words whose presence tells most about a category (chi-squared), from the labelled sample."""
    rows = labelled.select(F.array_distinct(_terms("text")).alias("__terms"), *categories)
    sums = rows.agg(F.count("*"), *[F.sum(c) for c in categories]).first()
    n = float(sums[0])
    df = (rows.select(F.explode_outer("__terms").alias("term"), *categories).where("term is not null")
          .groupBy("term").agg(F.count("*").alias("d"), *[F.sum(c).alias(c) for c in categories])
          .where(F.col("d") >= MIN_ROWS))
    def chi2(c: str, pos: float):
        gap = F.col(c) - F.col("d") * (pos / n)
        return F.when(gap > 0, gap * gap / (F.col("d") * (1 - F.col("d") / (n + 1)) * max(pos * (n - pos), 1.0) / (n * n)))
    best = F.greatest(*[F.coalesce(chi2(c, float(p or 0)), F.lit(0.0)) for c, p in zip(categories, sums[1:])],
                      F.lit(0.0))
    return [r["term"] for r in df.where(best >= MIN_CHI2).orderBy(best.desc(), "term").limit(TERMS).collect()]


def featurise(df: DataFrame, terms: list[str]) -> DataFrame:
    """Adds ``__x``: which of ``terms`` a text has."""
    cv = CountVectorizerModel.from_vocabulary(terms or [""], inputCol="__terms", outputCol="__x").setBinary(True)
    return cv.transform(df.withColumn("__terms", _terms("text"))).drop("__terms")


def _model(train: DataFrame, target: str, before: list[str]):
    x = VectorAssembler(inputCols=["__x", *before], outputCol="__in").transform(train)
    # one order of the bounded sample's rows, so that its sums, and with them the model, are the same in each run
    x = x.coalesce(1).sortWithinPartitions("__id", "__key")
    return LogisticRegression(featuresCol="__in", labelCol=target, regParam=0.01, maxIter=15).fit(x)


def _predict(model, df: DataFrame, before: list[str], out: str) -> DataFrame:
    x = VectorAssembler(inputCols=["__x", *before], outputCol="__in").transform(df)
    # the model's output columns get names that no document column has
    model = model.copy().setProbabilityCol("__p").setRawPredictionCol("__raw").setPredictionCol("__hit")
    return (model.transform(x).withColumn(out, vector_to_array("__p")[1])
            .drop("__in", "__p", "__raw", "__hit"))


def fit_chain(labelled: DataFrame, categories: list[str]):
    """``labelled`` (``doc_id``, ``text``, 0/1 columns ``categories``) → the words and the models in chain order."""
    terms = choose_terms(labelled, categories)
    train = (featurise(labelled, terms)
             .select("__x", F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__key"),
                     F.pmod(F.xxhash64("doc_id", "text"), F.lit(FOLDS)).alias("__fold"), *categories))
    train = materialize(train, "chain")
    models, before = [], []
    for i, target in enumerate(categories):
        models.append(_model(train, target, before))
        if i + 1 < len(categories):
            whole = None
            for f in range(FOLDS):
                fold = _predict(_model(train.where(F.col("__fold") != f), target, before),
                                train.where(F.col("__fold") == f), before, f"__p_{target}")
                whole = fold if whole is None else whole.unionByName(fold)
            before = [*before, f"__p_{target}"]
            train = materialize(whole, "chain")
    return terms, list(zip(categories, models))


def apply_chain(docs: DataFrame, fitted) -> DataFrame:
    """``docs`` plus a column ``__p_<category>`` for each category."""
    terms, chain = fitted
    df, before = featurise(docs, terms), []
    for target, model in chain:
        df = _predict(model, df, before, f"__p_{target}")
        before = [*before, f"__p_{target}"]
    return df.drop("__x")


def score(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """``docs`` plus ``__p_insult``, ``__p_contempt``, ``__p_toxic``.

    Categories of the training rows: a toxic row belongs to those whose seed words it has; the last
    category is the label itself.  A null or empty text has no words and gets the base rate.  Without a
    labelled document all probabilities are 0.  Repeated rows each get a row.
    """
    rows = labelled_sample(docs, labels, "toxic", limit)
    terms = _terms("text")
    for name, seeds in SEEDS.items():
        rows = rows.withColumn(name, (F.arrays_overlap(terms, F.array(*map(F.lit, seeds))) & (F.col("toxic") == 1)).cast("int"))
    categories = [*SEEDS, "toxic"]
    # copies would outvote single texts: of those with one text the smallest id counts
    rows = (rows.groupBy("text").agg(F.min(F.struct("doc_id", *categories)).alias("__row"))
            .select("text", "__row.*"))
    rows = materialize(rows, "labelled")
    if rows.agg(F.countDistinct("toxic")).first()[0] < 2:       # nothing to learn a border from
        return docs.withColumns({f"__p_{c}": F.lit(0.0) for c in categories})
    return apply_chain(docs, fit_chain(rows, categories))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` whose probability of the last category is below ``threshold``; the columns of ``docs``."""
    return score(docs, labels).where(F.col("__p_toxic") < threshold).select(*docs.columns)
