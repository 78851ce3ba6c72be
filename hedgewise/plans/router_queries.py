"""The router: features, preparation, training, application, comparison of conditions. Models are a column, not a loop."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, functions as F

from hedgewise.operators import boosting as B
from hedgewise.operators import components as PC
from hedgewise.operators import features as X
from hedgewise.operators import forests as FO
from hedgewise.operators import keyed as K
from hedgewise.operators import router as R
from hedgewise.operators.calibration import vanilla_error_prob
from hedgewise.operators.curation import stratified_folds, stratified_holdout
from hedgewise.operators.ranking import binary_scores
from hedgewise.plans import inputs
from hedgewise.plans.catalog import VIEWS, query
from hedgewise.plans.curation_queries import draw_sql, folds_sql, holdout_sql
from hedgewise.plans.retrieval_queries import contexts
from hedgewise.plans.text_queries import lexicon
from hedgewise.session import materialise, scratch_path
from hedgewise.sources.readers import scan_matrix as read_matrix

MODEL = ["model"]
LABEL = R.LABEL
FOLDS = 5


def inference(spark, sf):
    """Recorded answers of every model for the documents that were asked."""
    docs = inputs.all_questions(spark, sf).select("row_id", F.col("source").alias("topic"))
    answers = inputs.direct(spark, sf).select(
        "model", "row_id", "gold_label", F.col("pred_by_probs").alias("model_answer"), (F.col("correct_by_probs") == 1).alias("is_correct")
    )
    return docs.join(answers.join(inputs.generations(spark, sf), ["model", "row_id"]), "row_id")


def matrix(spark, sf, components=None):
    docs = inputs.long_texts(spark, sf).select("row_id", F.col("question").alias("original_question"))
    return X.build_router_matrix(inference(spark, sf), lexicon(spark, sf), components, questions=docs)


VIEWS["fx_matrix"] = """
SELECT d.model, d.row_id, 1 - d.correct_by_probs AS target_label, b.* EXCLUDE (row_id), k.* EXCLUDE (row_id), c.* EXCLUDE (row_id),
  g.first_token_entropy AS feat_first_token_entropy, g.avg_entropy AS feat_avg_entropy, g.perplexity AS feat_perplexity,
  g.chosen_token_prob AS feat_chosen_token_prob, 1 - g.chosen_token_prob AS feat_prob_margin, s.top2_margin AS feat_top2_margin,
  s.top5_entropy AS feat_top5_entropy, s.dist_kurtosis AS feat_dist_kurtosis, s.dist_std AS feat_dist_std
FROM fx_direct d JOIN fx_basic b USING (row_id) JOIN fx_keywords k USING (row_id) JOIN fx_class_shares c USING (row_id)
JOIN fx_generations g ON g.row_id = d.row_id AND g.model = d.model LEFT JOIN fx_shape s ON s.row_id = d.row_id AND s.model = d.model"""
FEATURES = sorted(X.FEATURE_NAMES)
KEYED = "model:i row_id:i "


@query("build_router_matrix", KEYED + "target_label:i " + " ".join(f"{c}:d" for c in FEATURES), "SELECT * FROM fx_matrix")
def build_router_matrix(spark, sf):
    return matrix(spark, sf)


@query(
    "scan_matrix",
    "feature:s n_present:i",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS n_present FROM fx_matrix" for c in FEATURES if not c.startswith(("feat_top", "feat_dist_"))
    ),
)
def scan_matrix(spark, sf):
    path = scratch_path(spark, "matrix")
    matrix(spark, sf).write.parquet(path)
    df, names = read_matrix(spark, path, ("feat_top", "feat_dist_"))
    return df.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "feature", "n_present")


@query(
    "feature_name_list",
    "position:i feature:s n_present:i",
    " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS feature, count({c}) AS n_present FROM fx_matrix" for i, c in enumerate(FEATURES)
    ),
)
def feature_name_list(spark, sf):
    return X.feature_name_list(matrix(spark, sf))


VIEWS["fx_imputed"] = (
    "SELECT model, row_id, target_label, " + ", ".join(f"coalesce({c}, median({c}) OVER (PARTITION BY model)) AS {c}" for c in FEATURES) + " FROM fx_matrix"
)


@query("impute_median", KEYED + " ".join(f"{c}:d" for c in FEATURES), "SELECT * FROM fx_imputed")
def impute_median(spark, sf):
    rows = raw(spark, sf)
    return K.filled(rows, K.preparation(rows, MODEL, FEATURES), MODEL, FEATURES)


_SPREAD = "stddev_pop({0}) OVER (PARTITION BY model)"


@query(
    "standardise",
    KEYED + " ".join(f"{c}:d" for c in FEATURES),
    "SELECT model, row_id, "
    + ", ".join(f"({c} - avg({c}) OVER (PARTITION BY model)) / (CASE WHEN {_SPREAD.format(c)} = 0 THEN 1 ELSE {_SPREAD.format(c)} END) AS {c}" for c in FEATURES)
    + " FROM fx_imputed",
)
def standardise(spark, sf):
    rows = raw(spark, sf)
    return K.standardised(rows, K.preparation(rows, MODEL, FEATURES), MODEL, FEATURES)


@query(
    "class_weights",
    "target:i n:i balanced_weight:d scale_pos_weight:d",
    """SELECT target, count(*) AS n, (SELECT count(*) FROM fx_questions) / (2.0 * count(*)) AS balanced_weight,
  (SELECT count(*) FILTER (target = 0) / count(*) FILTER (target = 1) FROM fx_questions) AS scale_pos_weight
FROM fx_questions GROUP BY target""",
)
def class_weights(spark, sf):
    return R.class_weights(inputs.questions(spark, sf).select("target"), "target")


# ---------------------------------------------------------------- stored steps

# Each step is written once per session and tables, for the queries that share it.
_STORED: dict[tuple, object] = {}


def stored(name: str, spark, sf, make):
    at = (spark.sparkContext.applicationId, sf, name)
    if at not in _STORED:
        found = make()
        _STORED[at] = materialise(found, name) if isinstance(found, DataFrame) else found
    return _STORED[at]


def forget_stored() -> None:
    """Work out every step anew, for measurements."""
    _STORED.clear()


def raw(spark, sf) -> DataFrame:
    """The matrix of all models."""
    return stored("matrix", spark, sf, lambda: matrix(spark, sf).drop("original_question", "first_token_top5_logprobs"))


def _split(rows: DataFrame) -> DataFrame:
    """80/20 by label within every model, training rows with a fold; test rows have none."""
    part = stratified_holdout(rows, LABEL, keys=MODEL).select("model", "row_id", "split")
    rows = materialise(rows.join(part, ["model", "row_id"]), "matrix-split")
    train = rows.filter("split = 'train'")
    fold = stratified_folds(train, LABEL, FOLDS, keys=MODEL).select("model", "row_id", "fold")
    third = stratified_folds(train, LABEL, 3, None, keys=MODEL).select("model", "row_id", F.col("fold").alias("third"))
    return rows.join(fold, ["model", "row_id"], "left").join(third, ["model", "row_id"], "left")


def split(spark, sf) -> DataFrame:
    return stored("matrix-folds", spark, sf, lambda: _split(raw(spark, sf)))


def wide(spark, sf) -> DataFrame:
    """The matrix with components, on the same split."""

    def make():
        found = semantic(spark, sf)[0]
        return split(spark, sf).join(found, ["model", "row_id"], "left")

    return stored("matrix38", spark, sf, make)


def train(rows: DataFrame) -> DataFrame:
    return rows.filter("split = 'train'")


def test(rows: DataFrame) -> DataFrame:
    return rows.filter("split = 'test'")


# ---------------------------------------------------------------- training


def parts(rows: DataFrame) -> DataFrame:
    """What every fit is scored on: the whole set's fit (-1) on train and test, a fold's fit on that fold."""
    named = lambda df, part, fit: df.withColumn("part", F.lit(part)).withColumn("fit", fit)
    whole = F.lit(-1)
    return named(train(rows), "train", whole).unionByName(named(test(rows), "test", whole)).unionByName(named(train(rows), "fold", F.col("fold")))


FIT = ["model", "fit"]
SCORE = ["model", "fit", "part", "row_id", LABEL]


def logistic_rows(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(training rows of every fit, rows to be scored, preparation) with standardised features as ``x``."""
    copies = materialise(K.training_copies(train(rows), FOLDS), "fits")
    prepared = materialise(K.preparation(copies, FIT, columns), "prepared")
    taught = K.feature_vectors(copies, prepared, FIT, columns, [*FIT, "row_id", LABEL])
    taught = K.balanced(taught, FIT, LABEL).withColumn("y", F.col(LABEL).cast("double"))
    return taught, K.feature_vectors(parts(rows), prepared, FIT, columns, SCORE), prepared


def logistic(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scored parts, training rows, fits): the logistic regressions of all models and folds."""

    def make():
        taught, asked, _ = logistic_rows(split(spark, sf), FEATURES)
        taught = materialise(taught, "taught")
        fits = materialise(K.fit_logistic(taught, FIT), "logistic")
        return materialise(K.score_logistic(asked, fits, FIT), "scored"), taught, fits

    return stored("logistic", spark, sf, make)


def tuned_settings(spark, sf) -> DataFrame:
    """The best of the published grid for every model: 144 settings in five folds."""

    def make():
        copies = K.training_copies(train(split(spark, sf)), FOLDS).filter("fit >= 0")
        held = train(split(spark, sf)).withColumn("fit", F.col("fold"))
        both = copies.withColumn("held", F.lit(0)).unionByName(held.withColumn("held", F.lit(1)))
        named = both.withColumn("y", F.col(LABEL).cast("int"))
        rows, _, _ = B.prepare_bins(copies, named, FIT, FEATURES, [*FIT, "held", "row_id", "y"])
        found = materialise(B.search(materialise(rows, "binned"), MODEL), "search")
        return B.best_settings(found, MODEL)

    return stored("settings", spark, sf, make)


def boosted(spark, sf) -> B.Router:
    """The tuned trees of every model, for the whole training set and for every fold."""

    def make():
        copies = K.training_copies(train(split(spark, sf)), FOLDS)
        return B.fit_router(copies, FIT, FEATURES, tuned_settings(spark, sf), MODEL, LABEL)

    return stored("boosted", spark, sf, make)


def _whole(scored: DataFrame) -> DataFrame:
    """The test rows under the fit of the whole training set."""
    return scored.filter("part = 'test' AND fit = -1")


SCORED = "model:i row_id:i target_label:i router_prob:d router_pred:i"


@query("router_logreg", SCORED)
def router_logreg(spark, sf):
    return _whole(logistic(spark, sf)[0])


_NAMES = ", ".join(f"'{c}'" for c in [*FEATURES, "intercept"])


@query(
    "router_logreg_gradient",
    "model:i fit:i feature:s gradient:d settled:b",
    f"""SELECT model, fit, feature, 0.0 AS gradient, true AS settled FROM (SELECT DISTINCT model FROM fx_matrix),
  (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS fit), (SELECT unnest([{_NAMES}]) AS feature)""",
)
def router_logreg_gradient(spark, sf):
    """The slope of the penalised loss at the coefficients of every model and fold is zero in every feature."""
    _, taught, fits = logistic(spark, sf)
    names = F.array(*[F.lit(c) for c in [*FEATURES, "intercept"]])
    found = K.gradients(taught, fits, FIT).withColumn("feature", F.get(names, F.col("position")))
    return found.join(fits.select(*FIT, "settled"), FIT)


def forests(spark, sf, rows=None, local_rows=FO.LOCAL_ROWS) -> DataFrame:
    """Forests of all models and folds on the parts; fits too large for a task are ``pyspark.ml`` fits, submitted side by side."""
    rows = split(spark, sf) if rows is None else rows
    asked, copies = parts(rows), K.training_copies(train(rows), FOLDS)
    taught = copies.withColumn("part", F.lit(None).cast("string")).withColumn("held", F.lit(0))
    both = taught.unionByName(asked.withColumn("held", F.lit(1))).withColumn("y", F.col(LABEL).cast("int"))
    small, large = FO.small_fits(both, FIT, local_rows)
    out = None
    if large:

        @inheritable_thread_target(spark)
        def one(at):
            mine = F.col("model") == at[0]
            model = R.fit_forest(train(rows).filter(mine & (F.col("fold") != at[1])), FEATURES)
            return R.apply_router(model, asked.filter(mine & (F.col("fit") == at[1]))).select(*SCORE, "router_prob", "router_pred")

        with ThreadPool(4) as pool:
            for scored in pool.map(one, large):
                out = scored if out is None else out.unionByName(scored)
    ready, _, _ = B.prepare_bins(small.filter("held = 0"), small, FIT, FEATURES, [*SCORE, "held", "y"])
    found = FO.scores(ready, FIT, ["part", "row_id", LABEL]).select(*SCORE, "router_prob", "router_pred")
    return found if out is None else out.unionByName(found)


@query("router_forest", SCORED)
def router_forest(spark, sf):
    return _whole(stored("forests", spark, sf, lambda: forests(spark, sf)))


@query("router_boosted", SCORED)
def router_boosted(spark, sf):
    return boosted(spark, sf).score(_asked(test(split(spark, sf))))


def _asked(rows: DataFrame, fit=-1) -> DataFrame:
    return rows.withColumn("fit", F.lit(fit))


@query("boosted_settings", "model:i depth:i rate:d l1:d l2:d trees:i cv_f1:d")
def boosted_settings(spark, sf):
    """The best of 144 settings in five folds, per model."""
    return tuned_settings(spark, sf)


def stump_rows(spark, sf) -> DataFrame:
    """Binned training rows of every model."""

    def make():
        named = train(split(spark, sf)).withColumn("y", F.col(LABEL).cast("int")).select("model", "row_id", "y", *FEATURES)
        rows, _, edges = B.prepare_bins(named, named, MODEL, FEATURES, ["model", "row_id", "y"])
        return materialise(rows, "stump-rows"), edges

    return stored("stump", spark, sf, make)


STUMP = {"l1": 0.1, "l2": 1.0}
VIEWS["fx_split"] = holdout_sql("fx_matrix", "target_label", "model")
VIEWS["fx_train"] = "SELECT model, row_id, target_label FROM fx_split WHERE split = 'train'"
VIEWS["fx_filled"] = (
    "SELECT m.model, m.row_id, m.target_label, s.split, "
    + ", ".join(f"coalesce({c}, median({c}) FILTER (s.split = 'train') OVER (PARTITION BY m.model), 0) AS {c}" for c in FEATURES)
    + " FROM fx_matrix m JOIN fx_split s ON s.model = m.model AND s.row_id = m.row_id"
)
VIEWS["fx_long_train"] = f"SELECT model, row_id, target_label, feature, x FROM fx_filled UNPIVOT (x FOR feature IN ({', '.join(FEATURES)})) WHERE split = 'train'"
_PROBS = ", ".join(repr((i + 1) / B.BINS) for i in range(B.BINS - 1))
VIEWS["fx_edges"] = f"SELECT DISTINCT model, feature, edge FROM (SELECT model, feature, unnest(quantile_cont(x, [{_PROBS}])) AS edge FROM fx_long_train GROUP BY model, feature)"
VIEWS["fx_slopes"] = """
SELECT model, row_id, CASE WHEN target_label = 1 THEN -0.5::DOUBLE * scale ELSE 0.5::DOUBLE END AS g,
  CASE WHEN target_label = 1 THEN 0.25::DOUBLE * scale ELSE 0.25::DOUBLE END AS h FROM fx_train
JOIN (SELECT model, count(*) FILTER (target_label = 0)::DOUBLE / count(*) FILTER (target_label = 1) AS scale FROM fx_train GROUP BY model) USING (model)"""
VIEWS["fx_stump"] = """
SELECT model, feature, edge, gain, left_leaf, right_leaf FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(gain, 10) DESC, feature, edge) AS k,
    -sign(lg) * greatest(abs(lg) - 0.1, 0) / (lh + 1) * 0.1 AS left_leaf, -sign(tg - lg) * greatest(abs(tg - lg) - 0.1, 0) / (th - lh + 1) * 0.1 AS right_leaf
  FROM (SELECT *, pow(greatest(abs(lg) - 0.1, 0), 2) / (lh + 1) + pow(greatest(abs(tg - lg) - 0.1, 0), 2) / (th - lh + 1)
          - pow(greatest(abs(tg) - 0.1, 0), 2) / (th + 1) AS gain
    FROM (SELECT e.model, e.feature, e.edge, sum(s.g) FILTER (l.x <= e.edge) AS lg, sum(s.h) FILTER (l.x <= e.edge) AS lh, sum(s.g) AS tg, sum(s.h) AS th
      FROM fx_edges e JOIN fx_long_train l ON l.model = e.model AND l.feature = e.feature JOIN fx_slopes s ON s.model = l.model AND s.row_id = l.row_id
      GROUP BY ALL))
  WHERE lh >= 1 AND th - lh >= 1)
WHERE k = 1"""


def stump(spark, sf) -> DataFrame:
    """The first split of every model's first tree as a table: feature, edge, gain and both leaves."""
    rows, edges = stump_rows(spark, sf)
    return B.first_splits(rows, edges, MODEL, FEATURES, rate=0.1, **STUMP)


@query("boosted_first_split", "model:i feature:s edge:d gain:d left_leaf:d right_leaf:d", "SELECT * FROM fx_stump")
def boosted_first_split(spark, sf):
    return stump(spark, sf)


@query("apply_router", SCORED)
def apply_router(spark, sf):
    """Store the tuned router, load it and score the raw matrix."""
    path = scratch_path(spark, "router")
    boosted(spark, sf).save(path)
    return B.Router.load(spark, path, FIT, FEATURES).score(_asked(raw(spark, sf)))


@query("cv_f1", "model:i fold:i n:i precision:d recall:d f1:d")
def cv_f1(spark, sf):
    held = logistic(spark, sf)[0].filter("part = 'fold'").withColumn("fold", F.col("fit"))
    return binary_scores(held, "router_pred", LABEL, ["model", "fold"])


_ALWAYS = "2.0 * sum(target_label) / (2 * sum(target_label) + sum(1 - target_label))"


@query(
    "baseline_always",
    "model:i strategy:s train_f1:d cv_f1:d test_f1:d test_auc:d",
    f"""SELECT model, 'always' AS strategy, train_f1, cv_f1, test_f1, 0.5 AS test_auc
FROM (SELECT model, {_ALWAYS} AS train_f1 FROM fx_train GROUP BY model)
JOIN (SELECT model, avg(f) AS cv_f1 FROM (SELECT model, fold, {_ALWAYS} AS f
  FROM ({folds_sql('fx_train', 'target_label', 5, draw_sql(42) + ', row_id', 'model')}) GROUP BY model, fold) GROUP BY model) USING (model)
JOIN (SELECT model, {_ALWAYS} AS test_f1 FROM fx_split WHERE split = 'test' GROUP BY model) USING (model)""",
)
def baseline_always(spark, sf):
    return R.strategy_table(always(spark, sf), MODEL)


def always(spark, sf) -> DataFrame:
    rows = parts(split(spark, sf)).select(*SCORE)
    return rows.select(*SCORE, F.lit(1.0).alias("router_prob"), F.lit(1).alias("router_pred"), F.lit("always").alias("strategy"))


STRATEGY = "model:i strategy:s train_f1:d cv_f1:d test_f1:d test_auc:d"


@query("results_table", STRATEGY)
def results_table(spark, sf):
    named = lambda df, name: df.select(*SCORE, "router_prob", "router_pred", F.lit(name).alias("strategy"))
    rows = always(spark, sf).unionByName(named(logistic(spark, sf)[0], "logistic_regression"))
    rows = rows.unionByName(named(stored("forests", spark, sf, lambda: forests(spark, sf)), "random_forest"))
    rows = rows.unionByName(named(boosted(spark, sf).score(parts(split(spark, sf))), "boosted_trees"))
    return R.strategy_table(rows, MODEL)


@query("feature_importance", "model:i feature:s readable:s importance:d")
def feature_importance(spark, sf):
    """The fifteen features whose splits gain most in each model's tuned trees."""
    gains = B.importances(boosted(spark, sf)).filter("fit = -1")
    return R.top_features(gains, MODEL, "gain", 15)


# ---------------------------------------------------------------- components


def vectors(spark, sf) -> DataFrame:
    return inputs.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("vector"))


def semantic(spark, sf, k=X.PCA_FEATURES):
    """(components of every answer's vector, variances), fitted on each model's own training rows."""

    def make():
        rows = split(spark, sf).select("model", "row_id", "split").join(vectors(spark, sf), "row_id", "left")
        found, variances = PC.principal_components(rows, MODEL, rows.filter("split = 'train'"), k)
        return materialise(found, "components"), variances

    return stored(f"components{k}", spark, sf, make)


@query("semantic_pca", KEYED + " ".join(f"feat_pc_{i:02d}:d" for i in range(1, 17)))
def semantic_pca(spark, sf):
    return semantic(spark, sf)[0]


VIEWS["fx_train_vectors"] = "SELECT t.model, t.row_id, e.embedding FROM fx_train t JOIN embeddings e ON e.vec_id = t.row_id"


@query(
    "semantic_pca_total",
    "model:i n:i total_variance:d",
    """SELECT model, max(n) AS n, sum(v) AS total_variance FROM (
  SELECT model, d, count(*) AS n, var_samp(x) AS v FROM (SELECT model, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS d FROM fx_train_vectors)
  GROUP BY model, d) GROUP BY model""",
)
def semantic_pca_total(spark, sf):
    """All components together hold the variance of the training vectors."""
    found, _ = semantic(spark, sf, 64)
    names = [c for c in found.columns if c.startswith("feat_pc_")]
    taught = found.join(train(split(spark, sf)).select("model", "row_id"), ["model", "row_id"], "left_semi")
    total = sum((F.var_samp(c) for c in names), F.lit(0.0))
    return taught.groupBy("model").agg(F.count(F.lit(1)).alias("n"), total.alias("total_variance"))


@query(
    "semantic_pca_covariance",
    "model:i a:i b:i covariance:d",
    """SELECT model, a, b, 0.0 AS covariance FROM (SELECT DISTINCT model FROM fx_train), (SELECT unnest(range(1, 17)) AS a), (SELECT unnest(range(1, 17)) AS b)
WHERE a < b""",
)
def semantic_pca_covariance(spark, sf):
    """Different components do not vary together on the training rows."""
    found, _ = semantic(spark, sf)
    taught = found.join(train(split(spark, sf)).select("model", "row_id"), ["model", "row_id"], "left_semi")
    name = lambda i: f"feat_pc_{i:02d}"
    pairs = [(a, b) for a in range(1, 17) for b in range(a + 1, 17)]
    wide_ = taught.groupBy("model").agg(F.array(*[F.covar_samp(name(a), name(b)) for a, b in pairs]).alias("c"))
    named = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    return wide_.select("model", F.explode(F.arrays_zip(named.alias("p"), F.col("c").alias("c"))).alias("z")).select("model", "z.p.a", "z.p.b", F.col("z.c").alias("covariance"))


@query("ablation_compare", "model:i strategy:s n_features:i train_f1:d cv_f1:d test_f1:d test_auc:d")
def ablation_compare(spark, sf):
    """Logistic regression and the tuned trees with and without the components."""
    rows = wide(spark, sf)
    both = [*FEATURES, *[f"feat_pc_{i:02d}" for i in range(1, X.PCA_FEATURES + 1)]]
    taught, asked, _ = logistic_rows(rows, both)
    linear = K.score_logistic(asked, K.fit_logistic(taught, FIT), FIT)
    router = B.fit_router(K.training_copies(train(rows), FOLDS), FIT, both, tuned_settings(spark, sf), MODEL, LABEL)
    scores = [
        ("logistic_base_features", len(FEATURES), logistic(spark, sf)[0]),
        ("logistic_with_components", len(both), linear),
        ("boosted_base_features", len(FEATURES), boosted(spark, sf).score(parts(split(spark, sf)))),
        ("boosted_with_components", len(both), router.score(parts(rows))),
    ]
    out = None
    for name, n, scored in scores:
        named = scored.select(*SCORE, "router_prob", "router_pred", F.lit(name).alias("strategy"), F.lit(n).alias("n_features"))
        out = named if out is None else out.unionByName(named)
    return R.strategy_table(out, [*MODEL, "n_features"])


# ---------------------------------------------------------------- calibration


def platt(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calibrated test rows, held-out scores, sigmoids): three fits per model, each with a sigmoid on what it has not seen."""

    def make():
        rows = split(spark, sf)
        copies = K.training_copies(train(rows), 3, "third").filter("fit >= 0")
        router = B.fit_router(copies, FIT, FEATURES, tuned_settings(spark, sf), MODEL, LABEL)
        held = materialise(router.score(train(rows).withColumn("fit", F.col("third"))).select(*FIT, "row_id", LABEL, "router_prob"), "held")
        sigmoids = materialise(K.fit_platt(held, FIT, "router_prob", LABEL), "sigmoids")
        every = test(rows).withColumn("fit", F.explode(F.array(*[F.lit(k) for k in range(3)])))
        scored = router.score(every).join(F.broadcast(sigmoids), FIT)
        mean = F.avg(K.logistic(F.col("slope") * F.col("router_prob") + F.col("shift")))
        return materialise(scored.groupBy("model", "row_id", LABEL).agg(mean.alias("calibrated_prob")), "calibrated"), held, sigmoids

    return stored("platt", spark, sf, make)


@query("platt_calibration", "model:i row_id:i target_label:i calibrated_prob:d")
def platt_calibration(spark, sf):
    return platt(spark, sf)[0]


@query(
    "platt_slopes",
    "model:i fit:i position:i gradient:d",
    """SELECT model, fit, position, 0.0 AS gradient FROM (SELECT DISTINCT model FROM fx_matrix), (SELECT unnest([0, 1, 2]) AS fit), (SELECT unnest([0, 1]) AS position)""",
)
def platt_slopes(spark, sf):
    """The likelihood equations of every sigmoid hold on its held-out scores."""
    _, held, sigmoids = platt(spark, sf)
    fits = sigmoids.select(*FIT, F.array("slope", "shift").alias("coefficients"))
    return K.gradients(K.platt_rows(held, FIT, "router_prob", LABEL), fits, FIT, penalty=0.0)


@query("calibration_report", "model:i series:s f1:d n:i ece:d")
def calibration_report(spark, sf):
    plain = boosted(spark, sf).score(_asked(test(split(spark, sf)))).select("model", "row_id", "chosen_token_prob", "router_prob")
    scored = platt(spark, sf)[0].join(plain, ["model", "row_id"]).withColumn("vanilla_prob", vanilla_error_prob(F.col("chosen_token_prob")))
    return R.calibration_report(scored, ["vanilla_prob", "router_prob", "calibrated_prob"], keys=MODEL)


# ---------------------------------------------------------------- three conditions

VIEWS["fx_stump_values"] = f"SELECT model, row_id, feature, x FROM fx_filled UNPIVOT (x FOR feature IN ({', '.join(FEATURES)}))"
VIEWS["fx_flags"] = """
SELECT v.model, v.row_id, (CASE WHEN v.x <= s.edge THEN s.left_leaf ELSE s.right_leaf END > 0)::INT AS router_pred
FROM fx_stump s JOIN fx_stump_values v ON v.model = s.model AND v.feature = s.feature"""
VIEWS["fx_conditions"] = """
SELECT *, vanilla_pred = gold_label AS vanilla_correct, coalesce(rag_pred = gold_label, false) AS rag_correct,
  router_rag_pred = gold_label AS router_rag_correct FROM (
SELECT d.model, d.row_id, d.source, d.gold_label, d.pred_by_probs AS vanilla_pred, r.pred_by_probs AS rag_pred, coalesce(f.router_pred, 0) AS router_pred,
  coalesce(x.raw_context <> '', false) AS rag_context_raw_used, coalesce(x.filtered_context <> '', false) AS rag_context_filtered_used,
  CASE WHEN f.router_pred = 1 AND x.filtered_context <> '' THEN coalesce(r.pred_by_probs, d.pred_by_probs) ELSE d.pred_by_probs END AS router_rag_pred
FROM fx_direct d LEFT JOIN fx_retries r USING (model, row_id) LEFT JOIN fx_flags f USING (model, row_id) LEFT JOIN fx_contexts x ON x.row_id = d.row_id)"""


def stump_router(spark, sf) -> B.Router:
    """The first split of every model as a stored router."""
    named = train(split(spark, sf)).withColumn("y", F.col(LABEL).cast("int"))
    rows, edges = stump_rows(spark, sf)
    del rows
    prepared = K.preparation(named, MODEL, FEATURES)
    return B.router_of_splits(stump(spark, sf), prepared, edges, MODEL, FEATURES)


def conditions(spark, sf, router: B.Router, asked: DataFrame) -> DataFrame:
    """Recorded plain and retrieved answers of every model, flags of a stored and loaded router, contexts of the filtered passages."""
    path = scratch_path(spark, "router")
    router.save(path)
    flags = B.Router.load(spark, path, router.keys, FEATURES).score(asked)
    direct = inputs.direct(spark, sf)
    return R.three_conditions(
        direct.withColumn("pred", F.col("pred_by_probs")),
        inputs.retries(spark, sf).select("model", "row_id", F.col("pred_by_probs").alias("pred")),
        flags.select("model", "row_id", "router_pred"),
        contexts(spark, sf),
        ["model", "row_id"],
    )


def _stump_conditions(spark, sf) -> DataFrame:
    return stored("conditions", spark, sf, lambda: conditions(spark, sf, stump_router(spark, sf), raw(spark, sf)))


_CONDITIONS = (
    "model:i row_id:i source:s gold_label:s vanilla_pred:s rag_pred:s router_rag_pred:s router_pred:i vanilla_correct:b rag_correct:b "
    "router_rag_correct:b rag_context_raw_used:b rag_context_filtered_used:b"
)


@query("three_conditions", _CONDITIONS, "SELECT * FROM fx_conditions")
def three_conditions(spark, sf):
    """With a router of one split per model, which SQL can work out too."""
    return _stump_conditions(spark, sf)


@query("three_conditions_tuned", _CONDITIONS)
def three_conditions_tuned(spark, sf):
    """With the tuned trees."""
    return conditions(spark, sf, boosted(spark, sf), _asked(raw(spark, sf)))


_CONDITION_SQL = """count(*) AS n, avg(vanilla_correct::INT) AS vanilla_accuracy, avg(rag_correct::INT) AS rag_accuracy,
  avg(router_rag_correct::INT) AS router_rag_accuracy, count(*) - sum(router_pred) AS calls_saved,
  count(*) FILTER (router_pred = 1 AND rag_context_filtered_used) AS actual_rag_calls FROM fx_conditions"""
_CONDITION_COLUMNS = "n:i vanilla_accuracy:d rag_accuracy:d router_rag_accuracy:d calls_saved:i actual_rag_calls:i"


@query("condition_summary", "model:i " + _CONDITION_COLUMNS, f"SELECT model, {_CONDITION_SQL} GROUP BY model")
def condition_summary(spark, sf):
    return R.condition_summary(_stump_conditions(spark, sf), ["model"])


@query(
    "condition_by_source",
    "model:i source:s " + _CONDITION_COLUMNS,
    f"SELECT model, source, {_CONDITION_SQL} GROUP BY GROUPING SETS ((model, source), (model))",
)
def condition_by_source(spark, sf):
    return R.condition_by_source(_stump_conditions(spark, sf), ["model"])
