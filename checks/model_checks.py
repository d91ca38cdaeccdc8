"""Feature preparation, classifiers, clustering and anomalies."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from checks.common import EVENTS_GAPS, NUMERIC, events_gaps, query, r, table
from checks.profile_checks import corr_sql, mode_sql, q
from checks.role_checks import rich_sql
from tablewright.operators import anomaly as A
from tablewright.operators import charts as V
from tablewright.operators import cluster as K
from tablewright.operators import evaluate as E
from tablewright.operators import models as M
from tablewright.operators import prepare as R
from tablewright.operators import profile as P
from tablewright.operators import roles as T
from tablewright.plans import training
from tablewright.session import scratch_path

MEDIAN = f"(SELECT {q('value', 0.5)} FROM {EVENTS_GAPS})"
MODE = mode_sql("event_type", EVENTS_GAPS)


@query(
    "m1_prepare_features",
    f"""WITH c AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events))
    SELECT {r('user_id')} AS user_id, {r('code')} AS event_type, {r(f'coalesce(value, {MEDIAN})')} AS value
    FROM {EVENTS_GAPS} e JOIN c ON c.event_type = coalesce(e.event_type, {MODE})""",
)
def _(spark, folder):
    return R.prepare_features(events_gaps(spark, folder))


@query("m2_training_features", f"SELECT l_orderkey, {r('l_quantity')} AS l_quantity, {r('l_tax')} AS l_tax FROM lineitem")
def _(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_quantity", "l_tax", "l_linenumber", "l_returnflag")
    return df.select(*R.training_features(df, "l_linenumber"))


@query(
    "m3_stratified_split",
    "SELECT event_type, count(*) AS n, CAST(round(count(*) * 0.2) AS BIGINT) AS n_test FROM events GROUP BY event_type",
)
def _(spark, folder):
    split = R.stratified_split(table(spark, folder, "events").select("event_id", "event_type"), "event_type", ["event_id"])
    return split.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("n_test"))


@query(
    "m3_adaptive_split",
    "SELECT count(*) AS n, CAST(round(count(*) * 0.2) AS BIGINT) AS n_test FROM customer",
)
def _(spark, folder):
    # as many classes as rows, so the split is not stratified
    df = table(spark, folder, "customer").select("c_custkey", "c_name")
    split = R.adaptive_split(df, "c_name", ["c_custkey"])
    return split.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("n_test"))


# a class that follows from the features by two thresholds
RULE = (
    "CASE WHEN least(floor(value / 2), 60) > 5 THEN CASE WHEN user_id % 20 > 9 THEN 'late' ELSE 'early' END ELSE 'small' END"
)
FEATURES = ["slot", "team"]


def ruled(spark, folder):
    slot, team = F.least(F.floor(F.col("value") / 2), F.lit(60)), F.col("user_id") % 20
    label = F.when(slot > 5, F.when(team > 9, "late").otherwise("early")).otherwise("small")
    events = table(spark, folder, "events")
    return events.select("event_id", "event_type", "value", "user_id", slot.alias("slot"), team.alias("team"), label.alias("kind"))


def trained(spark, folder, algorithm, **options):
    return training.train(ruled(spark, folder), "kind", "event_id", FEATURES, algorithm, **options)


def accuracy_check(name, algorithm, floor, **options):
    @query(
        name,
        f"SELECT count(*) AS n_rows, true AS accurate FROM (SELECT {RULE} AS kind FROM events)",
    )
    def _(spark, folder):
        scored = trained(spark, folder, algorithm, cross_validation=False, **options).scored
        return E.accuracy(scored, "kind", "prediction").select("n_rows", (F.col("accuracy") >= floor).alias("accurate"))


@query("m4_decision_tree", f"SELECT event_id, {RULE} AS prediction, 1.0 + 0.0 AS confidence FROM events".replace("1.0 + 0.0", r("1.0")))
def _(spark, folder):
    scored = trained(spark, folder, "decision_tree", cross_validation=False).scored
    return scored.select("event_id", "prediction", "confidence")


accuracy_check("m5_random_forest", "random_forest", 0.99)
accuracy_check("m6_logistic_regression", "logistic_regression", 0.8)
accuracy_check("m7_svm", "svm", 0.8)
accuracy_check("m7_svm_linear", "svm", 0.6, kernel="linear")

# predictions by rule, so every measure has a closed form
GUESS = "CASE WHEN value > 12 THEN CASE WHEN user_id > 60 THEN 'late' ELSE 'early' END ELSE 'small' END"
GUESSED = f"(SELECT event_id, {RULE} AS kind, {GUESS} AS guess FROM events)"


def guessed(spark, folder):
    inner = F.when(F.col("user_id") > 60, "late").otherwise("early")
    return ruled(spark, folder).withColumn("guess", F.when(F.col("value") > 12, inner).otherwise("small"))


@query("m8_accuracy", f"SELECT count(*) AS n_rows, {r('avg(CASE WHEN kind = guess THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM {GUESSED}")
def _(spark, folder):
    return E.accuracy(guessed(spark, folder), "kind", "guess")


@query(
    "m9_classification_report",
    f"""WITH c AS (SELECT k AS "class", (SELECT count(*) FROM {GUESSED} WHERE kind = k) AS support, (SELECT count(*) FROM {GUESSED} WHERE guess = k) AS predicted,
    (SELECT count(*) FROM {GUESSED} WHERE guess = k AND kind = k) AS hit FROM (SELECT DISTINCT kind AS k FROM {GUESSED})),
    p AS (SELECT "class", support, CASE WHEN predicted = 0 THEN 0.0 ELSE hit / predicted END AS pr, CASE WHEN support = 0 THEN 0.0 ELSE hit / support END AS re FROM c),
    f AS (SELECT *, CASE WHEN pr + re = 0 THEN 0.0 ELSE 2 * pr * re / (pr + re) END AS f1 FROM p)
    SELECT "class", {r('pr')} AS precision, {r('re')} AS recall, {r('f1')} AS f1, support FROM f
    UNION ALL SELECT 'macro avg', {r('avg(pr)')}, {r('avg(re)')}, {r('avg(f1)')}, CAST(sum(support) AS BIGINT) FROM f
    UNION ALL SELECT 'weighted avg', {r('sum(pr * support) / sum(support)')}, {r('sum(re * support) / sum(support)')}, {r('sum(f1 * support) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM f""",
)
def _(spark, folder):
    return E.class_report(guessed(spark, folder), "kind", "guess")


@query("m10_confusion_matrix", f"SELECT kind AS label, guess AS prediction, count(*) AS n FROM {GUESSED} GROUP BY ALL")
def _(spark, folder):
    return E.confusion(guessed(spark, folder), "kind", "guess")


@query(
    "m11_feature_importance",
    "SELECT feature, true AS used FROM (VALUES ('slot'), ('team')) v(feature) WHERE (SELECT count(*) FROM events) > 0",
)
def _(spark, folder):
    importance = trained(spark, folder, "decision_tree", cross_validation=False).importance
    return importance.select("feature", (F.col("importance") > 0).alias("used"))


PAIR_CORR = " UNION ALL ".join(corr_sql(a, b, "lineitem") for a, b in combinations(NUMERIC["lineitem"], 2))


@query(
    "m12_top_features",
    f"""WITH i AS (SELECT column1 || '~' || column2 AS feature, abs(correlation) AS importance FROM ({PAIR_CORR.replace('round(', '(').replace(', 4)', ')')}))
    SELECT feature, {r('importance')} AS importance, (SELECT count(*) FROM i WHERE importance > 0.1) AS n_important FROM i ORDER BY i.importance DESC, feature LIMIT 8""",
)
def _(spark, folder):
    pairs = P.correlation(table(spark, folder, "lineitem"))
    weights = pairs.select(
        F.concat("column1", F.lit("~"), "column2").alias("feature"), F.abs("correlation").alias("importance")
    )
    return E.top_features(weights)


@query("m13_probabilities", "SELECT count(*) AS n_rows, true AS sums_to_one, true AS confidence_is_largest FROM events")
def _(spark, folder):
    scored = trained(spark, folder, "logistic_regression", cross_validation=False).scored
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, b: a + b)
    return scored.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.bool_and(F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        F.bool_and(F.col("confidence") == F.array_max("probabilities")).alias("confidence_is_largest"),
    )


@query(
    "m14_folds",
    "SELECT event_type, CAST(f AS BIGINT) AS fold, CAST((n - f + 4) // 5 AS BIGINT) AS n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type), range(5) t(f)",
)
def _(spark, folder):
    folds = R.fold_numbers(table(spark, folder, "events").select("event_id", "event_type"), "event_type", ["event_id"])
    return folds.groupBy("event_type", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("m14_cross_validation", "SELECT CAST(least(5, count(*) // 2) AS BIGINT) AS folds, true AS accurate, true AS steady FROM events")
def _(spark, folder):
    metrics = trained(spark, folder, "decision_tree").metrics
    return metrics.select("folds", (F.col("cv_mean") >= 0.99).alias("accurate"), (F.col("cv_std") < 0.01).alias("steady"))


def report(spark, folder, **options):
    return training.tree_report(ruled(spark, folder), "kind", "event_id", FEATURES, **options)


@query("m15_tree_rules")
def _(spark, folder):
    return report(spark, folder)["rules"]


@query("m16_train_from_table", f"SELECT event_id, kind, kind AS prediction FROM (SELECT event_id, {RULE} AS kind FROM events)")
def _(spark, folder):
    return trained(spark, folder, "decision_tree").scored.select("event_id", "kind", "prediction")


@query("m17_train_from_file", f"SELECT event_id, kind, kind AS prediction FROM (SELECT event_id, {RULE} AS kind FROM events)")
def _(spark, folder):
    from tablewright.sources.tables import write_csv

    path = scratch_path(spark, "training_csv")
    write_csv(ruled(spark, folder), path)
    result = training.train_from_file(
        spark, path, "kind", "event_id", features=FEATURES, algorithm="decision_tree", cross_validation=False
    )
    return result.scored.select(F.col("event_id").cast("long").alias("event_id"), "kind", "prediction")


@query(
    "m18_tree_report",
    f"SELECT {r('1.0')} AS accuracy, CAST(sum(n) - sum(t) AS BIGINT) AS n_train, CAST(sum(t) AS BIGINT) AS n_test FROM (SELECT count(*) AS n, CAST(round(count(*) * 0.2) AS BIGINT) AS t FROM (SELECT {RULE} AS kind FROM events) GROUP BY kind)",
)
def _(spark, folder):
    return report(spark, folder)["metrics"].select("accuracy", "n_train", "n_test")


@query("s8_scored_sink", f"SELECT event_id, {RULE} AS kind, {RULE} AS predicted_label FROM events")
def _(spark, folder):
    from tablewright.sources.tables import read_csv, write_scored

    path = scratch_path(spark, "scored_csv")
    scored = trained(spark, folder, "decision_tree", cross_validation=False).scored
    write_scored(scored, path, ["event_id", "kind"])
    return read_csv(spark, path, "event_id long, kind string, predicted_label string")


@query("m19_saved_model", f"SELECT event_id, {RULE} AS prediction FROM events")
def _(spark, folder):
    registry = training.Registry(spark, scratch_path(spark, "models"))
    model_id = registry.save(trained(spark, folder, "decision_tree", cross_validation=False), "rule")
    return registry.predict(model_id, ruled(spark, folder).drop("kind")).select("event_id", "prediction")


@query("m20_current_models", "SELECT CAST(event_id AS VARCHAR) AS model_id FROM events WHERE event_id % 7 <> 0")
def _(spark, folder):
    # a log with a line per event, every seventh deleted again
    ids = table(spark, folder, "events").select(F.col("event_id").cast("string").alias("model_id"), "event_id")
    saved = ids.select("model_id", F.lit("saved").alias("action"))
    deleted = ids.where("event_id % 7 = 0").select("model_id", F.lit("deleted").alias("action"))
    return training.current_models(saved.unionByName(deleted)).select("model_id")


@query("m21_training_history", f"SELECT 'second' AS name, 'decision_tree' AS algorithm, 'kind' AS target, {r('1.0')} AS accuracy, count(*) AS n_rows FROM events UNION ALL SELECT 'first', 'decision_tree', 'kind', {r('1.0')}, count(*) FROM events")
def _(spark, folder):
    registry = training.Registry(spark, scratch_path(spark, "models"))
    result = trained(spark, folder, "decision_tree", cross_validation=False)
    first = registry.save(result, "first")
    registry.save(result, "second")
    registry.delete(first)
    return registry.history().select(
        "name", "algorithm", "target", "accuracy", (F.col("n_train") + F.col("n_test")).alias("n_rows")
    )


@query("m22_predict", f"SELECT event_id, event_type, {RULE} AS prediction FROM events")
def _(spark, folder):
    result = trained(spark, folder, "decision_tree", cross_validation=False)
    return training.predict(result.model, ruled(spark, folder).drop("kind"), result.features, result.classes).select("event_id", "event_type", "prediction")


@query(
    "m23_class_distribution",
    f"SELECT kind AS prediction, count(*) AS n, {r('count(*) / (SELECT count(*) FROM events)')} AS share, {r('1.0')} AS mean_confidence FROM (SELECT {RULE} AS kind FROM events) GROUP BY kind",
)
def _(spark, folder):
    return E.class_distribution(trained(spark, folder, "decision_tree", cross_validation=False).scored)


THIRD = "CASE WHEN value > 8 THEN 'early' ELSE 'small' END"
VOTES = f"(SELECT event_id, {RULE} AS p, 0.9 AS c FROM events UNION ALL SELECT event_id, {GUESS}, 0.7 FROM events UNION ALL SELECT event_id, {THIRD}, 0.5 FROM events)"


@query(
    "m24_model_agreement",
    f"""SELECT key, agreed, {r('n * 100.0 / 3')} AS pct_agreement, {r('0.7')} AS mean_confidence FROM (SELECT event_id AS key, p AS agreed, count(*) AS n,
    row_number() OVER (PARTITION BY event_id ORDER BY count(*) DESC, p) AS rn FROM {VOTES} GROUP BY event_id, p) WHERE rn = 1""",
)
def _(spark, folder):
    df = guessed(spark, folder)
    third = F.when(F.col("value") > 8, "early").otherwise("small")
    scored = {
        "rule": df.select("event_id", F.col("kind").alias("prediction"), F.lit(0.9).alias("confidence")),
        "guess": df.select("event_id", F.col("guess").alias("prediction"), F.lit(0.7).alias("confidence")),
        "third": df.select("event_id", third.alias("prediction"), F.lit(0.5).alias("confidence")),
    }
    return E.agreement(scored, "event_id")


@query(
    "m25_target_suggestions",
    f"""SELECT "column", role, n_distinct, "column" IN ('l_quantity', 'l_tax') AS is_feature FROM {rich_sql('lineitem')}
    WHERE role = 'categorical' OR regexp_matches("column", 'id|tag|class|category|type') OR (role = 'numeric' AND n_distinct > 10 AND n_distinct < 0.8 * n_rows)""",
)
def _(spark, folder):
    found = E.suggest_targets(T.column_roles(table(spark, folder, "lineitem")), ["l_quantity", "l_tax"])
    return found.select("column", "role", "n_distinct", "is_feature")


@query(
    "m26_bands",
    "SELECT event_id, CASE WHEN s > 0.8 THEN 'High' WHEN s > 0.6 THEN 'Medium' ELSE 'Low' END AS performance, CASE WHEN s >= 0.8 THEN 'High' WHEN s >= 0.6 THEN 'Medium' ELSE 'Low' END AS confidence FROM (SELECT event_id, (event_id % 11) / 10 AS s FROM events)",
)
def _(spark, folder):
    score = (F.col("event_id") % 11) / 10
    df = table(spark, folder, "events").select("event_id", score.alias("s"))
    return df.select(
        "event_id", E.performance_band("s").alias("performance"), E.confidence_band("s").alias("confidence")
    )


DBSCAN = """WITH RECURSIVE s AS (SELECT avg(c_acctbal) AS m1, stddev_pop(c_acctbal) AS s1, avg(c_nationkey) AS m2, stddev_pop(c_nationkey) AS s2 FROM customer),
    p AS (SELECT c_custkey AS id, (c_acctbal - m1) / s1 AS x, (c_nationkey - m2) / s2 AS y FROM customer, s),
    near AS (SELECT a.id AS a, b.id AS b FROM p a, p b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {eps} * {eps}),
    core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {ms}),
    edges AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
    reach AS (SELECT id, id AS root FROM core UNION SELECT e.b, reach.root FROM reach JOIN edges e ON e.a = reach.id),
    roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
    labels AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM roots),
    border AS (SELECT n.a AS id, min(l.cluster) AS cluster FROM near n JOIN labels l ON l.id = n.b GROUP BY n.a),
    final AS (SELECT p.id AS c_custkey, CAST(coalesce(l.cluster, b.cluster, -1) AS BIGINT) AS cluster FROM p LEFT JOIN labels l USING (id) LEFT JOIN border b USING (id))
    """


def clustered(spark, folder, eps, min_samples):
    df = table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return K.dbscan(df, ["c_acctbal", "c_nationkey"], "c_custkey", eps, min_samples)


@query("m27_dbscan", DBSCAN.format(eps=0.06, ms=5) + "SELECT c_custkey, cluster FROM final")
def _(spark, folder):
    return clustered(spark, folder, 0.06, 5).select("c_custkey", "cluster")


@query("m27_dbscan_default", DBSCAN.format(eps=0.5, ms=5).replace(
    "reach AS (SELECT id, id AS root FROM core UNION SELECT e.b, reach.root FROM reach JOIN edges e ON e.a = reach.id)",
    "reach AS (SELECT id, (SELECT min(id) FROM core) AS root FROM core WHERE id = (SELECT min(id) FROM core) UNION SELECT e.b, reach.root FROM reach JOIN edges e ON e.a = reach.id)",
) + "SELECT c_custkey, cluster FROM final")
def _(spark, folder):
    # at this radius all customers are one cluster, so the SQL follows its first core point only
    return clustered(spark, folder, 0.5, 5).select("c_custkey", "cluster")


@query(
    "m28_cluster_stats",
    DBSCAN.format(eps=0.06, ms=5)
    + "SELECT cluster, count(*) AS n_rows, (SELECT count(DISTINCT cluster) FROM final WHERE cluster >= 0) AS n_clusters, (SELECT count(*) FROM final WHERE cluster = -1) AS n_noise, (SELECT count(*) FROM final) AS n_total FROM final GROUP BY cluster",
)
def _(spark, folder):
    return K.cluster_stats(clustered(spark, folder, 0.06, 5))


@query("m29_isolation_forest")
def _(spark, folder):
    df = table(spark, folder, "events").select("event_id", "value", "user_id")
    return A.isolation_forest(df, ["value", "user_id"], "event_id").select("event_id", "anomaly_score", "is_anomaly")


@query(
    "m29_isolation_forest_flags",
    "SELECT count(*) AS n_total, true AS share_is_contamination, true AS extremes_are_flagged FROM events",
)
def _(spark, folder):
    df = table(spark, folder, "events").select("event_id", "value", "user_id")
    scored = A.isolation_forest(df, ["value", "user_id"], "event_id")
    share = F.avg(F.col("is_anomaly").cast("double"))
    return scored.agg(
        F.count(F.lit(1)).alias("n_total"),
        (F.abs(share - 0.1) < 0.005).alias("share_is_contamination"),
        F.max_by("is_anomaly", "value").alias("extremes_are_flagged"),
    )


@query(
    "m30_anomaly_stats",
    f"SELECT count(CASE WHEN value > 50 THEN 1 END) AS n_anomalies, {r('count(CASE WHEN value > 50 THEN 1 END) * 100.0 / count(*)')} AS pct_anomalies, count(*) AS n_total, {r('0.05')} AS contamination FROM events",
)
def _(spark, folder):
    scored = table(spark, folder, "events").select("event_id", (F.col("value") > 50).alias("is_anomaly"))
    return A.anomaly_stats(scored, 0.05)


@query("v7_cluster_scatter", DBSCAN.format(eps=0.06, ms=5) + "SELECT c_custkey, cluster FROM final ORDER BY c_custkey LIMIT 200")
def _(spark, folder):
    return V.first_points(clustered(spark, folder, 0.06, 5), "c_custkey").select("c_custkey", "cluster")


@query("v7_anomaly_scatter", "SELECT event_id, value, user_id, true AS flag_follows_score FROM events ORDER BY event_id LIMIT 200")
def _(spark, folder):
    df = table(spark, folder, "events").select("event_id", "value", "user_id")
    scored = A.isolation_forest(df, ["value", "user_id"], "event_id")
    points = V.first_points(scored, "event_id")
    return points.select("event_id", "value", "user_id", (F.col("is_anomaly") == (F.col("anomaly_score") < 0)).alias("flag_follows_score"))


@query(
    "m29_isolation_forest_ranks",
    """SELECT count(*) AS n_total, CAST(floor(0.1 * (count(*) - 1)) AS BIGINT) + 1 AS most_flagged, true AS fewer_by_ties_only, CAST(0 AS BIGINT) AS out_of_order FROM events""",
)
def _(spark, folder):
    df = table(spark, folder, "events").select("event_id", "value", "user_id")
    scored = A.isolation_forest(df, ["value", "user_id"], "event_id")
    n = F.count(F.lit(1))
    cut = (F.floor((n - 1) * F.lit(0.1)) + 1).cast("long")
    return scored.agg(
        n.alias("n_total"),
        cut.alias("most_flagged"),
        # rows at the cut itself are not flagged, all below are
        ((F.count_if("is_anomaly") <= cut) & (F.count_if(F.col("anomaly_score") <= 0) >= cut)).alias("fewer_by_ties_only"),
        F.count_if(F.col("is_anomaly") != (F.col("anomaly_score") < 0)).alias("out_of_order"),
    )




@query(
    "m1_json_text",
    f"SELECT {r('user_id')} AS user_id, {r('least(floor(value / 2), 60)')} AS pair FROM events",
)
def _(spark, folder):
    """A JSON array in text counts as its first number."""
    events = table(spark, folder, "events")
    pair = F.concat(F.lit("["), F.least(F.floor(F.col("value") / 2), F.lit(60)).cast("string"), F.lit(", 7]"))
    return R.prepare_features(events.select("user_id", pair.alias("pair")))


@query("m22_predict_complex_feature", f"SELECT event_id, {RULE} AS prediction FROM events")
def _(spark, folder):
    """Arrays, JSON text and dotted names as features; the saved pipeline reduces them again when it scores."""
    df = ruled(spark, folder).select(
        F.col("event_id").alias("event.id"),
        F.col("kind").alias("the.kind"),
        F.array(F.col("slot").cast("double"), F.lit(1.0)).alias("slot.list"),
        F.concat(F.lit("["), F.col("team").cast("string"), F.lit("]")).alias("team"),
        F.create_map(F.lit("a"), F.col("event_type")).alias("about"),
    )
    result = training.train(df, "the.kind", "event.id", ["slot.list", "team", "about"], "decision_tree", cross_validation=False)
    registry = training.Registry(spark, scratch_path(spark, "complex-models"))
    scored = registry.predict(registry.save(result, "complex"), df.drop("the.kind"))
    return scored.select(F.col("`event.id`").alias("event_id"), "prediction")



@query("m15_rules_give_predictions", "SELECT count(*) AS n_rows, 0::BIGINT AS n_different FROM events")
def _(spark, folder):
    """The printed rules, read back and applied to every row, against the model's predictions; classes overlap."""
    events = table(spark, folder, "events")
    mixed = (F.col("user_id") * 7 + F.col("event_id") * 13) % 10 < 7
    kind = F.when(mixed, F.when(F.col("value") > 10, "high").otherwise("low")).otherwise("other")
    df = events.select("event_id", "value", "user_id", kind.alias("kind"))
    result = training.train(df, "kind", "event_id", ["value", "user_id"], "decision_tree", cross_validation=False, depth=M.REPORT_DEPTH, adaptive=True)
    rules = M.tree_rules(spark, result.model.stages[-1], result.features, depth=M.TREE_DEPTH)
    told = M.apply_rules(result.scored, rules, result.classes).select("prediction", "rule_prediction")
    return told.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("prediction").eqNullSafe(F.col("rule_prediction"))).alias("n_different"))
