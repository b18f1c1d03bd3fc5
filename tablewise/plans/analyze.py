"""O1: clean → EDA → chart data → model → attribution, as one function call.

Stages chain DataFrames; the cleaned table is cut from its lineage with a
reliable checkpoint (the session's checkpoint folder) because every later
stage reads it several times. Errors raise; a log of (stage, message) rows is
kept for the run summary.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.operators import charts as V
from tablewise.operators import eda as E
from tablewise.operators import explain as X
from tablewise.operators import models as M
from tablewise.operators import prep as PR
from tablewise.operators import profile as P
from tablewise.operators import results as R
from tablewise.operators.schema import NO_TARGET, column_roles, detect_problem_type
from tablewise.plans import cleaning as CP
from tablewise.session import materialize

TREE_MODELS = ("Random Forest", "Gradient Boosted Trees")


@dataclass
class Analysis:
    tables: dict = field(default_factory=dict)
    log: list = field(default_factory=list)
    problem_type: str | None = None
    champion: str | None = None
    metrics: dict = field(default_factory=dict)

    def log_frame(self, spark):
        return spark.createDataFrame(self.log, "stage string, message string")

    def write(self, out_dir: str, run_id: str, include_rows: bool = False) -> dict:
        """One parquet table per result under ``out_dir/<name>/run_id=…``.

        Row-level tables (the cleaned data, SHAP values, scatter points, box
        outliers, cluster labels) are skipped unless ``include_rows``."""
        row_level = {"cleaned", "shap", "chart_scatter", "chart_box_outliers", "clusters"}
        tables = {k: v for k, v in self.tables.items() if include_rows or k not in row_level}
        # nested/complex columns are written as they are; parquet keeps them
        return R.write_results(tables, out_dir, run_id)


def analyze(df: DataFrame, target: str | None = None, plan: CP.CleaningPlan | None = None,
            key: str | None = None, settings: M.ModelSettings | None = None,
            cut_lineage: bool = True, model: bool = True) -> Analysis:
    spark = df.sparkSession
    if target == NO_TARGET:
        target = None
    out = Analysis()

    def log(stage, msg):
        out.log.append((stage, msg))

    # clean
    prof = P.profile_columns(df)
    # One full-row shuffle serves both the duplicate count and the dedupe step.
    from pyspark import StorageLevel
    from tablewise.operators.clean import drop_duplicates
    n_rows = df.count()
    deduped = drop_duplicates(df).persist(StorageLevel.MEMORY_AND_DISK)
    n_distinct = deduped.count()
    dup = dict(total_rows=n_rows, total_cols=len(df.columns), duplicate_rows=n_rows - n_distinct)
    log("profile", ", ".join(f"{k}={v}" for k, v in dup.items()))
    plan = plan or CP.recommend_plan(df, prof, dup["duplicate_rows"])
    res = CP.apply_plan(df, plan, deduped=(deduped, n_distinct), n_rows=n_rows)
    if not plan.drop_duplicates:
        deduped.unpersist()
    else:
        res.cached.append(deduped)
    cleaned = materialize(res.data) if cut_lineage else res.data
    if cut_lineage:
        res.release()  # the checkpoint now holds the cleaned rows
    res.data = cleaned
    n_clean = cleaned.count()
    res.final_rows = n_clean
    out.tables.update(profile=P.profile(df, rows=prof), plan=CP.plan_frame(spark, plan), cleaning_log=res.log_frame(spark),
                      cleaning_report=res.report_frame(spark), cleaned=cleaned)
    log("clean", f"rows={n_clean}, columns={len(cleaned.columns)}")

    # EDA
    num, cat = column_roles(cleaned)
    pairs = E.correlation_pairs(cleaned, num)
    desc = E.describe_rows(cleaned, num)
    out.tables.update(describe=E.describe(cleaned, num, rows=desc), top_values=E.top_values(cleaned, 5, cat),
                      correlations=E.correlation_matrix(cleaned, num, pairs),
                      top_correlations=E.top_correlations(cleaned, pairs=pairs, cols=num),
                      distribution=E.distribution_labels(cleaned, desc),
                      key_findings=E.key_findings(cleaned, target, pairs,
                                                  {r["column"]: r["skewness"] for r in desc}),
                      feature_suggestions=E.suggest_features(cleaned, target, pairs))
    if target:
        out.tables["target_info"] = E.target_info(cleaned, target)
    log("eda", f"EDA complete: {len(num)} numeric, {len(cat)} categorical columns.")

    # charts
    manifest = V.chart_manifest(cleaned, target, pairs)
    out.tables["chart_manifest"] = manifest
    for ch in manifest.collect():  # ≤ 5 rows
        if ch["type"] == "heatmap":
            out.tables["chart_heatmap"] = V.heatmap_data(cleaned, pairs)
        elif ch["type"] == "histogram":
            out.tables["chart_histogram"] = V.histogram(cleaned, ch["x"])
            out.tables["chart_density"] = V.density_curve(cleaned, ch["x"])
        elif ch["type"] == "boxplot":
            s, o = V.box_stats(cleaned, ch["y"], ch["group"])
            out.tables["chart_box"], out.tables["chart_box_outliers"] = s, o
        elif ch["type"] == "scatterplot":
            out.tables["chart_scatter"] = V.scatter_points(cleaned, ch["x"], ch["y"], ch["group"])
            if not ch["group"]:
                out.tables["chart_trendline"] = V.ols_trendline(cleaned, ch["x"], ch["y"])
        elif ch["type"] == "bar":
            out.tables["chart_bar"] = V.value_frequency(cleaned, ch["x"])
    log("charts", f"Generated {manifest.count()} chart tables.")

    # model + attribution
    importance, method = None, None
    out.problem_type = detect_problem_type(cleaned, target)
    if model and out.problem_type != "clustering":
        run = M.train_supervised(cleaned, target, key=key, settings=settings)
        for name, err in run.failures:
            log("model", f"No {name}: {err}")
        out.tables["leaderboard"] = run.leaderboard(spark)
        out.champion = run.champion
        out.metrics = next((m for m in run.metrics if m["algorithm"] == run.champion), {})
        champ = run.champion_model()
        names = run.preprocessor.feature_names
        id_col = key
        test = run.test
        if id_col is None:
            test = materialize(test.withColumn("__row", F.monotonically_increasing_id()))
            id_col = "__row"
        try:
            if any(t in (run.champion or "") for t in TREE_MODELS) and hasattr(champ, "models"):
                shap = X.tree_shap_ovr(champ, test, id_col)  # one-vs-rest boosted trees
                method = "tree_shap"
            elif any(t in (run.champion or "") for t in TREE_MODELS):
                shap = X.tree_shap(champ, test, id_col)
                method = "tree_shap"
            else:
                shap = X.linear_shap(champ, run.train, test, id_col)
                method = "linear_shap"
            chosen = X.choose_class(shap)
            importance = X.shap_importance(chosen, names).drop("class")
            out.tables.update(shap=shap, shap_importance=importance,
                              local_explanation=X.local_explanation(chosen, id_col, names))
        except (TypeError, NotImplementedError, AttributeError) as e:
            log("explain", f"SHAP not available ({e}); native importances used.")
            importance = X.native_importance(champ, names)
            method = "native_importance"
            out.tables["native_importance"] = importance
        log("model", f"Selected best model: {run.champion}.")
    elif model:
        pre = PR.fit_preprocessor(cleaned, *PR.feature_columns(cleaned, None, [key] if key else None, (settings or M.ModelSettings()).date_features))
        feats = pre.transform(cleaned)
        crun = M.kmeans_search(feats)
        out.tables["leaderboard"] = M.leaderboard_frame(spark, "clustering", crun.metrics)
        out.tables["clusters"] = crun.assign(feats).drop("features")
        out.champion = f"KMeans (k={crun.best_k})"
        best = next(m for m in crun.metrics if m["k"] == crun.best_k)
        out.metrics = dict(silhouette_score=best["silhouette_score"], n_clusters=float(crun.best_k))
        log("model", f"clusters={crun.best_k}")

    ds = R.dataset_summary(spark, dup["total_rows"], cleaned, n_clean, target)
    out.tables["dataset_summary"] = ds
    out.tables["run_summary"] = R.run_summary(spark, ds, [r["message"] for r in res.log], out.problem_type,
                                              out.champion, out.metrics, importance, method)
    return out
