"""Queries over what the engine saves: model bundles, result files and JSON documents, read back whole.

Scoring by boosted trees goes through a saved bundle: the first query of a session that needs
one fits and saves it, this and all later ones load it (E11, E12). The short fit has a SQL twin down to the
reports; the full one (500 trees, cross-validated) is too long for that.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightjar import constants as K
from nightjar.operators import explain as X
from nightjar.operators import features as feat
from nightjar.operators import folds as FO
from nightjar.operators import metrics as ME
from nightjar.operators import report as RE
from nightjar.operators import score as SC
from nightjar.operators.boosting import Settings, even_edges, fit_models
from nightjar.operators.gbt import GBTScorer, load_bundle, node_table, save_bundle
from nightjar.operators.impute import fold_medians, imputation_values
from nightjar.operators.lineage import table_path
from nightjar.operators.model import EfficiencyModelLoadError
from nightjar.plans import oracle as O
from nightjar.plans import training as TR
from nightjar.plans.batch import export_batch, fit_fixture_model
from nightjar.plans.catalog import (_BR_D, _CV, _FM, _TOP, SPLITS, _schema_report_sql, both, cv, iso, learnable_training, nights, passed, register, scored, single_result,
                                    training)
from nightjar.sinks import save_evaluation_outputs, write_batch_csv, write_batch_export, write_result_json
from nightjar.streaming import read_reports, start_report_stream

#: Where a session's bundles are, by application, tables and settings (None: the full fit).
_BUNDLES: dict[tuple[str, str, Settings | None], str] = {}


def short_training(spark, sf_dir) -> DataFrame:
    """Training rows with features that SQL rounds alike."""
    rows = learnable_training(spark, sf_dir)
    return rows.select("source_index", K.PARTICIPANT_COLUMN, K.TARGET_NAME, *[F.round(f, 6).alias(f) for f in K.MODEL_FEATURES])


def bundle_path(spark: SparkSession, sf_dir: str, settings: Settings | None = O.SHORT_FIT) -> str:
    """The bundle fitted on these tables, saved once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, settings)
    if key not in _BUNDLES:
        path = table_path(spark, "bundle")
        if settings is None:
            TR.train_and_save(learnable_training(spark, sf_dir), path, SPLITS)
        else:
            train = TR.checkpointed(short_training(spark, sf_dir), "train")
            medians = imputation_values(fold_medians(train.withColumn("fold", F.lit(0)), n_splits=0), 0)
            nodes = fit_models(train, {0: medians}, (0,), settings, edges=even_edges)
            counts = train.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(K.PARTICIPANT_COLUMN).alias("who")).first()
            save_bundle(GBTScorer(node_table(nodes), medians), path, counts["n"], counts["who"])
        _BUNDLES[key] = path
    return _BUNDLES[key]


def tree_scored(spark, sf_dir, settings: Settings | None = O.SHORT_FIT) -> tuple[DataFrame, GBTScorer]:
    """Nights scored by the saved ensemble."""
    model = load_bundle(bundle_path(spark, sf_dir, settings))
    return SC.score_nights(nights(spark, sf_dir), model), model


# ---------------------------------------------------------------- F: scoring by a saved ensemble
_TREES = O.batch_ctes(trees=O.SHORT_FIT)


@both("batch_results_trees", list(K.BATCH_RESULT_COLUMNS), _BR_D, O.batch_results_sql(trees=O.SHORT_FIT))
def q_batch_results_trees(spark, sf_dir):
    s, model = tree_scored(spark, sf_dir)
    return SC.batch_results(s, model.model_mae)


@register("batch_results_gbt", None)
def q_batch_results_gbt(spark, sf_dir):
    """The flagship with the full ensemble: cross-validated, fitted, saved, loaded, scored."""
    s, model = tree_scored(spark, sf_dir, None)
    return SC.batch_results(s, model.model_mae)


@both("top_factors_trees", _TOP, ["shap_value"],
      O.with_(*_TREES) + "select rk.source_index, rnk as factor_rank, feature, display_name, shap_value, "
      "case when shap_value < 0 then 'lowering' else 'increasing' end as direction from rk join sc using (source_index) "
      "where sc.err is null and rnk <= 5 and shap_value <> 0")
def q_top_factors_trees(spark, sf_dir):
    s, _ = tree_scored(spark, sf_dir)
    top = passed(s).select("source_index", F.posexplode(X.top_factors(F.col("factors"))).alias("p", "x"))
    return top.filter(F.col("x.shap_value") != 0).select(
        "source_index", (F.col("p") + 1).alias("factor_rank"), *[F.col(f"x.{c}").alias(c) for c in ("feature", "display_name", "shap_value")],
        F.when(F.col("x.shap_value") < 0, F.lit("lowering")).otherwise(F.lit("increasing")).alias("direction"))


@both("reports_trees", ["source_index", "report"], [], O.report_sql(trees=O.SHORT_FIT))
def q_reports_trees(spark, sf_dir):
    s, model = tree_scored(spark, sf_dir)
    return passed(RE.with_reports(s, model.model_mae))


# ---------------------------------------------------------------- E11, E12: the bundle itself
_SAVED = ["feature_position", "feature", "median", "n_splits", "target_name", "model_version", "training_rows", "training_participants"]
_COUNTS = (f"(select count(*) from lt) as training_rows, (select count(distinct {O.nullify('participant_id')}) from nights "
           "where source_index in (select source_index from lt)) as training_participants")


@both("saved_bundle", _SAVED, ["median"],
      O.with_(*_TREES, "fe(feature_position, feature, median) as (" + " union all ".join(
          f"select {i + 1}, {O.lit(f)}, med_{f} from shape" for i, f in enumerate(K.MODEL_FEATURES)) + ")")
      + f"select fe.*, (select count(*) from nodes n where n.feature = fe.feature_position - 1) as n_splits, {O.lit(K.TARGET_NAME)} as target_name, "
        f"{O.lit(K.MODEL_VERSION)} as model_version, {_COUNTS} from fe")
def q_saved_bundle(spark, sf_dir):
    """What is on disk after a fit: the metadata row and the node table."""
    path = bundle_path(spark, sf_dir)
    meta = spark.read.json(f"{path}/bundle")
    features = meta.select("*", F.from_json("medians", "map<string, double>").alias("values"), F.posexplode("feature_names").alias("at", "feature"))
    splits = spark.read.parquet(f"{path}/model").groupBy(F.col("feature").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    # One row a feature on either side.
    return features.join(F.broadcast(splits), "at", "left").withColumns({
        "feature_position": F.col("at") + 1, "median": F.col("values")[F.col("feature")], "n_splits": F.coalesce("n", F.lit(0))})


#: What a bundle's metadata may lack, and the refusal; FIXED VALUES: the cases.
_FAULTS = {
    "complete": ({}, None),
    "metrics missing": ({"metrics": None}, K.BUNDLE_INCOMPLETE),
    "features missing": ({"feature_names": None}, K.BUNDLE_INCOMPLETE),
    "features in another order": ({"feature_names": [*K.MODEL_FEATURES][::-1]}, K.BUNDLE_FEATURE_ORDER),
    "another target": ({"target_name": "total"}, K.BUNDLE_TARGET),
}


@both("bundle_refusals", ["fault", "training_rows", "error"], [],
      O.with_(*_TREES) + " union all ".join(
          f"select {O.lit(name)} as fault, (select count(*) from lt) as training_rows, {'cast(null as varchar)' if text is None else O.lit(text)} as error"
          for name, (_, text) in _FAULTS.items()))
def q_bundle_refusals(spark, sf_dir):
    """The saved bundle loaded as it is and with each fault written into its metadata."""
    path, rows = bundle_path(spark, sf_dir), []
    meta = json.loads(spark.read.text(f"{path}/bundle").first()[0])
    for name, (change, _) in _FAULTS.items():
        broken = table_path(spark, "bundle")
        spark.read.parquet(f"{path}/model").write.parquet(f"{broken}/model")
        text = json.dumps({k: v for k, v in (meta | change).items() if v is not None})
        spark.createDataFrame([(text,)], "value string").write.text(f"{broken}/bundle")
        try:
            load_bundle(broken)
            error = None
        except EfficiencyModelLoadError as refusal:
            error = str(refusal)
        rows.append((name, meta["training_rows"], error))
    return spark.createDataFrame(rows, "fault string, training_rows bigint, error string")


# ---------------------------------------------------------------- D9, E4: refusals
def _leakage_sql() -> str:
    columns = [*O.NIGHT_COLUMNS, *[f for f in K.MODEL_FEATURES if f not in O.NIGHT_COLUMNS]]
    value = lambda c: c if c in O.NIGHT_COLUMNS else f"{c}_f"
    refused = lambda c: "true" if c in K.LEAKAGE_COLUMNS | K.EXCLUDED_COLUMNS else "false"
    return O.with_(O.NIGHTS, *O.features_ctes()) + " union all ".join(
        f"select {O.lit(c)} as name, count({value(c)}) as n_values, {refused(c)} as refused from feat" for c in columns)


@both("leakage_columns", ["name", "n_values", "refused"], [], _leakage_sql())
def q_leakage_columns(spark, sf_dir):
    """Every column that a night has after feature work, its values and whether the guard keeps it from the model."""
    raw = nights(spark, sf_dir)
    names = [c for c in raw.columns if c != "source_index"]
    wide = feat.engineer_features(raw.select("source_index", *names, *[F.col(c).alias(f"__raw_{c}") for c in names]))
    made = [f for f in K.MODEL_FEATURES if f not in names]
    counts = wide.agg(*[F.count(f"__raw_{c}").alias(c) for c in names], *[F.count(f).alias(f) for f in made])

    def refused(name: str) -> bool:
        try:
            feat.check_no_leakage([name])
        except feat.PreprocessingError:
            return True
        return False

    rows = [F.struct(F.lit(c).alias("name"), F.col(c).alias("n_values"), F.lit(refused(c)).alias("refused")) for c in counts.columns]
    return counts.select(F.inline(F.array(*rows)))


_DAYS = "select weekday, count(*) as n_rows, count(distinct participant_id) as n_participants from (select isodow(date) - 1 as weekday, participant_id from train) d group by weekday"


@both("too_few_participants", ["weekday", "n_participants", "n_splits", "error"], [],
      O.with_(O.NIGHTS, *O.training_ctes(), f"days as ({_DAYS})", f"asked as (select weekday, n_participants, {SPLITS} as n_splits from days "
              "union all select weekday, n_participants, n_participants + 1 as n_splits from days)")
      + "select cast(weekday as integer) as weekday, n_participants, cast(n_splits as integer) as n_splits, case when n_participants < n_splits then "
        "'Grouped validation requires at least ' || n_splits || ' participants; found ' || n_participants || '.' end as error from asked")
def q_too_few_participants(spark, sf_dir):
    """Each weekday's nights asked for the usual folds, and for one fold more than they have participants."""
    train = TR.checkpointed(training(spark, sf_dir).select(K.PARTICIPANT_COLUMN, F.weekday("date").alias("weekday")), "train")
    rows = []
    for day in sorted(r[0] for r in train.select("weekday").distinct().collect()):  # seven at most
        who = train.filter(F.col("weekday") == day).select(K.PARTICIPANT_COLUMN).distinct()
        n = FO.check_participants(who, 0)
        for n_splits in (SPLITS, n + 1):
            try:
                FO.check_participants(who, n_splits)
                error = None
            except FO.GroupedValidationError as refusal:
                error = str(refusal)
            rows.append((day, n, n_splits, error))
    return spark.createDataFrame(rows, "weekday int, n_participants bigint, n_splits int, error string")


# ---------------------------------------------------------------- K1, K2, K4: files
@both("batch_csv", list(K.BATCH_RESULT_COLUMNS), _BR_D, O.batch_results_sql(trees=O.SHORT_FIT))
def q_batch_csv(spark, sf_dir):
    s, model = tree_scored(spark, sf_dir)
    results, path = SC.batch_results(s, model.model_mae), table_path(spark, "csv")
    write_batch_csv(results, path)
    return spark.read.schema(results.schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


_PARTS = ["part", "source_row", "text"]


@both("export_parts", _PARTS, [],
      f"with b as ({O.batch_results_sql(trees=O.SHORT_FIT)}), n as ({O.with_(O.NIGHTS)} select source_index, date from nights order by source_index limit {K.MAX_BATCH_RECORDS}) "
      "select 'Analysis_Results' as part, source_row, record_label as text from b where error is null "
      "union all select 'Processing_Errors', source_row, error from b where error is not null "
      "union all select 'Input_Preview', source_index + 2, date from n")
def q_export_parts(spark, sf_dir):
    s, model = tree_scored(spark, sf_dir)
    results, path = SC.batch_results(s, model.model_mae), table_path(spark, "export")
    write_batch_export(results, None, path, preview=nights(spark, sf_dir))
    text = {"Analysis_Results": ("source_row", "record_label"), "Processing_Errors": ("source_row", "error"), "Input_Preview": (F.col("source_index") + 2, "date")}
    parts = [spark.read.parquet(f"{path}/{part}").select(F.lit(part).alias("part"), (F.col(row) if isinstance(row, str) else row).alias("source_row"), F.col(c).alias("text"))
             for part, (row, c) in text.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_OBSERVED = ["n_rows", "n_valid_rows", "n_error_rows", "errors", "warnings", "state"]


_OBSERVED_SQL = (
    f"select {', '.join('r.' + c for c in _OBSERVED)}, s.n_success, s.n_failed, s.mean_predicted_efficiency "
    f"from ({_schema_report_sql()}) r, (select count(*) filter (where error is null) as n_success, count(*) filter (where error is not null) as n_failed, "
    f"avg(predicted_efficiency) filter (where error is null) as mean_predicted_efficiency from ({O.batch_results_sql(with_mae=False)}) b) s")


@both("export_observed", [*_OBSERVED, "n_success", "n_failed", "mean_predicted_efficiency"], ["mean_predicted_efficiency"], _OBSERVED_SQL)
def q_export_observed(spark, sf_dir):
    """Schema report and summary as observed by the pass that writes the export."""
    rows = nights(spark, sf_dir)
    summary, report = export_batch(rows, fit_fixture_model(rows, with_metrics=False), table_path(spark, "export"))
    texts = [F.array_join(c, "; ").alias(c) if c in ("errors", "warnings") else c for c in _OBSERVED]
    return report.select(*texts).crossJoin(summary.drop("n_rows"))  # one row each


@both("stream_report", [*_OBSERVED, "n_success", "n_failed", "mean_predicted_efficiency"], ["mean_predicted_efficiency"], _OBSERVED_SQL)
def q_stream_report(spark, sf_dir):
    """The last report of a stream of the nights, which come in four micro-batches."""
    rows, source, out = nights(spark, sf_dir), table_path(spark, "stream-nights"), table_path(spark, "stream-reports")
    rows.repartition(4, "source_index").write.parquet(source)
    files = spark.read.parquet(source).select(F.input_file_name()).distinct().count()
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-files // 4)).parquet(source)
    query = start_report_stream(arriving, fit_fixture_model(rows, with_metrics=False), out, table_path(spark, "stream-state"))
    query.awaitTermination()
    reports = read_reports(spark, out)
    texts = [F.array_join(c, "; ").alias(c) if c in ("errors", "warnings") else c for c in _OBSERVED]
    # One row a micro-batch.
    return reports.orderBy(F.col("batch").desc()).limit(1).select(*texts, "n_success", "n_failed", "mean_predicted_efficiency")


_EVALUATION = [*ME.METRIC_NAMES, "number_of_rows", "number_of_participants", "mean_actual_efficiency", "mean_predicted_efficiency"]


def _evaluation_sql() -> str:
    overall = ", ".join(f"{{'name': '{m}', 'value': cast({m} as double)}}" for m in _EVALUATION)
    folds = ", ".join(f"{{'name': '{m}', 'value': cast({m} as double)}}" for m in _FM[1:])
    return O.with_(*_CV, *O.fold_metric_ctes(), f"ovr as (select {O.metric_aggs()}, (select spearman_correlation from sp where fold = 0) as spearman_correlation from oof)",
                   f"a as (select 'evaluation' as file, 0 as fold, unnest([{overall}]) as x from ovr union all select 'fold_metrics', fold, unnest([{folds}]) from fmx)") \
        + "select file, cast(fold as integer) as fold, x.name as name, x.value as value from a"


def evaluation_files(spark, sf_dir) -> str:
    result, path = cv(spark, sf_dir), table_path(spark, "evaluation")
    save_evaluation_outputs(path, result.summary(), result.fold_metrics(), result.predictions.withColumn("date", iso("date")))
    return path


@both("evaluation_files", ["file", "fold", "name", "value"], ["value"], _evaluation_sql())
def q_evaluation_files(spark, sf_dir):
    path = evaluation_files(spark, sf_dir)
    named = lambda names: F.inline(F.array(*[F.struct(F.lit(m).alias("name"), F.col(m).cast("double").alias("value")) for m in names]))
    overall = spark.read.json(f"{path}/evaluation").select(F.lit("evaluation").alias("file"), F.lit(0).alias("fold"), named(_EVALUATION))
    folds = spark.read.option("header", True).csv(f"{path}/fold_metrics").select(F.lit("fold_metrics").alias("file"), F.col("fold").cast("int").alias("fold"), named(_FM[1:]))
    return overall.unionByName(folds)


_SIX = [*K.OOF_COLUMNS]


@both("evaluation_predictions", _SIX, ["actual_efficiency", "predicted_efficiency", "absolute_error"],
      O.with_(*_CV) + f"select {', '.join(c if c != 'date' else O.iso('date') + ' as date' for c in _SIX)} from oof")
def q_evaluation_predictions(spark, sf_dir):
    path = evaluation_files(spark, sf_dir)
    types = ", ".join(f"{c} {'string' if c in ('participant_id', 'date') else 'int' if c == 'fold' else 'double'}" for c in _SIX)
    return spark.read.schema(types).option("header", True).csv(f"{path}/test_predictions")


# ---------------------------------------------------------------- F14, K3: whole documents
_ENTRY = ["source_index", "path", "number", "text"]


def entries(documents: DataFrame, depth: int = 4) -> DataFrame:
    """source_index, path, number, text: every value within a JSON text ``j``, whatever keys it has.

    Objects and arrays are opened level by level in one pass, in which values that are found go along; an empty
    one has no values.
    """
    def nested(v):
        kind = F.schema_of_variant(v)
        return kind.startswith("OBJECT") | kind.startswith("ARRAY")

    level = documents.select("source_index", F.lit("").alias("path"), F.parse_json("j").alias("v"))
    level = level.withColumn("more", nested(F.col("v"))).filter("more")
    for _ in range(depth):
        inside = documents.sparkSession.tvf.variant_explode_outer(F.when(F.col("more").outer(), F.col("v").outer()))
        opened = level.lateralJoin(inside).filter(~F.col("more") | F.col("pos").isNotNull())
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key")))
        level = opened.select("source_index", F.when(F.col("more"), F.concat("path", step)).otherwise(F.col("path")).alias("path"),
                              F.when(F.col("more"), F.col("value")).otherwise(F.col("v")).alias("v"), "more")
        level = level.withColumn("more", F.col("more") & nested(F.col("v")))
    values, kind = level.filter(~F.col("more")), F.schema_of_variant("v")
    return values.select("source_index", F.expr("substring(path, 2)").alias("path"), F.when(kind != "STRING", F.try_variant_get("v", "$", "double")).alias("number"),
                         F.when(kind == "STRING", F.try_variant_get("v", "$", "string")).alias("text"))


def _entries_sql(numbers: dict[str, str], texts: dict[str, str], lists: dict[str, str], with_mae: bool, nulls: bool) -> str:
    """The same from scored rows: scalars by path, lists of texts and the kept factors."""
    entry = lambda path, number="null", text="null": f"{{'path': {path}, 'number': cast({number} as double), 'text': cast({text} as varchar)}}"
    plain = [entry(O.lit(p), number=e) for p, e in numbers.items()] + [entry(O.lit(p), text=e) for p, e in texts.items()]
    parts = [f"select source_index, unnest([{', '.join(plain)}]) as x from ok"]
    for path, items in lists.items():
        item = entry(f"{O.lit(path)} || '[' || (i - 1) || ']'", text="items[i]")
        parts.append(f"select source_index, {item} as x from (select source_index, items, unnest(range(1, len(items) + 1)) as i from "
                     f"(select source_index, {items} as items from ok) a) b")
    at = "'factors_' || side || '_prediction[' || i || '].'"
    fields = [entry(f"{at} || '{c}'", text=c) for c in ("feature", "display_name")] + [entry(f"{at} || '{c}'", number=c) for c in ("feature_value", "shap_value")]
    parts.append(f"select source_index, unnest([{', '.join(fields)}]) as x from kept")
    ctes = [*O.batch_ctes(with_mae=with_mae), "ok as (select * from sc where err is null)",
            "kept as (select rk.*, case when shap_value < 0 then 'lowering' else 'increasing' end as side, row_number() over (partition by rk.source_index, shap_value < 0 order by rnk) - 1 as i "
            "from rk join (select source_index from ok) using (source_index) where rnk <= 5 and shap_value <> 0)"]
    return (O.with_(*ctes) + f"select source_index, x.path as path, x.number as number, x.text as text from ({' union all '.join(parts)}) u"
            + ("" if nulls else " where x.number is not null or x.text is not null"))


_DATE = f"coalesce({O.iso('night_date')}, date)"


def _measured(prefix: str) -> dict[str, str]:
    return {f"{prefix}.{name}": f"{source}_f" for name, source in K.DISPLAY_MEASUREMENTS}


@both("result_document", _ENTRY, ["number"], _entries_sql(
    {"source_index": "source_index", "predicted_efficiency_percent": "pred", "model_mae_percent": "model_mae", "base_value": "base_value",
     **_measured("display_measurements"), **{f"model_features.{f}": f"{f}_f" for f in K.MODEL_FEATURES}},
    {"data_quality.quality": "quality", "display_measurements.date": _DATE, "efficiency_band": O.band_sql("pred")},
    {"data_quality.warnings": "warnings_list", "data_quality.missing_optional_fields": "list_filter([missing_optional_text], lambda f: f <> '')"}, with_mae=False, nulls=True))
def q_result_document(spark, sf_dir):
    """K3 as written: every value of the JSON document of every night that was scored."""
    s, model = scored(spark, sf_dir)
    doc, path = single_result(passed(s), model), table_path(spark, "json")
    write_result_json(doc, path)
    found = spark.read.text(path).select(F.get_json_object("value", "$.source_index").cast("long").alias("source_index"), F.col("value").alias("j"))
    return entries(found)


@both("payload_document", _ENTRY, ["number"], _entries_sql(
    {"predicted_efficiency_percent": "pred", "model_mae_percent": "model_mae", **_measured("verified_measurements")},
    {"efficiency_band": O.band_sql("pred"), "verified_measurements.date": _DATE}, {"data_quality_warnings": "list_concat(warnings_list, fw_list)"}, with_mae=True, nulls=False))
def q_payload_document(spark, sf_dir):
    """every value of the payload of every night that was scored."""
    s, model = scored(spark, sf_dir, with_metrics=True)
    return entries(passed(s).select("source_index", F.to_json(RE.report_payload(s, model.model_mae)).alias("j")))
