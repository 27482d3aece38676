"""Independent DuckDB SQL for every catalog query (the correctness oracle).

The SQL restates each operator's semantics directly in SQL over the
``events`` view; it shares only the fixed values (messages, field lists)
with the Spark code; its patterns are its own. Conventions: arrays are compared
as '; '-joined text, dates as ISO text, floating results through ``r9``
(9 decimals, tiny values folded to 0.0 so both engines agree on the sign).
"""

from __future__ import annotations

import math

from nightjar import constants as K
from nightjar.operators.boosting import KEY_FACTOR, LEAST_GAIN, MODULUS, TREE_FACTOR, UNITS, Settings, tree_columns
from nightjar.sources.nights import night_view_sql

FINITE_NUMBER_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
NONFINITE_NUMBER_RE = r"^\s*[+-]?([iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"
TWO_PI = repr(2 * math.pi)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def r9(x: str) -> str:
    return f"(case when abs({x}) < 5e-10 then 0.0 else round({x}, 9) end)"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def nullify(c: str) -> str:
    spellings = ", ".join(lit(v) for v in K.MISSING_TEXT)
    return f"(case when lower({strip(c)}) in ({spellings}) then null else {c} end)"


def strict_num(c: str) -> str:
    return (f"(case when regexp_matches({c}, {lit(FINITE_NUMBER_RE)}) or "
            f"regexp_matches({c}, {lit(NONFINITE_NUMBER_RE)}) "
            f"then try_cast({strip(c)} as double) end)")


def lenient_num(c: str) -> str:
    v = nullify(c)
    inner = f"(case when regexp_matches({v}, {lit(FINITE_NUMBER_RE)}) then try_cast({strip(v)} as double) end)"
    return f"(case when isfinite({inner}) then {inner} end)"


MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def parse_date(c: str) -> str:
    s = strip(nullify(c))
    month = f"list_position([{', '.join(lit(m) for m in MONTHS)}], m)"
    short = f"list_position([{', '.join(lit(m[:3]) for m in MONTHS)}], m)"

    def ymd(y: str, m: str, d: str) -> str:
        return f"try_cast(concat(lpad({y}, 4, '0'), '-', lpad({m}, 2, '0'), '-', lpad({d}, 2, '0')) as date)"

    def part(pattern: str, n: int) -> str:
        return f"regexp_extract({s}, {lit(pattern)}, {n})"

    year_first = r"^(\d{4})([-/.])(\d{1,2})([-/.])(\d{1,2})$"
    year_last = r"^(\d{1,2})([-/.])(\d{1,2})([-/.])(\d{4})$"
    named_first = r"^([A-Za-z]+)\.? (\d{1,2}),? (\d{4})$"
    named_second = r"^(\d{1,2}) ([A-Za-z]+)\.?,? (\d{4})$"
    stamp = r"^\d{4}-\d\d-\d\d[T ]([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,9})?)?(Z|[+-]\d\d:?\d\d)?$"
    a, b, y = part(year_last, 1), part(year_last, 3), part(year_last, 5)
    named = lambda name: f"(select cast(coalesce({month}, {short}, case when m = 'sept' then 9 end) as varchar) from (select lower({name}) as m))"
    return (
        f"(case when regexp_matches({s}, {lit(stamp)}) then try_cast(substr({s}, 1, 10) as date) "
        f"when regexp_matches({s}, '^\\d{{8}}$') then {ymd(f'substr({s}, 1, 4)', f'substr({s}, 5, 2)', f'substr({s}, 7, 2)')} "
        f"when regexp_matches({s}, {lit(year_first)}) and {part(year_first, 2)} = {part(year_first, 4)} then {ymd(part(year_first, 1), part(year_first, 3), part(year_first, 5))} "
        f"when regexp_matches({s}, {lit(year_last)}) and {part(year_last, 2)} = {part(year_last, 4)} then coalesce({ymd(y, a, b)}, {ymd(y, b, a)}) "
        f"when regexp_matches({s}, {lit(named_first)}) then {ymd(part(named_first, 3), named(part(named_first, 1)), part(named_first, 2))} "
        f"when regexp_matches({s}, {lit(named_second)}) then {ymd(part(named_second, 3), named(part(named_second, 2)), part(named_second, 1))} end)"
    )


def iso(d: str) -> str:
    return f"strftime({d}, '%Y-%m-%d')"


def with_(*ctes: str) -> str:
    return "with recursive " + ",\n".join(ctes) + "\n"


NIGHTS = f"nights as (\n{night_view_sql('events')}\n)"
STRING_COLUMNS = ["participant_id", "email", "date"] + K.NUMERIC_INPUT_FIELDS[:-1] + [
    "temperature_trend_deviation", "efficiency"]
NIGHT_COLUMNS = ["participant_id", "email", "date", "onset_latency", "midpoint_time", "restless",
                 "hr_average", "hr_lowest", "rmssd", "breath_average", "temperature_deviation",
                 "temperature_trend_deviation", "rem", "deep", "total", "bedtime_start_delta", "efficiency"]


def quality_ctes(src: str = "nights") -> list[str]:
    """CTEs ``q0``/``q`` adding errors/warnings/quality over a raw night table."""
    fields = K.REQUIRED_FIELDS + K.OPTIONAL_FIELDS
    q0 = [f"({f} is null) as m_{f}" for f in fields]
    q0.append(f"{parse_date('date')} as p_date")
    q0 += [f"{strict_num(f)} as s_{f}" for f in K.NUMERIC_INPUT_FIELDS]
    fin = {f: f"(case when not m_{f} and isfinite(s_{f}) then s_{f} end)" for f in K.NUMERIC_INPUT_FIELDS}
    errs = [f"case when m_{f} then {lit(K.MSG_MISSING.format(field=f))} end" for f in K.REQUIRED_FIELDS]
    errs.append(f"case when not m_date and p_date is null then {lit(K.MSG_BAD_DATE)} end")
    for f in K.NUMERIC_INPUT_FIELDS:
        errs.append(f"case when not m_{f} and s_{f} is null then {lit(K.MSG_NOT_NUMERIC.format(field=f))} "
                    f"when not m_{f} and not isfinite(s_{f}) then {lit(K.MSG_NOT_FINITE.format(field=f))} end")
    for f in K.NON_NEGATIVE_FIELDS:
        errs.append(f"case when {fin[f]} < 0 then {lit(K.MSG_NEGATIVE.format(field=f))} end")
    errs.append(f"case when {fin['total']} <= 0 then {lit(K.MSG_TOTAL)} end")
    errs.append(f"case when {fin['rem']} + {fin['deep']} > {fin['total']} then {lit(K.MSG_STAGES)} end")
    warns = [f"case when m_temperature_trend_deviation then {lit(K.WARN_OPTIONAL)} end",
             f"case when {fin['hr_lowest']} > {fin['hr_average']} then {lit(K.WARN_HR_ORDER)} end"]
    for f, lo, hi in K.PLAUSIBLE_RANGES:
        warns.append(f"case when not ({fin[f]} between {lo} and {hi}) then {lit(K.WARN_RANGE.format(field=f))} end")
    q1 = [f"concat_ws('; ', {', '.join(errs)}) as errors_text",
          f"concat_ws('; ', {', '.join(warns)}) as warnings_text",
          f"list_filter([{', '.join(warns)}], lambda w: w is not null) as warnings_list",
          " + ".join(f"(case when ({w}) is not null then 1 else 0 end)" for w in warns) + " as n_warnings_q",
          "case when m_temperature_trend_deviation then 'temperature_trend_deviation' else '' end as missing_optional_text"]
    return [
        f"q0 as (select *, {', '.join(q0)} from {src})",
        f"q1 as (select *, {', '.join(q1)} from q0)",
        "q as (select *, case when errors_text <> '' then 'Poor' when warnings_text <> '' then 'Limited' "
        "else 'Good' end as quality, case when errors_text <> '' then errors_text end as error from q1)",
    ]


def feature_exprs(prefix: str = "") -> dict[str, str]:
    """Feature expressions over a table of lenient numbers ``n_<col>`` and ``night_date``."""
    p = prefix
    vt = f"(case when {p}n_total > 0 then {p}n_total end)"
    bsd = f"cast({p}n_bedtime_start_delta / 3600.0 as double)"
    hour = f"(case when {bsd} % 24.0 < 0 then ({bsd} % 24.0 + 24.0) % 24.0 else {bsd} % 24.0 end)"
    day = f"cast(isodow({p}night_date) - 1 as double)"
    raw = {f: f"{p}n_{f}" for f in K.MODEL_FEATURES[:9]}
    raw.update({
        "rem_sleep_percent": f"{p}n_rem / {vt} * 100.0",
        "deep_sleep_percent": f"{p}n_deep / {vt} * 100.0",
        "bedtime_sin": f"sin({TWO_PI} * {hour} / 24.0)",
        "bedtime_cos": f"cos({TWO_PI} * {hour} / 24.0)",
        "day_sin": f"sin({TWO_PI} * {day} / 7.0)",
        "day_cos": f"cos({TWO_PI} * {day} / 7.0)",
    })
    return {k: f"(case when isfinite({v}) then {v} end)" for k, v in raw.items()}


def features_ctes(src: str = "nights", name: str = "feat") -> list[str]:
    """CTE ``<name>``: every source column plus lenient numbers ``n_*``, ``night_date`` and ``<f>_f``."""
    nums = ", ".join(f"{lenient_num(c)} as n_{c}" for c in K.RAW_NUMERIC_COLUMNS)
    fx = feature_exprs()
    feats = ", ".join(f"{expr} as {f}_f" for f, expr in fx.items())
    return [
        f"{name}_n as (select *, {nums}, {parse_date('date')} as night_date from {src})",
        f"{name} as (select *, {feats} from {name}_n)",
    ]


def training_ctes(src: str = "nights") -> list[str]:
    """CTE ``train``: prepared training rows (email dropped; participant_id kept)."""
    fcols = ", ".join(f"{f}_f as {f}" for f in K.MODEL_FEATURES)
    return features_ctes(src, "tfeat") + [
        f"train as (select source_index, {nullify('participant_id')} as participant_id, night_date as date, "
        f"{fcols}, n_efficiency as efficiency from tfeat "
        f"where n_efficiency is not null and {nullify('participant_id')} is not null and night_date is not null)"
    ]


def dbl(x: float) -> str:
    return f"cast({x!r} as double)"


def folds_ctes(k: int) -> list[str]:
    """``folds`` (participant_id, n_rows, fold) and ``wf`` (train + fold).

    Participants go one by one, most rows first, to the fold with the fewest rows.
    """
    zeros = ", ".join(["0"] * k)
    return [
        "pc as (select participant_id, count(*) as n_rows from train group by participant_id)",
        "big as materialized (select participant_id, n_rows, row_number() over (order by n_rows desc, participant_id) as i from pc)",
        f"deal(i, participant_id, n_rows, fold, held) as (select cast(0 as bigint), cast(null as varchar), cast(0 as bigint), cast(0 as bigint), [{zeros}]::bigint[] "
        "union all select big.i, big.participant_id, big.n_rows, cast(list_position(held, list_min(held)) as bigint), "
        "list_transform(held, lambda x, p: case when p = list_position(held, list_min(held)) then x + big.n_rows else x end) "
        "from deal join big on big.i = deal.i + 1)",
        "folds as materialized (select participant_id, n_rows, cast(fold as integer) as fold from deal where i > 0)",
        "wf as (select t.*, f.fold from train t join folds f using (participant_id))",
    ]


def medians_ctes(k: int, src: str = "wf") -> list[str]:
    """``med`` (fold, feature, median, n_values): fold 0 = all rows, k = rows with fold <> k."""
    feats = ", ".join(K.MODEL_FEATURES)
    names = ", ".join(f"('{f}')" for f in K.MODEL_FEATURES)
    return [
        f"lng as (unpivot (select fold, {feats} from {src}) on {feats} into name feature value value)",
        f"ks as (select cast(unnest(range(0, {k + 1})) as integer) as fold)",
        f"grid as (select ks.fold, fe.feature from ks cross join (values {names}) fe(feature))",
        "mv as (select ks.fold, l.feature, median(l.value) as median, count(*) as n_values "
        "from lng l join ks on l.fold <> ks.fold group by ks.fold, l.feature)",
        "med as (select g.fold, g.feature, mv.median, coalesce(mv.n_values, 0) as n_values "
        "from grid g left join mv using (fold, feature))",
        "medw as (select fold, " + ", ".join(
            f"max(case when feature = '{f}' then median end) as med_{f}" for f in K.MODEL_FEATURES)
        + " from med group by fold)",
    ]


def linear_terms(value) -> dict[str, str]:
    """Contribution SQL per feature; ``value(f)`` gives the imputed feature SQL."""
    out = {}
    for f in K.MODEL_FEATURES:
        coef, centre = K.LINEAR_COEFFICIENTS.get(f, (0.0, 0.0))
        out[f] = f"({dbl(coef)} * ({value(f)} - {dbl(centre)}))" if coef != 0.0 else "0.0"
    return out


def linear_prediction(terms: dict[str, str]) -> str:
    parts = [dbl(K.LINEAR_BASE)] + [terms[f] for f in K.MODEL_FEATURES if K.LINEAR_COEFFICIENTS.get(f, (0, 0))[0]]
    return "(" + " + ".join(parts) + ")"


def oof_ctes(k: int) -> list[str]:
    """``imp`` (fold-imputed rows) and ``oof`` (out-of-fold linear predictions)."""
    imp_cols = ", ".join(f"coalesce(wf.{f}, m.med_{f}, 0.0) as {f}" for f in K.MODEL_FEATURES)
    pred = linear_prediction(linear_terms(lambda f: f))
    return folds_ctes(k) + medians_ctes(k) + [
        f"imp as (select wf.source_index, wf.participant_id, wf.date, wf.efficiency, wf.fold, {imp_cols} "
        "from wf left join medw m using (fold))",
        f"oof as (select source_index, participant_id, date, efficiency as actual_efficiency, "
        f"{pred} as predicted_efficiency, abs(efficiency - {pred}) as absolute_error, fold from imp)",
    ]


def metric_aggs(a: str = "actual_efficiency", p: str = "predicted_efficiency") -> str:
    err = f"({a} - {p})"
    return (
        f"count(*) as number_of_rows, avg(abs({err})) as mae, sqrt(avg({err} * {err})) as rmse, "
        f"case when count(*) < 2 then null when var_pop({a}) * count(*) = 0 then "
        f"case when sum({err} * {err}) = 0 then 1.0 else 0.0 end "
        f"else 1.0 - sum({err} * {err}) / (var_pop({a}) * count(*)) end as r2, "
        f"case when count(*) >= 2 and min({a}) < max({a}) and min({p}) < max({p}) "
        f"then greatest(-1.0, least(1.0, corr({a}, {p}))) end as pearson_correlation, "
        f"avg({a}) as mean_actual_efficiency, avg({p}) as mean_predicted_efficiency, "
        f"count(distinct participant_id) as number_of_participants"
    )


def spearman_ctes() -> list[str]:
    """``sp`` (fold, spearman_correlation), fold 0 = all rows."""
    rk = ("rank() over (partition by g order by {c}) + (count(*) over (partition by g, {c}) - 1) / 2.0")
    return [
        "sb as (select fold as g, actual_efficiency, predicted_efficiency from oof "
        "union all select 0 as g, actual_efficiency, predicted_efficiency from oof)",
        f"sr as (select g, actual_efficiency, predicted_efficiency, {rk.format(c='actual_efficiency')} as ra, "
        f"{rk.format(c='predicted_efficiency')} as rp from sb)",
        "sp as (select g as fold, case when count(*) >= 2 and min(actual_efficiency) < max(actual_efficiency) "
        "and min(predicted_efficiency) < max(predicted_efficiency) then greatest(-1.0, least(1.0, corr(ra, rp))) end "
        "as spearman_correlation from sr group by g)",
    ]


def fold_metric_ctes() -> list[str]:
    return spearman_ctes() + [
        "ov as (select fold, count(*) as n_participants, count(*) filter (where n_folds > 1) as participant_overlap_count "
        "from (select participant_id, fold, count(*) over (partition by participant_id) as n_folds "
        "from (select distinct participant_id, fold from wf)) group by fold)",
        f"fm as (select fold, {metric_aggs()} from oof group by fold)",
        "fmx as (select fm.*, sp.spearman_correlation, ov.participant_overlap_count "
        "from fm left join sp using (fold) left join ov using (fold))",
    ]


def band_sql(p: str) -> str:
    whens = " ".join(f"when {p} >= {b} then {lit(label)}" for b, label in K.EFFICIENCY_BANDS)
    return f"(case {whens} else {lit(K.EFFICIENCY_BAND_LOWEST)} end)"


def label_sql(row: str = "source_index") -> str:
    pid, email = strip("participant_id"), strip("email")
    masked = (f"case when contains({email}, '@') then substr(split_part({email}, '@', 1), 1, 2) || '***@' || "
              f"substr({email}, instr({email}, '@') + 1) else substr({email}, 1, 2) || '***' end")
    ident = f"case when {pid} <> '' then {pid} when {email} <> '' then {masked} end"
    return (f"concat_ws({lit(K.LABEL_SEPARATOR)}, {ident}, {iso(parse_date('date'))}, "
            f"'Row ' || cast({row} + 2 as varchar))")


def batch_ctes(k: int = K.DEFAULT_SPLITS, with_mae: bool = True, trees: Settings | None = None) -> list[str]:
    """``sc`` (scored nights), ``fl``/``rk`` (ranked factors), ``mains``.

    The linear fixture model's medians are fold 0 of ``med`` (all training rows); its MAE is
    the mean fold MAE of the same model's cross-validation. With ``trees`` the model is
    a fit of boosted trees by these settings instead, without an MAE.
    """
    if trees is not None:
        fitted, nodes = boosted_trees_ctes(trees)
        ctes = [*fitted, f"nodes as materialized ({nodes})", *tree_shap_ctes(trees)]
        shap, base, source = ", ".join(f"sh.shap_{f}" for f in K.MODEL_FEATURES), "sh.base_value", "bfeat b join sh using (source_index)"
        pred = "(base_value + " + " + ".join(f"shap_{f}" for f in K.MODEL_FEATURES) + ")"
    else:
        terms = linear_terms(lambda f: f"coalesce(b.{f}_f, m0.med_{f}, 0.0)")
        ctes = [NIGHTS, *quality_ctes(), *features_ctes("q", "bfeat"), *training_ctes(), *oof_ctes(k)]
        shap, base = ", ".join(f"{terms[f]} as shap_{f}" for f in K.MODEL_FEATURES), dbl(K.LINEAR_BASE)
        source = "bfeat b cross join (select * from medw where fold = 0) m0"
        pred = linear_prediction({f: f"shap_{f}" for f in K.MODEL_FEATURES})
    actual_text = nullify("b.efficiency")
    actual_num = strict_num(actual_text)
    fw = ", ".join(f"case when b.{f}_f is null then {lit(K.WARN_FEATURE_IMPUTED.format(feature=f))} end"
                   for f in K.MODEL_FEATURES)
    mae = "null"
    if with_mae and trees is None:
        ctes += [f"fmm as (select fold, {metric_aggs()} from oof group by fold)",
                 "mm as (select avg(mae) as mae_mean from fmm)"]
        mae = "(select mae_mean from mm)"
    ctes += [
        f"s0 as (select b.*, {shap}, {base} as base_value, {label_sql()} as record_label, "
        f"case when isfinite({actual_num}) then {actual_num} end as actual, "
        f"case when {actual_text} is not null and {actual_num} is null then "
        f"'could not convert string to float: ''' || {actual_text} || '''' end as actual_error, "
        f"concat_ws('; ', {fw}) as fw_text, list_filter([{fw}], lambda w: w is not null) as fw_list, "
        + " + ".join(f"(case when b.{f}_f is null then 1 else 0 end)" for f in K.MODEL_FEATURES)
        + f" as n_fw, cast({mae} as double) as model_mae "
        f"from {source})",
        f"sc as (select *, {pred} as pred, coalesce(error, actual_error) as err, "
        f"concat_ws('; ', nullif(warnings_text, ''), nullif(fw_text, '')) as all_warnings_text from s0)",
        "fl as (" + " union all ".join(
            f"select source_index, {i + 1} as pos, {lit(f)} as feature, {lit(K.FEATURE_LABELS[f])} as display_name, "
            f"{f}_f as feature_value, shap_{f} as shap_value from sc" for i, f in enumerate(K.MODEL_FEATURES)) + ")",
        "rk as (select *, row_number() over (partition by source_index order by abs(shap_value) desc, pos) as rnk from fl)",
        "mains as (select source_index, arg_min(display_name, rnk) filter (where rnk <= 5 and shap_value < 0) as main_low, "
        "arg_min(display_name, rnk) filter (where rnk <= 5 and shap_value > 0) as main_inc from rk group by source_index)",
    ]
    return ctes


def batch_results_sql(with_mae: bool = True, trees: Settings | None = None) -> str:
    ok = "sc.err is null"
    return with_(*batch_ctes(with_mae=with_mae, trees=trees)) + (
        "select sc.source_index + 2 as source_row, record_label, coalesce(participant_id, email) as participant_id, "
        f"date, case when {ok} then quality else 'Poor' end as data_quality, "
        f"case when {ok} then pred end as predicted_efficiency, actual as actual_efficiency, "
        f"case when {ok} then abs(pred - actual) end as absolute_error, "
        f"case when {ok} then {band_sql('pred')} end as efficiency_band, "
        f"case when {ok} then model_mae end as model_mae, "
        f"case when {ok} then main_low end as main_lowering_factor, "
        f"case when {ok} then main_inc end as main_increasing_factor, "
        f"case when {ok} then {lit(K.REPORT_NOT_REQUESTED)} else {lit(K.REPORT_FAILED)} end as report_status, "
        "err as error from sc left join mains using (source_index)")


def report_sql(trees: Settings | None = None) -> str:
    """Report text per passed night (same template; numbers via printf)."""
    low = (f"'- ' || display_name || ' ' || {lit(K.REPORT_LOWER)} || "
           f"'; its SHAP contribution was approximately ' || printf('%.2f', abs(shap_value)) || ' percentage points.'")
    inc = low.replace(lit(K.REPORT_LOWER), lit(K.REPORT_HIGHER))
    nl = "chr(10)"
    ctes = batch_ctes(with_mae=True, trees=trees) + [
        "lines as (select rk.source_index, case when shap_value < 0 then 0 else 1 end as d, rnk, "
        f"case when shap_value < 0 then {low} else {inc} end as line from rk "
        "where rnk <= 5 and shap_value <> 0)",
        f"infl as (select source_index, string_agg(line, {nl} order by d, rnk) as influence from lines group by source_index)",
    ]
    unc = (f"case when model_mae is not null then 'Typical validation MAE was ' || printf('%.1f', model_mae) || "
           f"' percentage points, so the estimate should not be treated as exact.' else {lit(K.REPORT_NO_MAE)} end")
    notes = f"case when coalesce(all_warnings_text, '') <> '' then {lit(K.REPORT_NOTES)} || all_warnings_text else '' end"
    parts = [lit(K.REPORT_TITLE),
             f"'The model estimated sleep efficiency at ' || printf('%.1f', pred) || '% (' || {band_sql('pred')} || ').'",
             "''", lit(K.REPORT_INFLUENCE_HEADING), f"coalesce(infl.influence, {lit(K.REPORT_NO_FACTORS)})",
             lit(K.REPORT_NOT_CAUSAL), "''", lit(K.REPORT_SUGGESTIONS_HEADING), lit(K.REPORT_SUGGESTION), "''",
             lit(K.REPORT_LIMITS_HEADING), unc, f"{lit(K.REPORT_ESTIMATES)} || ({notes})", lit(K.REPORT_ADVICE)]
    return with_(*ctes) + (f"select sc.source_index, concat_ws({nl}, {', '.join(parts)}) as report "
                           "from sc left join infl using (source_index) where sc.err is null")


def payload_sql() -> str:
    """Selected keys of the report payload, computed directly."""
    ctes = batch_ctes(with_mae=True) + [
        "fac as (select rk.source_index, "
        "string_agg(display_name, '; ' order by rnk) filter (where shap_value < 0) as lowering, "
        "string_agg(display_name, '; ' order by rnk) filter (where shap_value > 0) as increasing "
        "from rk where rnk <= 5 group by rk.source_index)",
    ]
    return with_(*ctes) + (
        f"select sc.source_index, pred as predicted_efficiency_percent, {band_sql('pred')} as efficiency_band, "
        f"model_mae as model_mae_percent, coalesce({iso('night_date')}, date) as measurement_date, "
        "rem_sleep_percent_f as rem_sleep_percent, coalesce(fac.lowering, '') as factors_lowering, "
        "coalesce(fac.increasing, '') as factors_increasing, coalesce(all_warnings_text, '') as data_quality_warnings "
        "from sc left join fac using (source_index) where sc.err is null")


def _spelled() -> str:
    """FIXED VALUES: a date of ``events`` in thirteen spellings by event_id, in SQL that both engines read alike."""
    y, m, d = (f"cast({f}(ts) as string)" for f in ("year", "month", "day"))
    mm, dd = (f"lpad({x}, 2, '0')" for x in (m, d))
    full = "case month(ts) " + " ".join(f"when {i + 1} then '{n.capitalize()}'" for i, n in enumerate(MONTHS)) + " end"
    forms = [f"{y}, '-', {m}, '-', {d}", f"{y}, '/', {mm}, '/', {dd}", f"{d}, ' ', substr({full}, 1, 3), ' ', {y}", f"substr({full}, 1, 3), ' ', {d}, ', ', {y}",
             f"{full}, ' ', {dd}, ', ', {y}", f"{dd}, '.', {mm}, '.', {y}", f"{mm}, '-', {dd}, '-', {y}", f"{m}, '/', {d}, '/', {y}", f"{d}, '/', {m}, '/', {y}",
             f"{y}, {mm}, {dd}", f"{y}, '-', {mm}, '-', {dd}, 'T08:30:00Z'", f"{d}, ' Foo ', {y}", f"{y}, '-', {mm}, '/', {dd}"]
    return "case event_id % 13 " + " ".join(f"when {i} then concat({f})" for i, f in enumerate(forms)) + " end"


SPELLED_DATE = _spelled()


def tree_attribution_sql() -> str:
    """Base, contributions and prediction of the fixed ensemble, each leaf's Shapley values written out by their definition."""
    from itertools import combinations

    base, parts = [], {f: [] for f in K.MODEL_FEATURES}

    def walk(node, weight, path):
        if len(node) == 2:
            value, names = weight * node[0], list(path)
            z = {f: math.prod(r for _, r in path[f]) for f in names}
            one = {f: "(case when " + " and ".join(c for c, _ in path[f]) + " then 1.0 else 0.0 end)" for f in names}
            base.append(f"({dbl(value)}" + "".join(f" * {dbl(z[f])}" for f in names) + ")")
            for f in names:
                rest = [g for g in names if g != f]
                terms = []
                for n in range(len(rest) + 1):
                    c = math.factorial(n) * math.factorial(len(names) - n - 1) / math.factorial(len(names))
                    for chosen in combinations(rest, n):
                        terms.append(" * ".join([dbl(c), *(one[g] if g in chosen else dbl(z[g]) for g in rest)]))
                parts[f].append(f"{dbl(value)} * ({one[f]} - {dbl(z[f])}) * ({' + '.join(terms)})")
            return
        feature, threshold, left, right = node
        rows = {id(x): _rows(x) for x in (left, right)}
        for child, sign in ((left, "<="), (right, ">")):
            step = (f"coalesce({feature}_f, 0.0) {sign} {dbl(threshold)}", rows[id(child)] / (rows[id(left)] + rows[id(right)]))
            walk(child, weight, {**path, feature: [*path.get(feature, []), step]})

    for tree, weight in zip(K.FIXED_TREES, K.FIXED_TREE_WEIGHTS):
        walk(tree, weight, {})
    shap = {f: " + ".join(p) if p else "0.0" for f, p in parts.items()}
    cols = ", ".join(f"{x} as shap_{f}" for f, x in shap.items())
    total = "base_value + " + " + ".join(f"shap_{f}" for f in K.MODEL_FEATURES)
    return (with_(NIGHTS, *features_ctes("nights", "feat"), f"a as (select source_index, {' + '.join(base)} as base_value, {cols} from feat)")
            + f"select *, {total} as predicted_efficiency from a")


def _rows(node) -> float:
    return float(node[1]) if len(node) == 2 else _rows(node[2]) + _rows(node[3])


#: The short fit that SQL repeats.
SHORT_FIT = Settings(trees=3, depth=3, bins=16)


def boosted_trees_sql(s: Settings = SHORT_FIT) -> str:
    """Node table of a fit by histograms."""
    ctes, nodes = boosted_trees_ctes(s)
    return with_(*ctes) + nodes


def tree_shap_ctes(s: Settings) -> list[str]:
    """``sh`` (source_index, base_value, shap_<f>): contributions of the ensemble in ``nodes`` to every row of ``bfeat``.

    By the definition of Shapley values, with the sums over sets of the other features written out: a path of
    three splits has at most two others.
    """
    assert s.depth <= 3
    value = "leaf.value * (a.o - a.z) * case count(b.f) when 0 then 1.0 when 1 then (product(b.z) + product(b.o)) / 2 " \
            "else product(b.z) / 3 + (sum(b.o) * sum(b.z) - sum(b.o * b.z)) / 6 + product(b.o) / 3 end"
    return [
        "leaf as materialized (select tree, node, value from nodes where tree >= 0 and feature < 0)",
        # The splits above each leaf: the share of rows that goes its way, and its side.
        "above as (select l.tree, l.node, p.feature as f, p.threshold, c.node % 2 as side, c.cover / p.cover as share "
        f"from leaf l cross join range({s.depth}) j(n) join nodes c on c.tree = l.tree and c.node = l.node >> j.n and c.node > 1 "
        "join nodes p on p.tree = l.tree and p.node = c.node >> 1)",
        "way as materialized (select tree, node, f, product(share) as z, coalesce(max(threshold) filter (where side = 1), '-infinity'::double) as low, "
        "coalesce(min(threshold) filter (where side = 0), 'infinity'::double) as high from above group by tree, node, f)",
        "bv as (select coalesce((select sum(v) from (select any_value(leaf.value) * product(z) as v from leaf join way using (tree, node) group by tree, node)), 0.0) "
        "+ coalesce((select sum(value) from leaf where node = 1), 0.0) + (select sum(value) from nodes where tree < 0) as base_value)",
        "xs as (select source_index, unnest([" + ", ".join(f"{{'f': {i}, 'x': coalesce({f}_f, med_{f}, 0.0)}}" for i, f in enumerate(K.MODEL_FEATURES))
        + "]) as x from bfeat, shape)",
        "met as materialized (select source_index, tree, node, way.f, z, case when x.x > low and x.x <= high then 1.0::double else 0.0::double end as o from xs join way on way.f = x.f)",
        f"part as (select a.source_index, a.f, {value} as v from met a left join met b on b.source_index = a.source_index and b.tree = a.tree and b.node = a.node "
        "and b.f <> a.f join leaf on leaf.tree = a.tree and leaf.node = a.node group by a.source_index, a.tree, a.node, a.f, a.o, a.z, leaf.value)",
        "shapes as (select source_index, " + ", ".join(f"coalesce(sum(v) filter (where f = {i}), 0.0) as shap_{f}" for i, f in enumerate(K.MODEL_FEATURES))
        + " from part group by source_index)",
        "sh as (select source_index, base_value, " + ", ".join(f"coalesce(shap_{f}, 0.0) as shap_{f}" for f in K.MODEL_FEATURES)
        + " from bfeat left join shapes using (source_index), bv)",
    ]


def boosted_trees_ctes(s: Settings) -> tuple[list[str], str]:
    """The CTEs of a fit by histograms, a few a level, and the query of its node table."""
    values = {f: f"cast(round({f}_f, 6) as double)" for f in K.MODEL_FEATURES}
    target = "85.0::double + 0.05::double * (n_rmssd - 60.0::double) - 0.03::double * (n_restless - 60.0::double)"
    shapes = ", ".join(f"min({f}) as lo_{f}, max({f}) as hi_{f}, median({f}) as med_{f}" for f in K.MODEL_FEATURES)
    bin_of = lambda f: (f"cast(len(list_filter(range(1, {s.bins}), lambda i: lo_{f} + (hi_{f} - lo_{f}) * i / {s.bins} < coalesce({f}, med_{f}, 0.0))) as integer)")
    score = lambda g, n: f"({g}) * ({g}) / (({n}) + {dbl(s.penalty)})"
    ctes = [NIGHTS, *quality_ctes(), *features_ctes("q", "bfeat"),
            f"lt as materialized (select source_index, y, {', '.join(f'{v} as {f}' for f, v in values.items())} from (select *, {target} as y from bfeat) b "
            f"where error is null and y is not null and {nullify('participant_id')} is not null and night_date is not null)",
            f"shape as materialized (select {shapes} from lt)",
            "bin as materialized (select source_index as id, unnest([" + ", ".join(f"{{'f': {i}, 'b': {bin_of(f)}}}" for i, f in enumerate(K.MODEL_FEATURES)) + "]) as x from lt, shape)",
            "long as materialized (select id, x.f as f, x.b as b from bin)",
            "edge as (" + " union all ".join(f"select {i} as f, lo_{f} as lo, hi_{f} as hi from shape" for i, f in enumerate(K.MODEL_FEATURES)) + ")",
            f"base as materialized (select cast(sum(floor(y * {dbl(UNITS)} + 0.5)) as double) / count(*) / {dbl(UNITS)} as v from lt)",
            "f0 as materialized (select source_index as id, y, v as p from lt, base)"]
    parts = ["select -1 as tree, 0 as node, -1 as feature, cast(null as double) as threshold, v as value, cast(0 as bigint) as cover from base"]
    for t in range(s.trees):
        columns = ", ".join(map(str, tree_columns(t, len(K.MODEL_FEATURES), s)))
        x = f"((id % {MODULUS}) * {KEY_FACTOR} + {s.seed + t * TREE_FACTOR}) % {MODULUS}"
        ctes += [f"r{t} as materialized (select id, cast(floor((y - p) * {dbl(UNITS)} + 0.5) as bigint) as r from f{t} where ({x}) * ({x}) % {MODULUS} < {dbl(s.rows * MODULUS)})",
                 f"p{t}_0 as (select id, 1 as node from f{t})"]
        for level in range(s.depth + 1):
            here, low, high = f"{t}_{level}", 1 << level, 2 << level
            ctes += [f"n{here} as materialized (select node, cast(sum(r) as double) / {dbl(UNITS)} as g, count(*) as n from p{here} join r{t} using (id) where node >= {low} and node < {high} group by node)"]
            if level == s.depth:
                ctes += [f"s{here} as (select 0 as node, 0 as f, 0 as b where false)"]
                break
            gain = f"{score('gl', 'nl')} + {score('g - gl', 'n - nl')} - ({score('g', 'n')})"
            ctes += [f"h{here} as (select node, f, b, sum(r) as r, count(*) as c from p{here} join r{t} using (id) join long using (id) where node >= {low} and node < {high} and f in ({columns}) group by node, f, b)",
                     f"c{here} as (select node, f, b, cast(sum(r) over w as double) / {dbl(UNITS)} as gl, cast(sum(c) over w as bigint) as nl from h{here} window w as (partition by node, f order by b))",
                     f"s{here} as materialized (select node, f, b from (select node, f, b, {gain} as gain from c{here} join n{here} using (node) where nl >= {s.least_rows} and n - nl >= {s.least_rows}) x "
                     f"where gain > {dbl(LEAST_GAIN)} qualify row_number() over (partition by node order by gain desc, f, b) = 1)",
                     f"p{t}_{level + 1} as materialized (select p.id, case when s.node is null then p.node else 2 * p.node + cast(l.b > s.b as integer) end as node "
                     f"from p{here} p left join s{here} s using (node) left join long l on l.id = p.id and l.f = s.f)"]
        levels = " union all ".join(f"select n.node, n.g, n.n, s.f, s.b from n{t}_{k} n left join s{t}_{k} s using (node)" for k in range(s.depth + 1))
        value = f"case when f is null then {dbl(s.rate)} * (g / (n + {dbl(s.penalty)})) else 0.0 end"
        ctes += [f"t{t} as materialized (select node, coalesce(x.f, -1) as feature, case when x.f is not null then lo + (hi - lo) * (b + 1) / {s.bins} end as threshold, {value.replace('f is', 'x.f is')} as value, n as cover "
                 f"from ({levels}) x left join edge on edge.f = x.f)",
                 f"f{t + 1} as materialized (select f{t}.id, y, p + value as p from f{t} join p{t}_{s.depth} using (id) join t{t} using (node))"]
        parts.append(f"select {t} as tree, node, feature, threshold, value, cover from t{t}")
    return ctes, " union all ".join(parts)
