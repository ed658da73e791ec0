"""Decision expressions for the farmer summary.

All are ``Column`` builders (``when`` chains, ``try_divide``, ``format_string``);
the whole summary for every district and month is one projection.
Displayed numbers round half-up (a 1e-9 nudge before ``round``), which makes
the text identical across engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrapanel import fixed_values as FV


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def abnormal_pct(pred, mean) -> Column:
    """(p - mean) / mean · 100; null when the mean is null or zero."""
    p, m = _c(pred), _c(mean)
    return F.when(m.isNotNull() & (m != 0), (p - m) / m * F.lit(100.0))


def volatility(std, mean) -> Column:
    """coefficient of variation std / max(mean, 0.1); 0 when the mean is
    0 or null; null when no std is available."""
    s, m = _c(std), _c(mean)
    cv = F.when(m.isNull() | (m == 0), F.lit(0.0)).otherwise(s / F.greatest(m, F.lit(FV.VOLATILITY_MEAN_FLOOR)))
    return F.when(s.isNotNull(), cv)


def volatility_label(cv) -> Column:
    v = _c(cv)
    return (F.when(v.isNull(), F.lit(None).cast("string"))
             .when(v > FV.VOLATILITY_HIGH, F.lit("High"))
             .when(v > FV.VOLATILITY_MODERATE, F.lit("Moderate"))
             .otherwise(F.lit("Low")))


def moisture_category(pred, p25, p75, low_thr, high_thr) -> Column:
    """month percentiles when available, else the thresholds."""
    p = _c(pred)
    lo = F.when(_c(p25).isNotNull() & _c(p75).isNotNull(), _c(p25)).otherwise(_c(low_thr))
    hi = F.when(_c(p25).isNotNull() & _c(p75).isNotNull(), _c(p75)).otherwise(_c(high_thr))
    return (F.when(p.isNull(), F.lit(None).cast("string"))
             .when(p < lo, F.lit("LOW")).when(p > hi, F.lit("HIGH")).otherwise(F.lit("MEDIUM")))


def thresholds(auto_low, auto_high, automatic: bool = True,
               manual_low: float = FV.MANUAL_LOW_THRESHOLD,
               manual_high: float = FV.MANUAL_HIGH_THRESHOLD) -> tuple[Column, Column]:
    """automatic (district percentiles) when both exist, else manual."""
    if not automatic:
        return F.lit(manual_low), F.lit(manual_high)
    both = _c(auto_low).isNotNull() & _c(auto_high).isNotNull()
    return (F.when(both, _c(auto_low)).otherwise(F.lit(manual_low)),
            F.when(both, _c(auto_high)).otherwise(F.lit(manual_high)))


def stress_level(pred, p10, p25, mean) -> Column:
    """percentile rule when the month has values; else the 0.7·mean rule
    (the Moderate branch only fires for a negative mean, L9); else None."""
    p, m = _c(pred), _c(mean)
    pct = (F.when(p < _c(p10), F.lit("Severe")).when(p < _c(p25), F.lit("Moderate"))
            .otherwise(F.lit("None")))
    fallback = (F.when(p < F.lit(FV.STRESS_FALLBACK_RATIO) * m, F.lit("Severe"))
                 .when(F.try_divide(m - p, m) > F.lit(FV.STRESS_MODERATE_DROP), F.lit("Moderate"))
                 .otherwise(F.lit("None")))
    return (F.when(_c(p10).isNotNull(), pct)
             .when(m.isNotNull(), fallback)
             .otherwise(F.lit("None")))


def irrigation_advice(stress) -> Column:
    """F14."""
    s = _c(stress)
    return (F.when(s == "Severe", F.lit(FV.IRRIGATION_ADVICE["Severe"]))
             .when(s == "Moderate", F.lit(FV.IRRIGATION_ADVICE["Moderate"]))
             .otherwise(F.lit(FV.IRRIGATION_ADVICE["None"])))


def uncertainty_flag(std, mean) -> Column:
    """' (high uncertainty)' when std > max(0.1, 0.3·max(1, |mean|))."""
    s, m = _c(std), _c(mean)
    bound = F.greatest(F.lit(FV.UNCERTAINTY_FLOOR),
                       F.lit(FV.UNCERTAINTY_RATIO) * F.greatest(F.lit(1.0), F.abs(m)))
    return F.when(s.isNotNull() & m.isNotNull() & (s > bound), F.lit(" (high uncertainty)")) \
            .otherwise(F.lit(""))


def moisture_group(pred) -> Column:
    """F16."""
    p = _c(pred)
    expr = F.when(p.isNull(), F.lit(None).cast("string"))
    for cut, name in FV.MOISTURE_GROUP_CUTS:
        expr = expr.when(p < F.lit(cut), F.lit(name))
    return expr.otherwise(F.lit(FV.MOISTURE_GROUP_TOP))


def crop_suggestion(group, varieties) -> tuple[Column, Column]:
    """(label, explanation) from the moisture group and the first two
    varieties; ('Unknown', 'Prediction not available.') without a prediction."""
    g = _c(group)
    first_two = F.concat_ws(", ", F.slice(_c(varieties), 1, 2))
    label = F.when(g.isNull(), F.lit("Unknown"))
    text = F.when(g.isNull(), F.lit("Prediction not available."))
    for name, (lab, tmpl) in FV.CROP_ADVICE.items():
        label = label.when(g == name, F.lit(lab))
        if "{v}" in tmpl:
            before, after = tmpl.split("{v}")
            piece = F.concat(F.lit(before), first_two, F.lit(after))
        else:
            piece = F.lit(tmpl)
        text = text.when(g == name, piece)
    return label, text


def fmt_fixed(x, places: int) -> Column:
    """Half-up fixed-point text of a double (the nudge defines ties)."""
    v = F.round(_c(x) + F.lit(1e-9), places)
    return F.format_string(f"%.{places}f", v)


def summary_text(pred, category, abn_pct, stress, label, explanation, uncertainty) -> Column:
    """bullet-joined summary; null parts are skipped by concat_ws."""
    p, a = _c(pred), _c(abn_pct)
    abn = F.when(a.isNotNull(), F.concat(
        F.round(F.abs(a) + F.lit(1e-9), 0).cast("long").cast("string"), F.lit("% "),
        F.when(a > 0, F.lit("above")).otherwise(F.lit("below")), F.lit(" normal")))
    s = _c(stress)
    stress_txt = (F.when(s == "Severe", F.lit(FV.STRESS_TEXT["Severe"]))
                   .when(s == "Moderate", F.lit(FV.STRESS_TEXT["Moderate"]))
                   .otherwise(F.lit(FV.STRESS_TEXT["None"])))
    body = F.concat_ws(
        FV.SUMMARY_SEPARATOR,
        F.concat(F.lit("Predicted moisture: "), fmt_fixed(p, 2)),
        F.concat(F.lit("Category: "), _c(category)),
        abn,
        stress_txt,
        F.concat(_c(label), F.lit(": "), _c(explanation), _c(uncertainty)))
    return F.when(p.isNull(), F.lit("Prediction not available")).otherwise(body)


def confidence_flag(conf_pct, threshold: float = FV.CONFIDENCE_THRESHOLD_PCT) -> Column:
    """'below threshold' / 'meets threshold'."""
    c = _c(conf_pct)
    return F.when(c.isNull(), F.lit(None).cast("string")) \
            .when(c < F.lit(threshold), F.lit("below threshold")).otherwise(F.lit("meets threshold"))
