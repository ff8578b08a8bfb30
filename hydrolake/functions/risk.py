"""Risk bands, reasons and decision rules as column expressions.

Rule tables come first; the functions turn them into ``when`` chains, which stay inside
whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydrolake import config
from hydrolake.functions.numeric import clip, col, flag, zero
from hydrolake.functions.text import fixed0, fixed1


def _bands(value: Column, limits: list[float], names: list, missing: Column | None) -> Column:
    """names[i] for the first limit above the value, names[-1] beyond the last limit."""
    chain = F.when(missing, F.lit(None)) if missing is not None else None
    for limit, name in zip(limits, names):
        test = value < F.lit(limit)
        chain = F.when(test, F.lit(name)) if chain is None else chain.when(test, F.lit(name))
    return chain.otherwise(F.lit(names[-1]))


def _depth_band(depth: str | Column, part: int, nan_as_awas: bool) -> Column:
    d = col(depth)
    missing = None if nan_as_awas else d.isNull() | F.isnan(d)
    limits = [config.DEPTH_WASPADA, config.DEPTH_SIAGA, config.DEPTH_AWAS]
    return _bands(d, limits, [band[part] for band in config.RISK_BANDS], missing)


def risk_level(depth: str | Column, nan_as_awas: bool = False) -> Column:
    return _depth_band(depth, 0, nan_as_awas)


def risk_label(depth: str | Column, nan_as_awas: bool = False) -> Column:
    return _depth_band(depth, 1, nan_as_awas)


def risk_color(depth: str | Column, nan_as_awas: bool = False) -> Column:
    return _depth_band(depth, 2, nan_as_awas)


def recommendation(depth: str | Column, nan_as_awas: bool = False) -> Column:
    return _depth_band(depth, 3, nan_as_awas)


def main_factor(rain: str | Column, tide: str | Column) -> Column:
    r, t = zero(rain), zero(tide)
    rainy = F.when(r > config.RAIN_EXTREME, F.lit("Hujan Ekstrem")).when(
        r > config.RAIN_HEAVY, F.lit("Hujan Deras")
    )
    surge = t - F.lit(config.TIDE_DATUM_OFFSET) > 0
    return (
        F.when(rainy.isNotNull() & surge, F.concat(rainy, F.lit(" & Rob")))
        .when(rainy.isNotNull(), rainy)
        .when(surge, F.lit("Pasang Rob"))
        .otherwise(F.lit("Tidak Ada"))
    )


def reasons(depth, rain=None, tide=None, elevation=None) -> Column:
    """Reason text. ``elevation`` defaults to the standard site height, which is low ground.

    With no inputs at all (rain, tide and elevation all omitted) only the depth speaks.
    """
    quiet = F.when(col(depth) > 10, F.lit("Akumulasi Air Permukaan")).otherwise(F.lit("Kondisi Kondusif"))
    if rain is None and tide is None and elevation is None:
        return quiet
    r = zero(rain if rain is not None else F.lit(0.0))
    t = zero(tide if tide is not None else F.lit(0.0))
    e = F.coalesce(
        col(elevation).cast("double") if elevation is not None else F.lit(None).cast("double"),
        F.lit(config.STATIC_DEFAULTS["elevation_m"]),
    )
    found = F.concat_ws(
        ", ",
        F.when(r > config.RAIN_EXTREME, F.concat(F.lit("Hujan Ekstrem ("), fixed1(r), F.lit("mm)"))).when(
            r > config.RAIN_HEAVY, F.concat(F.lit("Hujan Deras ("), fixed1(r), F.lit("mm)"))
        ),
        F.when(
            t - F.lit(config.TIDE_DATUM_OFFSET) > 0,
            F.concat(F.lit("Pasang Laut Tinggi ("), fixed1(t), F.lit("m)")),
        ),
        F.when(
            e < config.ELEVATION_LOW, F.concat(F.lit("Topografi Rendah ("), e.cast("string"), F.lit("m)"))
        ),
    )
    return F.when(found == "", quiet).otherwise(found)


def assessment_columns(depth, rain=None, tide=None, elevation=None) -> dict[str, Column]:
    given = [c for c in (rain, tide) if c is not None]
    factor = main_factor(
        rain if rain is not None else F.lit(0.0), tide if tide is not None else F.lit(0.0)
    )
    return {
        "level": risk_level(depth),
        "label": risk_label(depth),
        "color": risk_color(depth),
        "main_factor": factor if given else F.lit("Tidak Ada"),
        "reasoning": reasons(depth, rain, tide, elevation),
        "recommendation": recommendation(depth),
    }


def command_status(level: str | Column, label: str | Column) -> Column:
    out = col(label)
    for name, text in config.COMMAND_TERMS.items():
        out = F.when(col(level) == name, F.lit(text)).otherwise(out)
    return out


def probability_band(probability: str | Column) -> Column:
    p = col(probability)
    return (
        F.when(p >= 0.85, F.lit("AWAS"))
        .when(p >= 0.70, F.lit("SIAGA"))
        .when(p >= 0.50, F.lit("WASPADA"))
        .otherwise(F.lit("AMAN"))
    )


def probability_color(probability: str | Column) -> Column:
    p = col(probability)
    return (
        F.when(p >= 0.85, F.lit("red"))
        .when(p >= 0.70, F.lit("orange"))
        .when(p >= 0.50, F.lit("yellow"))
        .otherwise(F.lit("green"))
    )


def probability_action(probability: str | Column) -> Column:
    p = col(probability)
    return F.when(p >= 0.85, F.lit("🚨 Evakuasi")).when(p >= 0.7, F.lit("⚠️ Siaga")).otherwise(F.lit("✅ Pantau"))


def legacy_level(label: str | Column) -> Column:
    return F.when(col(label) == "BAHAYA BANJIR", F.lit("WASPADA")).otherwise(F.lit("NORMAL"))


def legacy_color(label: str | Column) -> Column:
    return F.when(col(label) == "BAHAYA BANJIR", F.lit("yellow")).otherwise(F.lit("green"))


def alert_rank(status: str | Column) -> Column:
    """0..3, NULL for an unknown status."""
    ranks = F.create_map(*[x for i, n in enumerate(config.ALERT_RANK) for x in (F.lit(n), F.lit(i))])
    return F.try_element_at(ranks, col(status))


def passes_gate(status: str | Column, min_level: str = config.ALERT_MIN_LEVEL) -> Column:
    """True where the status is known and ranks at least ``min_level``; an unknown gate lets none pass."""
    if min_level not in config.ALERT_RANK:
        return F.lit(False)
    return F.coalesce(alert_rank(status) >= F.lit(config.ALERT_RANK.index(min_level)), F.lit(False))


def meteo_front(rain, upstream) -> Column:
    r, u = zero(rain), zero(upstream)
    return (
        F.when((r > 100) | (u > 50), F.lit("KRITIS"))
        .when((r > 50) | (u > 20), F.lit("GANGGUAN"))
        .otherwise(F.lit("AMAN"))
    )


def tide_front(tide) -> Column:
    t = zero(tide)
    return F.when(t > 2.5, F.lit("OVERFLOW")).when(t > 2.0, F.lit("PASANG TINGGI")).otherwise(F.lit("SURUT/AMAN"))


def land_front(soil) -> Column:
    return F.when(zero(soil) > 0.6, F.lit("JENUH")).otherwise(F.lit("KERING"))


def soil_card(soil) -> Column:
    return F.when(zero(soil) > 0.5, F.lit("Jenuh Air")).otherwise(F.lit("Normal"))


def upstream_status(recent) -> Column:
    r = zero(recent)
    return F.when(r > 20, F.lit("Hujan Deras")).when(r > 5, F.lit("Hujan Ringan")).otherwise(F.lit("Kering/Aman"))


def tide_trend_class(change: str | Column, eps: float = 0.05) -> Column:
    c = col(change)
    return (
        F.when(F.abs(c) < eps, F.lit("Stabil")).when(c > 0, F.lit("Pasang Naik")).otherwise(F.lit("Surut"))
    )


def inundation_columns(elevation, tide, rain) -> dict[str, Column]:
    """Intensity, status and depth text of a zone against the tide of one hour."""
    e, r = col(elevation), zero(rain)
    level = col(tide) - F.lit(config.TIDE_DATUM_OFFSET)
    under, dry = e < level, r < 5
    near, close = e < level + 0.5, e < level + 1.0
    cm = fixed0((level - e) * 100)
    return {
        "heatmap_intensity": F.when(under & dry, 0.6)
        .when(under, 1.0)
        .when(near, F.when(r > 20, 0.7).otherwise(0.4))
        .when(close, 0.3)
        .otherwise(0.0),
        "status_text": F.when(under & dry, F.lit("WASPADA (PASANG)"))
        .when(under, F.lit("BAHAYA (TENGGELAM)"))
        .when(near, F.lit("SIAGA (RISIKO TINGGI)"))
        .when(close, F.lit("WASPADA (RISIKO)"))
        .otherwise(F.lit("AMAN")),
        "depth_est": F.when(under & dry, F.concat(F.lit("Genangan "), cm, F.lit(" cm")))
        .when(under, F.concat(F.lit("Banjir "), cm, F.lit(" cm")))
        .when(near, F.lit("Hampir Meluap"))
        .when(close, F.lit("Belum Tergenang"))
        .otherwise(F.lit("Kering")),
    }


def zone_risk_score(elevation, lowland_pct, rain, tide) -> Column:
    r, t = zero(rain), zero(tide)
    height = clip((F.lit(3.0) - col(elevation)) / F.lit(3.0), 0, 1)
    weather = F.when(r > 50, 1.5).when(r > 20, 1.2).otherwise(1.0)
    sea = F.when(t > 2.5, 1.3).when(t > 2.0, 1.1).otherwise(1.0)
    base = height * F.lit(0.4) + col(lowland_pct) / F.lit(100.0) * F.lit(0.6)
    return F.least(F.lit(1.0), base * (weather * sea))


def zone_risk_label(score: str | Column) -> Column:
    s = col(score)
    return (
        F.when(s >= 0.85, F.lit("EKSTREM"))
        .when(s >= 0.7, F.lit("TINGGI"))
        .when(s >= 0.5, F.lit("SEDANG"))
        .when(s >= 0.3, F.lit("RENDAH"))
        .otherwise(F.lit("AMAN"))
    )


def tide_warning(est: str | Column) -> Column:
    return F.when(col(est) > 3.8, F.lit("BAHAYA")).when(col(est) > 3.5, F.lit("PERINGATAN")).otherwise(F.lit("NORMAL"))


def tidal_range_class(height_range: str | Column) -> Column:
    """Micro- (<2 m), meso- (2-4 m) or macrotidal (>4 m)."""
    r = col(height_range)
    return F.when(r < 2, F.lit("Microtidal")).when(r <= 4, F.lit("Mesotidal")).otherwise(F.lit("Macrotidal"))


def heuristic_boost(flow_accumulation, rain, upstream, runoff) -> dict[str, Column]:
    f, r = zero(flow_accumulation), zero(rain)
    ru = F.coalesce(col(runoff), F.lit(0.85))
    spatial = F.when((f > 5000) & (r > 20), F.least(F.lit(0.15), f / 50000 * 0.10)).otherwise(0.0)
    above = F.when(zero(upstream) > 20, 0.10).otherwise(0.0)
    urban = F.when(ru > 0.8, 0.05).when(ru < 0.6, -0.05).otherwise(0.0)
    return {
        "spatial_boost": spatial,
        "upstream_boost": above,
        "runoff_boost": urban,
        "total_boost": spatial + above + urban,
    }


def formula_depth(intensity, tide, base=None, noise=None) -> Column:
    """Depth in cm from hourly rain intensity and tide; the stand-in for a fitted model."""
    depth = zero(intensity) * F.lit(2.0) + F.greatest(zero(tide) - F.lit(config.TIDE_HIGH), F.lit(0.0)) * F.lit(20.0)
    if base is not None:
        depth = col(base) + depth
    if noise is not None:
        depth = F.when(depth > 0, depth + noise).otherwise(depth)
    return F.greatest(depth, F.lit(0.0))


def threshold_flags(tide, rain) -> dict[str, Column]:
    t, r = col(tide), col(rain)
    return {
        "is_high_tide": flag(t > config.TIDE_HIGH),
        "is_heavy_rain": flag(r > config.RAIN_HEAVY),
        "tide_rain_sync": flag((t > config.TIDE_HIGH) & (r > config.RAIN_HEAVY)),
    }
