"""The derived relations once more, as SQL for the oracle; independent of the Spark definitions."""

BASE = {
    "gauge_events": """select user_id // 5 as loc, ts, date_trunc('hour', ts) as "time", event_type, value from events""",
    "obs_sparse": """select loc, "time",
  round(sum(case when event_type='purchase' then value end)/5.0::double, 2) as precipitation,
  round(least(max(case when event_type='click' then value end)/100.0::double, 1.0::double), 4) as soil_moisture_surface,
  round(least(max(case when event_type='view' then value end)/100.0::double, 1.0::double), 4) as soil_moisture_root,
  round(max(case when event_type='signup' then value end)/10.0::double, 3) as wind_speed,
  round(sum(case when event_type='error' then value end)/5.0::double, 2) as upstream_precipitation
  from gauge_events group by 1, 2""",
    "obs_hourly": """select g.loc, g."time",
  coalesce(s.precipitation, 0.0::double) as precipitation,
  coalesce(s.soil_moisture_surface, 0.4::double) as soil_moisture_surface,
  coalesce(s.soil_moisture_root, 0.4::double) as soil_moisture_root,
  coalesce(s.wind_speed, 2.0::double) as wind_speed,
  coalesce(s.upstream_precipitation, 0.0::double) as upstream_precipitation,
  round(2.5::double + 0.9::double*cos((g.hr + 0.5::double*g.loc)*(2*pi())/12.4206::double)
        + 0.5::double*cos((g.hr + 0.5::double*g.loc)*(2*pi())/23.9345::double), 2) as est
  from (select l.loc, h."time", date_diff('hour', timestamp '2024-01-01', h."time")::double as hr
        from (select distinct loc from obs_sparse) l
        cross join (select unnest(generate_series((select min("time") from obs_sparse), (select max("time") from obs_sparse), interval 1 hour)) as "time") h) g
  left join obs_sparse s on s.loc = g.loc and s."time" = g."time" """,
    "obs_daily": """select loc, tanggal, rain_sum_imputed, rain_intensity_max, soil_moisture_surface_mean, soil_moisture_root_mean,
  round(2.5::double + 1.2::double*cos(2*pi()*(date_diff('day', date '1995-01-01', tanggal) + loc)::double/14.765::double), 2) as pasut_msl_max,
  case when score > 80 then 'Banjir' when score > 45 then 'Air Meluap' else 'Aman' end as status_siaga
  from (select l_suppkey as loc, cast(l_shipdate as date) as tanggal, sum(l_quantity) as rain_sum_imputed,
          max(l_quantity)/4.0::double as rain_intensity_max, round(max(l_discount)*10.0::double, 2) as soil_moisture_surface_mean,
          round(max(l_tax)*10.0::double, 2) as soil_moisture_root_mean,
          sum(l_quantity) + max(case when l_returnflag='R' then 10 else 0 end) as score
        from lineitem group by 1, 2)""",
    "status_reports": """select l_suppkey as loc, cast(l_shipdate as date) as tanggal, l_orderkey as report_id, l_linenumber as line,
  case when l_returnflag='R' then 'Banjir' when l_quantity > 40 then 'Air Meluap' when l_quantity > 2 then 'Aman' end as status_siaga
  from lineitem""",
    "zones": """select s_suppkey as zone_id, s_name as zone, s_suppkey % 50 as gx, s_suppkey // 50 as gy,
  ((s_suppkey*7) % 25)/4.0::double - 1.0::double as mean_elev, ((s_suppkey*37) % 100)::double as risk_pct,
  round(117.05::double + 0.0034::double*(s_suppkey % 50), 6) as lon0, round(-0.58::double + 0.008::double*(s_suppkey // 50), 6) as lat0,
  round(117.05::double + 0.0034::double*(s_suppkey % 50 + 1), 6) as lon1, round(-0.58::double + 0.008::double*(s_suppkey // 50 + 1), 6) as lat1
  from supplier""",
    "buildings": """select c_custkey as id, round(117.05::double + ((c_custkey*7919) % 1700)/10000.0::double + 0.00005::double, 6) as lon,
  round(-0.58::double + ((c_custkey*104729) % 1600)/10000.0::double + 0.00005::double, 6) as lat, c_name as name,
  case c_mktsegment when 'BUILDING' then 'school' when 'MACHINERY' then 'hospital' when 'FURNITURE' then 'clinic' when 'HOUSEHOLD' then 'kindergarten' end as amenity
  from customer""",
    "raster": """select p_partkey // 50 as "row", p_partkey % 50 as col,
  case when p_partkey % 97 = 5 then -9999.0::double else round(0.4::double*(p_partkey // 50) + 0.2::double*abs(p_partkey % 50 - 25) + p_size/50.0::double, 2) end as value,
  p_partkey // 250 as zone_id from part""",
    "tide_obs": """select user_id // 50 as station, ts as t,
  round(2.5::double + 0.9::double*cos(2*pi()*epoch(ts)/44714.16::double) + value/2000.0::double, 4) as est,
  round(0.9::double*cos(2*pi()*epoch(ts)/44714.16::double) + value/2000.0::double, 4) as msl,
  round(1.1::double + 0.9::double*cos(2*pi()*epoch(ts)/44714.16::double) + value/2000.0::double, 4) as lt from events""",
    "pred_log": """select event_id as id, ts as "timestamp", user_id // 5 as loc, value/2.0::double as depth_cm, value as rain_24h,
  round(2.0::double + (event_id % 20)/10.0::double, 1) as tide_level, least(value/200.0::double, 1.0::double) as probability,
  case when value/2 < 20 then 'AMAN' when value/2 < 50 then 'WASPADA' when value/2 < 100 then 'SIAGA' else 'AWAS' end as risk_level,
  case event_type when 'error' then 'Banjir' when 'purchase' then 'Air Meluap' when 'view' then 'Aman' end as actual_outcome from events""",
    "scored": """select l.doc_id as id, l.quality as y, d.n_chars/200000.0::double as score from labels l join documents d using (doc_id)""",
    "vectors": """select vec_id as id, embedding::double[] as x, label as y from embeddings""",
}
NEEDS = {"obs_sparse": ["gauge_events"], "obs_hourly": ["obs_sparse"]}


def _order(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        for need in _order(NEEDS.get(name, [])) + [name]:
            if need not in out:
                out.append(need)
    return out


def with_relations(names: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    """``with <relations>, <extra> <body>``"""
    parts = [f"{n} as ({BASE[n]})" for n in _order(names)]
    parts += [f"{n} as ({q})" for n, q in (extra or {}).items()]
    return "with " + ",\n".join(parts) + "\n" + body


# Added before rounding on both sides: moves rounding borders off the decimal grid that products of
# short decimals fall on, where the engines' last-bit differences would decide the digit.
NUDGE = 3.7e-10


def r(expr: str, digits: int = 6) -> str:
    """Rounded double without negative zero."""
    return f"(round(({expr})::double + {NUDGE}::double, {digits}) + 0.0::double)"
