"""Zones, buildings, rasters and tides."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from hydrolake import config
from hydrolake.catalog.registry import oracle, query
from hydrolake.catalog.rollup_queries import AS_OF
from hydrolake.catalog.series_queries import as_of_time
from hydrolake.functions import risk, spatial
from hydrolake.operators import raster, rollups, spatial as space, stats, tide
from hydrolake.sources import relations as rel

# raster placement: 50 columns over the map's width, rows of 0.0004 degrees from the south edge
X0, Y0, DX, DY = 117.05, -0.58, 0.0034, 0.0004

HOUR = f"""select max(est) filter (where precipitation is not null) as tide, max(rain) as rain from (
 select est, precipitation, sum(precipitation) over (partition by loc order by "time" rows between 23 preceding and current row) as rain, "time" from obs_hourly) where "time" = {AS_OF} """


def hour_values(spark, d):
    """Highest tide and largest 24 h rain over the sites at the moment taken as now: one row."""
    now = as_of_time(spark, d)
    h = rel.obs_hourly(spark, d).where((F.col("time") <= now) & (F.col("time") > now - F.expr("interval 24 hours")))
    per_site = h.groupBy("loc").agg(F.sum("precipitation").alias("rain"), F.max_by("est", "time").alias("tide"))
    one = per_site.select(F.struct(F.max("tide").alias("tide"), F.max("rain").alias("rain")).alias("h")).scalar()
    return one.getField("tide"), one.getField("rain")


@query(oracle("zone_id zone heatmap_intensity:d status_text depth_est", """
select zone_id, zone, case when elev < adj and rain < 5 then 0.6 when elev < adj then 1.0 when elev < adj + 0.5 then case when rain > 20 then 0.7 else 0.4 end when elev < adj + 1.0 then 0.3 else 0.0 end as heatmap_intensity,
 case when elev < adj and rain < 5 then 'WASPADA (PASANG)' when elev < adj then 'BAHAYA (TENGGELAM)' when elev < adj + 0.5 then 'SIAGA (RISIKO TINGGI)' when elev < adj + 1.0 then 'WASPADA (RISIKO)' else 'AMAN' end as status_text,
 case when elev < adj and rain < 5 then 'Genangan ' || printf('%.0f', (adj-elev)*100) || ' cm' when elev < adj then 'Banjir ' || printf('%.0f', (adj-elev)*100) || ' cm' when elev < adj + 0.5 then 'Hampir Meluap' when elev < adj + 1.0 then 'Belum Tergenang' else 'Kering' end as depth_est
from (select zone_id, zone, mean_elev as elev, tide - 2.8::double as adj, rain from zones cross join hour_now)""", "zones obs_hourly", {"hour_now": HOUR}))
def zone_inundation(spark, d):
    t, r = hour_values(spark, d)
    z = space.zone_inundation(rel.zones(spark, d), t, r)
    return z.select("zone_id", "zone", "heatmap_intensity", "status_text", "depth_est")


RISK = """select *, case when risk >= 0.85 then 'EKSTREM' when risk >= 0.7 then 'TINGGI' when risk >= 0.5 then 'SEDANG' when risk >= 0.3 then 'RENDAH' else 'AMAN' end as risk_label from (
 select zone_id, zone, (lon0+lon1+lon1+lon0+lon0)/5 as lon, (lat0+lat0+lat1+lat1+lat0)/5 as lat,
 least(1.0::double, (least(greatest((3.0::double-mean_elev)/3.0::double,0),1)*0.4::double + risk_pct/100.0::double*0.6::double)
   * ((case when rain > 50 then 1.5::double when rain > 20 then 1.2::double else 1.0::double end) * (case when tide > 2.5 then 1.3::double when tide > 2.0 then 1.1::double else 1.0::double end))) as risk
 from zones cross join hour_now)"""


def risky_zones(spark, d):
    t, r = hour_values(spark, d)
    return space.zone_risk(rel.zone_rings(rel.zones(spark, d)), t, r)


@query(oracle("zone_id lon:d lat:d risk:d risk_label", RISK, "zones obs_hourly", {"hour_now": HOUR}))
def zone_risk_score(spark, d):
    return risky_zones(spark, d).select("zone_id", "lon", "lat", "risk", "risk_label")


@query(oracle("zone_id lon:d lat:d", "select zone_id, (lon0+lon1+lon1+lon0+lon0)/5 as lon, (lat0+lat0+lat1+lat1+lat0)/5 as lat from zones", "zones"))
def zone_centroid(spark, d):
    lon, lat = spatial.ring_centroid("ring")
    return rel.zone_rings(rel.zones(spark, d)).select("zone_id", lon.alias("lon"), lat.alias("lat"))


BOXES = f"select zone_id, lon-0.005::double as x0, lat-0.005::double as y0, lon+0.005::double as x1, lat+0.005::double as y1, risk from ({RISK}) where risk > 0.5"
HITS = "select b.id, b.name, b.amenity, x.zone_id, x.risk from buildings b join boxes x on b.lon between x.x0 and x.x1 and b.lat between x.y0 and x.y1"
SPACE_EXTRA = {"hour_now": HOUR, "boxes": BOXES}


@query(oracle("zone_id x0:d y0:d x1:d y1:d risk:d", "select * from boxes", "zones obs_hourly", SPACE_EXTRA))
def risk_boxes(spark, d):
    return space.risk_boxes(risky_zones(spark, d)).select("zone_id", "x0", "y0", "x1", "y1", "risk")


def hits(spark, d):
    boxes = space.risk_boxes(risky_zones(spark, d)).select("zone_id", "x0", "y0", "x1", "y1", "risk")
    return space.spatial_join(rel.buildings(spark, d), boxes)


@query(oracle("id zone_id risk:d", HITS, "zones buildings obs_hourly", SPACE_EXTRA))
def buildings_at_risk(spark, d):
    return hits(spark, d).select("id", "zone_id", "risk")


@query(oracle("id zone_id", "select b.id, z.zone_id from buildings b join zones z on b.lon > z.lon0 and b.lon < z.lon1 and b.lat > z.lat0 and b.lat < z.lat1", "zones buildings"))
def buildings_in_zones(spark, d):
    z = space.ring_box(rel.zone_rings(rel.zones(spark, d)).select("zone_id", "ring"))
    return space.spatial_join(rel.buildings(spark, d), z, ring="ring").select("id", "zone_id")


@query(oracle("mode total_affected:i schools_affected:i hospitals_affected:i", f"""
select 'hits' as mode, count(*) as total_affected, sum(case when amenity in ('school','university','college','kindergarten') then 1 else 0 end) as schools_affected,
 sum(case when amenity in ('hospital','clinic','pharmacy') then 1 else 0 end) as hospitals_affected from ({HITS})
union all select 'distinct', count(distinct id), count(distinct case when amenity in ('school','university','college','kindergarten') then id end), count(distinct case when amenity in ('hospital','clinic','pharmacy') then id end) from ({HITS})""",
 "zones buildings obs_hourly", SPACE_EXTRA))
def impact_summary(spark, d):
    h = hits(spark, d)
    both = space.impact_summary(h).withColumn("mode", F.lit("hits"))
    return both.unionByName(space.impact_summary(h, distinct=True).withColumn("mode", F.lit("distinct")))


@query(oracle("name amenity", f"select name, amenity from ({HITS}) where name is not null and amenity is not null order by id, zone_id limit 10", "zones buildings obs_hourly", SPACE_EXTRA))
def impact_details(spark, d):
    return space.impact_details(hits(spark, d))


@query(oracle("kelurahan persen_dataran_rendah:d mean_elev:d", "select zone as kelurahan, risk_pct as persen_dataran_rendah, mean_elev from zones order by mean_elev, zone_id limit 10", "zones"))
def lowest_zones(spark, d):
    return space.lowest_zones(rel.zones(spark, d))


SEGMENTS = "select * from (values " + ", ".join(
    f"({x1}::double, {y1}::double, {x2}::double, {y2}::double)" for line in config.RIVERS.values() for (x1, y1), (x2, y2) in zip(line, line[1:])
) + ") s(x1, y1, x2, y2)"
RIVER = """select id, min(sqrt(power(lon - (x1 + t*(x2-x1)), 2) + power(lat - (y1 + t*(y2-y1)), 2)))*111139 as river_dist_m from (
 select id, lon, lat, x1, y1, x2, y2, greatest(0, least(1, ((lon-x1)*(x2-x1) + (lat-y1)*(y2-y1)) / ((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)))) as t from buildings cross join seg) group by id"""


@query(oracle("id river_dist_m:d", RIVER, "buildings", {"seg": SEGMENTS}, digits=4), digits=4)
def river_distance(spark, d):
    return rel.buildings(spark, d).select("id", spatial.river_distance_m("lon", "lat").alias("river_dist_m"))


@query(oracle("id x_tile:i y_tile:i x_pixel:i y_pixel:i", """
select id, floor(x) as x_tile, floor(y) as y_tile, least(greatest(floor((x-floor(x))*256),0),255) as x_pixel, least(greatest(floor((y-floor(y))*256),0),255) as y_pixel
from (select id, (lon+180)/360*256 as x, (1 - asinh(tan(radians(lat)))/pi())/2*256 as y from buildings)""", "buildings"))
def tile_pixel(spark, d):
    return rel.buildings(spark, d).select("id", *[c.alias(n) for n, c in spatial.tile_pixel("lat", "lon").items()])


@query(oracle("zone_id i j lat:d lon:d", """
select zone_id, i, j, lat0 + i*((lat1-lat0)/19) as lat, lon0 + j*((lon1-lon0)/19) as lon from zones cross join (select unnest(range(20)) as i) cross join (select unnest(range(20)) as j)""", "zones"))
def geo_grid(spark, d):
    box = rel.zones(spark, d).select("zone_id", F.col("lon0").alias("x0"), F.col("lat0").alias("y0"), F.col("lon1").alias("x1"), F.col("lat1").alias("y1"))
    return space.geo_grid(box, 20)


@query(oracle("id value:d", f"""select b.id, coalesce(r.value, 0) as value from buildings b left join raster r on r."row" = floor((b.lat - {Y0}::double)/{DY}::double) and r.col = floor((b.lon - {X0}::double)/{DX}::double)""", "buildings raster"))
def raster_sample(spark, d):
    return space.sample_raster(rel.buildings(spark, d), rel.raster(spark, d), X0, Y0, DX, DY).select("id", "value")


@query(oracle("zone_id p10_elev:d p50_elev:d", """
select z.zone_id, coalesce(p10, 0) as p10_elev, coalesce(p50, 0) as p50_elev from zones z left join
 (select zone_id, quantile_cont(value, 0.1) as p10, quantile_cont(value, 0.5) as p50 from raster where value > -100 group by 1) q on q.zone_id = z.zone_id""", "zones raster"))
def zonal_percentiles(spark, d):
    return raster.zonal_percentiles(rel.zones(spark, d).select("zone_id"), rel.raster(spark, d))


@query(oracle("zone_id total_area_px flood_prone_px:i flood_prone_pct:d min_elevation:d mean_elevation:d", """
select zone_id, count(*) as total_area_px, sum(case when value < 5 then 1 else 0 end) as flood_prone_px, 100.0::double*sum(case when value < 5 then 1 else 0 end)/count(*) as flood_prone_pct,
 min(value) as min_elevation, avg(value) as mean_elevation from raster where value > -100 group by 1""", "raster"))
def raster_summary(spark, d):
    return rollups.raster_summary(rel.raster(spark, d), "zone_id")


SLOPE = """select c."row", c.col, c.value, atan(sqrt(power(case when w.value is not null and e.value is not null then (e.value-w.value)/2 when e.value is not null then e.value-c.value when w.value is not null then c.value-w.value else 0 end, 2)
 + power(case when n.value is not null and s.value is not null then (s.value-n.value)/2 when s.value is not null then s.value-c.value when n.value is not null then c.value-n.value else 0 end, 2))) as slope
from raster c left join raster n on n."row"=c."row"-1 and n.col=c.col left join raster s on s."row"=c."row"+1 and s.col=c.col left join raster w on w."row"=c."row" and w.col=c.col-1 left join raster e on e."row"=c."row" and e.col=c.col+1"""


@query(oracle("row col slope:d", SLOPE, "raster"))
def raster_slope(spark, d):
    return raster.slope(rel.raster(spark, d), tile=16).select("row", "col", "slope")


DIRS = "select * from (values " + ", ".join(f"({i}, {code}, {dr}, {dc})" for i, (_, code, dr, dc) in enumerate(raster.DIRECTIONS)) + ") v(ord, code, dr, dc)"
D8 = """select c."row", c.col, coalesce(b.code, 0) as direction, b.dr, b.dc, coalesce(b.dropv, 0) as dropv from (select * from raster where value > -100) c left join (
 select c."row", c.col, dirs.code, dirs.dr, dirs.dc, (c.value-t.value)/case when dirs.dr<>0 and dirs.dc<>0 then power(2.0::double, 0.5::double) else 1.0::double end as dropv, ord
 from raster c cross join dirs join raster t on t."row"=c."row"+dirs.dr and t.col=c.col+dirs.dc where c.value > -100 and t.value > -100 and c.value > t.value
 qualify row_number() over (partition by c."row", c.col order by dropv desc, ord) = 1) b on b."row"=c."row" and b.col=c.col"""


@query(oracle("row col direction:i drop:d", """select r."row", r.col, d.direction, coalesce(d.dropv, 0) as "drop" from raster r left join d8 d on d."row"=r."row" and d.col=r.col""", "raster", {"dirs": DIRS, "d8": D8}))
def d8_direction(spark, d):
    return raster.d8(rel.raster(spark, d), tile=16).select("row", "col", "direction", "drop")


# the recursive walk: every cell sends one unit to each cell on its way down
WALK = """(with recursive walk("row", col) as (select "row", col from d8 union all select w."row"+d.dr, w.col+d.dc from walk w join d8 d on d."row"=w."row" and d.col=w.col where d.dr is not null)
 select "row", col, count(*) as flow_accumulation from walk group by 1, 2)"""


@query(oracle("row col flow_accumulation:i", f"select * from {WALK}", "raster", {"dirs": DIRS, "d8": D8}))
def flow_accumulation(spark, d):
    return raster.flow_accumulation(raster.d8(rel.raster(spark, d)))


TWI = f"""select s."row", s.col, s.value, s.slope, coalesce(a.flow_accumulation, 0) as flow_accumulation, case when tan(s.slope + 0.001::double) > 0 then ln((coalesce(a.flow_accumulation, 0) + 1)/tan(s.slope + 0.001::double)) end as twi
 from ({SLOPE}) s left join {WALK} a on a."row"=s."row" and a.col=s.col"""


@query(oracle("row col flow_accumulation:i twi:d", TWI, "raster", {"dirs": DIRS, "d8": D8}))
def twi(spark, d):
    return raster.twi(rel.raster(spark, d)).select("row", "col", "flow_accumulation", "twi")


@query(oracle("id elevation:d slope:d twi:d flow_accumulation:d river_dist_m:d", f"""
select b.id, coalesce(t.value, 0) as elevation, coalesce(t.slope, 0) as slope, coalesce(t.twi, 0) as twi, coalesce(t.flow_accumulation, 0) as flow_accumulation, rv.river_dist_m
from buildings b join ({RIVER}) rv on rv.id=b.id left join ({TWI}) t on t."row" = floor((b.lat - {Y0}::double)/{DY}::double) and t.col = floor((b.lon - {X0}::double)/{DX}::double)""",
 "buildings raster", {"seg": SEGMENTS, "dirs": DIRS, "d8": D8}, digits=4), digits=4)
def site_features(spark, d):
    cells = raster.twi(rel.raster(spark, d))
    return space.site_features(rel.buildings(spark, d), cells, X0, Y0, DX, DY).select(
        "id", "elevation", "slope", "twi", F.col("flow_accumulation").cast("double").alias("flow_accumulation"), "river_dist_m"
    )


# --- tide ------------------------------------------------------------------------------------

MEASURES = ("est", "msl", "lt")


@query(oracle("station measure min:d max:d mean:d median:d std:d range:d", " union all ".join(
    f"select station, '{m}' as measure, min({m}) as min, max({m}) as max, avg({m}) as mean, quantile_cont({m}, 0.5) as median, stddev_samp({m}) as std, max({m})-min({m}) as \"range\" from tide_obs group by station" for m in MEASURES), "tide_obs"))
def tide_describe(spark, d):
    return stats.describe(rel.tide_obs(spark, d), MEASURES, ["station"])


@query(oracle("station bulan mean:d min:d max:d", "select station, strftime(t, '%Y-%m') as bulan, avg(est) as mean, min(est) as min, max(est) as max from tide_obs group by 1, 2", "tide_obs"))
def tide_monthly(spark, d):
    return rollups.tide_monthly(rel.tide_obs(spark, d))


@query(oracle("station highest_at:t highest:d lowest_at:t lowest:d tidal_range:d range_class", """
select *, case when tidal_range < 2 then 'Microtidal' when tidal_range <= 4 then 'Mesotidal' else 'Macrotidal' end as range_class from (
select station, (select min(t) from tide_obs x where x.station=o.station and x.est=max(o.est)) as highest_at, max(est) as highest, (select min(t) from tide_obs x where x.station=o.station and x.est=min(o.est)) as lowest_at, min(est) as lowest, max(est)-min(est) as tidal_range from tide_obs o group by station)""", "tide_obs"))
def tide_extremes(spark, d):
    return rollups.tide_extremes(rel.tide_obs(spark, d)).withColumn("range_class", risk.tidal_range_class("tidal_range"))


@query(oracle("station kategori jumlah persen:d", """
select station, kategori, count(*) as jumlah, 100.0::double*count(*)/sum(count(*)) over (partition by station) as persen from (
 select o.station, case when est <= q[1] then 'Sangat Rendah' when est <= q[2] then 'Rendah' when est <= q[3] then 'Tinggi' else 'Sangat Tinggi' end as kategori
 from tide_obs o join (select station, quantile_cont(est, [0.25, 0.5, 0.75]) as q from tide_obs group by 1) e on e.station=o.station) group by 1, 2""", "tide_obs"))
def tide_quartile_bins(spark, d):
    return stats.bin_shares(stats.quartile_bins(rel.tide_obs(spark, d), "est", ["station"]), ["station"])


@query(oracle("station t:t msl:d lower:d upper:d", """
select o.station, o.t, o.msl, lower, upper from tide_obs o join (select station, q[1]-1.5::double*(q[2]-q[1]) as lower, q[2]+1.5::double*(q[2]-q[1]) as upper from (
 select station, quantile_cont(value, [0.25, 0.75]) as q from (select station, msl as value from tide_obs) group by 1)) b on b.station=o.station where o.msl < lower or o.msl > upper
union all select station, t, value, lower, upper from (select user_id // 50 as station, ts as t, value from events) join (select station, q[1]-1.5::double*(q[2]-q[1]) as lower, q[2]+1.5::double*(q[2]-q[1]) as upper from (
 select user_id // 50 as station, quantile_cont(value, [0.25, 0.75]) as q from events group by 1)) using (station) where value < lower or value > upper""", "tide_obs"))
def tide_outliers(spark, d):
    """Outliers of the gauge and of the raw readings behind it."""
    gauge = stats.iqr_outliers(rel.tide_obs(spark, d).select("station", "t", "msl"), "msl", ["station"])
    raw = rel.table(spark, d, "events").select(F.expr("user_id div 50").alias("station"), F.col("ts").alias("t"), F.col("value").alias("msl"))
    return gauge.unionByName(stats.iqr_outliers(raw, "msl", ["station"]))


@query(oracle("station expected:i present:i n_rows:i missing:i duplicates:i", """
select *, expected - present as missing, n_rows - present as duplicates from (
select station, max(slot)-min(slot)+1 as expected, count(distinct slot) as present, count(*) as n_rows from (select station, epoch_us(t) // 600000000 as slot from tide_obs) group by 1)""", "tide_obs"))
def series_completeness(spark, d):
    return stats.series_completeness(rel.tide_obs(spark, d), "t", "station")


@query(oracle("station t:t est:d warning msl_alert:i", """
select station, t, est, case when est > 3.8::double then 'BAHAYA' when est > 3.5::double then 'PERINGATAN' else 'NORMAL' end as warning, case when msl > 1.0::double then 1 else 0 end as msl_alert from tide_obs""", "tide_obs"))
def tide_warning(spark, d):
    return tide.tide_warning(rel.tide_obs(spark, d)).select("station", "t", "est", "warning", "msl_alert")


TIDE_MODEL_EXPR = "2.5::double + 0.9::double*cos({w1}::double*h - loc*0.1::double) + 0.5::double*cos({w2}::double*h - loc*0.2::double)"


@query(oracle("loc time:t est:d", f"""
select loc, "time", case when loc % 5 = 4 then 0 else {TIDE_MODEL_EXPR.format(w1=2 * math.pi / 12.4206, w2=2 * math.pi / 23.9345)} end as est from (select loc, "time", epoch("time")/3600.0::double as h from obs_hourly)""", "obs_hourly"))
def tide_predict(spark, d):
    h = rel.obs_hourly(spark, d).select("loc", "time")
    sites = rel.gauge_events(spark, d).select("loc").distinct().where(F.col("loc") % 5 != 4)  # the others have no model
    parts = F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.lit(w).alias("omega"), F.lit(a).alias("amplitude"), (F.col("loc") * F.lit(g)).alias("phase"))
            for (n, w), a, g in zip(tide.omegas().items(), (0.9, 0.5), (0.1, 0.2))
        ]
    )
    model = sites.select("loc", F.lit(2.5).alias("mean"), F.inline(parts))
    return tide.tide_predict(h, model, by="loc")


# least squares for mean + one constituent, solved by Cramer's rule
CRAMER = f"""select station, n, s1, s2, s11, s22, s12, sy, sy1, sy2, n*(s11*s22-s12*s12) - s1*(s1*s22-s12*s2) + s2*(s1*s12-s11*s2) as det from (
 select station, count(*)::double as n, sum(c) as s1, sum(s) as s2, sum(c*c) as s11, sum(s*s) as s22, sum(c*s) as s12, sum(est) as sy, sum(est*c) as sy1, sum(est*s) as sy2 from (
 select station, est, cos({2 * math.pi / 12.4206}::double*epoch(t)/3600) as c, sin({2 * math.pi / 12.4206}::double*epoch(t)/3600) as s from tide_obs) group by 1)"""


@query(oracle("station name amplitude:d phase:d mean:d", f"""
select station, 'M2' as name, sqrt(a*a+b*b) as amplitude, atan2(b, a) as phase, m as mean from (select station,
 (sy*(s11*s22-s12*s12) - s1*(sy1*s22-s12*sy2) + s2*(sy1*s12-s11*sy2))/det as m,
 (n*(sy1*s22-s12*sy2) - sy*(s1*s22-s12*s2) + s2*(s1*sy2-sy1*s2))/det as a,
 (n*(s11*sy2-sy1*s12) - s1*(s1*sy2-sy1*s2) + sy*(s1*s12-s11*s2))/det as b from ({CRAMER}))""", "tide_obs"))
def tide_fit(spark, d):
    return tide.tide_fit(rel.tide_obs(spark, d), tide.omegas(("M2",))).select("station", "name", "amplitude", "phase", "mean")
