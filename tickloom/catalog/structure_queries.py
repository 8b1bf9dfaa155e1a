"""Pivots, hierarchy, fans and angle events over the hourly event bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog import inputs
from tickloom.catalog.indicator_queries import MOMENTUM_SQL, STREAK_SQL
from tickloom.catalog.inputs import HOURLY_SQL, INDEXED_SQL, rounded
from tickloom.catalog.registry import query, with_sql
from tickloom.functions import geometry as geo
from tickloom.operators import hierarchy as H
from tickloom.operators import pivots as P
from tickloom.plans import studies
from tickloom.session import settle


def raw_sql(left: int, right: int) -> str:
    return (
        INDEXED_SQL
        + f""", fr AS (SELECT *, max(high) OVER b AS hb, min(low) OVER b AS lb, max(high) OVER a AS ha, min(low) OVER a AS la, count(*) OVER a AS na
  FROM ib WINDOW b AS (PARTITION BY symbol ORDER BY epoch ROWS BETWEEN {left} PRECEDING AND 1 PRECEDING),
                 a AS (PARTITION BY symbol ORDER BY epoch ROWS BETWEEN 1 FOLLOWING AND {right} FOLLOWING)),
raw AS (
  SELECT symbol, bar_index, epoch, 'high' AS type, high AS price, 0 AS seq, bar_index + {right} AS visible_index FROM fr
  WHERE bar_index >= {left} AND na = {right} AND high > hb AND high > ha
  UNION ALL
  SELECT symbol, bar_index, epoch, 'low', low, 1, bar_index + {right} FROM fr
  WHERE bar_index >= {left} AND na = {right} AND low < lb AND low < la)"""
    )


ALTERNATE_SQL = (
    raw_sql(5, 5)
    + """, ty AS (SELECT *, lag(type) OVER (PARTITION BY symbol ORDER BY bar_index, seq) AS before FROM raw),
rn AS (SELECT *, sum(CASE WHEN before <> type THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY bar_index, seq) AS run,
              CASE WHEN type = 'high' THEN price ELSE -price END AS score FROM ty),
best AS (SELECT symbol, run, arg_max({'bar_index': bar_index, 'epoch': epoch, 'type': type, 'price': price}, (score, -bar_index)) AS p,
                min(visible_index) AS starts FROM rn GROUP BY symbol, run),
alt AS (SELECT b.symbol, b.run, b.p.bar_index AS bar_index, b.p.epoch AS epoch, b.p.type AS type, b.p.price AS price, n.starts AS confirm_index
        FROM best b LEFT JOIN best n ON n.symbol = b.symbol AND n.run = b.run + 1),
conf AS (SELECT * FROM alt WHERE confirm_index IS NOT NULL)"""
)


@query("w5_raw_pivots", with_sql(raw_sql(5, 5), "SELECT symbol, epoch, bar_index, type, price, visible_index FROM raw"))
def w5_raw_pivots(spark, sf):
    out = P.raw_pivots(inputs.hourly_indexed(spark, sf))
    return out.select("symbol", "epoch", "bar_index", "type", "price", "visible_index")


@query("w6_alternating_pivots", with_sql(ALTERNATE_SQL, "SELECT symbol, epoch, bar_index, type, price, confirm_index FROM alt"))
def w6_alternating_pivots(spark, sf):
    runs = P.with_runs(settle(P.raw_pivots(inputs.hourly_indexed(spark, sf))))
    out = P.alternate_pivots(settle(runs))
    return out.select("symbol", "epoch", "bar_index", "type", "price", "confirm_index")


@query(
    "w11_staircase",
    with_sql(
        ALTERNATE_SQL
        + """, sc AS (SELECT *, max(CASE WHEN type = 'high' THEN price ELSE -price END) OVER (PARTITION BY symbol, type ORDER BY bar_index
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM conf)""",
        """SELECT symbol, epoch, type, price FROM sc
WHERE top IS NULL OR CASE WHEN type = 'high' THEN price ELSE -price END > top""",
    ),
)
def w11_staircase(spark, sf):
    confirmed = settle(P.confirmed_pivots(inputs.hourly_indexed(spark, sf)))
    return P.staircase(confirmed).select("symbol", "epoch", "type", "price")


@query(
    "w12_recent_pivots",
    with_sql(
        raw_sql(5, 5),
        """SELECT symbol, epoch, type, price, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_index DESC, seq DESC) AS rank FROM raw WHERE bar_index < 600)
WHERE rank <= 4""",
    ),
)
def w12_recent_pivots(spark, sf):
    raw = P.raw_pivots(inputs.hourly_indexed(spark, sf))
    return P.recent_pivots(raw, F.lit(600), 4).select("symbol", "epoch", "type", "price", "rank")


@query(
    "f13_pivots_in_range",
    with_sql(
        raw_sql(10, 10),
        "SELECT symbol, epoch, type, price FROM raw WHERE epoch BETWEEN 1704844800 AND 1705708800 AND type = 'high'",
    ),
)
def f13_pivots_in_range(spark, sf):
    from tickloom.operators.ranges import filter_events

    raw = P.symmetric_pivots(inputs.hourly_indexed(spark, sf), 10)
    return filter_events(raw, 1704844800, 1705708800, types=["high"]).select("symbol", "epoch", "type", "price")


PAIRS_SQL = (
    raw_sql(10, 10)
    + """, pv AS (SELECT *, {'bar_index': bar_index, 'epoch': epoch, 'type': type, 'price': price} AS p FROM raw),
lt AS (SELECT symbol, arg_max(p, bar_index) FILTER (type = 'high') AS rh, arg_max(p, bar_index) FILTER (type = 'low') AS rl FROM pv GROUP BY symbol),
ou AS (SELECT pv.symbol, arg_max(p, (price, -bar_index)) FILTER (type = 'high') AS oh, arg_max(p, (-price, -bar_index)) FILTER (type = 'low') AS ol
       FROM pv JOIN lt USING (symbol) WHERE (type = 'high' AND bar_index <> rh.bar_index) OR (type = 'low' AND bar_index <> rl.bar_index) GROUP BY pv.symbol),
cand AS (SELECT symbol, 'inner' AS pair_type, rh AS h, rl AS l FROM lt WHERE rh IS NOT NULL AND rl IS NOT NULL
         UNION ALL SELECT symbol, 'outer', oh, ol FROM ou WHERE oh IS NOT NULL AND ol IS NOT NULL),
pairs AS (SELECT symbol, pair_type, CASE WHEN l.epoch < h.epoch THEN l ELSE h END AS first,
                 CASE WHEN l.epoch < h.epoch THEN h ELSE l END AS second, CASE WHEN l.epoch < h.epoch THEN 2 ELSE 1 END AS scenario FROM cand)"""
)


@query(
    "j12_j13_pivot_pairs",
    with_sql(
        PAIRS_SQL,
        """SELECT symbol, pair_type, scenario, first.epoch AS first_epoch, first.price AS first_price, first.type AS first_type,
       second.epoch AS second_epoch, second.price AS second_price FROM pairs""",
    ),
)
def j12_j13_pivot_pairs(spark, sf):
    pairs = P.pivot_pairs(settle(P.symmetric_pivots(inputs.hourly_indexed(spark, sf), 10)))
    return pairs.select(
        "symbol", "pair_type", "scenario",
        F.col("first.epoch").alias("first_epoch"), F.col("first.price").alias("first_price"), F.col("first.type").alias("first_type"),
        F.col("second.epoch").alias("second_epoch"), F.col("second.price").alias("second_price"),
    )


@query(
    "x20_pair_scenarios",
    with_sql(
        PAIRS_SQL,
        """SELECT p.symbol, p.pair_type, scenario, count(*) FILTER (CASE WHEN scenario = 1 THEN b.close > second.price ELSE b.close < second.price END) AS breaches
FROM pairs p JOIN bars b USING (symbol) WHERE b.epoch > second.epoch GROUP BY 1, 2, 3""",
    ),
)
def x20_pair_scenarios(spark, sf):
    bars = inputs.hourly_indexed(spark, sf)
    pairs = P.pivot_pairs(settle(P.symmetric_pivots(bars, 10)))
    after = bars.join(pairs, "symbol").where(F.col("epoch") > F.col("second.epoch"))
    broke = geo.breaches(F.col("close"), F.col("second.price"), F.col("scenario"))
    return after.groupBy("symbol", "pair_type", "scenario").agg(F.count_if(broke).alias("breaches"))


@query(
    "j11_bars_asof_pivots",
    with_sql(
        ALTERNATE_SQL,
        """SELECT b.symbol, b.epoch, arg_max(p.price, p.run) FILTER (p.type = 'high') AS last_high,
       arg_max(p.price, p.run) FILTER (p.type = 'low') AS last_low, count(p.run) AS pivots_seen
FROM ib b LEFT JOIN conf p ON p.symbol = b.symbol AND p.confirm_index <= b.bar_index GROUP BY 1, 2""",
    ),
)
def j11_bars_asof_pivots(spark, sf):
    bars = inputs.hourly_indexed(spark, sf)
    seen = P.visible_at(bars, settle(P.confirmed_pivots(bars)))
    return seen.select(
        "symbol", "epoch", F.col("last_high.price").alias("last_high"), F.col("last_low.price").alias("last_low"), "pivots_seen"
    )


HIERARCHY_SQL = (
    ALTERNATE_SQL
    + """, grown AS (SELECT *, max({'score': score, 'early': -bar_index, 'epoch': epoch, 'type': type, 'price': price}) OVER
         (PARTITION BY symbol, run ORDER BY bar_index, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM rn),
lastp AS (SELECT symbol, visible_index, arg_max(g, seq) AS g FROM grown GROUP BY symbol, visible_index),
ctx AS (SELECT b.*, l.g.epoch AS o_epoch, l.g.price AS o_price, CASE WHEN l.g.type = 'low' THEN 'bullish' ELSE 'bearish' END AS context,
               CASE WHEN l.g.type = 'low' THEN -1.0 ELSE 1.0 END AS s, CASE WHEN l.g.type = 'low' THEN 'high' ELSE 'low' END AS near
        FROM ib b ASOF JOIN lastp l ON l.symbol = b.symbol AND b.bar_index >= l.visible_index),
vis AS (SELECT c.symbol, c.epoch, c.bar_index, c.close, c.context, c.o_epoch, c.o_price, c.s, c.near, p.run, p.epoch AS p_epoch,
               p.price AS p_price, p.bar_index AS p_index, p.type AS p_type
        FROM ctx c JOIN conf p ON p.symbol = c.symbol AND p.confirm_index <= c.bar_index),
nr AS (SELECT symbol, epoch, any_value(bar_index) AS bar_index, any_value(close) AS close, any_value(context) AS context,
              any_value(o_epoch) AS o_epoch, any_value(o_price) AS o_price, any_value(s) AS s, any_value(near) AS near,
              arg_max({'epoch': p_epoch, 'price': p_price, 'bar_index': p_index}, run) FILTER (p_type = near) AS a0,
              arg_max({'epoch': p_epoch, 'price': p_price, 'bar_index': p_index, 'run': run}, run) FILTER (p_type = near AND s * p_price < s * close) AS n0
       FROM vis GROUP BY symbol, epoch),
fr2 AS (SELECT v.symbol, v.epoch, arg_max({'epoch': p_epoch, 'price': p_price, 'bar_index': p_index}, (v.s * p_price, -run)) AS f0
        FROM vis v JOIN nr ON nr.symbol = v.symbol AND nr.epoch = v.epoch WHERE p_type <> v.near AND run > nr.n0.run GROUP BY 1, 2),
base AS (SELECT nr.symbol, nr.epoch, nr.bar_index, close, context, o_epoch, o_price, s, near,
                CASE WHEN s * close >= s * a0.price THEN a0 END AS anchor, CASE WHEN f0 IS NOT NULL THEN n0 END AS n0, f0
         FROM nr LEFT JOIN fr2 ON fr2.symbol = nr.symbol AND fr2.epoch = nr.epoch),
cd AS (SELECT b.symbol, b.epoch, v.p_epoch, v.p_price, v.p_index, v.run, v.s * v.p_price AS sp,
              max(v.s * v.p_price) OVER (PARTITION BY b.symbol, b.epoch ORDER BY v.run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
       FROM base b JOIN vis v ON v.symbol = b.symbol AND v.epoch = b.epoch
       WHERE b.anchor IS NOT NULL AND b.f0 IS NOT NULL AND v.p_type <> b.near AND v.p_epoch > b.n0.epoch AND v.p_epoch <> b.f0.epoch
         AND v.s * v.p_price > b.s * b.close),
inn AS (SELECT symbol, epoch, list({'epoch': p_epoch, 'price': p_price, 'bar_index': p_index} ORDER BY run) AS inner_l FROM cd WHERE top IS NULL OR sp > top GROUP BY 1, 2),
tree AS (SELECT base.*, coalesce(inner_l, []) AS inner_l FROM base LEFT JOIN inn ON inn.symbol = base.symbol AND inn.epoch = base.epoch)"""
)


def tree(spark, sf, left=5, right=5):
    bars = inputs.hourly_indexed(spark, sf)
    return bars, H.hierarchy(bars, left, right)


@query(
    "g11_pivot_hierarchy",
    with_sql(
        HIERARCHY_SQL,
        """SELECT symbol, epoch, context, o_epoch AS origin_epoch, o_price AS origin_price, anchor.epoch AS anchor_epoch,
       f0.epoch AS outer_from, n0.epoch AS outer_to, list_transform(inner_l, lambda p : p.epoch) AS inner_from FROM tree""",
    ),
)
def g11_pivot_hierarchy(spark, sf):
    _, out = tree(spark, sf)
    return out.select(
        "symbol", "epoch", "context",
        F.col("origin.epoch").alias("origin_epoch"), F.col("origin.price").alias("origin_price"),
        F.col("anchor.epoch").alias("anchor_epoch"), F.col("outer_from.epoch").alias("outer_from"),
        F.col("outer_to.epoch").alias("outer_to"), F.transform("inner", lambda p: p["epoch"]).alias("inner_from"),
    )


@query(
    "g12_active_pair",
    with_sql(
        HIERARCHY_SQL,
        "SELECT symbol, epoch, context, f0.price AS from_price, n0.price AS to_price FROM tree WHERE f0 IS NOT NULL",
    ),
)
def g12_active_pair(spark, sf):
    _, out = tree(spark, sf)
    return H.active_pair(out).select(
        "symbol", "epoch", "context", F.col("outer_from.price").alias("from_price"), F.col("outer_to.price").alias("to_price")
    )


FANS_SQL = (
    HIERARCHY_SQL
    + """, dp AS (
  SELECT symbol, epoch, bar_index, 'outer' AS pair_type, f0 AS a, {'epoch': n0.epoch, 'price': n0.price, 'bar_index': n0.bar_index} AS b FROM tree WHERE f0 IS NOT NULL
  UNION ALL
  SELECT symbol, epoch, bar_index, 'inner', unnest(inner_l[1:3]), anchor FROM tree WHERE len(inner_l) > 0),
fn AS (SELECT symbol, concat_ws('_', a.epoch, b.epoch, pair_type) AS fan_id, pair_type, a, b, min(bar_index) AS drawn_index, min(epoch) AS drawn_epoch
       FROM dp GROUP BY symbol, pair_type, a, b),
og AS (SELECT *, CASE WHEN a.epoch <= b.epoch THEN a ELSE b END AS o, CASE WHEN a.epoch <= b.epoch THEN b ELSE a END AS t FROM fn),
gm AS (SELECT *, greatest(1, abs(t.bar_index - o.bar_index)) AS db, atan((t.price - o.price) / greatest(1, abs(t.bar_index - o.bar_index))) AS th,
              unnest([1.0, 0.875, 0.75, 0.5, 0.25]::DOUBLE[]) AS fr FROM og),
lines AS (SELECT symbol, fan_id, pair_type, drawn_index, drawn_epoch, b.price > a.price AS rising, CASE WHEN fr < 1 THEN fr END AS fraction,
                 o.epoch AS start_time, o.price AS start_price, t.epoch AS end_time,
                 CASE WHEN fr < 1 THEN o.price + tan(th * fr) * db ELSE t.price END AS end_price FROM gm)"""
)


@query(
    "g13_fans",
    with_sql(
        FANS_SQL,
        """SELECT symbol, fan_id, pair_type, drawn_epoch, rising, coalesce(fraction, 1.0) AS fraction, start_time, start_price, end_time,
       round(end_price, 6) AS end_price FROM lines""",
    ),
)
def g13_fans(spark, sf):
    _, out = tree(spark, sf)
    lines = H.fans(out).withColumn("fraction", F.coalesce("fraction", F.lit(1.0)))
    return rounded(
        lines.select(
            "symbol", "fan_id", "pair_type", "drawn_epoch", "rising", "fraction", "start_time", "start_price", "end_time", "end_price"
        ),
        "end_price",
    )


@query(
    "g14_fan_completion",
    with_sql(
        FANS_SQL
        + """, lv AS (SELECT l.symbol, l.fan_id, b.epoch, bool_and(CASE WHEN rising THEN b.close < lp ELSE b.close > lp END) AS crossed
  FROM (SELECT l.*, b.epoch, b.close, l.start_price + (b.epoch - l.start_time) / greatest(1, l.end_time - l.start_time)::DOUBLE * (l.end_price - l.start_price) AS lp
        FROM lines l JOIN bars b ON b.symbol = l.symbol AND b.epoch BETWEEN l.start_time AND l.end_time + 864000 AND b.epoch >= l.drawn_epoch
        WHERE l.fraction IS NOT NULL) l JOIN bars b ON b.symbol = l.symbol AND b.epoch = l.epoch GROUP BY 1, 2, 3),
dn AS (SELECT symbol, fan_id, min(epoch) FILTER (crossed) AS c, max(epoch) AS la FROM lv GROUP BY 1, 2)""",
        """SELECT f.symbol, f.fan_id, f.pair_type, f.drawn_epoch, CASE WHEN la IS NULL THEN f.drawn_epoch ELSE c END AS completed_epoch,
       CASE WHEN la IS NULL THEN 'inactive' WHEN c IS NOT NULL THEN 'covered' ELSE 'open' END AS status
FROM fn f LEFT JOIN dn ON dn.symbol = f.symbol AND dn.fan_id = f.fan_id""",
    ),
)
def g14_fan_completion(spark, sf):
    bars, out = tree(spark, sf)
    return H.fan_status(bars, settle(H.fans(out)), 10 * 86400)


@query(
    "u4_g15_fan_changes",
    with_sql(
        HIERARCHY_SQL
        + """, idl AS (SELECT symbol, epoch, bar_index, list_concat(CASE WHEN f0 IS NOT NULL THEN [concat_ws('_', f0.epoch, n0.epoch, 'outer')] ELSE [] END,
         list_transform(inner_l[1:3], lambda p : concat_ws('_', p.epoch, anchor.epoch, 'inner'))) AS ids,
         concat_ws('|', context, coalesce(f0.epoch, 0), coalesce(n0.epoch, 0), list_transform(inner_l, lambda p : p.epoch)) AS shape FROM tree),
pv2 AS (SELECT *, coalesce(lag(ids) OVER w, []) AS pids, lag(shape) OVER w AS pshape FROM idl WINDOW w AS (PARTITION BY symbol ORDER BY bar_index))""",
        """SELECT symbol, epoch, list_sort(list_filter(ids, lambda x : NOT list_contains(pids, x))) AS added,
       list_sort(list_filter(pids, lambda x : NOT list_contains(ids, x))) AS removed, shape IS DISTINCT FROM pshape AS changed FROM pv2""",
    ),
)
def u4_g15_fan_changes(spark, sf):
    _, out = tree(spark, sf)
    changes = H.fan_changes(settle(out))
    return changes.select("symbol", "epoch", F.array_sort("added").alias("added"), F.array_sort("removed").alias("removed"), "changed")


@query(
    "u5_pivot_markers",
    with_sql(
        HIERARCHY_SQL
        + """, mk AS (
  SELECT symbol, epoch, o_epoch AS time, 0 AS r, CASE WHEN context = 'bearish' THEN 'high' ELSE 'low' END AS type, o_price AS price FROM tree
  UNION ALL SELECT symbol, epoch, f0.epoch, 1, CASE WHEN context = 'bearish' THEN 'high' ELSE 'low' END, f0.price FROM tree WHERE f0 IS NOT NULL
  UNION ALL SELECT symbol, epoch, n0.epoch, 2, near, n0.price FROM tree WHERE n0 IS NOT NULL
  UNION ALL SELECT symbol, epoch, anchor.epoch, 3, near, anchor.price FROM tree WHERE anchor IS NOT NULL
  UNION ALL SELECT symbol, epoch, p.epoch, 4, CASE WHEN context = 'bearish' THEN 'high' ELSE 'low' END, p.price
            FROM (SELECT *, unnest(inner_l[1:3]) AS p FROM tree))""",
        """SELECT symbol, epoch, time, arg_min(type, r) AS type, arg_min(price, r) AS price, concat_ws('_', 'pm', time, arg_min(type, r)) AS id
FROM mk GROUP BY symbol, epoch, time""",
    ),
)
def u5_pivot_markers(spark, sf):
    _, out = tree(spark, sf)
    return H.pivot_markers(out).select("symbol", "epoch", "time", "type", "price", "id")


@query(
    "w17_time_squares",
    with_sql(
        FANS_SQL,
        "SELECT symbol, fan_id, k, end_time + k * (end_time - start_time) AS time FROM lines, range(1, 4) r(k) WHERE fraction IS NULL",
    ),
)
def w17_time_squares(spark, sf):
    _, out = tree(spark, sf)
    return H.time_squares(H.fans(out)).select("symbol", "fan_id", "k", "time")


@query(
    "j16_confluence",
    with_sql(
        FANS_SQL
        + """, lf AS (SELECT * FROM fn QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY drawn_index DESC, fan_id DESC) <= 5),
fl AS (SELECT l.symbol, l.fan_id, l.fraction, (end_price - start_price) / greatest(1, end_time - start_time) AS m, start_price, start_time
       FROM lines l JOIN lf ON lf.symbol = l.symbol AND lf.fan_id = l.fan_id WHERE fraction IS NOT NULL),
fm AS (SELECT *, start_price - m * start_time AS c FROM fl)""",
        """SELECT a.symbol, a.fan_id AS a_fan_id, b.fan_id AS b_fan_id, a.fraction AS a_fraction, b.fraction AS b_fraction
FROM fm a JOIN fm b ON a.symbol = b.symbol AND a.fan_id < b.fan_id AND a.m <> b.m""",
    ),
)
def j16_confluence(spark, sf):
    _, out = tree(spark, sf)
    met = H.confluence(settle(H.fans(out)))
    return met.select("symbol", "a_fan_id", "b_fan_id", "a_fraction", "b_fraction")


@query(
    "j16_zones",
    with_sql(
        FANS_SQL
        + """, lf AS (SELECT * FROM fn QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY drawn_index DESC, fan_id DESC) <= 5),
fl AS (SELECT l.symbol, l.fan_id, l.fraction, (end_price - start_price) / greatest(1, end_time - start_time) AS m, start_price AS p, start_time AS t
       FROM lines l JOIN lf ON lf.symbol = l.symbol AND lf.fan_id = l.fan_id WHERE fraction IS NOT NULL),
cr AS (SELECT a.symbol, a.fan_id AS a_fan_id, b.fan_id AS b_fan_id, a.fraction AS a_fraction, b.fraction AS b_fraction,
              (b.p - a.p + b.m * (a.t - b.t)) / (a.m - b.m) AS after, a.t + after AS time, a.p + a.m * after AS price
       FROM fl a JOIN fl b ON a.symbol = b.symbol AND a.fan_id < b.fan_id AND a.m <> b.m),
nc AS (SELECT * FROM cr WHERE time BETWEEN 1704067200 AND 1709251200),
st AS (SELECT *, sum(late) OVER (PARTITION BY symbol ORDER BY time, price, a_fan_id, b_fan_id, a_fraction, b_fraction) AS stretch
  FROM (SELECT *, CASE WHEN time - lag(time) OVER (PARTITION BY symbol ORDER BY time, price, a_fan_id, b_fan_id, a_fraction, b_fraction) <= 21600 THEN 0 ELSE 1 END AS late FROM nc)),
zn AS (SELECT *, sum(apart) OVER (PARTITION BY symbol ORDER BY stretch, price, time, a_fan_id, b_fan_id, a_fraction, b_fraction) AS zone
  FROM (SELECT *, CASE WHEN lag(stretch) OVER w = stretch AND price - lag(price) OVER w <= abs(lag(price) OVER w) * 5.0 / 100 THEN 0 ELSE 1 END AS apart FROM st
        WINDOW w AS (PARTITION BY symbol ORDER BY stretch, price, time, a_fan_id, b_fan_id, a_fraction, b_fraction))),
sg AS (SELECT symbol, zone, count(DISTINCT (a_fan_id, b_fan_id)) AS strength FROM zn GROUP BY 1, 2)""",
        """SELECT z.symbol, a_fan_id, b_fan_id, a_fraction, b_fraction, round(time, 1) AS time, round(price, 4) AS price, z.zone, strength, strength > 1 AS confluent
FROM zn z JOIN sg ON sg.symbol = z.symbol AND sg.zone = z.zone""",
    ),
)
def j16_zones(spark, sf):
    """Crossings from the first bar to a month after the last, in zones of 6 hours and 5 %."""
    _, out = tree(spark, sf)
    met = H.confluence(settle(H.fans(out))).where(F.col("time").between(1704067200, 1709251200))
    zones = H.confluence_zones(settle(met), 6 * 3600, 5.0)
    found = zones.select("symbol", "a_fan_id", "b_fan_id", "a_fraction", "b_fraction", "time", "price", "zone", "strength", "confluent")
    return rounded(rounded(found, "time", places=1), "price", places=4)


SETUP_SQL = (
    PAIRS_SQL
    + """, su AS (SELECT *, greatest(1, abs(second.bar_index - first.bar_index)) AS db,
       atan((second.price - first.price) / greatest(1, abs(second.bar_index - first.bar_index))) AS th FROM pairs),
sl AS (SELECT *, unnest([1.0, 0.875, 0.75, 0.5, 0.25]::DOUBLE[]) AS fr, unnest(['θ', '7/8θ', '3/4θ', '1/2θ', '1/4θ']) AS angle_name FROM su),
ln AS (SELECT symbol, pair_type, scenario, angle_name, fr, first.epoch AS start_time, first.price AS start_price, second.epoch AS end_time,
              CASE WHEN fr < 1 THEN first.price + tan(th * fr) * db ELSE second.price END AS end_price, abs(degrees(th)) AS deg FROM sl),
tg AS (SELECT symbol, pair_type, first.price + tan(th * 0.5) * db AS horizontal_target, first.price AS full_coverage_target, abs(degrees(th)) AS deg, second FROM su)"""
)


@query(
    "x15_angle_targets",
    with_sql(
        SETUP_SQL,
        "SELECT symbol, pair_type, round(deg, 6) AS angle_degrees, round(horizontal_target, 6) AS horizontal_target, full_coverage_target FROM tg",
    ),
)
def x15_angle_targets(spark, sf):
    out = studies.angle_setups(inputs.hourly_indexed(spark, sf))
    return rounded(
        out.select("symbol", "pair_type", "angle_degrees", "horizontal_target", "full_coverage_target"), "angle_degrees", "horizontal_target"
    )


@query(
    "x12_fan_geometry",
    with_sql(
        SETUP_SQL,
        """SELECT symbol, pair_type, angle_name, round(deg * fr, 6) AS line_degrees, start_time, start_price, end_time, round(end_price, 6) AS end_price FROM ln""",
    ),
)
def x12_fan_geometry(spark, sf):
    out = studies.angle_divisions(studies.angle_setups(inputs.hourly_indexed(spark, sf)))
    return rounded(
        out.select("symbol", "pair_type", "angle_name", "line_degrees", "start_time", "start_price", "end_time", "end_price"),
        "line_degrees", "end_price",
    )


@query(
    "x13_linear_fan",
    with_sql(
        PAIRS_SQL,
        """SELECT symbol, pair_type, fr AS fraction, first.epoch AS start_time, second.epoch + 180000 AS end_time,
       round(first.price + (second.price - first.price) / greatest(1, second.epoch - first.epoch) * fr * (greatest(1, second.epoch - first.epoch) + 180000), 6) AS end_price
FROM (SELECT *, unnest([1.0, 0.875, 0.75, 0.5, 0.25, 0.125]::DOUBLE[]) AS fr FROM pairs)""",
    ),
)
def x13_linear_fan(spark, sf):
    pairs = P.pivot_pairs(settle(P.symmetric_pivots(inputs.hourly_indexed(spark, sf), 10)))
    lines = pairs.select("symbol", "pair_type", F.inline(geo.linear_fan(F.col("first"), F.col("second"), 50 * 3600)))
    return rounded(lines.select("symbol", "pair_type", "fraction", "start_time", "end_time", "end_price"), "end_price")


ON_LINE_SQL = (
    SETUP_SQL
    + """, bl AS (SELECT b.symbol, b.epoch, b.close, l.pair_type, l.scenario, l.angle_name,
        l.start_price + (b.epoch - l.start_time) / greatest(1, l.end_time - l.start_time)::DOUBLE * (l.end_price - l.start_price) AS lp
   FROM bars b JOIN ln l ON l.symbol = b.symbol AND b.epoch >= l.start_time)"""
)


@query(
    "x14_j8_line_prices",
    with_sql(ON_LINE_SQL, "SELECT symbol, epoch, pair_type, angle_name, round(lp, 6) AS line_price FROM bl"),
)
def x14_j8_line_prices(spark, sf):
    bars = inputs.hourly_indexed(spark, sf)
    lines = studies.angle_divisions(studies.angle_setups(bars))
    last = bars.groupBy("symbol").agg(F.max("epoch").alias("_last"))
    out = H.join_active(bars, lines.join(last, "symbol"), F.col("_last"), 30 * 86400)
    return rounded(out.select("symbol", "epoch", "pair_type", "angle_name", "line_price"), "line_price")


EVENTS_SQL = (
    ON_LINE_SQL
    + ", "
    + STREAK_SQL.format(src="ib")
    + """, nr2 AS (SELECT bl.*, CASE WHEN bl.close > lp THEN up_streak ELSE down_streak END AS closes FROM bl JOIN st ON st.symbol = bl.symbol AND st.epoch = bl.epoch
        WHERE abs(bl.close - lp) <= abs(lp * 5.0 / 100)),
ev AS (
  SELECT symbol, epoch, 'angle_touch' AS event_type, pair_type, angle_name, close AS price, NULL AS direction FROM nr2
  UNION ALL
  SELECT symbol, epoch, 'angle_breach', pair_type, angle_name, close, CASE WHEN close > lp THEN 'up' ELSE 'down' END FROM nr2
  WHERE CASE WHEN scenario = 1 THEN close > lp ELSE close < lp END AND closes >= 2
  UNION ALL
  SELECT b.symbol, b.epoch, 'horizontal_touch', t.pair_type, NULL, b.close, NULL FROM bars b JOIN tg t ON t.symbol = b.symbol
  WHERE abs(b.close - horizontal_target) <= abs(horizontal_target * 5.0 / 100))"""
)


def events(spark, sf):
    bars = inputs.hourly_indexed(spark, sf)
    return studies.angle_events(bars, settle(studies.angle_setups(bars)), tolerance=5.0)


@query(
    "g16_angle_events",
    with_sql(EVENTS_SQL, "SELECT symbol, epoch, event_type, pair_type, angle_name, price, direction FROM ev"),
)
def g16_angle_events(spark, sf):
    return events(spark, sf).select("symbol", "epoch", "event_type", "pair_type", "angle_name", "price", "direction")


LOG_SQL = (
    EVENTS_SQL
    + ", "
    + MOMENTUM_SQL.format(src="ib")
    + """, cp AS (SELECT symbol, epoch, close, unnest(list_filter([
    CASE WHEN high - low > 0 AND abs(close - open) <= 0.1 * (high - low) THEN 'doji' END,
    CASE WHEN abs(close - open) > 0 AND least(open, close) - low >= 2.0 * abs(close - open) AND high - greatest(open, close) <= abs(close - open) THEN 'hammer' END,
    CASE WHEN abs(close - open) > 0 AND high - greatest(open, close) >= 2.0 * abs(close - open) THEN 'long_upper_wick' END,
    CASE WHEN abs(close - open) > 0 AND least(open, close) - low >= 2.0 * abs(close - open) THEN 'long_lower_wick' END,
    CASE WHEN lag(close) OVER w < lag(open) OVER w AND close > open AND open <= lag(close) OVER w AND close >= lag(open) OVER w THEN 'bullish_engulfing' END,
    CASE WHEN lag(close) OVER w > lag(open) OVER w AND close < open AND open >= lag(close) OVER w AND close <= lag(open) OVER w THEN 'bearish_engulfing' END,
    CASE WHEN bar_index >= 20 AND volume > 2.0 * avg(volume) OVER v THEN 'volume_spike' END,
    CASE WHEN close < lag(close, 5) OVER w AND rsi > lag(rsi, 5) OVER w THEN 'bullish_divergence' END,
    CASE WHEN close > lag(close, 5) OVER w AND rsi < lag(rsi, 5) OVER w THEN 'bearish_divergence' END], lambda x : x IS NOT NULL)) AS pattern
  FROM rs WINDOW w AS (PARTITION BY symbol ORDER BY epoch), v AS (PARTITION BY symbol ORDER BY epoch ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
mc AS (SELECT *, lag(overall_momentum) OVER (PARTITION BY symbol ORDER BY epoch) AS before FROM mo),
lg AS (
  SELECT symbol, epoch, event_type, pair_type, angle_name, price, direction, 'tolerance_percent=5.0' AS details FROM ev WHERE event_type = 'angle_touch'
  UNION ALL SELECT ev.symbol, ev.epoch, event_type, ev.pair_type, ev.angle_name, price, direction, 'close_count=' || closes FROM ev
    JOIN nr2 ON nr2.symbol = ev.symbol AND nr2.epoch = ev.epoch AND nr2.pair_type = ev.pair_type AND nr2.angle_name = ev.angle_name WHERE event_type = 'angle_breach'
  UNION ALL SELECT symbol, epoch, event_type, pair_type, angle_name, price, direction, '' FROM ev WHERE event_type = 'horizontal_touch'
  UNION ALL SELECT symbol, epoch, 'candle_pattern', NULL, NULL, close, NULL, 'pattern_name=' || pattern FROM cp
  UNION ALL SELECT symbol, epoch, 'momentum_change', NULL, NULL, close, NULL, 'after=' || overall_momentum || ',before=' || before FROM mc WHERE overall_momentum <> before
  UNION ALL SELECT symbol, epoch, 'pivot_formed', NULL, NULL, price, NULL, 'pivot_type=' || type FROM raw)"""
)


def logged(spark, sf):
    bars = inputs.hourly_indexed(spark, sf)
    return bars, studies.event_log(bars, settle(studies.angle_setups(bars)), tolerance=5.0)


def detail_text():
    return F.array_join(F.array_sort(F.transform(F.map_entries("details"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")


@query(
    "g16_event_log",
    with_sql(
        LOG_SQL,
        """SELECT lg.symbol, lg.epoch, event_type, pair_type, angle_name, price, direction, details, round(ema_9, 6) AS ema_9, round(rsi, 6) AS rsi, overall_momentum, confidence
FROM lg JOIN mo ON mo.symbol = lg.symbol AND mo.epoch = lg.epoch""",
    ),
)
def g16_event_log(spark, sf):
    """Every event with its details and the snapshot of its bar."""
    _, events = logged(spark, sf)
    out = events.withColumn("details", detail_text()).select(
        "symbol", "epoch", "event_type", "pair_type", "angle_name", "price", "direction", "details",
        "snapshot.ema_9", "snapshot.rsi", "snapshot.overall_momentum", "snapshot.confidence",
    )
    return rounded(out, "ema_9", "rsi")


@query(
    "s7_session_log",
    with_sql(
        LOG_SQL
        + """, ty AS (SELECT symbol, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS by_type, sum(n) AS event_count FROM (SELECT symbol, event_type, count(*) AS n FROM lg GROUP BY ALL) GROUP BY 1),
an AS (SELECT symbol, string_agg(angle_name || '=' || n, ',' ORDER BY angle_name) AS by_angle FROM (SELECT symbol, angle_name, count(*) AS n FROM lg WHERE angle_name IS NOT NULL GROUP BY ALL) GROUP BY 1),
dr AS (SELECT symbol, count(*) FILTER (direction = 'up') AS up, count(*) FILTER (direction = 'down') AS down, max(price) AS highest FROM lg GROUP BY 1),
sh AS (SELECT symbol, count(*) AS snapshots, count(rsi) AS with_rsi FROM mo GROUP BY 1)""",
        """SELECT ty.symbol, 'run 1' AS session_name, CAST(event_count AS BIGINT) AS event_count, by_type, coalesce(by_angle, '') AS by_angle, up, down, highest, snapshots, with_rsi
FROM ty JOIN dr USING (symbol) JOIN sh USING (symbol) LEFT JOIN an USING (symbol)""",
    ),
)
def s7_session_log(spark, sf):
    """A session written as JSON and read back: name, counts, statistics with zero counts, events and snapshots."""
    from tickloom.session import scratch_path
    from tickloom.sources.files import read_session, write_session

    bars, events = logged(spark, sf)
    events = settle(events)
    path = scratch_path(spark, "session")
    write_session(path, "run 1", events, studies.indicator_snapshots(bars), studies.session_statistics(events))
    counts = "map<string,bigint>"
    schema = f"symbol string, session_name string, event_count long, statistics struct<events_by_type:{counts},events_by_angle:{counts},breach_directions:{counts}>"
    head = read_session(spark, path, "session", schema)
    priced = read_session(spark, path, "events", "symbol string, price double").groupBy("symbol").agg(F.max("price").alias("highest"))
    shots = read_session(spark, path, "indicator_snapshots", "symbol string, rsi double").groupBy("symbol").agg(F.count(F.lit(1)).alias("snapshots"), F.count("rsi").alias("with_rsi"))
    text = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    out = head.join(priced, "symbol").join(shots, "symbol")
    return out.select(
        "symbol", "session_name", "event_count", text("statistics.events_by_type").alias("by_type"), text("statistics.events_by_angle").alias("by_angle"),
        F.col("statistics.breach_directions")["up"].alias("up"), F.col("statistics.breach_directions")["down"].alias("down"), "highest", "snapshots", "with_rsi",
    )


@query(
    "s7_csv_union",
    with_sql(
        LOG_SQL,
        """SELECT symbol, epoch, event_type, price, CASE WHEN starts_with(details, 'close_count=') THEN substr(details, 13) END AS detail_close_count,
  CASE WHEN starts_with(details, 'pattern_name=') THEN substr(details, 14) END AS detail_pattern_name, CASE WHEN starts_with(details, 'pivot_type=') THEN substr(details, 12) END AS detail_pivot_type,
  'after,before,close_count,pattern_name,pivot_type,tolerance_percent' AS columns FROM lg""",
    ),
)
def s7_csv_union(spark, sf):
    """The log as CSV with a column for every detail that occurs, read back."""
    from tickloom.session import scratch_path
    from tickloom.sources.files import write_events

    _, events = logged(spark, sf)
    path = scratch_path(spark, "log")
    write_events(settle(events.drop("snapshot")), path, "csv")
    back = spark.read.csv(path, header=True)
    names = ",".join(c.removeprefix("detail_") for c in back.columns if c.startswith("detail_"))
    return back.select(
        "symbol", F.col("epoch").cast("long").alias("epoch"), "event_type", F.col("price").cast("double").alias("price"),
        "detail_close_count", "detail_pattern_name", "detail_pivot_type", F.lit(names).alias("columns"),
    )


@query(
    "j9_line_touches",
    with_sql(EVENTS_SQL, "SELECT symbol, epoch, pair_type, angle_name FROM ev WHERE event_type = 'angle_touch'"),
)
def j9_line_touches(spark, sf):
    return events(spark, sf).where("event_type = 'angle_touch'").select("symbol", "epoch", "pair_type", "angle_name")


@query(
    "j10_target_touches",
    with_sql(EVENTS_SQL, "SELECT symbol, epoch, pair_type FROM ev WHERE event_type = 'horizontal_touch'"),
)
def j10_target_touches(spark, sf):
    return events(spark, sf).where("event_type = 'horizontal_touch'").select("symbol", "epoch", "pair_type")


@query(
    "a4_event_stats",
    with_sql(
        EVENTS_SQL,
        """SELECT symbol, 'total' AS dimension, 'all' AS key, count(*) AS n FROM ev GROUP BY 1
UNION ALL SELECT symbol, 'type', event_type, count(*) FROM ev GROUP BY 1, 3
UNION ALL SELECT symbol, 'angle', angle_name, count(*) FROM ev WHERE angle_name IS NOT NULL GROUP BY 1, 3
UNION ALL SELECT symbol, 'direction', direction, count(*) FROM ev WHERE event_type = 'angle_breach' GROUP BY 1, 3""",
    ),
)
def a4_event_stats(spark, sf):
    return studies.event_stats(events(spark, sf))


@query(
    "g17_study_batch",
    with_sql(
        EVENTS_SQL
        + """, ec AS (SELECT symbol, count(*) FILTER (event_type = 'angle_touch') AS angle_touch, count(*) FILTER (event_type = 'angle_breach') AS angle_breach,
   count(*) FILTER (event_type = 'horizontal_touch') AS horizontal_touch, count(*) AS total_events FROM ev GROUP BY symbol)""",
        """SELECT b.symbol, count(*) AS total_bars, (SELECT count(*) FROM pairs p WHERE p.symbol = b.symbol) AS setups,
       coalesce(any_value(angle_touch), 0) AS angle_touch, coalesce(any_value(angle_breach), 0) AS angle_breach,
       coalesce(any_value(horizontal_touch), 0) AS horizontal_touch, coalesce(any_value(total_events), 0) AS total_events
FROM bars b LEFT JOIN ec ON ec.symbol = b.symbol GROUP BY b.symbol""",
    ),
)
def g17_study_batch(spark, sf):
    return studies.study_batch(inputs.hourly_indexed(spark, sf), tolerance=5.0)


@query(
    "g18_study_geometry",
    with_sql(
        SETUP_SQL + ", lb AS (SELECT symbol, max(epoch) AS last FROM bars GROUP BY symbol)",
        """SELECT symbol, pair_type, 'pivot' AS kind, 'First' AS name, first.epoch AS time, round(first.price, 6) AS price, NULL::BIGINT AS end_time, NULL::DOUBLE AS end_price FROM pairs
UNION ALL SELECT symbol, pair_type, 'pivot', 'Second', second.epoch, round(second.price, 6), NULL, NULL FROM pairs
UNION ALL SELECT symbol, pair_type, 'angle_line', angle_name, start_time, round(start_price, 6), end_time, round(end_price, 6) FROM ln
UNION ALL SELECT t.symbol, pair_type, 'horizontal_target', 'target', second.epoch, round(horizontal_target, 6), last, round(horizontal_target, 6)
FROM tg t JOIN lb ON lb.symbol = t.symbol""",
    ),
)
def g18_study_geometry(spark, sf):
    bars = inputs.hourly_indexed(spark, sf)
    out = studies.study_geometry(bars, settle(studies.angle_setups(bars)))
    return rounded(out, "price", "end_price")


def angle_levels_sql(confirmations: int = 2, wicks: bool = False) -> str:
    """Bars with the lines around them, confirmed breaches and reversal signs, for a tolerance of 10 %."""
    n = confirmations
    touched = " OR low <= line AND line <= high" if wicks else ""
    return (
        SETUP_SQL
        + ", "
        + STREAK_SQL.format(src="ib")
        + f""", pt AS (SELECT s.symbol, s.bar_index, s.epoch, s.close, s.high, s.low, s.up_streak, s.down_streak,
  coalesce((high - low > 0 AND abs(close - open) <= 0.1 * (high - low))
    OR (abs(close - open) > 0 AND (high - greatest(open, close) >= 2.0 * abs(close - open) OR least(open, close) - low >= 2.0 * abs(close - open)))
    OR (lag(close) OVER w < lag(open) OVER w AND close > open AND open <= lag(close) OVER w AND close >= lag(open) OVER w)
    OR (lag(close) OVER w > lag(open) OVER w AND close < open AND open >= lag(close) OVER w AND close <= lag(open) OVER w), false) AS pattern
  FROM st s WINDOW w AS (PARTITION BY symbol ORDER BY epoch)),
rc AS (SELECT *, min(low) OVER two AS recent_low, max(high) OVER two AS recent_high, bool_or(pattern) OVER three AS shown FROM pt
  WINDOW two AS (PARTITION BY symbol ORDER BY epoch ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), three AS (PARTITION BY symbol ORDER BY epoch ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)),
onl AS (SELECT r.symbol, r.epoch, r.close, r.low, r.high, l.start_price + (l.end_price - l.start_price) * (r.epoch - l.start_time) / (l.end_time - l.start_time)::DOUBLE AS line
  FROM rc r JOIN ln l ON l.symbol = r.symbol AND r.epoch >= l.start_time),
lv AS (SELECT symbol, epoch, min(line) FILTER (line > close) AS next_up, max(line) FILTER (line < close) AS next_down,
  arg_min(line, close - line) FILTER (reached AND close > line) AS broke_up, arg_min(line, line - close) FILTER (reached AND close < line) AS broke_down, bool_or(reached) AS at_line
  FROM (SELECT *, (abs(close - line) <= abs(line * 10.0 / 100){touched}) AS reached FROM onl) GROUP BY symbol, epoch),
ls AS (SELECT r.*, next_up, next_down, CASE WHEN up_streak >= {n} THEN broke_up END AS bu, CASE WHEN down_streak >= {n} THEN broke_down END AS bd,
  CASE WHEN at_line AND shown AND up_streak >= {n} THEN 1 WHEN at_line AND shown AND down_streak >= {n} THEN -1 END AS turn
  FROM rc r LEFT JOIN lv ON lv.symbol = r.symbol AND lv.epoch = r.epoch)"""
    )


ANGLE_LEVELS_SQL = angle_levels_sql()


def angle_walk_sql(name: str, mode: str) -> str:
    """One bar of every symbol per round: what happens at it (``ev``), and the position afterwards."""
    halved = f"(ev = 'goal' AND '{mode}' = 'partial' AND part = 1.0)"
    left = f"(ev IN ('stop', 'turn') OR ev = 'goal' AND '{mode}' = 'fixed')"
    stop = f"CASE WHEN {halved} THEN paid ELSE stop END"
    broken = "CASE WHEN side > 0 THEN bu ELSE bd END"
    return f"""{name} AS (
  SELECT symbol, -1::BIGINT AS bar_index, NULL::BIGINT AS epoch, NULL::DOUBLE AS price, 0 AS side, NULL::DOUBLE AS paid, NULL::DOUBLE AS stop, NULL::DOUBLE AS goal, 0.0::DOUBLE AS part,
         NULL::VARCHAR AS action, NULL::DOUBLE AS weight, NULL::VARCHAR AS reason FROM (SELECT DISTINCT symbol FROM ls)
  UNION ALL
  SELECT symbol, bar_index, epoch, close, CASE WHEN ev = 'up' THEN 1 WHEN ev = 'down' THEN -1 WHEN {left} THEN 0 ELSE side END,
         CASE WHEN ev IN ('up', 'down') THEN close ELSE paid END,
         CASE WHEN ev = 'up' THEN recent_low WHEN ev = 'down' THEN recent_high
              WHEN '{mode}' <> 'fixed' AND {broken} IS NOT NULL AND side * {broken} > side * {stop} THEN {broken} ELSE {stop} END,
         CASE WHEN ev = 'up' OR ev = 'goal' AND side > 0 THEN next_up WHEN ev = 'down' OR ev = 'goal' THEN next_down ELSE goal END,
         CASE WHEN ev IN ('up', 'down') THEN 1.0 WHEN {halved} THEN 0.5 ELSE part END,
         CASE WHEN ev = 'up' THEN 'enter_long' WHEN ev = 'down' THEN 'enter_short' WHEN {left} OR {halved} THEN CASE WHEN side > 0 THEN 'exit_long' ELSE 'exit_short' END END,
         CASE WHEN ev IN ('up', 'down') THEN 1.0 WHEN {halved} THEN 0.5 WHEN {left} THEN part END,
         CASE WHEN ev IN ('up', 'down') THEN 'breach' WHEN ev = 'turn' THEN 'reversal' WHEN ev = 'goal' THEN 'target' ELSE ev END
  FROM (SELECT b.*, w.side, w.paid, w.stop, w.goal, w.part,
          CASE WHEN w.side = 0 AND bu IS NOT NULL THEN 'up' WHEN w.side = 0 AND bd IS NOT NULL THEN 'down' WHEN w.side = 0 THEN 'none'
               WHEN w.side * b.close <= w.side * w.stop THEN 'stop' WHEN b.turn <> w.side THEN 'turn' WHEN w.side * b.close >= w.side * w.goal THEN 'goal' ELSE 'hold' END AS ev
        FROM {name} w JOIN ls b ON b.symbol = w.symbol AND b.bar_index = w.bar_index + 1))"""


@query(
    "g20_angle_signals",
    with_sql(
        "RECURSIVE " + ANGLE_LEVELS_SQL + ", " + angle_walk_sql("wk", "partial"),
        "SELECT symbol, bar_index, epoch, action, round(price, 6) AS price, weight, reason FROM wk WHERE action IS NOT NULL",
    ),
)
def g20_angle_signals(spark, sf):
    from tickloom.plans.angles import AngleTrading, angle_signals

    bars = inputs.hourly_indexed(spark, sf)
    setups = settle(studies.angle_setups(bars))
    return rounded(angle_signals(bars, setups, AngleTrading(tolerance=10.0)), "price")


def angle_total_sql(name: str, mode: str) -> str:
    result = "CASE WHEN action = 'exit_long' THEN 1 ELSE -1 END * (price - paid) * weight"
    return f"""SELECT symbol, count(*) AS exits, count(*) FILTER ({result} > 0) AS wins, round(sum({result}), 6) AS total_pnl, '{mode}' AS param_id, '2' AS confirmations,
  '10.0' AS tolerance, '{mode}' AS exit_mode, 'False' AS use_wicks, 'True' AS reversals FROM {name} WHERE starts_with(action, 'exit') GROUP BY symbol"""


@query(
    "g20_angle_trades",
    with_sql(
        "RECURSIVE " + ANGLE_LEVELS_SQL + ", " + angle_walk_sql("wf", "fixed") + ", " + angle_walk_sql("wp", "partial"),
        angle_total_sql("wf", "fixed") + " UNION ALL " + angle_total_sql("wp", "partial"),
    ),
)
def g20_angle_trades(spark, sf):
    from tickloom.plans.angles import AngleTrading, angle_sweep

    bars = inputs.hourly_indexed(spark, sf)
    grid = {m: AngleTrading(tolerance=10.0, exit_mode=m) for m in ("fixed", "partial")}
    return rounded(angle_sweep(bars, settle(studies.angle_setups(bars)), grid), "total_pnl")


TIMEFRAMES = (3600, 7200, 14400)
ANGLE_GRID = [(n, wicks) for n in (1, 2, 3) for wicks in (False, True)]


def timeframe_sql(confirmations: int, wicks: bool) -> str:
    """Totals of one parameter set over the bars of all timeframes, each symbol and timeframe a series of its own."""
    one = HOURLY_SQL.split(", bars AS (")[1]
    assert HOURLY_SQL.endswith(one) and "3600" in one
    each = " UNION ALL ".join(
        "(" + one.removesuffix(")").replace("3600.0", f"{r}.0").replace("* 3600", f"* {r}").replace("SELECT symbol,", f"SELECT symbol || '@{r}' AS symbol,").replace("GROUP BY 1, 2", f"GROUP BY ticks.symbol, 2") + ")"
        for r in TIMEFRAMES
    )
    parts = (angle_levels_sql(confirmations, wicks) + ", " + angle_walk_sql("wk", "partial")).replace(one, each + ")")
    result = "CASE WHEN action = 'exit_long' THEN 1 ELSE -1 END * (price - paid) * weight"
    return f"""(WITH RECURSIVE {parts} SELECT split_part(symbol, '@', 1) AS symbol, CAST(split_part(symbol, '@', 2) AS INTEGER) AS seconds, '{confirmations}_{wicks}' AS param_id,
  count(*) AS exits, count(*) FILTER ({result} > 0) AS wins, round(sum({result}), 6) AS total_pnl FROM wk WHERE starts_with(action, 'exit') GROUP BY ALL)"""


@query("g21_timeframe_sweep", " UNION ALL ".join(timeframe_sql(*p) for p in ANGLE_GRID))
def g21_timeframe_sweep(spark, sf):
    """Three timeframes, one to three confirming closes, and breaches by close or by wick, from one pass over the ticks."""
    from tickloom.plans.angles import AngleTrading
    from tickloom.plans.sweep import timeframe_sweep

    grid = {f"{n}_{wicks}": AngleTrading(confirmations=n, tolerance=10.0, use_wicks=wicks) for n, wicks in ANGLE_GRID}
    out = timeframe_sweep(inputs.ticks(spark, sf), TIMEFRAMES, grid, order=("ts",))
    return rounded(out.select("symbol", "seconds", "param_id", "exits", "wins", "total_pnl"), "total_pnl")


@query(
    "t5_first_inner_pairs",
    with_sql(
        HIERARCHY_SQL,
        """SELECT symbol, epoch, list_transform(inner_l[1:3], lambda p : p.epoch) AS inner_from,
       CASE WHEN f0 IS NOT NULL THEN 1 ELSE 0 END + least(len(inner_l), 3) AS pairs FROM tree""",
    ),
)
def t5_first_inner_pairs(spark, sf):
    _, out = tree(spark, sf)
    inner = F.filter("pairs", lambda p: p["pair_type"] == "inner")
    return H.drawn_pairs(out, 3).select(
        "symbol", "epoch", F.transform(inner, lambda p: p["from"]["epoch"]).alias("inner_from"), F.size("pairs").alias("pairs")
    )


@query(
    "v2_study_registry",
    with_sql(HIERARCHY_SQL, "SELECT symbol, context, count(*) AS bars, count(f0) AS with_outer FROM tree GROUP BY 1, 2"),
)
def v2_study_registry(spark, sf):
    from tickloom.plans.registry import run_study

    out = run_study("angular_coverage", inputs.hourly_indexed(spark, sf))
    return out.groupBy("symbol", "context").agg(F.count(F.lit(1)).alias("bars"), F.count("outer_from").alias("with_outer"))


@query(
    "v4_pivot_inputs",
    with_sql(raw_sql(3, 7), "SELECT symbol, bar_index, type, price, -7 AS plot_offset FROM raw"),
)
def v4_pivot_inputs(spark, sf):
    found = P.raw_pivots(inputs.hourly_indexed(spark, sf), 3, 7)
    return found.select("symbol", "bar_index", "type", "price", (F.col("bar_index") - F.col("visible_index")).alias("plot_offset"))
