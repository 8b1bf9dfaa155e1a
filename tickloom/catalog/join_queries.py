"""As-of and nearest joins, contracts, option enrichment, unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog import inputs
from tickloom.catalog.inputs import DAY, HOURLY_SQL, INDEXED_SQL, rounded, table
from tickloom.catalog.registry import query, with_sql
from tickloom.catalog.strategy_queries import BREAKOUT_SQL, LEDGER_SQL, breakout, breakout_ledger
from tickloom.functions.dates import expiry_text, next_thursday
from tickloom.functions.labels import entry_label
from tickloom.operators import asof, bars as B, contracts as C, ledger as L
from tickloom.session import settle


def nation_bars(spark, sf):
    """Daily unit-price bars per supplier nation."""
    nation = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"), "s_nationkey")
    ticks = inputs.sales_ticks(spark, sf).join(nation, "symbol")
    return B.resample(ticks.withColumn("symbol", F.col("s_nationkey").cast("string")), DAY, inputs.SALES_ORDER)


def order_trades(spark, sf):
    """Orders as trades of the customer's nation, at a time inside their day."""
    nation = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("string").alias("symbol"))
    day = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return (
        table(spark, sf, "orders")
        .join(nation, "o_custkey")
        .select(
            "symbol",
            "o_orderkey",
            (day + F.col("o_orderkey") % 86400).alias("epoch"),
            F.when(F.col("o_orderkey") % 2 == 0, "buy").otherwise("sell").alias("type"),
            F.col("o_totalprice").alias("price"),
            F.col("o_orderstatus").alias("status"),
        )
    )


NATION_SQL = """sales AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS symbol, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS epoch, l_extendedprice / l_quantity AS price,
         l_quantity AS volume, l_orderkey AS orderkey, l_linenumber AS linenumber FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
bars AS (
  SELECT symbol, CAST(floor(epoch / 86400.0) * 86400 AS BIGINT) AS epoch, arg_min(price, (epoch, orderkey, linenumber, price, volume)) AS open,
         max(price) AS high, min(price) AS low, arg_max(price, (epoch, orderkey, linenumber, price, volume)) AS close, sum(volume) AS volume
  FROM sales GROUP BY 1, 2),
tr AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS symbol, o_orderkey, CAST(floor(epoch(o_orderdate)) AS BIGINT) + o_orderkey % 86400 AS epoch,
         CASE WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS type, o_totalprice AS price, o_orderstatus AS status
  FROM orders JOIN customer ON c_custkey = o_custkey)"""

NEAR_SQL = (
    NATION_SQL
    + """, pv AS (SELECT t.*, b.epoch AS pe, b.close AS pc, b.high AS ph, b.low AS pl FROM tr t ASOF LEFT JOIN bars b ON b.symbol = t.symbol AND t.epoch >= b.epoch),
nx AS (SELECT t.*, b.epoch AS ne, b.close AS nc, b.high AS nh, b.low AS nl FROM pv t ASOF LEFT JOIN bars b ON b.symbol = t.symbol AND t.epoch <= b.epoch),
nb AS (SELECT *, pe IS NOT NULL AND (ne IS NULL OR epoch - pe <= ne - epoch) AS back FROM nx),
nr AS (SELECT symbol, o_orderkey, epoch, type, price, status, CASE WHEN back THEN pe ELSE ne END AS near_epoch, CASE WHEN back THEN pc ELSE nc END AS near_close,
              CASE WHEN back THEN ph ELSE nh END AS near_high, CASE WHEN back THEN pl ELSE nl END AS near_low,
              CASE WHEN back THEN epoch - pe ELSE ne - epoch END AS gap FROM nb)"""
)


@query(
    "j1_nearest_price_source",
    with_sql(
        NEAR_SQL,
        """SELECT o_orderkey, symbol, epoch, near_epoch, near_close, gap,
  CASE WHEN gap IS NULL THEN 'failed' WHEN gap = 0 THEN 'exact' WHEN gap <= 3600 THEN 'nearest_bar' ELSE 'day_close' END AS price_source FROM nr""",
    ),
)
def j1_nearest_price_source(spark, sf):
    out = asof.nearest(order_trades(spark, sf), nation_bars(spark, sf), ["symbol"], ["close"])
    return out.select(
        "o_orderkey", "symbol", "epoch", "near_epoch", "near_close", "gap", asof.price_source(F.col("gap")).alias("price_source")
    )


@query(
    "j2_nearest_within",
    with_sql(
        NEAR_SQL,
        "SELECT o_orderkey, CASE WHEN gap <= 7200 THEN near_close END AS near_close, CASE WHEN gap <= 7200 THEN gap END AS gap FROM nr",
    ),
)
def j2_nearest_within(spark, sf):
    out = asof.nearest(order_trades(spark, sf), nation_bars(spark, sf), ["symbol"], ["close"], limit=7200)
    return out.select("o_orderkey", "near_close", "gap")


@query("j3_nearest_any", with_sql(NEAR_SQL, "SELECT o_orderkey, near_epoch, near_close FROM nr"))
def j3_nearest_any(spark, sf):
    out = asof.nearest(order_trades(spark, sf), nation_bars(spark, sf), ["symbol"], ["close"])
    return out.select("o_orderkey", "near_epoch", "near_close")


@query(
    "j4_exact_price",
    with_sql(
        NATION_SQL,
        "SELECT t.o_orderkey, t.symbol, b.close FROM tr t LEFT JOIN bars b ON b.symbol = t.symbol AND b.epoch = t.epoch // 86400 * 86400",
    ),
)
def j4_exact_price(spark, sf):
    trades = order_trades(spark, sf).withColumn("epoch", (F.floor(F.col("epoch") / DAY) * DAY).cast("long"))
    return asof.exact(trades, nation_bars(spark, sf), ["symbol"], ["close"]).select("o_orderkey", "symbol", "close")


@query(
    "j7_snap_trades",
    with_sql(
        NEAR_SQL,
        """SELECT o_orderkey, coalesce(near_epoch, epoch) AS snap_epoch, CASE WHEN gap < 60 THEN near_high ELSE price END AS candle_high,
       CASE WHEN gap < 60 THEN near_low ELSE price END AS candle_low FROM nr""",
    ),
)
def j7_snap_trades(spark, sf):
    out = asof.snap_trades(order_trades(spark, sf), nation_bars(spark, sf))
    return out.select("o_orderkey", "snap_epoch", "candle_high", "candle_low")


@query(
    "w13_marker_rank",
    with_sql(
        NEAR_SQL
        + """, mr AS (SELECT *, epoch // 300 * 300 AS bucket, row_number() OVER (PARTITION BY symbol, epoch // 300, type ORDER BY epoch, price) - 1 AS marker_rank,
           CASE WHEN gap < 60 THEN near_high ELSE price END AS ch, CASE WHEN gap < 60 THEN near_low ELSE price END AS cl FROM nr)""",
        """SELECT o_orderkey, bucket, marker_rank, round(CASE WHEN type = 'buy' THEN cl - (price * 0.0015 + price * 0.001 * marker_rank)
       ELSE ch + (price * 0.0015 + price * 0.001 * marker_rank) END, 8) AS marker_price FROM mr""",
    ),
)
def w13_marker_rank(spark, sf):
    out = L.marker_offsets(asof.snap_trades(order_trades(spark, sf), nation_bars(spark, sf)))
    return rounded(out.select("o_orderkey", "bucket", "marker_rank", "marker_price"), "marker_price", places=8)


@query(
    "j17_higher_timeframe",
    with_sql(
        HOURLY_SQL
        + """, hi AS (SELECT symbol, epoch // 86400 * 86400 AS epoch, arg_min(open, epoch) AS open, max(high) AS high, min(low) AS low,
            arg_max(close, epoch) AS close FROM bars GROUP BY 1, 2)""",
        """SELECT b.symbol, b.epoch, h.epoch AS asof_epoch, h.high AS asof_high, h.low AS asof_low
FROM bars b ASOF LEFT JOIN hi h ON h.symbol = b.symbol AND b.epoch >= h.epoch""",
    ),
)
def j17_higher_timeframe(spark, sf):
    bars = settle(inputs.hourly(spark, sf))
    out = asof.map_timeframe(bars, B.rebar(bars, DAY), ["high", "low"])
    return out.select("symbol", "epoch", "asof_epoch", "asof_high", "asof_low")


@query(
    "j18_due_unseen_trades",
    with_sql(
        NATION_SQL,
        "SELECT symbol, epoch, type, price FROM tr WHERE epoch <= 915148800 EXCEPT ALL SELECT symbol, epoch, type, price FROM tr WHERE status = 'F'",
    ),
)
def j18_due_unseen_trades(spark, sf):
    trades = order_trades(spark, sf)
    due = asof.unseen(trades, trades.where("status = 'F'"), F.lit(915148800))
    return due.select("symbol", "epoch", "type", "price")


def part_instruments(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_name").alias("trading_symbol"),
        F.upper("p_name").alias("search_symbol"),
        F.col("p_partkey").cast("string").alias("security_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).alias("expiry"),
        F.col("p_partkey").alias("position"),
        F.when(F.col("p_type") == "ECONOMY", "EQUITY").otherwise("INDEX").alias("instrument_name"),
        F.col("p_name").alias("name"),
        F.concat_ws(" ", "p_brand", "p_type").alias("description"),
        F.col("p_brand").alias("exchange"),
        F.lower("p_type").alias("type"),
    )


INSTRUMENTS_SQL = """ins AS (
  SELECT p_name AS trading_symbol, upper(p_name) AS search_symbol, CAST(p_partkey AS VARCHAR) AS security_id, DATE '2024-01-01' + p_size AS expiry,
         p_partkey AS position, CASE WHEN p_type = 'ECONOMY' THEN 'EQUITY' ELSE 'INDEX' END AS instrument_name, p_name AS name,
         concat_ws(' ', p_brand, p_type) AS description, p_brand AS exchange, lower(p_type) AS type FROM part)"""


@query(
    "j5_contract_resolution",
    with_sql(
        INSTRUMENTS_SQL
        + """, rq AS (SELECT DISTINCT p_name AS contract_key FROM part UNION SELECT DISTINCT string_split(p_name, ' ')[2] FROM part
   UNION SELECT DISTINCT p_brand FROM part),
ex AS (SELECT trading_symbol AS k, arg_max(security_id, (expiry, -position)) AS id FROM ins GROUP BY 1),
pt AS (SELECT contract_key AS k, arg_min(security_id, position) AS id, arg_min(trading_symbol, position) AS ts
       FROM rq JOIN ins ON contains(trading_symbol, contract_key) WHERE contract_key NOT IN (SELECT k FROM ex) GROUP BY 1)""",
        """SELECT contract_key, coalesce(ex.id, pt.id) AS security_id, coalesce(ex.k, pt.ts) AS trading_symbol,
       CASE WHEN ex.k IS NOT NULL THEN 'exact' WHEN pt.k IS NOT NULL THEN 'partial' END AS match
FROM rq LEFT JOIN ex ON ex.k = contract_key LEFT JOIN pt ON pt.k = contract_key""",
    ),
)
def j5_contract_resolution(spark, sf):
    part = table(spark, sf, "part")
    keys = part.select(F.explode(F.array("p_name", F.get(F.split("p_name", " "), F.lit(1)), "p_brand")).alias("contract_key"))
    return C.resolve(keys.distinct(), part_instruments(spark, sf))


def option_signals(signals):
    """Channel signals with contract labels: the buy names a call, the sell is its exit."""
    strike = (F.bround("close") * 1).cast("long").cast("string")
    bought = entry_label(strike, F.lit("CE"), expiry_text(next_thursday(F.col("epoch"))), F.lit("0"))
    return signals.withColumn("signal_label", F.when(F.col("signal") == 1, bought).otherwise("Exit Long"))


def option_instruments(bars):
    """A monthly-named contract per symbol, Thursday and whole strike seen; two Thursdays share a name."""
    rows = bars.select(
        "symbol", F.bround("close").cast("long").alias("strike"), next_thursday(F.col("epoch")).alias("expiry")
    ).distinct()
    key = C.monthly_key(F.col("symbol"), F.col("expiry"), F.col("strike"), F.lit("CE"))
    return rows.select(
        key.alias("trading_symbol"),
        F.concat_ws("|", "symbol", "strike", "expiry").alias("security_id"),
        "expiry",
        F.col("strike").alias("position"),
        "symbol",
        "strike",
    )


def option_bars(bars, instruments):
    """Premium bars: the underlying's bars on even hours plus a strike-dependent offset."""
    even = bars.where((F.floor(F.col("epoch") / 3600) % 2) == 0)
    return even.join(instruments.select("symbol", "strike", "security_id"), "symbol").select(
        "security_id", "epoch", (F.col("close") + F.col("strike") + 1.0).alias("close")
    )


OPTIONS_SQL = (
    BREAKOUT_SQL
    + """, thu AS (SELECT *, CAST(make_timestamp(epoch * 1000000) AS DATE) AS d, epoch % 86400 // 60 AS mi FROM ib),
th AS (SELECT *, d + CAST((4 - isodow(d) + 7) % 7 + CASE WHEN isodow(d) = 4 AND mi >= 930 THEN 7 ELSE 0 END AS INTEGER) AS expiry FROM thu),
oi AS (SELECT DISTINCT symbol, CAST(round_even(close, 0) AS BIGINT) AS strike, expiry FROM th),
oin AS (SELECT *, concat_ws('-', symbol, strftime(expiry, '%b%Y'), strike, 'CE') AS k, concat_ws('|', symbol, strike, strftime(expiry, '%Y-%m-%d')) AS id FROM oi),
bestk AS (SELECT k, arg_max(id, expiry) AS id FROM oin GROUP BY k),
os AS (SELECT s.*, CASE WHEN s.signal = 1 THEN concat_ws('-', s.symbol, strftime(t.expiry, '%b%Y'), CAST(round_even(s.close, 0) AS BIGINT), 'CE') END AS k
       FROM sig s JOIN th t ON t.symbol = s.symbol AND t.epoch = s.epoch),
orr AS (SELECT os.*, bestk.id FROM os LEFT JOIN bestk ON bestk.k = os.k),
oc AS (SELECT *, CASE WHEN signal = 1 THEN id ELSE lag(id) OVER (PARTITION BY symbol ORDER BY epoch) END AS active FROM orr),
ob AS (SELECT oin.id AS sid, b.epoch, b.close + oin.strike + 1.0 AS close FROM bars b JOIN oin ON oin.symbol = b.symbol
       WHERE b.epoch // 3600 % 2 = 0 AND oin.id IN (SELECT active FROM oc)),
op AS (SELECT o.*, b.epoch AS pe, b.close AS pc FROM oc o ASOF LEFT JOIN ob b ON b.sid = o.active AND o.epoch >= b.epoch),
onx AS (SELECT o.*, b.epoch AS ne, b.close AS nc FROM op o ASOF LEFT JOIN ob b ON b.sid = o.active AND o.epoch <= b.epoch),
en AS (SELECT symbol, epoch, signal, bar_index, active, CASE WHEN pe IS NOT NULL AND (ne IS NULL OR epoch - pe <= ne - epoch) THEN pc ELSE nc END AS premium,
              CASE WHEN pe IS NOT NULL AND (ne IS NULL OR epoch - pe <= ne - epoch) THEN epoch - pe ELSE ne - epoch END AS gap, close FROM onx),
enr AS (SELECT symbol, epoch, signal, bar_index, active AS security_id, CASE WHEN premium > 0 THEN premium ELSE close END AS signal_price,
               CASE WHEN active IS NULL THEN NULL WHEN gap IS NULL THEN 'failed' WHEN gap = 0 THEN 'exact' WHEN gap <= 3600 THEN 'nearest_bar' ELSE 'day_close' END AS price_source FROM en)"""
)


def enriched(spark, sf):
    bars = inputs.hourly_indexed(spark, sf)
    signals = settle(option_signals(breakout(spark, sf)))
    instruments = settle(option_instruments(bars))
    # bars are made for the contracts that signals name, not for every one of the symbol
    named = C.label_contracts(signals).select(F.col("contract_key").alias("trading_symbol")).distinct()
    used = instruments.join(named, "trading_symbol", "left_semi")
    return C.enrich_signals(signals, instruments, option_bars(bars, used))


@query("g8_option_enrichment", with_sql(OPTIONS_SQL, "SELECT symbol, epoch, signal, security_id, signal_price, price_source FROM enr"))
def g8_option_enrichment(spark, sf):
    return enriched(spark, sf).select("symbol", "epoch", "signal", "security_id", "signal_price", "price_source")


@query(
    "j6_contract_carry",
    with_sql(OPTIONS_SQL, "SELECT symbol, epoch, signal, active AS active_contract FROM oc"),
)
def j6_contract_carry(spark, sf):
    signals = settle(option_signals(breakout(spark, sf)))
    instruments = settle(option_instruments(inputs.hourly_indexed(spark, sf)))
    found = C.resolve(C.label_contracts(signals), instruments).drop("trading_symbol", "match")
    return C.carry_contracts(found).select("symbol", "epoch", "signal", "active_contract")


@query(
    "g9_replay_pnl",
    with_sql(
        OPTIONS_SQL
        + """, rp AS (SELECT enr.*, th.expiry, th.close, lag(signal_price) OVER (PARTITION BY enr.symbol ORDER BY enr.epoch) AS ep
  FROM enr JOIN th ON th.symbol = enr.symbol AND th.epoch = enr.epoch)""",
        """SELECT symbol, epoch, signal_price, round(CASE WHEN signal = -1 THEN signal_price - ep END, 6) AS pnl,
  CASE WHEN signal = 1 THEN 'Buy ' || CAST(round_even(close, 0) AS BIGINT) || ' CE (' || strftime(expiry, '%d-%b') || ') | SL:0'
       WHEN ep IS NULL THEN 'Exit Long' ELSE 'Exit Long (PnL: ' || printf('%+.2f', signal_price - ep) || ')' END AS label FROM rp""",
    ),
)
def g9_replay_pnl(spark, sf):
    out = C.replay_trades(settle(enriched(spark, sf)))
    return rounded(out.select("symbol", "epoch", "signal_price", "pnl", "label"), "pnl")


@query(
    "a12_enrichment_stats",
    with_sql(
        OPTIONS_SQL,
        """SELECT coalesce(price_source, 'unpriced') AS price_source, count(*) AS signals, count(DISTINCT security_id) AS contracts FROM enr GROUP BY 1""",
    ),
)
def a12_enrichment_stats(spark, sf):
    return C.enrichment_stats(enriched(spark, sf))


@query(
    "f16_unpriced_signals",
    with_sql(
        BREAKOUT_SQL + ", up AS (SELECT *, CASE WHEN close >= 20 THEN signal_price END AS sp FROM sig)",
        """SELECT count(*) FILTER (sp IS NULL OR sp <= 0) AS missing, arg_min(signal_label, (epoch, symbol)) FILTER (sp IS NULL OR sp <= 0) AS example FROM up""",
    ),
)
def f16_unpriced_signals(spark, sf):
    signals = breakout(spark, sf).withColumn("signal_price", F.when(F.col("close") >= 20, F.col("signal_price")))
    return C.unpriced(signals)


@query("f16_assert_priced", with_sql(BREAKOUT_SQL, "SELECT symbol, epoch, signal, signal_price FROM sig WHERE signal_price > 0"))
def f16_assert_priced(spark, sf):
    """Signals that all have a price pass the assertion unchanged."""
    priced = breakout(spark, sf).where("signal_price > 0")
    return C.assert_priced(priced).select("symbol", "epoch", "signal", "signal_price")


@query(
    "f15_effective_price",
    with_sql(
        BREAKOUT_SQL,
        "SELECT symbol, epoch, CASE WHEN signal_price - 20 > 0 THEN signal_price - 20 ELSE close END AS price FROM sig",
    ),
)
def f15_effective_price(spark, sf):
    from tickloom.functions.labels import effective_price

    out = breakout(spark, sf)
    return out.select("symbol", "epoch", effective_price(F.col("signal_price") - 20, F.col("close")).alias("price"))


CHAIN_SQL = """ch AS (
  SELECT p_brand AS underlying, DATE '2024-01-04' + CAST(p_size // 10 * 7 AS INTEGER) AS expiry, CAST(round_even(p_retailprice / 10, 0) * 10 AS DOUBLE) AS strike,
         max(p_retailprice) AS last_price, count(*) AS oi FROM part GROUP BY 1, 2, 3),
sg AS (SELECT o_orderkey, 'Brand#' || CAST(o_orderkey % 25 + 1 AS VARCHAR) AS underlying, o_totalprice / 100 AS price,
              CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS signal FROM orders),
fe AS (SELECT underlying, min(expiry) AS expiry FROM ch GROUP BY 1),
fc AS (SELECT ch.* FROM ch JOIN fe USING (underlying, expiry)),
n1 AS (SELECT s.*, c.strike AS ps FROM sg s ASOF LEFT JOIN fc c ON c.underlying = s.underlying AND s.price >= c.strike),
n2 AS (SELECT s.*, c.strike AS ns FROM n1 s ASOF LEFT JOIN fc c ON c.underlying = s.underlying AND s.price <= c.strike),
pick AS (SELECT o_orderkey, underlying, price, signal, CASE WHEN ps IS NOT NULL AND (ns IS NULL OR price - ps <= ns - price) THEN ps ELSE ns END AS strike FROM n2)"""


def part_chain(spark, sf):
    """Parts as an option chain: both sides of every brand, weekly expiry and price step."""
    expiry = F.date_add(F.lit("2024-01-04").cast("date"), (F.floor(F.col("p_size") / 10) * 7).cast("int"))
    sides = F.array(F.lit("CE"), F.lit("PE"))
    return (
        table(spark, sf, "part")
        .groupBy(
            F.col("p_brand").alias("underlying"), expiry.alias("expiry"), (F.bround(F.col("p_retailprice") / 10) * 10).alias("strike")
        )
        .agg(F.max("p_retailprice").alias("last_price"), F.count(F.lit(1)).alias("oi"))
        .withColumn("option_type", F.explode(sides))
    )


def chain_signals(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(F.lit("Brand#"), (F.col("o_orderkey") % 25 + 1).cast("string")).alias("underlying"),
        (F.col("o_totalprice") / 100).alias("price"),
        F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1).alias("signal"),
    )


@query("j14_atm_strike", with_sql(CHAIN_SQL, "SELECT o_orderkey, underlying, strike FROM pick WHERE strike IS NOT NULL"))
def j14_atm_strike(spark, sf):
    return C.select_options(chain_signals(spark, sf), settle(part_chain(spark, sf))).select("o_orderkey", "underlying", "strike")


@query(
    "g19_option_selection",
    with_sql(
        CHAIN_SQL,
        """SELECT o_orderkey, p.underlying, CASE WHEN signal > 0 THEN 'CE' ELSE 'PE' END AS option_type, p.strike, strftime(c.expiry, '%Y-%m-%d') AS expiry,
       c.last_price, c.oi, 1 AS lot_size FROM pick p JOIN fc c ON c.underlying = p.underlying AND c.strike = p.strike""",
    ),
)
def g19_option_selection(spark, sf):
    out = C.select_options(chain_signals(spark, sf), settle(part_chain(spark, sf)))
    return out.select(
        "o_orderkey", "underlying", "option_type", "strike", F.col("expiry").cast("string").alias("expiry"), "last_price", "oi", "lot_size"
    )


@query(
    "t4_nearest_expiry",
    with_sql(CHAIN_SQL, "SELECT underlying, strftime(expiry, '%Y-%m-%d') AS expiry FROM fe"),
)
def t4_nearest_expiry(spark, sf):
    return part_chain(spark, sf).groupBy("underlying").agg(F.min("expiry").cast("string").alias("expiry"))


@query(
    "j15_lookup_maps",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 13 WHEN '2-HIGH' THEN 25 ELSE 1 END AS lot FROM orders""",
)
def j15_lookup_maps(spark, sf):
    lots = {"1-URGENT": C.UNDERLYING_IDS["NIFTY"], "2-HIGH": C.UNDERLYING_IDS["BANKNIFTY"]}
    return table(spark, sf, "orders").select("o_orderkey", C.lookup(lots, F.col("o_orderpriority"), 1).alias("lot"))


@query(
    "u1_union_chunks",
    with_sql(
        inputs.SALES_SQL,
        """SELECT symbol, epoch, arg_min(price, (orderkey, linenumber, price)) AS price FROM (
  SELECT * FROM sales WHERE epoch < 946684800 UNION ALL SELECT * FROM sales WHERE epoch >= 930000000) GROUP BY 1, 2""",
    ),
)
def u1_union_chunks(spark, sf):
    ticks = inputs.sales_ticks(spark, sf).select("symbol", "epoch", "price", "orderkey", "linenumber")
    both = ticks.where("epoch < 946684800").unionByName(ticks.where("epoch >= 930000000"))
    return B.dedupe_bars(both, ("orderkey", "linenumber", "price")).select("symbol", "epoch", "price")


@query(
    "u2_merge_pages",
    with_sql(HOURLY_SQL, "SELECT symbol, epoch, close FROM bars"),
)
def u2_merge_pages(spark, sf):
    bars = inputs.hourly(spark, sf)
    return B.merge_pages(bars.where("epoch <= 1705276800"), bars.where("epoch >= 1705276800")).select("symbol", "epoch", "close")


@query(
    "u3_favourites_and_hits",
    with_sql(
        INSTRUMENTS_SQL,
        """SELECT 'NIFTY OPTIONS' AS symbol, 'Nifty Options ATM Premium' AS description, 'options' AS type
UNION ALL SELECT search_symbol, description, CASE WHEN instrument_name = 'EQUITY' THEN 'stock' ELSE 'index' END FROM (
  SELECT * FROM ins WHERE contains(search_symbol, 'OPT') ORDER BY position LIMIT 20)""",
    ),
)
def u3_favourites_and_hits(spark, sf):
    from tickloom.operators.search import search_with_favourites

    return search_with_favourites(part_instruments(spark, sf), "opt")


def search_asks(spark, sf):
    """A table of search requests: every run of 2 to 6 characters of the part names, and pairs of word beginnings, per kind."""
    names = table(spark, sf, "part").select("p_name").distinct()
    runs = names.select(F.explode(F.expr("flatten(transform(sequence(2, 6), n -> transform(sequence(1, length(p_name) - n + 1), i -> substr(p_name, i, n))))")).alias("query"))
    pairs = names.select(F.expr("concat(substr(split(p_name, ' ')[1], 1, 2), ' ', substr(p_name, 1, 2))").alias("query"))
    both = runs.select("query", F.lit(False).alias("all_words")).union(pairs.select("query", F.lit(True)))
    asks = both.distinct().withColumn("kind", F.explode(F.array(F.lit("all"), F.lit("index"))))
    return asks.withColumn("request_id", F.concat_ws("|", "query", "kind", "all_words"))


ASKS_SQL = (
    INSTRUMENTS_SQL
    + """, nm AS (SELECT DISTINCT p_name FROM part),
bt AS (SELECT substr(p_name, i, n) AS query, false AS all_words FROM nm, range(2, 7) a(n), range(1, 40) b(i) WHERE i + n - 1 <= length(p_name)
  UNION SELECT substr(string_split(p_name, ' ')[2], 1, 2) || ' ' || substr(p_name, 1, 2), true FROM nm),
asks AS (SELECT concat_ws('|', query, kind, all_words) AS request_id, query, kind, CASE WHEN all_words THEN list_filter(string_split(upper(query), ' '), lambda w : w <> '') ELSE [upper(query)] END AS words
  FROM bt, (VALUES ('all'), ('index')) k(kind)),
hits AS (SELECT a.request_id, row_number() OVER (PARTITION BY a.request_id ORDER BY i.position) AS rank, i.*, CASE WHEN instrument_name = 'EQUITY' THEN 'stock' ELSE 'index' END AS sort
  FROM asks a JOIN ins i ON len(list_filter(a.words, lambda w : NOT contains(i.search_symbol, w))) = 0 AND (a.kind = 'all' OR instrument_name <> 'EQUITY') QUALIFY rank <= 30)"""
)


@query("f9_search_requests", with_sql(ASKS_SQL, "SELECT request_id, rank, security_id, search_symbol FROM hits"))
def f9_search_requests(spark, sf):
    from tickloom.operators.search import search_requests

    return search_requests(part_instruments(spark, sf), search_asks(spark, sf), 30).select("request_id", "rank", "security_id", "search_symbol")


@query(
    "f10_rank_requests",
    with_sql(
        ASKS_SQL,
        """SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY weight, position) AS rank, name AS symbol, exchange || ':' || name AS full_name, description, weight
FROM (SELECT request_id, query, i.*, instr(upper(name), upper(query)) - 1 AS pn, instr(upper(description), upper(query)) - 1 AS pd, CASE WHEN pn >= 0 THEN pn ELSE 8000 + pd END AS weight
      FROM (SELECT request_id, query FROM asks WHERE kind = 'all') JOIN ins i ON contains(upper(name), upper(query)) OR contains(upper(description), upper(query))) QUALIFY rank <= 30""",
    ),
)
def f10_rank_requests(spark, sf):
    from tickloom.operators.search import rank_requests

    asks = search_asks(spark, sf).where("kind = 'all'").withColumns({"kind": F.lit(""), "exchange": F.lit(None).cast("string")})
    return rank_requests(part_instruments(spark, sf), asks, 30).select("request_id", "rank", "symbol", "full_name", "description", "weight")


@query(
    "u3_favourites_requests",
    with_sql(
        ASKS_SQL
        + """, fv AS (SELECT * FROM (VALUES (0, 'NIFTY 50', 'Nifty 50 Index (Spot)', 'index', ['NIFTY']), (1, 'NIFTY OPTIONS', 'Nifty Options ATM Premium', 'options', ['OPT', 'NIFTY'])) f(place, symbol, description, type, words)),
rq AS (SELECT DISTINCT request_id, upper(concat(query, CASE WHEN contains(query, 'ri') THEN 'opt' ELSE '' END)) AS q FROM asks WHERE kind = 'all' AND NOT request_id LIKE '% %'),
ht AS (SELECT q.request_id, row_number() OVER (PARTITION BY q.request_id ORDER BY position) AS n, search_symbol, description, CASE WHEN instrument_name = 'EQUITY' THEN 'stock' ELSE 'index' END AS type
  FROM rq q JOIN ins ON contains(search_symbol, replace(q.q, 'OPT', '')) QUALIFY n <= 20),
al AS (SELECT request_id, place, symbol, description, type FROM rq JOIN fv ON len(list_filter(words, lambda w : contains(q, w))) > 0
  UNION ALL SELECT request_id, n + 2, search_symbol, description, type FROM ht JOIN rq USING (request_id) WHERE NOT contains(q, 'OPT'))""",
        "SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY place) AS rank, symbol, description, type FROM al",
    ),
)
def u3_favourites_requests(spark, sf):
    """Requests of one word; those with "ri" name options besides, which favourites know and no instrument holds."""
    from tickloom.operators.search import favourites_requests

    asks = search_asks(spark, sf).where("kind = 'all' AND NOT request_id LIKE '% %'")
    asks = asks.withColumn("query", F.when(F.col("query").contains("ri"), F.concat("query", F.lit("opt"))).otherwise(F.col("query")))
    return favourites_requests(part_instruments(spark, sf), asks, 20)


@query(
    "u5_distinct_trades",
    with_sql(NATION_SQL, "SELECT DISTINCT symbol, epoch, type, price FROM (SELECT * FROM tr UNION ALL SELECT * FROM tr WHERE status = 'O')"),
)
def u5_distinct_trades(spark, sf):
    trades = order_trades(spark, sf)
    again = trades.unionByName(trades.where("status = 'O'"))
    return L.distinct_trades(again).select("symbol", "epoch", "type", "price")


@query(
    "g10_chart_marks",
    with_sql(
        LEDGER_SQL,
        """SELECT symbol, concat_ws('_', epoch, type) AS id, epoch AS time, CASE WHEN type = 'buy' THEN 'green' ELSE 'red' END AS color,
       CASE WHEN type = 'buy' THEN 'B' ELSE 'S' END AS mark_label FROM closed WHERE epoch BETWEEN 1704844800 AND 1705708800""",
    ),
)
def g10_chart_marks(spark, sf):
    out = L.marks(breakout_ledger(spark, sf), 1704844800, 1705708800)
    return out.select("symbol", "id", "time", "color", "mark_label")


@query(
    "t1_sorted_bars",
    with_sql(INDEXED_SQL, "SELECT symbol, epoch, close FROM ib ORDER BY symbol, epoch"),
)
def t1_sorted_bars(spark, sf):
    return inputs.hourly_indexed(spark, sf).select("symbol", "epoch", "close").orderBy("symbol", "epoch")
