"""Option contracts: keys, ladders, resolution against the instrument master, price enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.dates import day_of, parse_expiry
from tickloom.functions.labels import money, parse_contract
from tickloom.operators.asof import nearest, price_source
from tickloom.operators.blocks import running
from tickloom.session import settle

# fixed values: vendor ids and lot sizes of the index underlyings
UNDERLYING_IDS = {"NIFTY": 13, "BANKNIFTY": 25, "FINNIFTY": 27}
LOT_SIZES = {"NIFTY": 50, "BANKNIFTY": 15, "FINNIFTY": 40}


def lookup(table: dict, key: Column, default=None) -> Column:
    """A small fixed table as a column expression."""
    pairs = F.create_map(*[F.lit(v) for k, x in table.items() for v in (k, x)])
    found = F.try_element_at(pairs, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def atm_strike(price: Column, step: Column | int) -> Column:
    """Nearest multiple of ``step``, halves to the even multiple."""
    return (F.bround(price / step) * step).cast("long")


def monthly_key(underlying: Column, expiry: Column, strike: Column, option_type: Column) -> Column:
    """``NIFTY-Jan2026-24100-CE``."""
    return F.concat_ws("-", underlying, F.date_format(expiry, "MMMyyyy"), strike.cast("string"), option_type)


def dated_key(underlying: Column, expiry: Column, strike: Column, option_type: Column) -> Column:
    """``NIFTY 15 JAN 2026 24100 CE``."""
    return F.concat_ws(" ", F.upper(underlying), F.upper(F.date_format(expiry, "dd MMM yyyy")), strike.cast("string"), F.upper(option_type))


def strike_ladder(requests: DataFrame, price: str, step: int, reach: int, expiries: str) -> DataFrame:
    """Contracts ``ATM ± reach`` x CE/PE x the row's array of expiries."""
    atm = atm_strike(F.col(price), step)
    n = reach // step
    return (
        requests.withColumn("_step", F.explode(F.sequence(F.lit(-n), F.lit(n))))
        .withColumn("strike", atm + F.col("_step") * step)
        .withColumn("option_type", F.explode(F.array(F.lit("CE"), F.lit("PE"))))
        .withColumn("expiry", F.explode(expiries))
        .drop("_step", expiries)
    )


def thursdays(start: Column, end: Column) -> Column:
    """All Thursdays of a date range as an array."""
    first = F.next_day(F.date_sub(start, 1), "THU")
    return F.when(first <= end, F.sequence(first, end, F.expr("interval 7 days"))).otherwise(F.array().cast("array<date>"))


def nearest_expiries(start: Column, limit: int = 2, from_start: bool = False) -> Column:
    """The next ``limit`` Thursdays, counted from a week before ``start`` unless ``from_start``."""
    origin = start if from_start else F.date_sub(start, 7)
    first = F.next_day(F.date_sub(origin, 1), "THU")
    return F.sequence(first, F.date_add(first, 7 * (limit - 1)), F.expr("interval 7 days"))


def resolve(requests: DataFrame, instruments: DataFrame, key: str = "contract_key", gram: int = 6) -> DataFrame:
    """Contract keys to instruments: equal trading symbol (latest expiry wins), else first containing it.

    ``instruments``: ``trading_symbol, security_id, expiry, position`` (position is file order). The
    substring search joins each key on its rarest run of ``gram`` characters (a shorter key on itself), so contracts of one underlying
    with a common beginning don't meet all of each other.
    """
    wanted = requests.select(F.col(key).alias("_key")).where(F.col("_key") != "").distinct()
    per_symbol = instruments.groupBy("trading_symbol").agg(
        F.max_by("security_id", F.struct("expiry", -F.col("position"))).alias("_latest"),
        F.min_by("security_id", "position").alias("_first"),
        F.min("position").alias("_position"),
    )
    same = wanted.join(per_symbol, F.col("_key") == F.col("trading_symbol")).select(
        "_key", F.col("_latest").alias("security_id"), "trading_symbol", F.lit("exact").alias("match")
    )
    missing = wanted.join(same, "_key", "left_anti").withColumn("_size", F.least(F.length("_key"), F.lit(gram)))
    cut = lambda text: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - F.col("_size") + 1), lambda i: F.substr(text, i, F.col("_size"))))
    wishes = missing.withColumn("_gram", F.explode(cut("_key")))
    # at most ``gram`` lengths occur, and only those are cut
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.length("trading_symbol"), F.lit(gram))))
    sized = per_symbol.where(F.length("trading_symbol") > 0).withColumn("_size", sizes).join(missing.select("_size").distinct(), "_size", "left_semi")
    spread = settle(sized.withColumn("_gram", F.explode(cut("trading_symbol"))).drop("_size").join(wishes.select("_gram").distinct(), "_gram", "left_semi"))
    counts = spread.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    missing = wishes.join(counts, "_gram", "left").groupBy("_key").agg(F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram"))
    partial = (
        missing.join(spread, "_gram")
        .where(F.col("trading_symbol").contains(F.col("_key")))
        .groupBy("_key")
        .agg(F.min_by(F.struct(F.col("_first").alias("security_id"), "trading_symbol"), "_position").alias("_hit"))
        .select("_key", "_hit.security_id", "_hit.trading_symbol", F.lit("partial").alias("match"))
    )
    found = same.unionByName(partial)
    return requests.join(found, F.col(key) == F.col("_key"), "left").drop("_key")


def label_contracts(signals: DataFrame, underlying: Column | None = None, rule: str = "season") -> DataFrame:
    """Contract columns parsed from signal labels; ``contract_key`` is null for exits and plain signals."""
    parsed = parse_contract(F.col("signal_label"))
    out = signals.withColumns({"strike": parsed["strike"], "option_type": parsed["option_type"]})
    out = out.withColumn("expiry", parse_expiry(parsed["expiry_text"], day_of(F.col("epoch")), rule))
    base = underlying if underlying is not None else F.col("symbol")
    key = monthly_key(base, F.col("expiry"), F.col("strike"), F.col("option_type"))
    return out.withColumn("contract_key", F.when(F.col("expiry").isNotNull(), key))


def carry_contracts(signals: DataFrame, contract: str = "security_id", exits_only: bool = True) -> DataFrame:
    """``active_contract``: an entry's own contract, or for the first exit after it the entry's.

    An exit uses the contract up; without ``exits_only`` any signal that names none may use it.
    """
    entry = F.col("strike").isNotNull()
    leaves = ~entry & (F.col("signal_label").contains("Exit") if exits_only else F.lit(True))
    event = F.when(entry & F.col(contract).isNotNull(), F.struct(F.col(contract).alias("c"))).when(
        leaves, F.struct(F.lit(None).cast("string").alias("c"))
    )
    out = running(signals, {"_held": ("last", event)}, inclusive=False)
    return out.withColumn(
        "active_contract", F.when(entry, F.col(contract)).when(leaves, F.col("_held.c"))
    ).drop("_held")


def enrich_signals(signals: DataFrame, instruments: DataFrame, option_bars: DataFrame, rule: str = "season") -> DataFrame:
    """Signals with option premiums as ``signal_price`` where a positive price was found.

    ``option_bars``: ``security_id, epoch, close``. Bars of contracts that no signal uses are dropped
    by a semi join before the nearest-time scan.
    """
    named = settle(label_contracts(signals, rule=rule))
    resolved = settle(resolve(named, instruments).drop("trading_symbol", "match"))
    probes = carry_contracts(resolved).drop("security_id").withColumnRenamed("active_contract", "security_id")
    probes = settle(probes.withColumnRenamed("close", "spot"))
    used = probes.select("security_id").where(F.col("security_id").isNotNull()).distinct()
    prices = settle(option_bars.join(used, "security_id", "left_semi").select("security_id", "epoch", "close"))
    priced = nearest(probes, prices, ["security_id"], ["close"])
    found = F.coalesce(F.col("near_close") > 0, F.lit(False))
    return (
        priced.withColumn("price_source", F.when(F.col("security_id").isNotNull(), price_source(F.col("gap"))))
        .withColumn("signal_price", F.when(found, F.col("near_close")).otherwise(F.col("signal_price")))
        .withColumnRenamed("spot", "close")
        .drop("near_close", "near_epoch")
    )


def enrichment_stats(enriched: DataFrame) -> DataFrame:
    """Signals, contracts and price matches by source class."""
    return enriched.groupBy(F.coalesce("price_source", F.lit("unpriced")).alias("price_source")).agg(
        F.count(F.lit(1)).alias("signals"), F.count_distinct("security_id").alias("contracts")
    )


def unpriced(signals: DataFrame) -> DataFrame:
    """Signals without a positive price: how many, and the label of the first."""
    missing = (F.col("signal") != 0) & (F.col("signal_price").isNull() | (F.col("signal_price") <= 0))
    return signals.agg(
        F.count_if(missing).alias("missing"), F.min_by("signal_label", F.when(missing, F.struct("epoch", "symbol"))).alias("example")
    )


def assert_priced(signals: DataFrame) -> DataFrame:
    """``signals`` unchanged; running it fails when a signal has no positive price."""
    missing = (F.col("signal") != 0) & (F.col("signal_price").isNull() | (F.col("signal_price") <= 0))
    message = F.concat(F.lit("signal without an option price: "), F.coalesce("signal_label", F.lit("")))
    return signals.withColumn("signal_price", F.when(missing, F.raise_error(message).cast("double")).otherwise(F.col("signal_price")))


def replay_trades(priced: DataFrame) -> DataFrame:
    """Exit rows with premium profit (exit - entry) and the label suffix of a replay."""
    entry = F.col("signal_label").contains("Buy") & (F.col("signal_label").contains("CE") | F.col("signal_label").contains("PE"))
    leave = ~entry & F.col("signal_label").contains("Exit")
    event = F.when(entry, F.struct(F.col("signal_price").alias("p"))).when(leave, F.struct(F.lit(None).cast("double").alias("p")))
    out = running(priced, {"_held": ("last", event)}, inclusive=False)
    pnl = F.when(leave, F.col("signal_price") - F.col("_held.p"))
    signed = F.concat(F.when(pnl < 0, "").otherwise("+"), money(pnl))
    label = F.when(pnl.isNotNull(), F.concat("signal_label", F.lit(" (PnL: "), signed, F.lit(")"))).otherwise(F.col("signal_label"))
    return out.withColumns({"pnl": pnl, "label": label}).drop("_held")


def select_options(signals: DataFrame, chain: DataFrame, width: float = 1000.0) -> DataFrame:
    """At-the-money option per signal: nearest expiry of the underlying, nearest strike, call or put.

    ``signals``: ``underlying, price, signal``; ``chain``: one row per ``underlying, expiry, strike,
    option_type`` with quotes. Strikes are matched by the same scan as times.
    """
    first = chain.groupBy("underlying").agg(F.min("expiry").alias("expiry"))
    listed = chain.join(first, ["underlying", "expiry"], "left_semi").withColumn("price", F.col("strike"))
    quotes = [c for c in listed.columns if c not in ("underlying", "option_type", "price")]
    strikes = listed.groupBy("underlying", "price").agg(
        F.map_from_entries(F.collect_list(F.struct("option_type", F.struct(*quotes)))).alias("sides")
    )
    out = nearest(signals, strikes, ["underlying"], ["sides"], at="price", width=width)
    side = F.when(F.col("signal") > 0, "CE").otherwise("PE")
    return (
        out.withColumn("option_type", side)
        .withColumn("_quote", F.try_element_at("near_sides", side))
        .where(F.col("_quote").isNotNull())
        .withColumn("lot_size", lookup(LOT_SIZES, F.upper("underlying"), 1))
        .select(*signals.columns, "option_type", "lot_size", "_quote.*")
    )
