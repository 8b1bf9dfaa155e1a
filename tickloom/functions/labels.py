"""Signal labels: building, classifying and parsing them as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUY, SELL, HOLD = 1, -1, 0

# fixed value: the contract part of an entry label
CONTRACT_PATTERN = r"(\d+)\s+(CE|PE)\s+\(([^)]+)\)"


def parse_contract(label: Column) -> dict[str, Column]:
    """Strike, option type and expiry text found in a label; null when there is none."""
    part = lambda i: F.nullif(F.regexp_extract(label, CONTRACT_PATTERN, i), F.lit(""))
    return {"strike": part(1).cast("int"), "option_type": part(2), "expiry_text": part(3)}


def entry_label(strike: Column, option_type: Column, expiry: Column, stop: Column) -> Column:
    """``Buy {strike} {type} ({expiry}) | SL:{stop}``."""
    return F.concat(F.lit("Buy "), strike, F.lit(" "), option_type, F.lit(" ("), expiry, F.lit(") | SL:"), stop)


def pnl_suffix(label: Column, pnl: Column) -> Column:
    """Append the profit of a closed trade to its label."""
    return F.concat(label, F.lit(" (PnL: "), money(pnl), F.lit(")"))


def money(value: Column) -> Column:
    """Two decimals of the binary value, half to even, no thousands separators."""
    return F.call_function("format_number", value, F.lit("0.00"))


def classify(label: Column) -> dict[str, Column]:
    """Entry/exit and side flags of a label, as the ledger reads them."""
    entry = label.contains("Buy ") & (label.contains(" CE ") | label.contains(" PE "))
    leave = label.contains("Exit")
    return {
        "is_entry": entry,
        "is_exit": leave,
        "is_long_entry": entry & label.contains(" CE "),
        "is_short_entry": entry & label.contains(" PE "),
        "is_long_exit": leave & label.contains("Long"),
        "is_short_exit": leave & label.contains("Short"),
    }


def effective_price(signal_price: Column, close: Column) -> Column:
    """The signal's own price when it is positive, else the bar's close."""
    usable = signal_price.isNotNull() & ~F.isnan(signal_price) & (signal_price > 0)
    return F.when(usable, signal_price).otherwise(close)
