"""Plain sequential models of the rules, written for the tests only."""

import numpy as np
import pandas as pd


def random_walk(symbols=3, n=300, seed=7, base=1000.0, step=4.0, gaps=True):
    rng = np.random.default_rng(seed)
    frames = []
    for k in range(symbols):
        close = base + np.cumsum(rng.normal(0, step, n))
        open_ = np.concatenate(([base], close[:-1]))
        high = np.maximum(open_, close) + np.abs(rng.normal(0, step / 2, n))
        low = np.minimum(open_, close) - np.abs(rng.normal(0, step / 2, n))
        hops = rng.integers(1, 4, n) if gaps else np.ones(n, int)
        frames.append(
            pd.DataFrame(
                {
                    "symbol": f"S{k}",
                    "epoch": 1_700_000_000 + np.cumsum(hops) * 60,
                    "open": open_.round(2),
                    "high": high.round(2),
                    "low": low.round(2),
                    "close": close.round(2),
                    "volume": rng.integers(1000, 9999, n).astype(float),
                }
            )
        )
    return pd.concat(frames, ignore_index=True)


def pivots(bars, left, right):
    """(confirmed pivots with confirm index, last pivot by revealing bar) of one symbol."""
    high, low, time = bars["high"].tolist(), bars["low"].tolist(), bars["epoch"].tolist()
    last = {"high": None, "low": None}
    kind, confirmed, seen = None, [], {}
    for i in range(len(high)):
        c = i - right
        if c >= left:
            span = [j for j in range(c - left, c + right + 1) if j != c]
            for k, series, beyond in (("high", high, lambda a, b: a > b), ("low", low, lambda a, b: a < b)):
                if not all(beyond(series[c], series[j]) for j in span):
                    continue
                p = {"type": k, "price": series[c], "epoch": time[c], "bar_index": c}
                if kind == k:
                    if beyond(p["price"], last[k]["price"]):
                        last[k] = p
                else:
                    other = "low" if k == "high" else "high"
                    if last[other] is not None:
                        confirmed.append({**last[other], "confirm_index": i})
                    last[k], kind = p, k
        seen[i] = last[kind] if kind else None
    return confirmed, seen


def hierarchy(close, context, visible):
    """(anchor, outer from, outer to, inner list) by plain scans over one bar's confirmed pivots."""
    falling = context == "bearish"
    near_kind, far_kind = ("low", "high") if falling else ("high", "low")
    inside = (lambda price: price < close) if falling else (lambda price: price > close)
    outside = (lambda price: price > close) if falling else (lambda price: price < close)
    more = (lambda a, b: a > b) if falling else (lambda a, b: a < b)
    anchor = next((p for p in reversed(visible) if p["type"] == near_kind), None)
    if anchor and ((close < anchor["price"]) if falling else (close > anchor["price"])):
        anchor = None
    start = next((i for i in range(len(visible) - 1, -1, -1) if visible[i]["type"] == near_kind and inside(visible[i]["price"])), None)
    if start is None:
        return anchor, None, None, []
    near, far = visible[start], None
    for p in visible[start + 1 :]:
        if p["type"] == far_kind and (far is None or more(p["price"], far["price"])):
            far = p
    if far is None:
        return anchor, None, None, []
    inner, best = [], None
    for p in visible:
        if anchor is None or p["epoch"] <= near["epoch"] or p["epoch"] == far["epoch"] or p["type"] != far_kind or not outside(p["price"]):
            continue
        if best is None or more(p["price"], best):
            inner.append(p)
            best = p["price"]
    return anchor, far, near, inner


def greedy(touches, gap):
    free, kept = 0, []
    for t in sorted(touches):
        if t >= free:
            kept.append(t)
            free = t + gap
    return kept


def ledger(signals):
    """Trades of one symbol's signals as (epoch, type, price, pnl) by walking the rules in order."""
    position, out = None, []
    for s in signals:
        label, signal, price = s["signal_label"], s["signal"], s["signal_price"]
        entry = "Buy " in label and (" CE " in label or " PE " in label)
        leave = "Exit" in label
        opens = None
        if signal == 1 and entry and " CE " in label and position is None:
            opens = "long"
        elif signal == -1 and entry and " PE " in label and position is None:
            opens = "short"
        elif position is not None and signal == -1 and leave and "Long" in label:
            pass
        elif position is not None and signal == 1 and leave and "Short" in label:
            pass
        elif signal == 1 and position is None and not leave:
            opens = "long"
        elif signal == -1 and position is not None and not entry:
            pass
        else:
            continue
        if opens:
            position = (opens, price)
            out.append((s["epoch"], "buy" if opens == "long" else "sell", price, None))
        else:
            side, paid = position
            pnl = price - paid if side == "long" else paid - price
            out.append((s["epoch"], "sell" if side == "long" else "buy", price, round(pnl, 6)))
            position = None
    return out


def ema_signals(bars, span=5, validity=3, reward=3.0):
    """Alert-candle breakout of one symbol as (bar index, action)."""
    ema = bars["close"].ewm(span=span, adjust=False).mean().tolist()
    high, low, close = (bars[c].tolist() for c in ("high", "low", "close"))
    held, alerts, out = None, {}, []
    for i in range(span + 1, len(close)):
        if held:
            side, stop, goal = held
            if side == "long":
                done = close[i] <= stop or close[i] >= goal or low[i] <= ema[i]
            else:
                done = close[i] >= stop or close[i] <= goal or high[i] >= ema[i]
            if done:
                out.append((i, f"exit_{side}"))
                held = None
            continue
        if low[i - 1] > ema[i - 1]:
            alerts["short"] = (low[i - 1], high[i - 1], i + validity)
        if high[i - 1] < ema[i - 1]:
            alerts["long"] = (low[i - 1], high[i - 1], i + validity)
        short, long = alerts.get("short"), alerts.get("long")
        if short and i <= short[2] and close[i] < short[0]:
            held = ("short", short[1], close[i] - reward * (short[1] - close[i]))
            out.append((i, "enter_short"))
            alerts = {}
        elif long and i <= long[2] and close[i] > long[1]:
            held = ("long", long[0], close[i] + reward * (close[i] - long[0]))
            out.append((i, "enter_long"))
            alerts = {}
    return out
