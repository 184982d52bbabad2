"""A market's events by rule, for tests and trials: open, book deltas, spot quotes, reference ticks, close, resolution."""

from __future__ import annotations

import json

#: The first market's window, in milliseconds.
WINDOW_START = 1_790_284_500_000
LENGTH_MS = 900_000


def market_lines(start: int = WINDOW_START, p0: float = 84_000.0, p1: float = 84_010.0, holes: list[tuple[int, int]] = (), join_late_ms: int = -1, resolution: str | None = "UP", price_to_beat: float | None = None, final_price: float | None = None, market: str = "0xabc") -> list[tuple[int, str]]:
    """(arrival in nanoseconds, line) by arrival. No events arrive in a hole [from, to) ; joining late leaves out book events."""
    end, out = start + LENGTH_MS, []

    def put(ms: int, at: int, kind: str, payload: dict, market_id: str | None = None, token: str | None = None) -> None:
        if not any(a <= ms < b for a, b in holes):
            event = {"kind": kind, "marketId": market_id, "token": token, "exchangeTs": ms, "recvTs": str(at * 1_000_000), "payload": payload}
            out.append((at * 1_000_000, json.dumps({k: v for k, v in event.items() if v is not None})))

    fees = {"rate": 0.07, "exponent": 1, "takerOnly": True, "rebateRate": 0.2}
    put(start - 90_000, start - 90_000, "market_open", {"slug": f"m-{start // 1000}", "upTokenId": "u", "downTokenId": "d", "windowStart": start, "windowEnd": end, "tickSize": 0.01, "minOrderSize": 5, "feeSchedule": fees}, market)
    for ms in range(start - 89_000, end + 4_001, 250):
        put(ms, ms, "spot", {"type": "bbo", "source": "binance", "bid": p0, "bidSize": 1, "ask": p0 + 1, "askSize": 1})
        if ms % 1000 == 0:
            price = p0 if ms < start + LENGTH_MS // 2 else p1
            put(ms, ms + 1, "res_price", {"source": "chainlink", "symbol": "btc/usd", "price": price, "scaled": str(round(price * 10**6) * 10**12)})
        if ms % 500 == 0 and ms >= start + join_late_ms:
            change = {"token": "UP", "side": "BUY", "price": 0.5, "size": ms // 500 % 100, "bestBid": 0.5, "bestAsk": 0.51}
            put(ms, ms + 2, "book_delta", {"changes": [change]}, market)
    put(end, end, "market_close", {"windowEnd": end}, market)
    if resolution:
        put(end + 5_000, end + 5_000, "resolution", {"outcome": resolution, "priceToBeat": price_to_beat or p0, "finalPrice": final_price or p1}, market)
    return sorted(out, key=lambda x: x[0])
