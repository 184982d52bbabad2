"""Settings of a recording, validated as a whole: every value that is missing, of another type or out of range is named."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from tidebook.operators.health import HealthRules
from tidebook.streaming.market_state import FeedProcessor, MarketProcessor

_number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
_above: Callable = lambda x: _number(x) and x > 0
_least: Callable = lambda x: _number(x) and x >= 0
_whole: Callable = lambda x: _number(x) and x == int(x)
_text: Callable = lambda x: isinstance(x, str)
_flag: Callable = lambda x: isinstance(x, bool)

#: What each setting must be; a setting's path is its name in the file.
RULES: dict[str, tuple[Callable, str]] = {
    "market.durationSec": (lambda x: _whole(x) and x > 0, "a whole number above 0"), "market.slugPrefix": (_text, "a text"),
    "venue.tickSize": (_above, "above 0"), "venue.minOrderSize": (_above, "above 0"), "venue.feeSchedule.rate": (_least, "at least 0"), "venue.feeSchedule.exponent": (_least, "at least 0"),
    "venue.feeSchedule.takerOnly": (_flag, "true or false"), "venue.feeSchedule.rebateRate": (lambda x: _least(x) and x <= 1, "from 0 to 1"),
    "settlement.tieGoesTo": (lambda x: x in ("up", "down"), '"up" or "down"'), "settlement.twapWindow.fromSec": (_whole, "a whole number"), "settlement.twapWindow.toSec": (_whole, "a whole number"),
    "settlement.twapToleranceUsd": (_least, "at least 0"), "settlement.mergePairs": (_flag, "true or false"),
    "recorder.dataDir": (_text, "a text"), "recorder.postCloseGraceSec": (_least, "at least 0"), "recorder.resolutionGiveUpSec": (_above, "above 0"), "recorder.maxGapMs": (_above, "above 0"),
    "recorder.silenceMs.clob": (_above, "above 0"), "recorder.silenceMs.rtds": (_above, "above 0"), "recorder.silenceMs.binance": (_above, "above 0"), "recorder.silenceMs.coinbase": (_above, "above 0"),
    "recorder.dropMirrored": (_flag, "true or false"), "recorder.spotSources": (lambda x: isinstance(x, list) and len(x) > 0 and all(s in ("binance", "coinbase") for s in x), "a list of binance, coinbase"),
    "fairValue.volHalfLivesSec": (lambda x: isinstance(x, list) and len(x) > 0 and all(map(_above, x)), "a list of numbers above 0"), "fairValue.spotInput": (lambda x: x in ("spot_mid", "res_price"), '"spot_mid" or "res_price"'),
}


class Invalid(ValueError):
    """Settings that cannot be used; the message names each of them."""


@dataclass(frozen=True)
class Config:
    """Valid settings by their paths; others that a file has are kept but not looked at."""

    values: dict

    def __getitem__(self, path: str):
        at = self.values
        for name in path.split("."):
            at = at[name]
        return at

    def health_rules(self) -> HealthRules:
        first, last = self["settlement.twapWindow.fromSec"], self["settlement.twapWindow.toSec"]
        return HealthRules(length_ms=self["market.durationSec"] * 1000, twap_first_ms=first * 1000, twap_last_ms=last * 1000, tie=self["settlement.tieGoesTo"].upper(), tolerance=float(self["settlement.twapToleranceUsd"]), max_gap_ms=int(self["recorder.maxGapMs"]))

    def market_processor(self) -> MarketProcessor:
        return MarketProcessor(grace_ms=int(self["recorder.postCloseGraceSec"] * 1000), give_up_ms=int(self["recorder.resolutionGiveUpSec"] * 1000))

    def feed_processor(self, feed: str) -> FeedProcessor:
        return FeedProcessor(silence_ms=int(self[f"recorder.silenceMs.{feed}"]))


def validated(values: dict) -> Config:
    """values as settings, or Invalid with all that is wrong."""
    config, wrong = Config(values), []
    for path, (holds, must) in RULES.items():
        try:
            if not holds(config[path]):
                wrong.append(f"{path} must be {must}, not {config[path]!r}")
        except (KeyError, TypeError):
            wrong.append(f"{path} is missing; it must be {must}")
    if not wrong and config["settlement.twapWindow.fromSec"] > config["settlement.twapWindow.toSec"]:
        wrong.append("settlement.twapWindow.fromSec must not come after toSec")
    if wrong:
        raise Invalid("; ".join(wrong))
    return config


def load(spark: SparkSession, path: str) -> Config:
    """The settings of a JSON file at any path that Spark can open."""
    return validated(json.loads(spark.read.text(path, wholetext=True).first()[0]))
