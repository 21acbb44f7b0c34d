"""The panels themselves."""

from __future__ import annotations

from ..sources.tables import daily_bars, market_panel, weekly_panel
from .oracle import DAILY, MPANEL
from .registry import query


@query("weekly_panel", "date entity open~ high~ low~ close~ volume~2 dollar_volume~2 n_trades# "
       "ret~ sig~ industry# sector# mkt~", "SELECT * FROM mpanel", MPANEL)
def _(spark, sf):
    return market_panel(spark, sf)


@query("daily_bars", "date entity open~ high~ low~ close~ volume~2 dollar_volume~2 n_trades#",
       "SELECT * FROM bars_d", DAILY)
def _(spark, sf):
    return daily_bars(spark, sf)
