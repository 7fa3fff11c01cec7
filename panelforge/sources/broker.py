"""A broker behind an interface: account, clock and positions in, orders out. Nothing here talks to a network."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from panelforge.operators.portfolio import plan_actions, size_orders


class FractionRefused(Exception):
    """The broker takes whole shares of this ticker only."""


@dataclass
class Account:
    equity: float
    buying_power: float
    last_equity: float = 0.0


class Broker(Protocol):
    def account(self) -> Account: ...
    def market_open(self) -> bool: ...
    def positions(self) -> list[str]: ...
    def price(self, ticker: str) -> float: ...
    def close(self, ticker: str) -> str: ...
    def buy_notional(self, ticker: str, notional: float) -> str: ...
    def buy_shares(self, ticker: str, shares: int) -> str: ...


def orders(spark: SparkSession, broker: Broker, buys: DataFrame) -> DataFrame:
    """(ticker, action, notional, status) planned from the broker's account and positions; nothing is sent."""
    account, held = broker.account(), broker.positions()
    positions = spark.createDataFrame([(t,) for t in held], "ticker string")
    actions = plan_actions(positions, buys)
    opened = size_orders(actions, account.equity, account.buying_power, buys.count())
    closed = actions.where("action = 'CLOSE'").selectExpr("ticker", "'CLOSE' AS action", "cast(null AS double) AS notional", "'submitted' AS status")
    return closed.unionByName(opened)


def submit(planned: DataFrame, broker: Broker, retry: Callable[[Callable[[], str]], str | None] = lambda call: call()) -> list[dict]:
    """Send planned orders, closes first; a refused fraction is tried as whole shares. One result an order.

    Orders are as many as the buys selected and the positions held, a few dozen, so they
    are sent from one place, in order, and each failure is reported with its order.
    """
    out = []
    rows = planned.where("status = 'submitted'").collect()
    for r in sorted(rows, key=lambda r: (r.action != "CLOSE", r.ticker)):
        try:
            if r.action == "CLOSE":
                got = retry(lambda r=r: broker.close(r.ticker))
            else:
                try:
                    got = retry(lambda r=r: broker.buy_notional(r.ticker, r.notional))
                except FractionRefused:
                    shares = int(r.notional // broker.price(r.ticker))
                    got = retry(lambda r=r, n=shares: broker.buy_shares(r.ticker, n)) if shares else "skipped"
            out.append({"ticker": r.ticker, "action": r.action, "status": got or "failed"})
        except Exception as e:  # noqa: BLE001  the other orders still go out
            out.append({"ticker": r.ticker, "action": r.action, "status": "failed", "error": str(e)})
    return out
