"""The summary: reports over a stored ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import ledger as L
from ..operators import subscriptions as S


def summary(
    transactions: DataFrame, subscriptions: DataFrame, anomalies: DataFrame, as_of: str, days: int = 30
) -> dict[str, DataFrame]:
    """Small result tables of one period; each reads only the columns and dates it needs."""
    by_category = L.spending_by_category(transactions, as_of, days)
    return {
        "transactions": L.transactions(transactions, as_of, days),
        "total": L.ledger_total(L.transactions(transactions, as_of, days)),
        "by_category": L.category_share(by_category),
        "trend": L.spending_trend(transactions, as_of),
        "change": L.period_change(transactions, as_of, days),
        "subscriptions": S.active_subscriptions(subscriptions),
        "cost": S.subscription_cost(subscriptions),
        "anomalies": L.unresolved_anomalies(anomalies),
    }
