"""A cross-section of the registered queries against their SQL oracles on the smallest tables."""

import os

import pytest

from foliometry.plans import parity
from foliometry.plans.queries import PLANS, oracles

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "position_ledger",
    "cash_ledger",
    "fx_ledger",
    "account_valuation",
    "activation_issues",
    "nav_series_blocked",
    "parse_transactions",
    "transaction_hashes",
    "provider_bars",
    "market_merge",
    "strategy_prices",
    "dataset_diff",
    "published_active_rows",
    "positions_resource",
]


@pytest.fixture(scope="module")
def duck():
    return parity.duck(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, duck, name):
    result = parity.compare(spark, duck, FOLDER, name, PLANS[name], oracles()[name])
    assert result["ok"], result


def test_every_query_has_an_oracle():
    assert set(PLANS) == set(oracles())
