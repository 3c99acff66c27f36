"""Account-ledger analytics as Spark jobs: ledgers, valuation, NAV, returns, backtests, versions."""
