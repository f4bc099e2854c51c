"""DataFrame to DataFrame: ledger, folds, attribution, windows, rollups, reports, alerts and the announcement board."""
