"""Physical patterns shared by the operators: ordered scans, exact quantiles, interval joins, top-k."""
