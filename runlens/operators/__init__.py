"""Analytics over the model tables. Every function is DataFrame(s) -> DataFrame, per run, for all runs at once."""
