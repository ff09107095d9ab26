"""Market and retail-shelf analytics on Spark."""
