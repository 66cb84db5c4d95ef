"""Marked point-process analytics on Spark: catalogues, grids, causal joins, features, forecasts, scoring."""
