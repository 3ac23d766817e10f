"""Fathomline: zone-risk analytics on Spark DataFrames.

The package is a set of functions from DataFrame to DataFrame:

* ``sources``    scans, sinks and staging (CSV, preamble CSV, GeoJSON, Parquet);
* ``functions``  column expressions, above all the null-aware aggregates;
* ``operators``  DataFrame operators (joins, reshaping, rescaling, quantiles, spatial join);
* ``plans``      the named jobs built from them, and the query registry;
* ``streaming``  empty on purpose: every job is a batch job.
"""
