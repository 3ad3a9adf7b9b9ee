"""Whole plans: ingestion of a bundle, and the queries over the tables of the driver."""
