"""Failure-forecast analytics over host telemetry, written as Spark DataFrame jobs."""
