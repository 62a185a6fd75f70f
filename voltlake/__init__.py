"""Electricity-grid analytics as plain PySpark DataFrame jobs.

``sources``    landed JSON payloads and seeds -> typed bronze frames
``plans``      bronze -> silver -> gold -> read queries
``operators``  newest-wins, ranking, runs, upsert and data checks, reusable alone
``functions``  column expressions (rounding, time, scoring, cleaning)
``sinks``      tables, views and JSON rows
``streaming``  the same ingest, upsert and hourly mean on Structured Streaming
"""
