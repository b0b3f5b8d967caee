"""lectern: reader and subscriber analytics as Spark DataFrame jobs.

Sub-packages
------------
sources    logical tables (scan with an enforced schema), adapters over the
           driver tables, and table sinks.
functions  column-expression helpers (dates, scores, window masks).
operators  table-to-table operators (events, cohorts, engagement windows,
           book ranking, distributed rank, dashboard metrics).
plans      compositions of operators into the published reports, and the
           query registry used by ``__spark_entry__``.
streaming  intentionally empty: every workload is a batch over tables.
oracle     DuckDB SQL text in the reference's literal shape (test oracle).
"""

__version__ = "0.1.0"
