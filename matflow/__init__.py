"""matflow: stock and production analytics as Spark DataFrame, SQL and
Structured Streaming jobs.

Layout:
  constants   fixed domain values (thresholds, statuts, labels, permissions)
  schemas     StructTypes of the four domain tables
  session     SparkSession builder for tests and the benchmark
  sources/    typed readers, fixture mapping, versioned snapshot store
  functions/  column-expression helpers (formatting, lenient parsing, states)
  operators/  the query and change operators, one function per operator
  plans/      skew-safe building blocks and the query registry with SQL twins
  streaming/  windowed guards and stateful folds for streams
"""

__version__ = "0.1.0"
