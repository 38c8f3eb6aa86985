"""topicscope: topic discovery and topic trends over document collections on
Apache Spark (DataFrames, Spark SQL, Spark ML, Structured Streaming)."""

__version__ = "0.1.0"
