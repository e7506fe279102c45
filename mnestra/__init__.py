"""mnestra: a Spark-native engine for long-term memory corpora.

Every operator is a function ``DataFrame -> DataFrame``; many banks and many
queries are worked on in one job.  Nothing here holds state between calls.
"""

__version__ = "0.1.0"
