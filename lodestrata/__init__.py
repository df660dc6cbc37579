"""lodestrata: a Spark-native engine for dataset curation and graph analytics.

Every operator is a function from DataFrames to a DataFrame.  Nothing here keeps
state between calls, collects unbounded data to the driver or needs a network.
"""

__version__ = "0.1.0"
