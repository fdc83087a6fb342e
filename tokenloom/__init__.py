"""tokenloom: Spark-native corpus preparation and vocabulary induction."""

__version__ = "0.1.0"
