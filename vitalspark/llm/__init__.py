"""Training-data operators on Spark: scoring, filtering, tokenising, sharding and near-duplicate search.

Nothing else in the library imports this subpackage.
"""
