"""Training-data operators: ten corpus jobs that run on Spark, and their queries.

Nothing else in the library imports this subpackage.
"""
