"""Training-data operators: ten pipeline components on top of Spark.

Nothing else in the library imports this subpackage.
"""
