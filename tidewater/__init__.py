"""Episode and time-series analytics as plain PySpark DataFrame operators.

``functions`` hold column expressions, ``operators`` take and return DataFrames,
``sources`` read and publish tables, ``streaming`` has the stateful twins, and
``plans`` apply all of these to concrete tables.
"""
