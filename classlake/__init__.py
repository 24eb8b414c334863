"""Set-level analytics over facts about compiled code, as Spark DataFrames.

Every operator takes DataFrames and returns a DataFrame that covers all units
(methods, classes, archives) at once.
"""
