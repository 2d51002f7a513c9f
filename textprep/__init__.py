"""textprep: PySpark-native text and tabular data preparation.

Plain functions ``DataFrame -> DataFrame`` and ``Column -> Column``; learned state
(code tables, vocabularies, merges) is a DataFrame.  No import side effects.
"""

__version__ = "0.1.0"
