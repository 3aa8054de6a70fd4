"""quirewright: a PySpark-native engine for document analytics.

Technical articles are read as tables, turned into one ordered relation of typed blocks, and
everything else is a DataFrame operation over that relation.
"""

__version__ = "0.1.0"
