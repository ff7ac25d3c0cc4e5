"""Training-data pipeline operators (language-model scoring, token files, near and
exact deduplication, packing, quality selection, BPE, HTML extraction).

Nothing else in the library imports this subpackage. Operators take and return
DataFrames; ``queries.py`` registers one thin query per operator.
"""
