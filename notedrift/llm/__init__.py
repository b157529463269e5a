"""Training-data operators.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames and column names and returns a DataFrame; inputs are first narrowed
to the named columns, so extra or clashing columns never matter.
"""
