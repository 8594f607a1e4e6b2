"""Panel analytics on PySpark: long (instrument x time) tables in, DataFrames out.

Nothing in this package pivots, collects a panel or keeps hidden session state.  Rows are sparse
(an instrument without a print has no row) and carry an integer position in their calendar, so
"k slots ago" is a RANGE frame over that integer instead of a row offset over a padded grid.
"""

__version__ = "0.1.0"
