"""DataFrame operators. Every function takes and returns DataFrames (or
Columns) and stays lazy: no action runs unless the docstring says so."""
