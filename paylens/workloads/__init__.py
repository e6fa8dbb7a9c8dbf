"""Every operator run on the benchmark tables, next to the SQL that gives the same result.

Each module has QUERIES: name -> (function of session and folder, DuckDB SQL). Dates are returned
as text and computed fractions rounded, so that both engines can be compared value by value.
"""
