"""Relational operators, tables, text features and XML columns on Spark DataFrames."""
