"""labelloom: building and judging labelled text corpora with Spark DataFrames.

Every operator is a plain function from DataFrame to DataFrame (or from Column to
Column).  Nothing here runs an action unless its docstring says so.
"""
