"""quarrymill: catalog analytics and corpus preparation as Spark plans.

Every operator takes DataFrames and column names and returns a DataFrame; the
plans stay lazy until the caller runs an action.
"""
