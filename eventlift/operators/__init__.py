"""The analytical operators: each takes DataFrames and returns one."""
