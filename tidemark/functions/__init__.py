"""Expressions shared by the operators.

They take and give Spark SQL text, so that a long expression costs one parse
and reads like the formula it is.
"""
