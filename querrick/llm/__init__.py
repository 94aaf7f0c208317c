"""Training-data operators.

One module an operator; ``queries`` holds the thin registered queries and
their SQL. Nothing outside this subpackage imports it.
"""
