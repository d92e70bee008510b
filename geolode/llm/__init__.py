"""Operators for preparing training text at scale.

One module per operator; ``registry`` lists their queries and SQL.
Nothing outside this package imports it.
"""
