"""Operators for building language-model training data, each one a module of this subpackage.

Nothing outside this subpackage imports it.  ``registry`` holds the queries and their SQL.
"""
