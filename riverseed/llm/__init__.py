"""Operators of a training-data pipeline over ``documents``/``pages`` tables.

Each module holds one operator with a general interface; ``queries`` holds the
thin queries that apply them to whole tables and ``sql`` the matching SQL.
"""
