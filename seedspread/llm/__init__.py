"""Operators for preparing training text at corpus scale, and the queries over the test tables.

Each module holds one operator as plain functions ``DataFrame -> DataFrame``;
``catalog`` registers the queries and ``oracle`` their SQL.
"""
