"""Operators for preparing training text. Nothing else in the library imports this package.

One module for each operator; ``queries`` registers one query for each. Tables are read with
``spark.read`` only and intermediates go to the shared folder of the session.
"""
