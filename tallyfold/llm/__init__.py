"""Training-data operators: each module holds one operator, ``queries`` their registered queries.

Nothing outside this package imports it.
"""
