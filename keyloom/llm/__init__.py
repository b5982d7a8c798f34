"""Operators for preparing training text at corpus scale.

Nothing outside this subpackage imports it.  Each operator lives in its own
module with a general interface; ``queries`` holds the registered queries.
"""
