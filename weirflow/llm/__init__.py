"""Operators for training-data pipelines at corpus scale.

Nothing outside this folder imports it.  Each module holds one operator with
a general interface; ``queries`` binds the operators to the driver's tables.
"""
