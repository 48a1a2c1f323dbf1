"""Operators of a training-data pipeline: one module per operator, queries in ``queries``.

Nothing else in the package imports this folder. Texts are UTF-8 strings; a null
text counts as empty everywhere. Columns a caller adds, clashing names included,
are kept or ignored as each docstring says.
"""
