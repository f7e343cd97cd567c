"""Training-data operators over the ``documents`` and ``pages`` tables.

Nothing outside this subpackage imports it. ``registry`` lists the queries
and SQL that ``__spark_entry__`` adds when the subpackage is present.
"""
