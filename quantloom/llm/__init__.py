"""Training-data operators over text corpora.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; ``queries`` wraps them as the ``opN_<name>`` queries.
"""
