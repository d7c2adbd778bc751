"""Training-data operators: each module holds one operator with its own general interface.

``registry`` derives the fixed ``opN_<name>`` queries from them. Nothing outside this
subpackage imports it.
"""
