"""Training-data operators: ten corpus operators and the queries over them.

Each module holds one operator with its own general interface; ``queries``
holds the thin ``opN_<name>`` forms.  Nothing outside this folder imports it.
"""
