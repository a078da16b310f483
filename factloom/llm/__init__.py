"""Training-data operators: scoring, filtering, deduplication, mixing, packing and token output.

Nothing outside this folder imports it. Each module holds one operator with a general interface;
``queries.py`` derives the fixed-column digests from them.
"""
