"""Training-data operators: de-duplication, filtering, fingerprints, mixing,
sharding and token counts over a ``documents`` / ``pages`` corpus.

Nothing outside this subpackage imports it; ``queries.py`` registers one
query per operator.
"""
