"""Training-data operators: quality rules, mixing, chat formatting, near and
substring dedup, sharding, token files, packing, fingerprints and WARC.

Nothing else in the library imports this subpackage. ``catalog`` registers
one query per operator; ``corpus_pipeline.py`` at the repository top chains
five of them.
"""
