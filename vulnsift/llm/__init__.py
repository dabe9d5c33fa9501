"""Training-data operators: dedup, quality, HTML, sharding, BPE, PII, fingerprints, mixing, chat.

Nothing outside this folder, its tests and ``corpus_pipeline.py`` imports it, so it can be
deleted without touching the rest of the library.
"""
