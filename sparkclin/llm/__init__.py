"""Operators for preparing text corpora: decontamination, secret scans, token counts, byte-level
BPE, sharding, WARC archives, quality scoring and rules, near- and exact-substring deduplication.

Nothing else in the package imports this subpackage.
"""
