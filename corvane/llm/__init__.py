"""Operators for preparing training corpora: deduplication, decontamination,
language identification, secret scans, packing and token files.

Nothing else in the library imports this subpackage.
"""
