"""Operators for building language-model training corpora (quality, dedup,
scans, archives, scoring, mixing, packing). Nothing else in textlab imports
this subpackage."""
