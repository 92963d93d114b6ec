"""Operators for large training corpora: formatting, decontamination, de-duplication, scoring, packing, search."""
