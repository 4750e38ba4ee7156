"""Training-data operators: filters, near-duplicate search, decontamination, mixing.

Nothing outside this subpackage imports it; the folder can be deleted.
"""
