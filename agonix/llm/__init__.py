"""Training-data operators: tokenising, scanning, de-duplication, extraction, archiving, packing, search.

Nothing outside this subpackage imports it.
"""
