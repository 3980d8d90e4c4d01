"""Training-data operators: deduplication, runs, tries, quality, decontamination, packing.

Nothing outside this package imports it.  Every operator takes a DataFrame and
column names, projects the columns it needs under private names (so extra or
clashing columns are harmless) and returns a lazily evaluated DataFrame.
"""
