"""Training-data operators: URL filter, substring and line dedup, mixing,
exact top-k search, HTML extraction, learned quality rules, BPE, token counts
and SimHash near-dedup.  Nothing else in the library imports this package.
"""
