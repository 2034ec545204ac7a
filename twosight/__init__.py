"""Decision-study analytics on Spark DataFrames.

``sources``    readers with declared schemas
``functions``  column expressions: missing-value rules, bins, recodes, p-values
``operators``  reusable DataFrame operators (summaries, ranks, tests, models, plot layers)
``plans``      the study-level analyses built from those operators
"""
