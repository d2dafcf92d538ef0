"""opinia: product-review analytics on PySpark.

Captured review pages (or exported review files) go in; typed, deduplicated
reviews, page/run/product metrics and exports come out.  Everything is a
DataFrame or Column expression except HTML reading (`operators.extract`) and
the bounded part of the ordered cross-page dedup (`operators.dedup`).
"""
