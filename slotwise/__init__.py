"""Analytics over slot-aligned network event tables, as Spark DataFrame plans.

``sources``    reading event tables, newest row per key, stored results
``functions``  column expressions: labels, buckets, time parts, arrays
``operators``  DataFrame -> DataFrame building blocks
``plans``      the composed analyses and the catalogue that names them
"""
