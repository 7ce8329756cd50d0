"""Images, matrices, keypoints and frames as Spark tables.

A pixel table has the columns ``img, y, x, c, v``: one row for each element of each matrix. Operators take and
return DataFrames; Catalyst plans them. ``types`` has depths and casts, ``sources`` makes pixel tables,
``operators`` holds the operators, ``plans`` the registered queries, ``streaming`` operators over frame streams.
"""

__version__ = "0.1.0"
