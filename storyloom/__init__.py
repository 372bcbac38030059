"""storyloom: news intelligence on Spark DataFrames.

Landed articles are normalised, de-duplicated, clustered into events, checked
for source independence and numeric conflicts, scored on five axes and served
as ranked feeds.  Every operator is ``DataFrame -> DataFrame`` or
``Column -> Column``; all times are relative to an explicit ``as_of``.
"""

__version__ = "0.1.0"
