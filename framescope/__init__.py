"""framescope: measure how well a corpus covers a framework of named parameters, on Spark.

Every operator takes and returns DataFrames. Sub-packages:

* ``functions``  -- Column expressions (sentence split, tokens, vector maths).
* ``operators``  -- DataFrame -> DataFrame operators (search, adherence, codes,
  coverage, terms, statistics) plus the size-checked broadcast guard.
* ``sources``    -- readers and writers (CSV metadata, framework JSON/CSV,
  folders of text files, review tables).
* ``plans``      -- the named queries over the driver's test tables and
  their DuckDB oracle SQL.
* ``streaming``  -- the extraction operator applied to documents that arrive
  as files, one micro-batch at a time.
"""

__version__ = "0.1.0"
