"""seedspread: semi-supervised label propagation over kNN graphs, batch and streaming, on Spark.

Operators are plain functions ``DataFrame -> DataFrame``:

* ``sources``    -- point loaders (id, x array<double>, label), text/paired readers, run store
* ``functions``  -- column expressions: distances, weights, hash order keys, distribution maths
* ``operators``  -- sampling, kNN joins, graph building, propagation, prediction, metrics, sweeps
* ``streaming``  -- Structured Streaming learner with versioned state
* ``plans``      -- the named queries run over the test tables
"""

__version__ = "0.1.0"
