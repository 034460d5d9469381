"""flagloom: scale-safe DataFrame operators for catalog-style tables.

Every operator is a plain ``DataFrame -> DataFrame`` function (use it with
``df.transform``) built from native Spark expressions, so Catalyst keeps
pushdown, pruning, partial aggregation and whole-stage codegen.

Sub-packages
------------
``sources``    readers, writers, output manifests, small tables
``functions``  column-expression helpers (names, predicates, scalars)
``operators``  cleaning, encoding, derived features, de-duplication,
               aggregation, reshaping, ranking, set operations, ML, metrics
``plans``      the query catalogue run on the driver tables and the composed
               clean -> features -> model paths
``streaming``  the stateless encode path applied to an incremental file source
"""

from flagloom.session import get_spark, scratch_path

__all__ = ["get_spark", "scratch_path"]
