"""funnelworks: product analytics over nested clickstream events, on Spark.

Operators are ``DataFrame -> DataFrame`` functions. Sub-packages:

* ``sources``   - event scans, declared schemas, fixture adapters, sinks
* ``functions`` - column expressions (event params, safe division, weeks, normal p-values)
* ``operators`` - intermediate models and distributed building blocks (global tiles)
* ``plans``     - marts, findings, data-quality checks, experiment analysis, extracts, build
* ``streaming`` - incremental staging of newly landed event partitions
"""

from funnelworks.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
