"""corpusforge: text-corpus preparation as Spark DataFrame plans.

Every operator is a plain function ``DataFrame -> DataFrame`` (or a
``Column`` expression) built from Spark's own functions, so Catalyst
prunes, pushes down and code-generates the whole pipeline.
"""

from corpusforge.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
