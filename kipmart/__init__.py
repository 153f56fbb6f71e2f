"""kipmart — commerce analytics (sales, profit, pre-order, catalogue, order and
cart jobs) expressed as Spark DataFrame plans.

Every public function takes DataFrames (or a :class:`~kipmart.sources.tables.Shop`
namespace of them) and returns a lazy DataFrame. No function collects to the
driver or calls a Python UDF; the numbering helpers cut lineage by writing an
intermediate table under ``spark.checkpoint.dir``.
"""

from kipmart.session import build_session, ensure_checkpoint_dir  # noqa: F401

__all__ = ["build_session", "ensure_checkpoint_dir"]
