"""File formats of clouds and previews as Spark data sources."""

from .pos import PosDataSource
from .preview import PreviewDataSource


#: Says of a session that it knows the sources.
_KNOWN = "pointloom.sources.registered"


def register(spark) -> None:
    """Make spark.read.format("pos") and ("preview"), and their writers, known to a session."""
    if spark.conf.get(_KNOWN, None) is None:
        spark.dataSource.register(PosDataSource)
        spark.dataSource.register(PreviewDataSource)
        spark.conf.set(_KNOWN, "true")
