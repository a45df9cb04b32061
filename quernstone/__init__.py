"""Spark-native semantic chunking engine: every stage is a ``DataFrame -> DataFrame`` function."""

__version__ = "0.2.0"


def version_info() -> dict[str, str]:
    return {"version": __version__, "description": __doc__}
