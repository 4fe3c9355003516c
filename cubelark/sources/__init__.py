"""Collections of data: registration, resolution of inputs, cached regions and sinks."""

from cubelark.sources.catalog import Catalog, Collection

__all__ = ["Catalog", "Collection"]
