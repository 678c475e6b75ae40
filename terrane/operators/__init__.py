"""Spatial joins and nearest neighbours."""

from terrane.operators.join import deal, knn_join, spatial_join

__all__ = ["deal", "knn_join", "spatial_join"]
