"""Plug-ins by name: clusterings, reductions, stream codecs."""

from __future__ import annotations

from ..functions.bytes import register_codec
from ..operators import cluster
from ..operators.embed import register_method

#: name -> fn(tensor, quality, cluster_size) -> covering
CLUSTERINGS = {
    "monolithic": cluster.monolithic,
    "by_index": cluster.by_index,
    "kmeans": cluster.kmeans,
    "pca_kmeans": cluster.pca_kmeans,
    "first_axis": cluster.first_axis,
    "last_axis": cluster.last_axis,
    "near_quaternions": cluster.near_quaternions,
    "static_first": cluster.static_first,
    "static_monolithic": lambda t, quality, size: cluster.static_first(t, quality, size, cluster.monolithic),
}


def register_clustering(name: str, fn) -> None:
    if name in CLUSTERINGS and CLUSTERINGS[name] is not fn:
        raise ValueError(f"{name} is taken")
    CLUSTERINGS[name] = fn


__all__ = ["CLUSTERINGS", "register_clustering", "register_codec", "register_method"]
