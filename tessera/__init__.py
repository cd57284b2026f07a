"""tessera: a PySpark-native analytics engine for tiled-image mosaics.

Tiles, features, correspondences, overlap edges, poses, render chunks and
progress events are DataFrames; relational work is declared with the
DataFrame/SQL API and numeric kernels run as Arrow-batched numpy functions.
"""
