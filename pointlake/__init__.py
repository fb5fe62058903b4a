"""pointlake: point clouds, meshes and the data around them as Spark DataFrames."""

__version__ = "0.1.0"
