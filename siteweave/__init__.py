"""Scene-layout analytics over Spark tables of images, boxes, answers and plans."""

__version__ = "0.1.0"
