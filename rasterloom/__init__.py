"""A PySpark-native engine for rasters, segmentation masks and the corpora around them."""
