"""Readers and writers: grids made from tables, TIFF files, point shapefiles, statistics sidecars."""
