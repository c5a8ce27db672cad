"""Reading and writing: libsvm text, CSV pixels and image cubes."""

from bandnet.sources.cube import (
    attach_labels,
    cube_cells,
    cube_to_pixels,
    pixel_lines,
    pixels_to_cube,
    write_pixels_csv,
)
from bandnet.sources.libsvm import csv_to_libsvm, features_to_libsvm, read_libsvm, read_pixel_csv, write_lines
from bandnet.sources.scratch import scratch_path

__all__ = [
    "attach_labels",
    "csv_to_libsvm",
    "cube_cells",
    "cube_to_pixels",
    "features_to_libsvm",
    "pixel_lines",
    "pixels_to_cube",
    "read_libsvm",
    "read_pixel_csv",
    "scratch_path",
    "write_lines",
    "write_pixels_csv",
]
