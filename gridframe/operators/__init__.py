"""Frames, series, groups, indexes and positional rows."""

from .frame import Frame
from .groupby import GroupedFrame
from .index import cartesian_indices, decode, encode, from_arrays, from_product, range_index, repeat_indices, tile_indices, unique
from .index_objects import Index, MultiIndex, RangeIndex
from .positional import slice_rows, with_row_ids
from .series import Series

__all__ = [
    "Frame", "GroupedFrame", "Index", "MultiIndex", "RangeIndex", "Series", "cartesian_indices", "decode", "encode", "from_arrays", "from_product",
    "range_index", "repeat_indices", "slice_rows", "tile_indices", "unique", "with_row_ids",
]
