"""Column expressions: everything here stays in the JVM."""

from pairscreen.functions.hashing import hash_uniform
from pairscreen.functions.lists import clip_contacts_expr, contact_cells_expr, transpose_contacts
from pairscreen.functions.losses import bce_logits, cross_entropy, focal_cell, temperature
from pairscreen.functions.names import basename, clean_name, pair_name, percent_done
from pairscreen.functions.numbers import composite_key, floor_median, pair_key, shift_index
from pairscreen.functions.vectors import inner_product, l2_normalise, multihead_logit, sigmoid

__all__ = [
    "basename",
    "bce_logits",
    "clean_name",
    "clip_contacts_expr",
    "composite_key",
    "contact_cells_expr",
    "cross_entropy",
    "floor_median",
    "focal_cell",
    "hash_uniform",
    "inner_product",
    "l2_normalise",
    "multihead_logit",
    "pair_key",
    "pair_name",
    "percent_done",
    "shift_index",
    "sigmoid",
    "temperature",
    "transpose_contacts",
]
