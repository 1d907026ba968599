from .bins import (equal_width_edges, fixed_bin, left_closed_bin, quantile_bin, right_closed_bin)
from .numbers import ratio, round_half_even
from .text import classify_content, normalize_text, parse_content

__all__ = ["classify_content", "equal_width_edges", "fixed_bin", "left_closed_bin",
           "normalize_text", "parse_content", "quantile_bin", "ratio", "right_closed_bin",
           "round_half_even"]
