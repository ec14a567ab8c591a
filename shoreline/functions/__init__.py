"""Column expressions: text recoding, NA handling and safe arithmetic."""

from shoreline.functions.arith import count_equal, ieee_divide, na_sum, sum_or_zero
from shoreline.functions.text import (
    col_of,
    na_text,
    quote_regex,
    quote_replacement,
    recode_chain,
    replace_first,
    split_tokens,
    trim_unicode,
)

__all__ = [
    "col_of", "count_equal", "ieee_divide", "na_sum", "na_text", "quote_regex",
    "quote_replacement", "recode_chain", "replace_first", "split_tokens", "sum_or_zero",
    "trim_unicode",
]
