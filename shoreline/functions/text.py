"""String expressions with the report pipeline's semantics.

All helpers return a ``Column`` built from Spark's own expressions, so they
stay inside whole-stage codegen and can be used inside higher-order
functions (``transform``) as well as in ``select``/``withColumn``.

Semantics that differ from the obvious Spark call:

* ``replace_first`` replaces the *first* match only (``regexp_replace``
  replaces every match).
* ``trim_unicode`` trims every Unicode white-space character (``trim``
  trims only the space character).
* ``na_text`` renders SQL NULL as the text ``"NA"``; it is the only place a
  NULL turns into text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Characters that make a pattern a regular expression rather than a literal.
_REGEX_META = set(".^$*+?()[]{}|\\")


def col_of(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_literal_pattern(pattern: str) -> bool:
    return not any(ch in _REGEX_META for ch in pattern)


def quote_regex(text: str) -> str:
    """Java ``Pattern.quote``: the text matched literally."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def quote_replacement(text: str) -> str:
    """Java ``Matcher.quoteReplacement``: ``$`` and ``\\`` taken literally."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def _shift_groups(pattern: str, replacement: str) -> tuple[str, str]:
    # The first-match rewrite puts a (named) prefix group, number 1, and the
    # whole pattern, number 2, in front of the caller's groups, so numbered references move up by
    # two and ``$0`` (the whole match of the pattern) becomes ``$2``.
    pattern = re.sub(r"(?<!\\)((?:\\\\)*)\\([1-9])",
                     lambda m: f"{m.group(1)}\\{int(m.group(2)) + 2}", pattern)
    replacement = re.sub(r"(?<!\\)((?:\\\\)*)\$([0-9])",
                         lambda m: f"{m.group(1)}${int(m.group(2)) + 2}", replacement)
    return pattern, replacement


def replace_first(c: ColumnOrName, pattern: str, replacement: str,
                  literal: bool | None = None) -> Column:
    """Replace the first match of ``pattern`` in ``c``; NULL stays NULL.

    ``pattern`` is a Java regex and ``$n`` in ``replacement`` refers to its
    groups.  ``literal=True`` matches and inserts both texts as they are;
    ``None`` treats a pattern without regex metacharacters as literal (same
    result either way).

    One ``regexp_replace`` whose pattern is anchored at the start with a lazy
    prefix: the shortest prefix after which the pattern matches, i.e. the
    leftmost match, is kept and the rest of the text is untouched.  The
    input is referenced once, so a chain of k replacements is an expression
    of size k (not 3^k as with instr/overlay), which matters inside
    higher-order functions where no subexpression is shared.
    """
    if not pattern:
        raise ValueError("empty pattern")
    if literal is None:
        literal = is_literal_pattern(pattern)
    if literal:
        pattern, replacement = quote_regex(pattern), quote_replacement(replacement)
    else:
        pattern, replacement = _shift_groups(pattern, replacement)
    # The prefix is a named group: "${name}" cannot run into a replacement
    # that starts with a digit (Java reads "$1" + "0" as group 10 if it exists).
    return F.regexp_replace(col_of(c), F.lit(f"(?s)\\A(?<shorelinepre>.*?)({pattern})"),
                            F.lit("${shorelinepre}" + replacement))


def recode_chain(c: ColumnOrName, pairs: Iterable[tuple[str, str]]) -> Column:
    """Apply ``replace_first`` for each (pattern, replacement) in order.

    The chain is applied once; it is not idempotent (a value already
    replaced can be matched by a later or a repeated entry).
    """
    return reduce(lambda acc, pr: replace_first(acc, pr[0], pr[1]), list(pairs), col_of(c))


def trim_unicode(c: ColumnOrName) -> Column:
    """Strip leading and trailing Unicode white space (incl. NBSP, tabs)."""
    return F.regexp_replace(col_of(c), F.lit(r"(?U)\A\s+|\s+\z"), F.lit(""))


def na_text(c: ColumnOrName) -> Column:
    """NULL rendered as the text ``"NA"``; other values cast to string."""
    return F.coalesce(col_of(c).cast("string"), F.lit("NA"))


def split_tokens(c: ColumnOrName, sep: str = ",") -> Column:
    """Split a delimited list into an array, keeping empty parts.

    A NULL list becomes a one-element array holding NULL, so exploding it
    keeps the row (the value stays missing) and its size is 1.
    """
    sep_re = quote_regex(sep) if not is_literal_pattern(sep) else sep
    return F.coalesce(F.split(col_of(c), sep_re, -1), F.array(F.lit(None).cast("string")))


def utf16_key(c: ColumnOrName) -> Column:
    """Sort key that orders texts by their UTF-16 code units, as browsers do (Spark orders by
    code points)."""
    return F.encode(col_of(c), "UTF-16BE")
