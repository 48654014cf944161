"""Tokens of whole Arrow columns, for code inside tasks."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Whitespace of str.split() that is not ASCII, and the bytes of its ASCII part that Arrow does not split at.
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SEPARATORS = str.maketrans("\x1c\x1d\x1e\x1f", "    ")


def blank_rows(texts: list[str | None]) -> pa.Array:
    """The texts with every whitespace character of ``str.split()`` as one that :func:`split_rows` splits at; null is empty."""
    out = []
    for text in texts:
        text = text or ""
        if not text.isascii():
            text = _WIDE.sub(" ", text)
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            text = text.translate(_SEPARATORS)
        out.append(text)
    return pa.array(out, pa.string())


def split_rows(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Tokens between ASCII whitespace of a column without nulls, and the row of each."""
    lists = pc.ascii_split_whitespace(texts)
    tokens = lists.flatten()
    rows = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    whole = pc.not_equal(pc.binary_length(tokens), 0)
    return tokens.filter(whole), rows[whole.to_numpy(zero_copy_only=False)]
