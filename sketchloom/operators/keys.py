"""Keys of Arrow batches as numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class _Fields(dict):
    """A struct's fields, which Arrow takes as they are, as part of a key."""

    def __hash__(self) -> int:
        return hash(tuple(self.items()))


def _hashable(v):
    if isinstance(v, dict):
        return _Fields((k, _hashable(x)) for k, x in v.items())
    return tuple(map(_hashable, v)) if isinstance(v, list) else v


def key_codes(columns: list[pa.Array], rows: int) -> tuple[np.ndarray, list[tuple]]:
    """Each row's key as a number from 0, and the keys by these numbers. NULLs are a key like others."""
    if not columns:
        return np.zeros(rows, np.int64), [()] if rows else []
    if any(pa.types.is_nested(c.type) for c in columns):
        rows_ = [tuple(map(_hashable, k)) for k in zip(*(c.to_pylist() for c in columns))]
        seen = {k: i for i, k in enumerate(dict.fromkeys(rows_))}
        return np.array([seen[k] for k in rows_], np.int64), list(seen)
    code = np.zeros(rows, np.int64)
    for c in columns:
        d = c if pa.types.is_dictionary(c.type) else c.dictionary_encode(null_encoding="encode")
        code = np.unique(code * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    take = pa.array(first)
    return code, list(zip(*(c.take(take).to_pylist() for c in columns)))
