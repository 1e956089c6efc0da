"""Which of many terms a text contains, in one pass over it whatever their number: an Aho-Corasick automaton for a block of questions' terms.

Defined cases: terms match as they are written, anywhere, also inside words and over each other; equal terms are one; the empty term is in every text that is not null; a null text contains nothing; no terms:
nothing is read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=4)
def automaton(terms: tuple[str, ...]):
    """Built once in each worker for a block of terms."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for number, term in enumerate(terms):
        if term:
            out.add_word(term, number)
    if len(out):
        out.make_automaton()
    return out


def contained(text: Column, terms: Sequence[str]) -> Column:
    """The numbers (from 0, sorted) of the ``terms`` that ``text`` contains."""
    own = tuple(terms)
    if not own:
        return F.array().cast("array<int>")
    number: dict[str, int] = {}
    for i, term in enumerate(own):
        number.setdefault(term, i)
    same = [number[t] for t in own]
    copies: dict[int, list[int]] = {}
    for i, first in enumerate(same):
        copies.setdefault(first, []).append(i)
    empty = copies.get(number.get("", -1), [])

    @F.arrow_udf("array<int>")
    def each(values: pa.Array) -> pa.Array:
        find = automaton(own)
        ends, out = [0], []
        for value in values:
            body = value.as_py()
            hits = set(empty) if body is not None else set()
            if body and len(find):
                for first in {n for _, n in find.iter(body)}:
                    hits.update(copies[same[first]])
            out.extend(sorted(hits))
            ends.append(len(out))
        return pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(out, pa.int32()))

    return each(text)
