"""Unicode normal form C and full case folding as Columns.

Spark has neither. Texts that can't change are told apart in the JVM and stay there; only the others go to Python, in
Arrow batches. Nothing is shuffled, and no text is collected. (Arrow's own ``utf8_normalize`` decomposes under every form.)
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: All characters before this one stay in form C, in every text. The others are not told apart in the JVM: a class of all
#: that may change has 279 ranges, which cost a character more than the way to Python.
FIRST_UNSETTLED = 0x300


def changed(text: pa.Array, change: Callable[[str], str]) -> pa.Array:
    """``text`` with ``change`` made to what is not null: each distinct value once a batch."""
    if text.null_count == len(text):
        return text
    coded = text.dictionary_encode()
    return pa.array([change(x) for x in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


@F.arrow_udf(StringType())
def _composed(text: pa.Array) -> pa.Array:
    return changed(text, lambda x: unicodedata.normalize("NFC", x))


@F.arrow_udf(StringType())
def _folded(text: pa.Array) -> pa.Array:
    return changed(text, str.casefold)


def beyond_ascii(text: Column) -> Column:
    return F.octet_length(text) > F.length(text)


def unsettled(text: Column) -> Column:
    """Whether form C may change ``text``, told without Python."""
    return beyond_ascii(text) & text.rlike(rf"[^\x00-\x{{{FIRST_UNSETTLED - 1:x}}}]")


def nfc(text: Column) -> Column:
    """``text`` in Unicode normal form C; null is null."""
    return F.coalesce(_composed(F.when(unsettled(text), text)), text)


def fold_case(text: Column) -> Column:
    """``text`` without case, whole foldings included (ß is ss); null is null."""
    return F.coalesce(_folded(F.when(beyond_ascii(text), text)), F.lower(text))
