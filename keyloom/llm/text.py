"""Helpers shared by the text operators: words and bounded batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.plans.storage import forget, remove, shared_folder, stable

__all__ = ["ascii_words", "by_size", "crc_mod", "forget", "one_thread", "remove", "shared_folder", "squeezed", "stable", "text_blocks", "word_lists"]

#: Lower-cases A-Z and leaves every other byte of UTF-8 as it is.
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

#: Runs of white space other than one plain space; replacing these by one space
#: gives the same as replacing every run.
ODD_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8.

    ``bytes.split()`` splits at exactly these six bytes.  None counts as empty.
    """
    return (text or "").encode("utf-8", "replace").translate(ASCII_LOWER).split()


def word_lists(texts: pa.Array) -> pa.ListArray:
    """The same words of each text, and after them an empty one for its end; null counts as empty.

    Arrow takes the same six bytes for white space and lower-cases no others.
    """
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    return pc.ascii_split_whitespace(pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(texts, "", " ")))


def squeezed(text: Column) -> Column:
    """The text with each run of ``[\\x20\\x09-\\x0D]`` as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), ODD_SPACE, " ")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written in decimal, modulo n; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


@cache
def one_thread() -> None:
    """Lets numpy's products run in the calling thread.

    Products here are small: more threads only wait for each other, and a task
    has its share of the cores already.  Where numpy brings another library,
    nothing changes.
    """
    for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def by_size(items: Iterator, weight, most: int) -> Iterator[list]:
    """Lists of consecutive items whose weights sum to about ``most``."""
    held, total = [], 0
    for item in items:
        held.append(item)
        total += weight(item)
        if total >= most:
            yield held
            held, total = [], 0
    if held:
        yield held


def text_blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of consecutive rows whose texts (column text) have about ``most`` tokens, of five characters each and an end."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 5 + 1)
        start = done = 0
        while start < len(sizes):
            end = int(np.searchsorted(sizes, done + most - total)) + 1
            held.append(batch.slice(start, end - start))
            if end > len(sizes):
                total += int(sizes[-1]) - done
                break
            yield pa.concat_batches(held)
            held, total, start, done = [], 0, end, int(sizes[end - 1])
    if held:
        yield pa.concat_batches(held)
