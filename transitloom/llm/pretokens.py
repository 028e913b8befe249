"""Cutting a text into chunks that a byte-level BPE treats independently.

The pre-token pattern of the vocabulary never crosses from a non-space into a space, and
only a single U+0020 may lead a word. So a text falls into chunks of an optional space and
a run of non-spaces, and into runs of white space; each chunk has the same pre-tokens alone
as within its text. Special strings are cut out before, as the tokenizers library does.
"""

from __future__ import annotations

import re

#: The code points with the Unicode property White_Space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
chunks = CHUNK.findall

#: A chunk that is longer is neither counted nor cached.
CACHED_CHARS = 48


def read_bytes(spark, path: str) -> bytes:
    """A vocabulary file's bytes; they are part of each job's closure or broadcast, so only the driver opens it."""
    with open(path, "rb") as file:
        return file.read()
