"""Shared helpers: intermediate tables in the shared folder, connected components (from the core), cached word tokenisation."""

from __future__ import annotations

import functools
import json
import os
import re
from array import array

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.components import connected_components as connected_components
from ..sources.tables import cut as cut

#: ASCII white space as the contracts state it; the same set that bytes.split() splits at.
WHITE = r"[\x20\x09-\x0D]+"
WHITE_CHARS = " \t\n\x0b\x0c\r"


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies; the package that holds it must be on each machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: How the tokenizer file states its pre-tokeniser, and the parts of words for which that is done here:
#: runs of lower-case Latin letters, single digits, and runs of ASCII signs without ' and < (contractions, control strings).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS = "[a-zß-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįıĵķĺļľłńņňōŏőœŕŗřśŝşšţťŧũūŭůűųŵŷźżž]+"
PARTS = re.compile(LETTERS + r"|[0-9]|[!-&(-/:;=-@[-`{-~]+")
ONE_PART = re.compile(LETTERS)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the others
    get the code points from 256 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@functools.cache
def splits_parts(path: str) -> bool:
    """Whether a tokenizer file's pre-tokeniser splits words as PARTS does; read on the driver, so that no task parses it."""
    with open(path, encoding="utf-8") as f:
        steps = (json.load(f)["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    return steps[0].get("pattern", {}).get("Regex") == SPLIT


class Recent:
    """A cache of what was met lately: when the newer half holds `most` entries the older one goes, and what is met again
    moves to the newer one. Keys of over LONGEST characters are worked out each time, so its size has a bound."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def keep(self, key: bytes | str, value):
        if len(key) <= LONGEST:
            if len(self.new) >= self.most:
                self.old, self.new = self.new, {}
            self.new[key] = value
        return value


LONGEST = 48


class WordTokenizer:
    """Subword ids of whole texts from ids of their words.

    For a tokenizer whose normaliser and pre-tokeniser never join what ASCII white space parts (the white space itself
    is dropped), the ids of a text are the ids of its words in order. Ids of words, and of parts of words where the
    tokenizer splits as PARTS does, are kept in two caches; an entry takes some 200 bytes, 500 at most."""

    def __init__(self, path: str, splits: bool, most: int = 120_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.model, self.splits = tokenizer.encode, tokenizer.model, splits
        self.known, self.parts = Recent(most), Recent(most // 2)
        self.letters = byte_letters()

    def part_ids(self, part: str) -> list[int]:
        text = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
        return [t.id for t in self.model.tokenize(text)]

    def part(self, part: str) -> bytes:
        found = self.parts.old.get(part)
        return self.parts.keep(part, array("I", self.part_ids(part)).tobytes() if found is None else found)

    def parts_of(self, text: str) -> list[str] | None:
        """The parts of a word; None where the tokenizer must split it itself."""
        if self.splits and ONE_PART.fullmatch(text):
            return [text]
        small = text.lower()
        if self.splits and len(small) == sum(map(len, parts := PARTS.findall(small))):
            return parts
        return None

    def fresh(self, word: bytes) -> bytes:
        """Ids of a word as unsigned 32-bit numbers; only those of its parts are kept."""
        text = word.decode("utf-8", "replace")
        parts = self.parts_of(text)
        if parts is None:
            return array("I", self.encode(text, add_special_tokens=False).ids).tobytes()
        get, part = self.parts.new.get, self.part
        return b"".join([get(p) or part(p) for p in parts])

    def word(self, word: bytes) -> bytes:
        found = self.known.old.get(word)
        return self.known.keep(word, self.fresh(word) if found is None else found)

    def ids(self, text: bytes) -> bytes:
        get, word = self.known.new.get, self.word
        return b"".join([x if (x := get(w)) is not None else word(w) for w in text.split()])


_TOKENIZERS: dict[tuple, WordTokenizer] = {}


def word_tokenizer(path: str, splits: bool, most: int = 120_000) -> WordTokenizer:
    """One per Python worker and file; that of another file makes room for it. splits is splits_parts(path), `most` the
    entries of its caches' halves."""
    if (path, most) not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[path, most] = WordTokenizer(path, splits, most)
    return _TOKENIZERS[path, most]


def give_back() -> None:
    """Hands memory that this worker no longer uses back to the system: Spark keeps workers for the tasks to come."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def has_tokenizers() -> bool:
    """Whether this worker holds a tokenizer and its caches."""
    return bool(_TOKENIZERS)


def start_afresh() -> None:
    """Drops the tokenizer and its caches that an earlier stage may have left in this worker."""
    _TOKENIZERS.clear()
    give_back()
