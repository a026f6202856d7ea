"""Byte-level BPE by the tiktoken library: ids of whole texts from a local rank file, and the raw bytes of ids."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_texts, prepare

#: The pattern whose safe boundaries are known (fixed value).
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the pattern's ``\s`` has it (fixed value); Python's own class has four more.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Code points after which a text is cut at the next safe boundary.
CHUNK = 1 << 16
#: White space that goes on so long is a match of its own; the library's matcher would run out of stack on a million.
LONG_SPACE = 1 << 12

#: Places where a match of the pattern ends whatever stands before and after: before white space, since no match has white
#: space after another character; and between a letter or digit and ASCII or CJK punctuation, since none holds these in
#: this order. Apart from white space only characters are named whose class no Unicode version has changed.
_WORD = "0-9A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5"
_MARK = "!-/:-@\\[-`{-~、。！，：；？"
SAFE = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])|(?<=[{_WORD}])(?=[{_MARK}])")
_LONG = re.compile(f"[{SPACE}]{{{LONG_SPACE},}}")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of byte strings: a line has the base64 of the bytes and the rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def safe_parts(text: str) -> Iterator[tuple[str, bool]]:
    """The parts of a text whose ids follow one another as those of the whole text, each with whether it is one match.

    White space of LONG_SPACE and more is a match without its last character (with it at the text's end), as the pattern
    leaves that one to what follows. What lies between is cut at the first safe boundary after each CHUNK.
    """
    at = 0
    for run in _LONG.finditer(text) if len(text) >= LONG_SPACE else ():
        end = run.end() - (run.end() < len(text))
        yield from ((x, False) for x in _cut(text, at, run.start()))
        yield text[run.start() : end], True
        at = end
    yield from ((x, False) for x in _cut(text, at, len(text)))


def _cut(text: str, at: int, end: int) -> Iterator[str]:
    while end - at > CHUNK and (found := SAFE.search(text, at + CHUNK, end)):
        yield text[at : found.start()]
        at = found.start()
    if at < end:
        yield text[at:end]


class ByteBPE:
    """The library's encoding of one rank file, without special tokens.

    A file with another pattern than KNOWN_PATTERN may be given; texts are then encoded in one go, since nothing is
    known of its boundaries.
    """

    def __init__(self, path: str, pattern: str = KNOWN_PATTERN):
        import tiktoken

        self.library = tiktoken.Encoding(path.rsplit("/", 1)[-1], pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
        self.known = pattern == KNOWN_PATTERN

    def parts(self, text: str | None) -> Iterator[list[int]]:
        """Ids of a text, part by part, so that a text of any length needs the memory of a part."""
        if not text:
            return
        if not self.known or len(text) < LONG_SPACE:
            yield self.library.encode_ordinary(text)
        else:
            for part, single in safe_parts(text):
                yield self.library._encode_single_piece(part) if single else self.library.encode_ordinary(part)

    def encode(self, text: str | None) -> list[int]:
        return [i for part in self.parts(text) for i in part]

    def decode(self, ids: list[int]) -> bytes:
        """The raw bytes of ids; they need not be whole characters. An id without a rank raises KeyError."""
        return self.library.decode_bytes(ids)


_ENCODINGS: dict[tuple[str, str], ByteBPE] = {}


def encoding_of(path: str, pattern: str = KNOWN_PATTERN) -> ByteBPE:
    """A worker's encoding; a task reads the rank file only if its worker has not."""
    if (path, pattern) not in _ENCODINGS:
        _ENCODINGS[path, pattern] = ByteBPE(path, pattern)
    return _ENCODINGS[path, pattern]


def encoded(docs: DataFrame, path: str | None = None, pattern: str = KNOWN_PATTERN) -> DataFrame:
    """(doc_id, ids array<int>) of every text. Null and empty texts have no ids; rows of one doc_id and rows without
    one stay rows of their own; very long texts are encoded part by part; further columns are not read."""
    path = path or default_path()
    prepare(docs.sparkSession)

    def make():
        bpe = encoding_of(path, pattern)
        return lambda doc_ids, texts: (doc_ids, [bpe.encode(t) for t in texts])

    return map_texts(_rows(docs), "doc_id long, ids array<int>", make, ["doc_id", "text"])


def decoded(rows: DataFrame, path: str | None = None, pattern: str = KNOWN_PATTERN) -> DataFrame:
    """(doc_id, bytes binary) of rows with ids. Null ids give null, no ids empty bytes; so do null for an id, or one that has no rank."""
    path = path or default_path()
    prepare(rows.sparkSession)

    def make():
        bpe = encoding_of(path, pattern)
        top = bpe.library.max_token_value

        def of(ids):
            if ids is None or any(i is None or not 0 <= i <= top for i in ids):
                return None
            try:
                return bpe.decode(ids)
            except KeyError:
                return None

        return lambda doc_ids, lists: (doc_ids, [of(ids) for ids in lists])

    return map_texts(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), "doc_id long, bytes binary", make, ["doc_id", "ids"])


def round_trip(docs: DataFrame, path: str | None = None, pattern: str = KNOWN_PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded, part by part.

    The digests are those of the ids as little-endian unsigned 32-bit integers and of the decoded bytes, in lowercase
    hex. Null and empty texts have no ids and the digest of nothing; rows of one doc_id and rows without one stay rows
    of their own; an empty table gives no rows; further columns are not read.
    """
    path = path or default_path()
    prepare(docs.sparkSession)

    def make():
        bpe = encoding_of(path, pattern)

        def of(text):
            n, ids_sha, bytes_sha = 0, hashlib.sha256(), hashlib.sha256()
            for ids in bpe.parts(text):
                n += len(ids)
                ids_sha.update(np.array(ids, dtype="<u4").tobytes())
                bytes_sha.update(bpe.decode(ids))
            return n, ids_sha.hexdigest(), bytes_sha.hexdigest()

        return lambda doc_ids, texts: (doc_ids, *(list(x) for x in zip(*map(of, texts))))

    return map_texts(_rows(docs), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make, ["doc_id", "text"])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
