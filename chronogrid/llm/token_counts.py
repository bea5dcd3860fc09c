"""Token counts by overlap resynchronisation.

A text up to ``chunk_chars`` is encoded at once. A longer one is read in chunks
that overlap: each chunk is encoded with the byte offsets of its tokens, and two
neighbours are spliced at a place in their overlap where both have a token
boundary and which is *stable*: the character before is a letter, digit or sign
and the one after is white space. No pattern of the pre-tokenizer matches white
space after another character, and none looks behind, so the text before and
after such a place is encoded independently. Where an overlap holds no such
place, the overlap is widened until it has one or the text ends. Memory is
bounded by a chunk and its overlaps, not by the document.

The 50k vocabulary comes as a ``tokenizers`` file and, the same, as ranks; the
ranks give the same ids at four times the speed (tests hold them against
``tokenizers``). The end-of-text string inside a text is one token, as there.

Cases: null or empty text: 0 tokens; a null id stays; repeated rows each get
their row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import END_OF_TEXT, END_OF_TEXT_ID, encoder, id_text, per_batch, ranks_of, vocabulary_path

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks int, n_widened int"
STABLE = re.compile(r"(?<=\S)(?=[ \t\n\r])")  # white space to every engine, after what is none to any


def token_lengths(path: str) -> np.ndarray:
    """Bytes of each token id."""
    ranks = ranks_of(path)
    out = np.zeros(max(max(ranks.values()), END_OF_TEXT_ID) + 1, np.int64)
    for token, k in ranks.items():
        out[k] = len(token)
    out[END_OF_TEXT_ID] = len(END_OF_TEXT)
    return out


class ChunkedEncoder:
    """Encodes a long text chunk by chunk; ``spliced`` yields the ids between splice points."""

    def __init__(self, path: str, chunk_chars: int = 32768, overlap_chars: int = 256):
        self.encode = encoder(path).encode_to_numpy
        self.lengths = token_lengths(path)
        self.chunk, self.overlap = chunk_chars, overlap_chars

    def ids(self, text: str) -> np.ndarray:
        return self.encode(text, allowed_special="all")

    def bounds(self, ids: np.ndarray) -> np.ndarray:
        """Byte offsets at which tokens end."""
        return np.cumsum(self.lengths[ids])

    def splice(self, text: str, at: int, end: int, left: np.ndarray, start: int, right: np.ndarray) -> tuple[int, int, int] | None:
        """The last common stable boundary in text[start:end].

        left: token ends of text[at:end]; right: of text[start:...]. Returns the
        char and the number of tokens before it on the left and on the right.
        """
        window = text[start:end]
        left_base = len(text[at:start].encode())
        for m in reversed([m.start() for m in STABLE.finditer(window)]):
            if not m:
                continue  # the character before it is outside the overlap
            in_window = len(window[:m].encode())
            i = int(np.searchsorted(left, left_base + in_window))
            j = int(np.searchsorted(right, in_window))
            if i < len(left) and j < len(right) and left[i] == left_base + in_window and right[j] == in_window:
                return start + m, i + 1, j + 1
        return None

    def spliced(self, text: str):
        """Yield (ids, widened) pieces whose concatenation is the encoding of the text."""
        at, ids, end = 0, None, min(len(text), self.chunk)
        skip, widened = 0, 0
        ids = self.ids(text[at:end])
        while end < len(text):
            overlap = self.overlap
            while True:
                start = max(at, end - overlap)
                stop = min(len(text), end + self.chunk)
                if start == at:  # no stable place in the whole chunk: double it
                    end = min(len(text), at + 2 * (end - at))
                    ids = self.ids(text[at:end])
                    widened += 1
                    found = None
                    break
                nxt = self.ids(text[start:stop])
                found = self.splice(text, at, end, self.bounds(ids), start, self.bounds(nxt))
                if found:
                    break
                overlap *= 4
                widened += 1
            if found:
                _, before, dropped = found
                yield ids[skip:before], widened
                at, ids, end, skip, widened = start, nxt, stop, dropped, 0
        yield ids[skip:], widened


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = 1024, chunk_chars: int = 32768, overlap_chars: int = 256) -> DataFrame:
    """Tokens of every text; one row per input row."""
    path = vocabulary or vocabulary_path("byte_bpe_50k.tiktoken")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = ChunkedEncoder(path, chunk_chars, overlap_chars)
        rows: list[tuple] = []
        for text in batch.column(1).to_pylist():
            n = chunks = widened = 0
            for ids, w in enc.spliced(text):
                n, chunks, widened = n + len(ids), chunks + 1, widened + w
            rows.append((len(text.encode()), n, n > limit, chunks, widened))
        cols = list(zip(*rows))
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks", "n_widened"])

    return per_batch(id_text(df, id_col, text_col), count, SCHEMA)
