"""BPE encoding with reuse of content-defined chunks, and decoding.

A rolling hash over the last ``RING`` bytes cuts texts where their content says
so; equal passages therefore give equal chunks wherever they stand, and a task
encodes each distinct chunk once (a cache of bounded size). A chunk's tokens
hold only between its first and its last white space, since the tokenizer's
pattern matches no white space. Joins are repaired: the piece from the last
white space on the left to the first on the right, across as many chunks as it
takes, is encoded anew, so that both ends stand at white space, where left and
right encodings agree with that of the whole text.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lattica.llm.textbytes import BASE, BYTE, U, Block, blocks, mix, powers, release

RING = 16
#: One position in 2**CUT_BITS is a cut.
CUT_BITS = 9
#: Bytes of chunks whose tokens a task keeps.
CACHE = 8 << 20
#: Words, and their bytes, whose tokens a task keeps before it starts anew.
WORDS, WORD_BYTES = 500_000, 16 << 20
_WHITE = b" \t\n\r\x0b\x0c"


def cuts(data: np.ndarray, bits: int = CUT_BITS) -> np.ndarray:
    """Positions where a chunk ends: only the ``RING`` bytes before decide; never inside a character."""
    if len(data) <= RING:
        return np.zeros(0, np.int64)
    total = np.zeros(len(data) + 1, np.uint64)
    # running value h[i] = h[i-1] * base + byte, so a window is a difference of two such values
    back = powers(pow(BASE, -1, 1 << 64), len(data) + 1)
    np.cumsum(BYTE[data] * back[1:], out=total[1:])
    window = (total[RING:] - total[:-RING]) * powers(BASE, len(data) + 1)[RING:]
    at = np.flatnonzero(mix(window) >> U(64 - bits) == 0) + RING
    at = at[at < len(data)]
    return at[(data[at] & 0xC0) != 0x80]


#: Texts whose tokens must be those of their words, one word after the other.
_PROBES = ("a b", "ab12 c-d", " a", "a ", "a  b", "hello  world!\t,x\r\n \x0b\x0cthe end. ", "\u00e9t\u00e9 \u4e2d\u6587 \u0301x a\u0301 \U0001f600 'll it's")


def _require_words(tok, path: str) -> None:
    """Refuse a tokenizer whose words, between ASCII white space, can't be encoded and decoded one by one.

    That is one with a decoder of its own, with added tokens that hold or take in white space, or one that gives a
    probing text other tokens than its words alone, as byte-level and prefix-space ones do.
    """
    if tok.decoder is not None:
        raise ValueError(f"{path}: a tokenizer with a decoder is not understood")
    for added in tok.get_added_tokens_decoder().values():
        if added.lstrip or added.rstrip or added.single_word or any(c.isspace() for c in added.content):
            raise ValueError(f"{path}: added token {added.content!r} depends on white space around it")
    white = _WHITE.decode()
    for text in [*_PROBES, *(f"x{w}y{w}{w}z" for w in white)]:
        whole = tok.encode(text, add_special_tokens=False).ids
        words = [w.decode() for w in text.encode().split()]
        if whole != [i for w in words for i in tok.encode(w, add_special_tokens=False).ids]:
            raise ValueError(f"{path}: a tokenizer whose tokens reach across white space is not understood")


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> tuple:
    """The tokenizer and its tokens by id, read once in a worker; one that is not understood is refused."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    _require_words(tok, path)
    vocab = tok.get_vocab(with_added_tokens=True)
    names = [""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        names[i] = token
    return tok, names


class Encoder:
    """Whole-text token counts, ids and tokens as space-joined strings; the caches hold ids."""

    def __init__(self, path: str, cache: int = CACHE):
        self.tok, names = _tokenizer(path)
        self.decimal = [str(i) for i in range(len(names))]
        self.names = dict(zip(self.decimal, names, strict=True))
        self.words: dict[bytes, str] = {}
        self.room, self.cache = cache, cache
        self.word_bytes = 0
        self.known: dict[bytes, str] = {}
        self.encoded = 0

    def _learn(self, pieces: set[bytes]) -> None:
        """Encode what is new: a chunk's words one by one, those met before from ``words``."""
        new = [(p, p.split()) for p in pieces if p not in self.known]
        words, decimal = self.words, self.decimal
        missing = list(set(chain.from_iterable([own for _, own in new])).difference(words))
        for i in range(0, len(missing), 4096):
            part = missing[i : i + 4096]
            found = self.tok.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            for w, e in zip(part, found, strict=True):
                words[w] = " ".join([decimal[i] for i in e.ids])
                self.word_bytes += len(w)
        self.encoded += len(missing)
        for p, own in new:
            self.known[p] = " ".join(filter(None, map(words.__getitem__, own)))
            self.room -= len(p)

    def pieces(self, chunks: list[bytes]) -> list[bytes]:
        """Pieces of one text that start and end at white space: chunk cores and repaired joins."""
        out: list[bytes] = []
        carry: list[bytes] = []
        for chunk in chunks:
            core = chunk.split(None, 1)
            if len(core) < 2 and not (chunk[:1] in _SPACES or chunk[-1:] in _SPACES):
                carry.append(chunk)  # no white space: the join goes on
                continue
            if chunk[:1] in _SPACES:
                head, rest = b"", chunk
            else:
                head, rest = core[0], core[1] if len(core) == 2 else b""
            if carry or head:
                out.append(b"".join([*carry, head]))
            if rest[-1:] in _SPACES or not rest:
                core, carry = rest, []
            else:
                last = rest.rsplit(None, 1)
                core, carry = (last[0], [last[1]]) if len(last) == 2 else (b"", [last[0]])
            if core:
                out.append(core.strip(_WHITE))
        if carry:
            out.append(b"".join(carry))
        return out

    def block(self, block: Block) -> list[tuple[int, str, str]]:
        data, bounds = block.data.tobytes(), block.offsets
        ends = np.union1d(cuts(block.data), bounds)
        texts = []
        for t in range(block.n):
            a, b = bounds[t], bounds[t + 1]
            own = ends[np.searchsorted(ends, a) : np.searchsorted(ends, b, "right")].tolist()
            texts.append(self.pieces([data[x:y] for x, y in zip(own[:-1], own[1:], strict=True)]))
        if self.room < 0:
            self.known = {}
            self.room = self.cache
        if len(self.words) > WORDS or self.word_bytes > WORD_BYTES:
            self.words, self.word_bytes = {}, 0
        self._learn({p for text in texts for p in text})
        known, names = self.known, self.names
        out = []
        for text in texts:
            ids = " ".join(filter(None, map(known.__getitem__, text)))
            split = ids.split()
            out.append((len(split), ids, " ".join(map(names.__getitem__, split))))
        return out


_SPACES = {bytes([b]) for b in _WHITE}


def _encoded(docs: DataFrame, path: str, schema: str, types: list[pa.DataType], row) -> DataFrame:
    _tokenizer(path)  # one that is not understood is refused before a task starts

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(path)  # its caches go with the task
        yield from encoded(own, batches)
        del own
        release()

    def encoded(own: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                cols = list(zip(*[row(*x) for x in own.block(block)], strict=True))
                ids = batch.column(0).slice(block.first, block.n).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, cols, types)], [c.split()[0] for c in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(work, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)`` per row: token ids of the whole text (null: empty) and the text they decode to.

    Texts of any length count whole, one word of megabytes as well. Each of
    several equal rows is encoded, a null doc_id stays null, an empty table
    gives no rows; other columns are ignored, whatever their names. Tokenizers
    whose words between white space can't be encoded alone (byte-level ones,
    those with a decoder) are refused with a ValueError.
    """

    def row(n: int, ids: str, tokens: str) -> tuple:
        return n, [int(i) for i in ids.split()], tokens

    return _encoded(docs, path, "doc_id long, n_tokens long, ids array<int>, decoded string", [pa.int64(), pa.list_(pa.int32()), pa.string()], row)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``encode`` with SHA-256 digests in place of ids (decimal, joined by a space) and decoded text."""

    def row(n: int, ids: str, tokens: str) -> tuple:
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(tokens.encode()).hexdigest()

    return _encoded(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.string(), pa.string()], row)
