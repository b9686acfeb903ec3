"""Byte-level BPE by longest matches and backtracking.

An automaton over the vocabulary (bytes read as Latin-1) gives the longest token at
a place. A token may follow another one only if the merges, run on the two tokens'
bytes, would leave exactly this border; that answer is memoised for each pair. Where
no token fits, the encoder steps back and marks the place as dead, so that each
place is left at most once and the work stays linear in the text.

Texts are first cut by the public pattern; pieces that recur keep their ids in a
cache of bounded size.

Cases: a null text counts as empty (no ids); a null identifier stays null; repeated
rows each give a row; an empty table gives an empty result; only doc_id and text are
read. A long text is read piece by piece, so that no list of all its pieces is held.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from wakeline.llm.common import id_text, text_batches, tokenizer_file

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHE_PIECES = 300_000
STREAM_CHARS = 2_000_000
# White space as the library's engine reads it; Python's own class also holds U+001C to U+001F.
_WHITE = r"\t-\r \x85\xa0  -     　"


def piece_pattern():
    import public_tokenizers
    import regex

    inside = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^{_WHITE}\p{{L}}\p{{N}}]")
    return regex.compile(inside.replace(r"\s", f"[{_WHITE}]").replace(r"\S", f"[^{_WHITE}]"))


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.ranks = ranks
        self.data = dict(zip(ranks.values(), ranks))
        self.machine = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.machine.add_word(token.decode("latin-1"), rank)
        self.machine.make_automaton()
        self.shorter = {}  # rank -> rank of the longest token that is a proper prefix
        self.parts = {}  # rank -> the two tokens whose merge makes it; a byte has none
        self.merged = {}  # two tokens -> rank of their merge
        self.fits = {}  # memo of compatible neighbours
        self.pattern = piece_pattern()
        self.cache: dict[str, tuple[tuple[int, ...], str, bytes]] = {}
        self._build()

    def _build(self) -> None:
        for rank, token in sorted(self.data.items()):
            prefixes = [self.ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in self.ranks]
            self.shorter[rank] = prefixes[0] if prefixes else None
            for left in prefixes:
                right = self.ranks.get(token[len(self.data[left]):])
                if right is not None and max(left, right) < rank and self._compatible(left, right):
                    self.merged[left, right] = rank
                    self.parts[rank] = (left, right)
                    break
        self.fits.clear()

    def _compatible(self, left: int, right: int) -> bool:
        """Would the merges keep the border between these neighbours?

        Undo the merge that came last, on either side, and look each time whether
        the two tokens at the border would have merged before it.
        """
        bound = float("inf")
        while True:
            if self.merged.get((left, right), bound) < bound:
                return False
            # The right token's merge came first where ranks tie, hence the half step.
            order = [(left + 0.0, "left"), (right + 0.5, "right")]
            for bound, side in sorted(order, reverse=True):
                parts = self.parts.get(left if side == "left" else right)
                if parts is not None:
                    if side == "left":
                        left = parts[1]
                    else:
                        right = parts[0]
                    break
            else:
                return True

    def neighbours(self, left: int, right: int) -> bool:
        key = (left, right)
        if key not in self.fits:
            if len(self.fits) >= 2_000_000:
                self.fits.clear()
            self.fits[key] = self._compatible(left, right)
        return self.fits[key]

    def _longest(self, text: str, at: int) -> int:
        return next(self.machine.iter_long(text, at))[1]

    def encode_piece(self, piece: bytes) -> list[int]:
        known = self.ranks.get(piece)
        if known is not None:
            return [known]  # a piece that is a token is taken as it stands
        text, end = piece.decode("latin-1"), len(piece)
        tokens: list[int] = []
        alive = bytearray(b"\x01") * (end + 1)
        at, token = 0, self._longest(text, 0)
        while at < end:
            stop = at + len(self.data[token])
            if alive[stop] and (not tokens or self.neighbours(tokens[-1], token)):
                tokens.append(token)
                at = stop
                if at < end:
                    token = self._longest(text, at)
                continue
            token = self.shorter[token]
            while token is None:
                alive[at] = 0
                last = tokens.pop()
                at -= len(self.data[last])
                # The token that led here is tried again first: its end is dead now.
                token = last
        return tokens

    def _entry(self, piece: str) -> tuple[tuple[int, ...], str, bytes]:
        ids = tuple(self.encode_piece(piece.encode("utf-8")))
        entry = (ids, ",".join(map(str, ids)), self.decode(ids))
        if len(self.cache) >= CACHE_PIECES:
            self.cache.clear()
        self.cache[piece] = entry
        return entry

    def entries(self, text: str):
        """Lists of (ids, ids as text, bytes) for the pieces of a text, a bounded number at a time."""
        get, make = self.cache.get, self._entry
        if len(text) <= STREAM_CHARS:
            yield [get(p) or make(p) for p in self.pattern.findall(text)]
            return
        found = self.pattern.finditer(text)
        while block := [get(p) or make(p) for p in (m.group() for m in islice(found, 100_000))]:
            yield block

    def encode(self, text: str) -> list[int]:
        return [i for block in self.entries(text) for ids, _, _ in block for i in ids]

    def decode(self, ids) -> bytes:
        return b"".join([self.data[i] for i in ids])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _encode(path: str):
    def run(batches):
        own = codec(path)
        for ids, texts in text_batches(batches):
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([own.encode(t.as_py()) for t in texts], pa.list_(pa.int32()))], ["doc_id", "ids"]
            )

    return run


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids, the token ids of each whole text."""
    return id_text(docs).mapInArrow(_encode(tokenizer_file(VOCABULARY, path)), "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and data, the bytes that the ids stand for; null ids count as none."""
    where = tokenizer_file(VOCABULARY, path)

    def run(batches):
        own = codec(where)
        for batch in batches:
            data = [own.decode(x.as_py() or ()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, data binary")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Counts and digests of the ids and of the bytes decoded from them, in one pass."""
    where = tokenizer_file(VOCABULARY, path)

    def run(batches):
        own = codec(where)
        for ids, texts in text_batches(batches):
            counts, id_sums, byte_sums = [], [], []
            for text in texts:
                n, id_sum, byte_sum, lead = 0, hashlib.sha256(), hashlib.sha256(), ""
                for block in own.entries(text.as_py()):
                    n += sum([len(e[0]) for e in block])
                    if block:
                        id_sum.update((lead + ",".join([e[1] for e in block])).encode())
                        lead = ","
                    byte_sum.update(b"".join([e[2] for e in block]))
                counts.append(n)
                id_sums.append(id_sum.hexdigest())
                byte_sums.append(byte_sum.hexdigest())
            yield pa.RecordBatch.from_pydict({
                "doc_id": ids, "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(id_sums, pa.string()),
                "decoded_sha256": pa.array(byte_sums, pa.string()),
            })

    return id_text(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
