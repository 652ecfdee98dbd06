"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

Merges are compiled into a transducer that reads bytes. The encoding of a prefix ends in the one
token that may follow the encoding of what stands before it: two tokens may be neighbours when merging
their joined bytes gives back the same two tokens. A state is what the future can depend on: the last token
that is certain, the bytes after it, and for each place in them at which a longer token may still
begin, the tokens up to it. Tokens shared by all places are certain and are emitted; the lookahead is at most
the longest token. States and moves are made when first needed, up to ``MAX_STATES``; beyond them the places
are followed without being kept.

Text is split by the pattern of the vocabulary, and each match is encoded separately. Results of whole
words are remembered up to ``MAX_WORDS``. Nulls and empty texts have no tokens. No special tokens exist.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from stockledger.llm.common import held, id_and_text, record, runs

MAX_STATES = 60_000
MAX_WORDS = 600_000

ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
DECODED = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
DIGESTS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids_sha256", pa.string()),
        ("decoded_sha256", pa.string()),
        ("valid_utf8", pa.bool_()),
        ("ids", pa.binary()),
    ]
)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        # Of each token and each beginning of one: the token's id (-1: none, or not what merging gives), and
        # whether a longer token begins so.
        self.known: dict[bytes, tuple[int, bool]] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: len(x[0])):
            for i in range(1, len(token)):
                found = self.known.get(token[:i])
                if not (found and found[1]):
                    self.known[token[:i]] = (found[0] if found else -1, True)
            reached = self.merged(token, rank) == [rank]
            self.known[token] = (rank if reached else -1, False)
        self._pairs: dict[tuple[int, int], bool] = {}
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.start = self._number((-1, b"", ((0, ()),)))

    def merged(self, text: bytes, whole: int = -1) -> list[int]:
        """Merge the neighbours of lowest rank, the leftmost first, until no two are a token: the definition.

        ``whole`` is the text's own rank, of which the last merge is then kept.
        """
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            if rank == whole and len(parts) == 2:
                self.halves[whole] = (self.ranks[parts[0]], self.ranks[parts[1]])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _neighbours(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives the two again.

        Merges are undone from the last made. The two stay apart unless, at some time, what then stood on
        both sides of the border would have been merged before the merge undone (for one right of the
        border: or in its place, as the leftmost of equals goes first).
        """
        if left < 0:
            return True
        key = (left, right)
        known = self._pairs.get(key)
        if known is not None:
            return known
        before, apart = 1 << 60, None
        while apart is None:
            if self.ranks.get(self.bytes[left] + self.bytes[right], before) < before:
                apart = False
            elif left in self.halves and (left > right or right not in self.halves):
                before, left = left, self.halves[left][1]
            elif right in self.halves:
                before, right = right + 1, self.halves[right][0]
            else:
                apart = True
        if len(self._pairs) > 4 * MAX_STATES:
            self._pairs.clear()
        self._pairs[key] = apart
        return apart

    def _number(self, state: tuple) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return self.numbers[state]

    def _move(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Determinise one move: advance every place, and emit what all that stay open share."""
        last, text, places = self.states[number]
        text += bytes((byte,))
        reached, alive = None, []
        for at, tokens in places:
            token, longer = self.known.get(text[at:], (-1, False))
            if reached is None and token >= 0 and self._neighbours(tokens[-1] if tokens else last, token):
                reached = tokens + (token,)
            if longer:
                alive.append((at, tokens))
        alive.append((len(text), reached))
        first, shared = alive[0][1], 0
        while len(first) > shared and all(t[shared : shared + 1] == first[shared : shared + 1] for _, t in alive):
            shared += 1
        out, cut = first[:shared], alive[0][0]
        state = (out[-1] if out else last, text[cut:], tuple((at - cut, t[shared:]) for at, t in alive))
        result = self.moves[number][byte] = (self._number(state), out)
        return result

    def _rest(self, number: int, rest: bytes) -> list[int]:
        """Tokens of ``rest`` read from a state without making states: places are followed one at a time,
        the longest token first, and given up for good when no token may follow there."""
        last, text, places = self.states[number]
        begun, known, pairs = len(text), self.known, self._pairs
        text += rest
        size, dead = len(text), set()
        for at, tokens in places:
            path: list[tuple[int, list[tuple[int, int]]]] = []
            left, floor = tokens[-1] if tokens else last, begun
            while True:
                ends = []
                for end in range(at + 1, size + 1):
                    found = known.get(text[at:end])
                    if found is None:
                        break
                    token, longer = found
                    if token >= 0 and end > floor and end not in dead:
                        ends.append((end, token))
                    if not longer:
                        break
                path.append((left, ends))
                while path:
                    left, ends = path[-1]
                    while ends:
                        at, token = ends[-1]
                        apart = pairs.get((left, token))
                        if apart or apart is None and self._neighbours(left, token):
                            break
                        ends.pop()
                    else:
                        path.pop()
                        if path:
                            dead.add(path[-1][1].pop()[0])
                        continue
                    break
                if not path:
                    break
                if at == size:
                    return [*tokens, *(ends[-1][1] for _, ends in path)]
                left, floor = token, begun
        raise ValueError("the vocabulary lacks single bytes")

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one match of the pattern; a match that is a token itself is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, ids, moves, full = self.start, [], self.moves, len(self.states) >= MAX_STATES
        for i, byte in enumerate(piece):
            move = moves[state].get(byte)
            if move is None:
                if full:
                    return ids + self._rest(state, piece[i:])
                move = self._move(state, byte)
            state, out = move
            if out:
                ids += out
        return ids + list(self.states[state][2][-1][1])


class Utf8Machine:
    """UTF-8 read in pieces of any size: complete characters come out, an unfinished one waits for its rest.

    The state is what has been read of the unfinished character, at most three bytes; bytes that cannot
    be UTF-8 become U+FFFD, as the codec of the standard library replaces them.
    """

    def __init__(self):
        self.rest = b""

    @staticmethod
    def _open(text: bytes) -> int:
        """Number of bytes at the end that begin a character without ending it."""
        for back in range(1, min(3, len(text)) + 1):
            byte = text[-back]
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                return back if need > back else 0
            if byte < 0x80:
                return 0
        return 0

    def feed(self, piece: bytes) -> str:
        text = self.rest + piece
        n = self._open(text)
        self.rest = text[len(text) - n :]
        return text[: len(text) - n].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.rest = self.rest, b""
        return rest.decode("utf-8", "replace")


class _Words(dict):
    """Ids, as bytes, of ``prefix`` followed by a word; the words used least recently are forgotten by halves."""

    def __init__(self, codec: Codec, prefix: str):
        super().__init__()
        self.codec, self.prefix, self.older = codec, prefix, {}

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        return self._ids(word, self.codec.pattern.findall(self.prefix + word)) if out is None else self._kept(word, out)

    def _kept(self, word: str, out: bytes) -> bytes:
        if len(self) > MAX_WORDS // 2:
            self.older = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out

    def _ids(self, word: str, pieces: list[str]) -> bytes:
        ids: list[int] = []
        for piece in pieces:
            ids += self.codec.transducer.encode(piece.encode())
        return self._kept(word, struct.pack(f"<{len(ids)}I", *ids))

    def learn(self, words: list[str]) -> None:
        """Encode the words that are new, the pattern run once over all of them.

        With a space as prefix a word's first match is known by beginning with a space and a
        non-space. Words of which the matches do not come out whole are left to be encoded one by one.
        """
        new = [w for w in set(words) if w not in self and w not in self.older and len(w) <= 64]
        pieces = self.codec.pattern.findall(self.prefix + self.prefix.join(new)) if len(new) > 1 else []
        starts = [i for i, p in enumerate(pieces) if p[0] == " " and len(p) > 1 and not p[1].isspace()]
        if new and len(starts) == len(new):
            for word, begin, end in zip(new, starts, [*starts[1:], len(pieces)], strict=True):
                own = pieces[begin:end]
                if "".join(own) == self.prefix + word:
                    self._ids(word, own)


class Codec:
    def __init__(self, path: str, pattern: str):
        self.transducer = Transducer(read_ranks(path))
        self.pattern = regex.compile(pattern)
        # A match may begin with one space but never spans the place before a space that a
        # non-space follows, so what lies between such places is encoded on its own.
        self.double = re.compile(r" (?:\s|$)")
        self.places = re.compile(r" (?=\S)")
        self.first, self.rest = _Words(self, ""), _Words(self, " ")
        tokens = self.transducer.bytes
        self.lengths = np.asarray([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        words = self.places.split(text) if self.double.search(text) else text.split(" ")
        self.rest.learn(words[1:])
        return self.first[words[0]] + b"".join(map(self.rest.__getitem__, words[1:]))

    def bytes_of(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return b""
        return self.flat[np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()

    def decode(self, ids: bytes, block: int = 1 << 16) -> Iterator[str]:
        """Text of ids in pieces, each as soon as its characters are complete."""
        machine, numbers = Utf8Machine(), np.frombuffer(ids, dtype="<u4")
        for at in range(0, len(numbers), block):
            yield machine.feed(self.bytes_of(numbers[at : at + block]))
        yield machine.close()


def codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker and stage."""
    return held(Codec, path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers, one row for each row of ``docs``.

    Null and empty texts have 0 tokens and empty ids; a null id stays null; other columns are not touched.
    """

    def run(batches):
        own = codec(path, pattern)
        for ids, texts in runs(batches):
            found = [own.encode(t.decode()) for t in texts]
            yield record(ENCODED, ids, [len(x) // 4 for x in found], found)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows with ids, null ids counting as none; the inverse of ``encode_documents``."""

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            texts = ["".join(own.decode(x or b"")) for x in batch.column(1).to_pylist()]
            yield record(DECODED, batch.column(0).to_pylist(), texts)

    return encoded.select(id_col, ids_col).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, valid_utf8, ids), one row for each row of ``docs``.

    The digests are of the ids and of the bytes decoded from them. Encodes and decodes in one pass. ``valid_utf8`` tells whether the
    streaming decoder met only whole characters. Nulls: as in ``encode_documents``.
    """

    def run(batches):
        own = codec(path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for ids, texts in runs(batches):
            rows = []
            for text in texts:
                found = own.encode(text.decode())
                digest, valid = hashlib.sha256(), True
                for piece in own.decode(found):
                    digest.update(piece.encode())
                    valid = valid and "�" not in piece
                rows.append((len(found) // 4, sha(found), digest.hexdigest(), valid or "�" in text.decode(), found))
            yield record(DIGESTS, ids, *map(list, zip(*rows, strict=True)))

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, valid_utf8 boolean, ids binary"
    )
