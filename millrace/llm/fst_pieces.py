"""SentencePiece encoding and decoding as a shortest path through a weighted transducer.

Three machines are compiled from the model file: the normaliser (white space to the piece mark, dummy prefix, optional squeezing
of runs), the piece automaton (a trie of pieces; its final states carry piece ids), and byte fallback (one arc per UTF-8 byte of a character that is
no piece, at a cost above any piece path). Composing them with a text gives an acyclic lattice over its positions, and the
tropical shortest path through it is the encoding.

Weights depend on the model type. Unigram models: the negative log probability of the piece. BPE models: a piece arc is free,
and a state remembers the piece that led there; entering the next piece costs nothing if merging the two pieces' characters alone
gives exactly the two pieces, and infinity otherwise. Every prefix has one finite path, which is the sequence of merges.

No piece crosses from text into a following mark, so the lattice splits there; parts are solved alone and remembered.

Cases: null and empty texts have no pieces; a literal piece mark in a text counts as a blank, as in the library; decoding bytes that
are not UTF-8 gives replacement characters.
"""

from __future__ import annotations

import copy
import hashlib
import re
import struct
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from millrace.llm.common import annotated, per_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the file format
REMEMBERED = 250_000  # parts of texts, and piece pairs, kept per worker
FIELDS = "ids array<int>, round_trip boolean, decoded_sha256 string"


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message; fixed-width values stay bytes."""
    i = 0

    def varint():
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while i < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}[key & 7] if key & 7 != 2 else varint()
        yield key >> 3, data[i:i + n]
        i += n


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    bpe: bool = False
    dummy_prefix: bool = True
    squeeze: bool = True

    @classmethod
    def read(cls, data: bytes) -> Model:
        m = cls()
        for number, value in _fields(data):
            if number == 1:
                got = dict(_fields(value))
                m.pieces.append((got[1].decode(), struct.unpack("<f", got[2])[0] if 2 in got else 0.0, got.get(3, NORMAL)))
            elif number == 2:
                m.bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("a normaliser with a character map is not supported")
                m.dummy_prefix, m.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        return m


class Transducer:
    def __init__(self, model: Model):
        self.model = model
        self.id_of = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
        self.score = [s for _, s, _ in model.pieces]
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE}
        self.unknown = next(i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN)
        self.longest = max(map(len, self.id_of))
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("pieces with an inner mark are not supported")
        self.parts: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.fits: dict[int, bool] = {}
        whole = {p: i for p, i in self.id_of.items() if not model.bpe or self.merged(p) == [p]}
        # The trie: every prefix of a piece is a state; the piece id where it is final, else -1.
        self.states = {p[:k]: whole.get(p[:k], -1) for p in whole for k in range(1, len(p) + 1)}
        self.pairs = {p[k - 1:k + 1] for p in whole for k in range(1, len(p))}
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.bytes_of = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.replace(MARK, " ").encode()
                         for p, _, kind in model.pieces]

    # The normaliser.
    def normalise(self, text: str) -> str:
        if self.model.squeeze:
            text = " ".join(x for x in text.replace(MARK, " ").split(" ") if x)
        if not text:
            return ""
        return (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)

    def normal_text(self, text: str) -> str:
        """What decoding gives back."""
        out = self.normalise(text).replace(MARK, " ")
        return out[1:] if self.model.dummy_prefix and out else out

    # Byte fallback.
    def fallback(self, char: str) -> tuple[int, ...]:
        raw = char.encode("utf-8", "surrogatepass")
        return tuple(self.byte_id[b] for b in raw) if self.byte_id else (self.unknown,)

    # Weights of a BPE model.
    def merged(self, text: str) -> list[str]:
        """Merge the pair of the best piece, leftmost first, until none is left."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-self.score[i], k) for k in range(len(parts) - 1) if (i := self.id_of.get(parts[k] + parts[k + 1])) is not None]
            if not found:
                break
            _, k = min(found)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def follows(self, left: int, right: int) -> bool:
        """Whether the arc from one piece into the next is free."""
        key = left << 32 | right
        if (known := self.fits.get(key)) is None:
            if len(self.fits) >= 4 * REMEMBERED:
                self.fits.clear()
            a, b = self.model.pieces[left][0], self.model.pieces[right][0]
            known = self.fits[key] = self.merged(a + b) == [a, b]
        return known

    def _bpe_path(self, part: str) -> list[int]:
        """The path of weight 0, searched from the left with the longest arcs first. Only one piece can end a finite path to a position, so a
        position from which the search failed is never entered again."""
        n, state = len(part), self.states.get
        dead: set[int] = set()
        path, arcs = [(0, -1)], []  # (position, piece that led there; -1 for a character without piece)
        while path[-1][0] < n:
            at, left = path[-1]
            if len(arcs) < len(path):
                found, stop = [], at + 1
                while stop <= n and (i := state(part[at:stop])) is not None:
                    if i >= 0:
                        found.append((stop, i))
                    stop += 1
                arcs.append(found or [(at + 1, -1)])
            found = arcs[-1]
            while found:
                stop, right = found.pop()
                if stop not in dead and (left < 0 or right < 0 or self.follows(left, right)):
                    path.append((stop, right))
                    break
            else:
                dead.add(at)
                arcs.pop()
                path.pop()
        out: list[int] = []
        for stop, i in path[1:]:
            out.extend((i,) if i >= 0 else self.fallback(part[stop - 1]))
        return out

    def fresh(self) -> Transducer:
        """The same machine without what it remembers of texts: a task's memory goes with it, while workers and the machine stay."""
        out = copy.copy(self)
        out.parts, out.older, out.fits = {}, {}, {}
        return out

    def _unigram_path(self, part: str) -> list[str]:
        n, low = len(part), min(self.score) - 10
        cost, back = [0.0] + [float("inf")] * n, [0] * (n + 1)
        for stop in range(1, n + 1):
            for start in range(max(0, stop - self.longest), stop):
                i = self.id_of.get(part[start:stop])
                step = -self.score[i] if i is not None else -low if start == stop - 1 else None
                if step is not None and cost[start] + step < cost[stop]:
                    cost[stop], back[stop] = cost[start] + step, start
        path, at = [], n
        while at:
            path.append(part[back[at]:at])
            at = back[at]
        return path[::-1]

    def part_ids(self, part: str) -> tuple[int, ...]:
        if not self.model.bpe:
            out: list[int] = []
            for piece in self._unigram_path(part):
                i = self.id_of.get(piece)
                out.extend((i,) if i is not None else self.fallback(piece))
            return tuple(out)
        # No piece holds these two characters side by side, so no merge crosses the place between them.
        pairs, start, out = self.pairs, 0, []
        for k in range(1, len(part)):
            if part[k - 1:k + 1] not in pairs:
                out.extend(self.remembered(MARK + part[start:k], part[start:k]))
                start = k
        out.extend(self.remembered(MARK + part[start:], part[start:]) if start else self._bpe_path(part))
        return tuple(out)

    def remembered(self, key: str, part: str) -> tuple[int, ...]:
        """Two generations of solved parts: when the newer one is full it becomes the older one."""
        ids = self.parts.get(key)
        if ids is None:
            ids = self.older.pop(key, None) or self.part_ids(part)
            if len(part) <= 32:
                if len(self.parts) >= REMEMBERED:
                    self.older, self.parts = self.parts, {}
                self.parts[key] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        text = (text or "").replace(MARK, " ")
        plain = text.split(" ")
        if self.model.dummy_prefix and all(plain):  # single blanks only: each word is a mark and the word
            for word in plain:
                out.extend(self.parts.get(word) or self.remembered(word, MARK + word))
            return out
        for part in self.cut.findall(self.normalise(text)):
            # A part of one mark and a word is remembered by the word, any other by the part with its marks.
            key = part[1:] if part[0] == MARK and part[1:2] not in ("", MARK) else MARK + part
            out.extend(self.parts.get(key) or self.remembered(key, part))
        return out

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


_COMPILED: dict[bytes, Transducer] = {}


def transducer(data: bytes) -> Transducer:
    """Compiled once per worker process."""
    key = hashlib.sha256(data).digest()
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Transducer(Model.read(data))
    return _COMPILED[key]


def encode(docs: DataFrame, model: str = MODEL, name: str = "_pieces", text: str = "text") -> DataFrame:
    """docs with a struct `name`: ids, whether decoding them gives the normalised text, and the digest of the decoded text.
    The model file is read on the driver; its size is fixed by the vocabulary and it goes out as one broadcast."""
    with open(model, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run():
        machine = transducer(sent.value).fresh()

        def one(t):
            ids = machine.encode(t)
            back = machine.decode(ids)
            digest = hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest()
            return {"ids": ids, "round_trip": back == machine.normal_text(t or ""), "decoded_sha256": digest}
        return one

    return annotated(docs, per_text(run, FIELDS), text, name)
