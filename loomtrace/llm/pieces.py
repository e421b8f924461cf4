"""Sub-word encoding and decoding with the pieces and log scores of a SentencePiece model file.

A text gets a white-space marker before it and for each space.  Its segmentation is the one of the largest sum of piece
scores (Viterbi), over a double-array trie of the pieces' bytes; a character that no piece starts with costs the least
score less UNKNOWN and is written as its byte pieces.  If no piece holds a marker after another character (checked when a
model is read), no piece crosses from a word into the next one's marker, so the best segmentation of a text is that of
its words one by one.  Words met before are looked up; all new words of a batch go through the trie together, one vector
step per place and piece length.

Decoding joins the pieces' bytes, turns markers into spaces and drops the first one.

Defined cases: null and empty texts have no pieces; a marker character in a text counts as a space; runs of spaces stay;
equal sums: the segmentation found first, by start and then by length, stays; words of any length; repeated rows are
encoded each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import arrow_map

MARK = "▁"
#: How much less than the least score an unknown character costs.
UNKNOWN = 10.0
#: Bytes of a word from which it goes through the trie alone.
LONG = 96
#: Distinct words after which a worker remembers no more.
WORDS_KEPT = 250_000
NORMAL, UNKNOWN_KIND, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(b: bytes):
    """(number, value) of a protobuf message's fields."""
    i = 0

    def number():
        nonlocal i
        out = shift = 0
        while True:
            x = b[i]
            i += 1
            out |= (x & 127) << shift
            shift += 7
            if x < 128:
                return out

    while i < len(b):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, b[i : i + size]
        i += size


@dataclass
class Model:
    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    prefix: bool

    @property
    def bytes_at(self) -> list[int]:
        """The piece of each byte value."""
        out = [-1] * 256
        for i in np.flatnonzero(self.kinds == BYTE).tolist():
            out[int(self.pieces[i][3:5], 16)] = i
        return out


def double_array(words: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of a trie: from place p, byte b leads to base[p] + b if check[base[p] + b] is p; value is the word's number or -1."""
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for w, number in words:
        p = 0
        for b in w:
            q = children[p].get(b)
            if q is None:
                q = children[p][b] = len(children)
                children.append({})
                ends.append(-1)
            p = q
        ends[p] = number
    size = 2 * len(children) + 1024
    used = bytearray(size)
    base, check, value = [0] * size, [-1] * size, [-1] * size
    used[0] = 1
    value[0] = ends[0]
    place = [0] * len(children)
    free = hint = 1  # the first free place; where the search for several free places begins
    queue = [0]
    for node in queue:
        kids = sorted(children[node].items())
        if not kids:
            continue
        lead = kids[0][0]
        free = used.find(0, free)
        at = max(free if len(kids) == 1 else max(free, hint), lead + 1)
        tries = 0
        while True:
            at = used.find(0, at)
            if at < 0 or at - lead + 512 >= len(used):
                grow = len(used)
                used += bytearray(grow)
                base += [0] * grow
                check += [-1] * grow
                value += [-1] * grow
                continue
            b = at - lead
            if all(not used[b + c] for c, _ in kids):
                break
            at += 1
            tries += 1
        if tries > 64:
            hint = at
        base[place[node]] = b
        for c, kid in kids:
            used[b + c] = 1
            check[b + c] = place[node]
            value[b + c] = ends[kid]
            place[kid] = b + c
            queue.append(kid)
    return np.array(base, np.int64), np.array(check, np.int64), np.array(value, np.int64)


def model_of(pieces: list[tuple[str, float, int]], prefix: bool = True) -> Model:
    for piece, _, _ in pieces:
        if any(a != MARK and b == MARK for a, b in zip(piece, piece[1:], strict=False)):
            raise ValueError(f"the piece {piece!r} crosses a word's end")
    kinds = np.array([k for _, _, k in pieces])
    words = [(p.encode(), i) for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER, UNUSED)]
    return Model([p for p, _, _ in pieces], np.array([s for _, s, _ in pieces], np.float64), kinds, *double_array(words), prefix)


def read_model(path: str) -> Model:
    """Pieces, scores and kinds of a model file without text normalisation."""
    pieces, prefix = [], True
    with open(path, "rb") as f:
        for number, v in _fields(f.read()):
            if number == 1:
                d = dict(_fields(v))
                pieces.append((d[1].decode(), struct.unpack("<f", d[2])[0] if 2 in d else 0.0, d.get(3, NORMAL)))
            elif number == 3:
                d = dict(_fields(v))
                if d.get(2) or d.get(4):
                    raise ValueError("this model normalises its text; only identity models are read")
                prefix = bool(d.get(3, 1))
    return model_of(pieces, prefix)


class Encoder:
    def __init__(self, model: Model):
        self.m = model
        self.unknown = float(model.scores[model.kinds == NORMAL].min()) - UNKNOWN
        self.fallback = model.bytes_at
        self.known: dict[str, bytes] = {}
        self.scores = np.append(model.scores, self.unknown)
        self.lists = None
        self.out = []
        for piece, kind in zip(model.pieces, model.kinds.tolist(), strict=True):
            self.out.append(bytes([int(piece[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN_KIND else piece.replace(MARK, " ").encode())

    # a unit is a word with its markers, as bytes

    def _one(self, w: bytes) -> list[int]:
        """Viterbi for one unit, by plain steps."""
        if self.lists is None:
            self.lists = (self.m.base.tolist(), self.m.check.tolist(), self.m.value.tolist(), self.m.scores.tolist())
        base, check, value, scores = self.lists
        n = len(w)
        best, back, piece = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        s = 0
        while s < n:
            char = 1 + (w[s] >= 0xC0) + (w[s] >= 0xE0) + (w[s] >= 0xF0)
            here, node, single = best[s], 0, False
            for e in range(s, n):
                t = base[node] + w[e]
                if check[t] != node:
                    break
                node = t
                v = value[t]
                if v >= 0:
                    single |= e + 1 - s == char
                    if here + scores[v] > best[e + 1]:
                        best[e + 1], back[e + 1], piece[e + 1] = here + scores[v], s, v
            e = min(n, s + char)
            if not single and here + self.unknown > best[e]:
                best[e], back[e], piece[e] = here + self.unknown, s, -1
            s = e
        out: list[int] = []
        e = n
        while e > 0:
            s = back[e]
            out += [piece[e]] if piece[e] >= 0 else [self.fallback[b] for b in reversed(w[s:e])]
            e = s
        return out[::-1]

    def _many(self, units: list[bytes]) -> list[bytes]:
        """Viterbi for many short units at once."""
        m = self.m
        size = np.array([len(u) for u in units], np.int64)
        order = np.argsort(-size, kind="stable")  # longest first: the units that reach a place are the first ones
        size = size[order]
        raw = np.frombuffer(b"".join([units[i] for i in order.tolist()]) + b"\0", np.uint8).astype(np.int64)
        at = np.cumsum(size) - size
        slot = at + np.arange(len(units))  # each unit has size + 1 places
        total = int(size.sum()) + len(units)
        best, back, piece = np.full(total, -np.inf), np.zeros(total, np.int64), np.full(total, -1)
        best[slot] = 0.0
        reach = np.searchsorted(-size, -np.arange(int(size[0]) + 1), "right")  # units of that size at least
        for s in range(int(size[0])):
            who = np.arange(reach[s + 1])
            first = raw[at[who] + s]
            who = who[(first & 0xC0) != 0x80]
            if not len(who):
                continue
            first = raw[at[who] + s]
            char = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
            here = best[slot[who] + s]
            single = np.zeros(len(who), bool)
            i, node, e = np.arange(len(who)), np.zeros(len(who), np.int64), s
            while len(i):
                t = m.base[node] + raw[at[who[i]] + e]
                ok = m.check[t] == node
                i, node = i[ok], t[ok]
                v = m.value[node]
                end = v >= 0
                j, v = i[end], v[end]
                single[j] |= char[j] == e + 1 - s
                goal = slot[who[j]] + e + 1
                value = here[j] + m.scores[v]
                better = value > best[goal]
                goal = goal[better]
                best[goal], back[goal], piece[goal] = value[better], s, v[better]
                e += 1
                on = size[who[i]] > e
                i, node = i[on], node[on]
            j = np.flatnonzero(~single)
            if len(j):
                goal = slot[who[j]] + np.minimum(s + char[j], size[who[j]])
                value = here[j] + self.unknown
                better = value > best[goal]
                goal = goal[better]
                best[goal], back[goal], piece[goal] = value[better], s, -1
        result: list = [b""] * len(units)
        # walk back together
        who, e, step = np.arange(len(units)), size.copy(), 0
        owners, ids, turns = [], [], []
        while len(who):
            p = slot[who] + e[who]
            v, s = piece[p], back[p]
            known = v >= 0
            owners.append(who[known])
            ids.append(v[known])
            turns.append(np.full(int(known.sum()), step * 4))
            for w, b, x in zip(who[~known].tolist(), s[~known].tolist(), e[who[~known]].tolist(), strict=True):
                own = [self.fallback[c] for c in raw[at[w] + b : at[w] + x].tolist()]
                owners.append(np.full(len(own), w))
                ids.append(np.array(own))
                turns.append(step * 4 + np.arange(len(own))[::-1])
            e[who] = s
            who = who[s > 0]
            step += 1
        owner, number, turn = np.concatenate(owners), np.concatenate(ids), np.concatenate(turns)
        line = np.lexsort((-turn, owner))
        flat = number[line].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(owner, minlength=len(units))) * 4
        for i, a, b in zip(order.tolist(), np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True):
            result[i] = flat[a:b]
        return result

    def units(self, units: list[bytes]) -> list[bytes]:
        """The ids of each unit, as bytes of unsigned 32-bit integers."""
        short = [i for i, u in enumerate(units) if 0 < len(u) <= LONG]
        out: list = [None] * len(units)
        for k in range(0, len(short), 20_000):
            part = short[k : k + 20_000]
            for i, x in zip(part, self._many([units[i] for i in part]), strict=True):
                out[i] = x
        for i, u in enumerate(units):
            if out[i] is None:
                out[i] = np.array(self._one(u), "<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of unsigned 32-bit integers."""
        split = []
        for t in texts:
            parts = (t.replace(MARK, " ") if MARK in t else t).split(" ")
            if "" in parts:  # runs of spaces: a word has all markers before it
                joined, marks = [], ""
                for x in parts:
                    if x:
                        joined.append(marks + x)
                        marks = ""
                    else:
                        marks += MARK
                parts = [*joined, marks[1:]] if marks else joined
                if marks and not t:
                    parts = []
            split.append(parts)
        get = self.known.get
        looked = [list(map(get, parts)) for parts in split]
        new: set[str] = set()
        for parts, got in zip(split, looked, strict=True):
            if None in got:
                new.update([p for p, g in zip(parts, got, strict=True) if g is None])
        new_words = list(new)
        fresh = dict(zip(new_words, self.units([(MARK + w).encode() for w in new_words]), strict=True))
        if len(self.known) < WORDS_KEPT:
            self.known.update(fresh)
        out = []
        for parts, got in zip(split, looked, strict=True):
            if None in got:
                got = [fresh[p] if g is None else g for p, g in zip(parts, got, strict=True)]
            out.append(b"".join(got))
        if not self.m.prefix:
            out = [np.array(self._one(t.replace(" ", MARK).encode()), "<u4").tobytes() for t in texts]
        return out

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.out.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return (raw[1:] if self.m.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


_encoders: dict = {}


def _encoder(token: str, model: Model) -> Encoder:
    if token not in _encoders:
        _encoders.clear()
        _encoders[token] = Encoder(model)
    return _encoders[token]


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, n_tokens, n_byte_tokens, token_ids (array of int), decoded_sha256 (of the text that the ids decode to), round_trip (whether that is the text, markers as spaces).

    A kept column with the name of one of these is left out.  One pass, no shuffle.  The model is read on the driver and goes to the tasks; it is as large as its vocabulary.
    """
    model = read_model(path)
    token = hashlib.sha256(repr((path, len(model.pieces))).encode()).hexdigest()
    keep = tuple(c for c in keep if c.lower() not in ("n_tokens", "n_byte_tokens", "token_ids", "decoded_sha256", "round_trip"))
    src = docs.select(F.col(text).alias("__t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)])
    schema = ", ".join(f"`{c}` {src.dtypes[i + 1][1]}" for i, c in enumerate(keep)) + ", n_tokens bigint, n_byte_tokens bigint, token_ids array<int>, decoded_sha256 string, round_trip boolean"
    is_byte = model.kinds == BYTE

    def work(batches):
        use = _encoder(token, model)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = [t or "" for t in part.column(0).to_pylist()]
                ids = use.encode(texts)
                flat = np.frombuffer(b"".join(ids), "<u4")
                ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
                some = np.concatenate(([0], np.cumsum(is_byte[flat])))
                back = [use.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[1:],
                        pa.array(np.diff(ends).astype(np.int64)),
                        pa.array((some[ends[1:]] - some[ends[:-1]]).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32))),
                        pa.array([hashlib.sha256(b.encode("utf-8", "replace")).hexdigest() for b in back]),
                        pa.array([b == t or b == t.replace(MARK, " ") for b, t in zip(back, texts, strict=True)]),
                    ],
                    [*keep, "n_tokens", "n_byte_tokens", "token_ids", "decoded_sha256", "round_trip"],
                )

    return arrow_map(src, work, schema)
