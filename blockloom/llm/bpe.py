"""BPE encoding by backtracking, and decoding by an offset table (operator 5).

Encoding: one Aho-Corasick pass over a piece (tokens and piece reversed) gives the longest token
that starts at each byte. Walking left to right, the longest token is taken if it is compatible with the
token before it, that is, if byte pair merging would leave both as they are; else the next
shorter token that is its prefix; else the walk goes back one token. Places once left are never
entered again, so the work is linear. Compatibility follows from the merge table, and is kept
in a pair table. Results equal merging by rank.

Null text counts as empty (no ids, empty text). A special token's string in a text becomes its
id, as the tokenizers library does by default. Repeated rows give equal rows; an empty table gives
none. Texts are never cut. Columns other than the id and the text are not read. Tokenizers with a normalizer, with another
pre-tokenizer or with added tokens that strip or want whole words are refused.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import keyed, materialize, pieces, ragged, spans_of
from .pieces import PieceMemory

# Fixed value: the pre-tokenizer pattern of byte-level BPE.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

_coders: dict = {}


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Coder:
    """Tables of a byte-level BPE vocabulary (a tokenizers JSON file)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        odd = [t["content"] for t in spec["added_tokens"] if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")]
        before = spec.get("pre_tokenizer") or {}
        if odd or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"{path}: only byte-level BPE without a normalizer and with plain added tokens is known here {odd}")
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        ids = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # tokens are numbered by rank here: bytes first, then in the order of merging
        self.token = [bytes([b]) for b in range(256)]
        rank = {t: i for i, t in enumerate(self.token)}
        self.parts = [(i, i) for i in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for m in spec["model"]["merges"]:
            a, b = map(raw, m.split(" ") if isinstance(m, str) else m)
            pair = rank[a], rank[b]
            if a + b not in rank:
                rank[a + b] = len(self.token)
                self.token.append(a + b)
                self.parts.append(pair)
            self.merged.setdefault(pair, rank[a + b])
        self.id_of = [ids[t] for t in self.token]
        self.length = [len(t) for t in self.token]
        self.pairs: dict[int, bool] = {}
        self.shorter = [-1] * len(self.token)
        for i, t in enumerate(self.token):
            for k in range(len(t) - 1, 0, -1):
                if (p := rank.get(t[:k])) is not None:
                    self.shorter[i] = p
                    break
        self.match = ahocorasick.Automaton()
        for i, t in enumerate(self.token):
            if i < 256 or self.compatible(*self.parts[i], below=i):
                self.match.add_word(t[::-1].decode("latin-1"), i)
        self.match.make_automaton()
        size = max([*ids.values(), *self.special.values()]) + 1
        table = [b""] * size
        for t, i in ids.items():
            table[i] = t
        for t, i in self.special.items():
            table[i] = t.encode()
        self.offset = spans_of(np.array([len(t) for t in table]))
        self.blob = np.frombuffer(b"".join(table), np.uint8)
        self.piece = regex.compile(PIECE)
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        # a special token comes as a one-tuple, which no piece of text can be
        self.memory = PieceMemory(lambda new: ([self.special[p[0]]] if isinstance(p, tuple) else self.encode_piece(p) for p in new))

    def compatible(self, a: int, b: int, below: int | None = None) -> bool:
        """Would merging leave a and b as neighbours? Undo the later merge of the two again and again, and see whether the parts at the border would have merged earlier."""
        if below is None:
            key = a * 65536 * 2 + b
            if (known := self.pairs.get(key)) is not None:
                return known
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            self.pairs[key] = out = self._compatible(a, b, 1 << 60)
            return out
        return self._compatible(a, b, below)

    def _compatible(self, a: int, b: int, limit: int) -> bool:
        while True:
            m = self.merged.get((a, b))
            if m is not None and m < limit:
                return False
            right, left = self.parts[a], self.parts[b]
            if a < 256 and b < 256:
                return True
            # of the two the one that merged last is undone; at equal rank the left one had merged first
            if b < 256 or a > b:
                limit, a = a, right[1]
            else:
                limit, b = b + 1, left[0]

    def encode_piece(self, text: str) -> list[int]:
        raw = text.encode()
        n = len(raw)
        longest = [-1] * n
        last = -1
        for end, i in self.match.iter(raw[::-1].decode("latin-1")):
            if end != last:  # of matches that end together the longest comes first
                longest[n - 1 - end] = i
                last = end
        length, shorter, ok = self.length, self.shorter, self.compatible
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0] if n else -1
        while at < n:
            before = out[-1] if out else -1
            while True:
                end = at + length[token]
                if open_at[end] and (before < 0 or ok(before, token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    break
                token = shorter[token]
                if token < 0:
                    open_at[at] = 0
                    token = out.pop()
                    at -= length[token]
                    break
        return [self.id_of[i] for i in out]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and the number of each text."""
        found, per = [], []
        for t in texts:
            if self.cut is not None and any(s in t for s in self.special):
                own = []
                for i, s in enumerate(self.cut.split(t)):
                    own += [(s,)] if i % 2 else self.piece.findall(s)
            else:
                own = self.piece.findall(t)
            found += own
            per.append(len(own))
        return self.memory.flat(found, np.array(per, np.int64))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids, by one gather from the offset table."""
        start = self.offset[ids]
        return self.blob[ragged(start, self.offset[ids.astype(np.int64) + 1] - start)].tobytes()


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids and the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer)
        for b in pieces(batches, 2 << 20):
            flat, n = c.encode(b.column("text").to_pylist())
            at = spans_of(n).tolist()
            raw = memoryview(flat.astype("<u4")).cast("B")
            ids_sha = [hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(at, at[1:])]
            texts = [c.decode(flat[x:y]).decode("utf-8", "replace") for x, y in zip(at, at[1:])]
            columns = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array([flat[x:y] for x, y in zip(at, at[1:])], pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    more = ", ids array<int>, decoded string" if with_ids else ""
    out = keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + more)
    return materialize(out, "bpe")
