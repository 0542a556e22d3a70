"""Byte-level BPE encoding by prefix-sharing trie traversal, and decoding.

The distinct new pre-tokens of each Arrow batch form a trie, laid out in sorted order, which is its
depth-first order: where two neighbours part, the walk goes back to that node.  A node stands for a
prefix and holds the last token of that prefix's encoding; its state comes from the states of shorter
prefixes on the same path: the last token is the vocabulary entry that ends the prefix and can stand
after the last token of what precedes it.  Two tokens can stand side by side if merging their bytes
alone gives those two tokens again.  A prefix that several words of a batch share is encoded once; only
the path to the present node is held, and the words encoded so far are known to later batches.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from .common import prepare_python

#: Words, and checked pairs of tokens, that a worker keeps from earlier batches; bounds memory, never what
#: is encoded: beyond it the words that the present batch lacks are forgotten.
MAX_KNOWN = 300_000

# ---- FIXED VALUES: the pre-token pattern of byte-level vocabularies ----
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# ---- end of fixed values ----
#: Texts of these characters alone split alike under any Unicode tables of the last ten years.
PLAIN = r"[\u0000-\u0377\u0391-\u03A1\u03A3-\u03FF\u0400-\u052F\u2010-\u2027\u2030-\u205E\u20A0-\u20BF\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FCC\uAC00-\uD7A3]*"


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def token_bytes(vocabulary: str) -> list[bytes]:
    """The bytes of every id."""
    spec, letters = json.loads(vocabulary), _byte_letters()
    table = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items()}
    table |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    return [table.get(i, b"") for i in range(max(table) + 1)]


#: Key of a token's own id among the ids of those that it can follow; -1 there is "nothing".
SELF = -2


class Codec:
    """A byte-level BPE vocabulary with the trie of the prefixes met so far."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        model, letters = spec["model"], _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        merges = [(self.ids[raw(a)], self.ids[raw(b)], self.ids[raw(a) + raw(b)]) for a, b in pairs]
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(merges)}
        self.halves = {t: (a, b) for a, b, t in reversed(merges)}
        self.made = {t: self.rank[p] for t, p in self.halves.items()}
        self.never = len(merges)
        self.tails, self.heads, self.alone = {}, {}, {}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for t, i in self.ids.items():
            self.bytes_of[i] = t
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pattern = regex.compile(PRETOKEN)
        self.splitter = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.plain = regex.compile(PLAIN)
        self.odd = re.compile(r"\A\s|\s\Z| \s|\s ", re.A)
        self.odd_any = re.compile(r"\A\s|\s\Z| \s|\s |\A\Z")
        self.known: dict[str, bytes] = {}          # by unit: its ids as little-endian 32-bit numbers
        self.forget_pairs()

    def forget_pairs(self) -> None:
        """By a token's bytes: which tokens it can follow, as far as checked, and at ``SELF`` its id."""
        self.after: dict[bytes, dict[int, int | bool]] = {t: {SELF: i} for t, i in self.ids.items()}
        self.pairs = 0

    def tail(self, token: int) -> tuple[int, ...]:
        """The tokens that end ``token`` while it is merged, from its last byte to itself."""
        if token not in self.tails:
            self.tails[token] = (*self.tail(self.halves[token][1]), token) if token in self.halves else (token,)
        return self.tails[token]

    def head(self, token: int) -> tuple[int, ...]:
        """The tokens that begin ``token`` while it is merged, from its first byte to itself."""
        if token not in self.heads:
            self.heads[token] = (*self.head(self.halves[token][0]), token) if token in self.halves else (token,)
        return self.heads[token]

    def apart(self, left: int, right: int) -> bool:
        """Whether both tokens are complete before any merge takes place across their border.

        Merges run by rank, so the token at either side of the border grows along a fixed path; the
        better-ranked growth comes first, and a merge across the border first if it ranks better still
        (or as well as the right one's growth: equal merges run from the left).
        """
        a, b, never = self.tail(left), self.head(right), self.never
        i = j = 0
        while True:
            grow_left = self.made[a[i + 1]] if i + 1 < len(a) else never
            grow_right = self.made[b[j + 1]] if j + 1 < len(b) else never
            if grow_left == grow_right == never:
                return True
            across = self.rank.get((a[i], b[j]), never)
            if across < grow_left and across <= grow_right and across < never:
                return False
            i += grow_left <= grow_right
            j += grow_right <= grow_left

    def whole(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as that token."""
        if token not in self.alone:
            pair = self.halves.get(token)
            self.alone[token] = pair is None or self.whole(pair[0]) and self.whole(pair[1]) and self.apart(*pair)
        return self.alone[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` can follow ``left`` (-1: nothing) in an encoding."""
        return self.whole(right) and (left < 0 or (left, right) not in self.rank and self.apart(left, right))

    def learn(self, pieces) -> dict[str, bytes]:
        """The encoding of each of the distinct ``pieces``, whose trie is walked depth first."""
        encoded = {}
        if self.pairs > MAX_KNOWN:
            self.forget_pairs()
        after = self.after
        last, start = [-1], [0]         # of each prefix on the path: its last token, and where that token starts
        before = b""
        for piece in sorted(pieces):
            word = piece.encode()
            d, end = 0, min(len(word), len(before))
            while d < end and word[d] == before[d]:      # the way that the word before went as well
                d += 1
            before = word
            del last[d + 1:], start[d + 1:]
            for d in range(d + 1, len(word) + 1):
                for i in range(d - 1, -1, -1):           # one start fits; most tokens are short
                    token = after.get(word[i:d])
                    if token is not None:
                        ok = token.get(last[i])
                        if ok is None:
                            ok = token[last[i]] = self.fits(last[i], token[SELF])
                            self.pairs += 1
                        if ok:
                            break
                last.append(token[SELF])
                start.append(i)
            out, d = [], len(word)
            while d:
                out.append(last[d])
                d = start[d]
            encoded[piece] = array("i", out[::-1]).tobytes()
        return encoded

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text.  Characters that the pattern library's newer tables class
        differently are left to the tokenizers library's own splitter."""
        if self.plain.fullmatch(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def units(self, text: str) -> list[str]:
        """Pieces that split apart whatever surrounds them: where one blank parts two words.

        A pre-token never runs across a blank with no white space on either side.  Such pieces go without
        their blank; the first one, which has none, is marked by a line feed.  A text with other white
        space gives its pre-tokens, marked the same way.
        """
        if text.isascii() and not self.odd.search(text) or not self.odd_any.search(text):
            out = text.split(" ")
            out[0] = "\n" + out[0]
            return out
        return [_unit(p) for p in self.split(text)]

    def meet(self, units: set[str]) -> None:
        """Make the encoding of each unit known."""
        known = self.known
        if len(known) > MAX_KNOWN:
            known = self.known = {u: known[u] for u in units if u in known}
        parts = {u: self.split(_piece(u)) for u in units if u not in known}
        pieces = {p for ps in parts.values() for p in ps}
        known.update((_unit(p), ids) for p, ids in self.learn({p for p in pieces if _unit(p) not in known}).items())
        for u, ps in parts.items():
            if len(ps) > 1:
                known[u] = b"".join([known[_unit(p)] for p in ps])

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of every text; null as empty."""
        special = self.special
        cut = self.split_special.split if self.split_special else lambda t: [t]
        rows = [[p if p in special else self.units(p) for p in cut(t or "") if p] for t in texts]
        self.meet({u for row in rows for part in row if not isinstance(part, str) for u in part})
        of = self.known.__getitem__
        return [np.frombuffer(b"".join([special[p].to_bytes(4, "little") if isinstance(p, str) else b"".join(map(of, p))
                                        for p in row]), "<i4") for row in rows]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


def _unit(piece: str) -> str:
    """A pre-token without its blank, or marked by a line feed if it has none or is white space."""
    return piece[1:] if piece[0] == " " and not piece.isspace() else "\n" + piece


def _piece(unit: str) -> str:
    return unit[1:] if unit[0] == "\n" else " " + unit


@lru_cache(maxsize=2)
def _codec(vocabulary: str) -> Codec:
    return Codec(vocabulary)


@lru_cache(maxsize=2)
def _tokens(vocabulary: str):
    return token_bytes(vocabulary)


def decode_lists(ids: pa.ListArray, tokens: list[bytes]) -> pa.Array:
    """The text of each list of ids; bytes that are no UTF-8 become U+FFFD, null ids the empty text."""
    at, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
    token = tokens.__getitem__
    return pa.array([b"".join(map(token, flat[a:b].tolist())).decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])],
                    pa.string())


def _encode_batches(batches, vocabulary):
    codec = _codec(vocabulary.value)
    for b in batches:
        ids = codec.encode_all(b.column(1).to_pylist())
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                                         names=["doc_id", "ids"])


def _decode_batches(batches, vocabulary):
    tokens = _tokens(vocabulary.value)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), decode_lists(b.column(1), tokens)],
                                         names=["doc_id", "ids", "decoded"])


def _round_trip_batches(batches, vocabulary):
    return _decode_batches(_encode_batches(batches, vocabulary), vocabulary)


def _vocabulary(spark, path: str):
    """The vocabulary file's text, read on the driver and sent once to each executor (a fixed file)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _map(rows: DataFrame, work, vocabulary_path: str, schema: str) -> DataFrame:
    prepare_python(rows.sparkSession)
    return rows.mapInArrow(partial(work, vocabulary=_vocabulary(rows.sparkSession, vocabulary_path)), schema)


def encode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """``(doc_id, ids array<int>)`` for every row of ``docs``.

    A null or empty text gives no ids; special tokens written in a text get their own id, as the
    tokenizers library does by default; repeated rows each give a row; other columns are not read.
    """
    return _map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _encode_batches, vocabulary_path,
                "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """``(doc_id, ids)`` → ``(doc_id, ids, decoded)``; null ids give the empty text."""
    return _map(encoded.select("doc_id", "ids"), _decode_batches, vocabulary_path,
                "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """:func:`encode` and then :func:`decode`, in one pass of one Python worker per task."""
    return _map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _round_trip_batches,
                vocabulary_path, "doc_id long, ids array<int>, decoded string")
