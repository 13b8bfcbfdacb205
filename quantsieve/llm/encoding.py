r"""Token ids of texts by the tokenizers library, with each distinct piece of text looked up once.

A byte-level BPE tokenizer first splits a text into runs (letters, digits, marks, white space) and never
merges across them. ``cuts`` marks places where such a run ends whatever stands on either side: after an
ASCII or Latin-1 letter or a digit where another ASCII character follows, before the last character of a white-space
run that is followed by something else, and after that character unless it is a space. The pieces between
are told apart by Arrow's dictionary encoding, the library is asked about those a worker has not met, and the ids of
all texts of a batch are gathered in numpy. A tokenizer of another make, and texts that hold the string of an
added token, go to the library whole.

Defined results: a null text counts as empty and has no ids.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Pieces that a worker remembers, about (two generations of half as many), and the longest of them, in characters.
CACHE_PIECES, CACHE_CHARS = 600_000, 40
#: Bytes of text that are encoded together, about.
BATCH_BYTES = 4_000_000
# The pre-tokenizers and normalizers that cuts() is right for.
_BYTE_RUNS = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_WORD_RUNS = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_NORMALIZERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})

_bytes = np.arange(256)
_ALNUM = np.isin(_bytes, list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
_SPACES = np.isin(_bytes, list(b" \t\n\x0b\x0c\r"))
#: Bytes that begin a character that is surely no white space; those left out begin some that are.
_SOLID = ((_bytes > 0x20) & (_bytes < 0x7F)) | ((_bytes >= 0x80) & ~np.isin(_bytes, (0xC2, 0xE1, 0xE2, 0xE3)))
#: Second bytes of the Latin-1 letters, which all begin with 0xC3.
_LATIN = (_bytes >= 0x80) & (_bytes <= 0xBF) & ~np.isin(_bytes, (0x97, 0xB7))
_PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch


def _byte_characters() -> dict[int, str]:
    """The printable character that byte-level tokenizers put for each byte: itself, or the next free one from U+0100."""
    free, out = 0x100, {}
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


_CHARACTER = _byte_characters()


def cuts(b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each byte is a text's first or the text may be cut before it; b holds texts in UTF-8, which end at ends."""
    out = np.zeros(len(b), bool)
    if not len(b):
        return out
    alnum, space = _ALNUM[b], _SPACES[b]
    after_word = alnum[:-1].copy()
    after_word[1:] |= (b[:-2] == 0xC3) & _LATIN[b[1:-1]]
    out[1:] = after_word & ~alnum[1:] & (b[1:] < 0x80)
    last = np.append(space[:-1] & _SOLID[b[1:]], False)
    last[ends[ends > 0] - 1] = False
    out |= last
    out[1:] |= last[:-1] & (b[:-1] != 0x20)
    out[0] = out[ends[ends < len(b)]] = True
    return out


def _gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of flat that begin at starts, one after another."""
    ends = np.cumsum(counts)
    return flat[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Ids of texts by one tokenizer's file. special_strings: whether an added token's string in a text becomes that token, as the library has it."""

    def __init__(self, path: str, special_strings: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special_strings
        config = json.loads(self.tokenizer.to_str())
        first, *rest = (config["pre_tokenizer"] or {}).get("pretokenizers", [config["pre_tokenizer"]])
        rules = (config["normalizer"] or {}).get("normalizers", [config["normalizer"]])
        model = config["model"]
        byte_runs = first == _BYTE_RUNS and not rest and rules == [None]
        #: Whether white space leaves no tokens; these tokenizers also lower-case.
        self.drops_space = first == _WORD_RUNS and rest == [_BYTE_RUNS | {"use_regex": False}] and tuple(rules) == _NORMALIZERS
        #: Whether cuts() holds.
        self.local = (byte_runs or self.drops_space) and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges"))
        added = config["added_tokens"]
        self.local &= not any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        self.added = [t["content"].encode() for t in added if special_strings or not t["special"]]
        #: The largest id.
        self.largest = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        self._fresh: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._mapped: dict[int, str] = {c: "".join(_CHARACTER[x] for x in chr(c).encode()) for c in range(0x20, 0x180)}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, need: list[str]) -> None:
        """Ask the library: its model about words (a space, letters), which are one run each, and the whole tokenizer about the rest."""
        rest, tokenize, mapped = [], self.tokenizer.model.tokenize, self._mapped
        for p in need:
            if not _PLAIN(p):
                rest.append(p)
                continue
            q = p.lstrip(" ").lower() if self.drops_space else p
            ids = [t.id for t in tokenize(q.translate(mapped))]
            self._fresh[p] = struct.pack(f"<{len(ids)}I", *ids)
        self._fresh.update(zip(rest, self._whole(rest), strict=True))

    def _ids_of(self, found: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        if len(self._fresh) > CACHE_PIECES // 2:
            self._older, self._fresh = self._fresh, {}
        fresh, older, need = self._fresh, self._older, []
        for p in found:
            if p not in fresh:
                if (ids := older.get(p)) is None:
                    need.append(p)
                else:
                    fresh[p] = ids
        self._learn(need)
        out = [fresh[p] for p in found]
        for p in need:
            if len(p) > CACHE_CHARS:
                del fresh[p]
        return out

    def _encode(self, b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of texts whose UTF-8 is b, cut at ends."""
        may = cuts(b, ends)
        shift = (b >= 0x41) & (b <= 0x5A) if self.drops_space else None
        if self.drops_space:
            # Within a text, a letter before a non-ASCII character keeps its case: the two may be composed, in one case only.
            shift[:-1] &= (b[1:] < 0x80) | may[1:]
        if self.added and any(s in (data := b.tobytes()) for s in self.added):
            for lo, hi in zip(np.append(0, ends[:-1]), ends):
                if any(data.find(s, lo, hi) >= 0 for s in self.added):
                    may[lo + 1 : hi] = False
                    if self.drops_space:
                        shift[lo:hi] = False
        if self.drops_space:
            b = np.where(shift, b + 32, b).astype(np.uint8)
        at = np.flatnonzero(may).astype(np.int32)
        offsets = np.append(at, np.int32(len(b)))
        pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(b)))
        coded = pieces.dictionary_encode()
        known = self._ids_of(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(known), "<u4")
        counts = np.fromiter(map(len, known), np.int64, len(known)) // 4
        which = coded.indices.to_numpy()
        per_piece = counts[which]
        ids = _gather(flat, (np.cumsum(counts) - counts)[which], per_piece)
        total = np.concatenate(([0], np.cumsum(per_piece)))
        bounds = total[np.searchsorted(at, np.concatenate(([0], ends)))]
        return ids, np.diff(bounds)

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids as u32, number of ids of each text) of run after run of the texts, in batches of bounded size."""
        texts = texts.cast(pa.large_string()).fill_null("")
        ends = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + BATCH_BYTES, side="right")) - 1)
            if self.local:
                yield self._encode(data[ends[at] : ends[to]], ends[at + 1 : to + 1] - ends[at])
            else:
                found = self._whole(texts.slice(at, to - at).to_pylist())
                yield np.frombuffer(b"".join(found), "<u4"), np.array([len(f) // 4 for f in found], np.int64)
            at = to


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special_strings: bool = True) -> Encoder:
    """The encoder of a tokenizer's file, loaded once in a worker."""
    if (path, special_strings) not in _encoders:
        _encoders[path, special_strings] = Encoder(path, special_strings)
    return _encoders[path, special_strings]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """ids and counts of encode() with end_id after each text."""
    if end_id is None:
        return ids, counts
    out, last = np.empty(len(ids) + len(counts), "<u4"), np.cumsum(counts + 1) - 1
    is_end = np.zeros(len(out), bool)
    is_end[last] = True
    out[is_end], out[~is_end] = end_id, ids
    return out, counts + 1
