"""Token ids of whole texts by a given tokenizer file."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from sluice.llm.segments import SegmentTable, joinable, starts_of

#: New segments are handed to the library in texts of about this many bytes.
JOINED = 1 << 15
#: Segments that the pre-tokenizer leaves whole: letters up to U+00FF, perhaps after one blank.
WHOLE = re.compile(rb" ?(?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+")


def byte_alphabet() -> dict[int, str]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Encodes texts with the tokenizers library as it is, each distinct segment once.

    Added tokens inside a text are the library's to find, as by default.
    Segments apply to byte-level vocabularies without a normalizer, whose added
    tokens no segment cut divides; with any others texts are encoded whole.
    """

    def __init__(self, tokenizer_file: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        parts = json.loads(self.tokenizer.to_str())
        cuts, added = parts["pre_tokenizer"] or {}, parts["added_tokens"]
        self.added = {t["content"].encode(): t["id"] for t in added}
        self.by_segment = (parts["normalizer"] is None and parts["model"]["type"] == "BPE" and cuts.get("type") == "ByteLevel"
                           and not cuts.get("add_prefix_space") and cuts.get("use_regex", True) and not parts["truncation"] and not parts["padding"]
                           and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip"))
                           and all(len(starts_of(np.frombuffer(b"x" + t, dtype=np.uint8))) == 1 for t in self.added))
        if self.by_segment:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.token_bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
            for token, i in vocabulary.items():
                self.token_bytes[i] = len(token)
            for token, i in self.added.items():
                self.token_bytes[i] = len(token)
            self.alphabet = byte_alphabet()
            self.table = SegmentTable(self._learn, np.uint32)

    def ids(self, text: bytes | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; none for null."""
        return self.batch([text])[0].astype("<u4").tobytes()

    def batch(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        texts = [t or b"" for t in texts]
        return self.table.texts(texts) if self.by_segment else self._whole(texts)

    def _learn(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found: list[array | None] = [None] * len(segments)
        tokenize, alphabet, whole, joined = self.tokenizer.model.tokenize, self.alphabet, WHOLE.fullmatch, []
        for i, s in enumerate(segments):
            if whole(s) and s not in self.added:
                found[i] = array("I", [t.id for t in tokenize(s.decode("latin-1").translate(alphabet))])
            elif joinable(s):
                joined.append(i)
        if joined:
            self._learn_joined(segments, joined, found)
        rest = [i for i, ids in enumerate(found) if ids is None]
        ids, sizes = self._whole([segments[i] for i in rest])
        for i, part in zip(rest, np.split(ids, np.cumsum(sizes)[:-1]) if rest else []):
            found[i] = array("I", part.tobytes())
        return np.frombuffer(b"".join(found), dtype=np.uint32), np.array(list(map(len, found)), dtype=np.int64)

    def _learn_joined(self, segments: list[bytes], chosen: list[int], found: list[array | None]) -> None:
        """Encode segments in a row, several to a text, and deal the ids out by the bytes that each stands for."""
        lengths = np.array([len(segments[i]) for i in chosen], dtype=np.int64)
        heads = np.flatnonzero(np.diff((np.cumsum(lengths) - lengths) // JOINED, prepend=-1))
        groups = [chosen[a:b] for a, b in zip(heads, [*heads[1:], len(chosen)])]
        try:
            texts = [b"".join([segments[i] for i in g]).decode() for g in groups]
        except UnicodeDecodeError:
            return
        for group, encoded in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids, begin = array("I", encoded.ids), 0
            ends = np.cumsum(self.token_bytes[ids])
            stops = np.searchsorted(ends, np.cumsum([len(segments[i]) for i in group])) + 1
            for i, stop in zip(group, stops.tolist()):
                found[i], begin = ids[begin:stop], stop

    def _whole(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        found = [np.array(f.ids, dtype=np.uint32) for f in
                 self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        return np.concatenate(found), np.array([len(f) for f in found], dtype=np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer_file: str) -> Encoder:
    """The encoder of this worker process, with its table of segments."""
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = Encoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
