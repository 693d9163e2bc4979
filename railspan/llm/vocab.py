"""Token ids of whole texts by the tokenizers library, with a bounded memo of pre-tokens.

A text is cut at places where the vocabulary's own pre-tokenizer cuts, whatever stands around: a run of Latin
letters (with the space before it), a run of plain marks, a single line break, and else everything up to the
next ASCII white space. The ids of a text are the ids of its pieces in turn. Each worker keeps the ids of pieces
it has met; a full memo falls back to its oldest, and so commonest, entries. Pieces that are one pre-token go to
the library's model directly, many in a call; all others go through its whole pipeline. Texts with other Unicode
white space are encoded whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np

#: Pieces a worker remembers, and those it keeps when the memo is full.
MEMO, CORE = 800_000, 250_000
#: Pre-tokens in one call of the model.
JOINED = 500

_LETTERS = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++(?![\x80-\xff])"
_MARKS = rb"[.,!?;:]++(?![^\x20\x09-\x0DA-Za-z0-9])"
_PIECE = re.compile(rb"\x20?" + _LETTERS + rb"|\x20?" + _MARKS + rb"|\n(?=[^\x20\x09-\x0D])|[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
_WORD_PIECE = re.compile(_LETTERS + rb"|" + _MARKS + rb"|[^\x20\x09-\x0D]+")
_PLAIN = re.compile(rb"\x20?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[.,!?;:]+)")
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(own))}


class Encoder:
    """encode(texts as UTF-8 bytes) -> ids of all, and the ids of each text."""

    def __init__(self, path: str, lower_words: bool) -> None:
        """lower_words: the vocabulary folds case and drops white space (and its words have an end mark)."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.piece = Tokenizer(self.whole.model)
        self.piece.pre_tokenizer = pre_tokenizers.Split("Ċ", "isolated")  # the letter of the line break, which no plain piece holds
        self.part = np.uint32(self.piece.encode("Ċ", add_special_tokens=False).ids[0])
        self.lower_words = lower_words
        self.letters = _byte_letters()
        self.at: dict[bytes, int] = {}
        self.bounds = np.zeros(MEMO + 1, np.int64)
        self.ids = np.zeros(1 << 20, np.uint32)

    def _model_ids(self, plain: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single pre-tokens, and how many each has."""
        calls = []
        for i in range(0, len(plain), JOINED):
            text = b"\n".join(plain[i : i + JOINED]) + b"\n"
            if self.lower_words:
                text = text.decode().lower().encode()
            calls.append(text.decode("latin-1").translate(self.letters))
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.piece.encode_batch_fast(calls, add_special_tokens=False)])
        parts = np.flatnonzero(ids == self.part)
        return np.delete(ids, parts), np.diff(parts, prepend=-1) - 1

    def _learn(self, new: list[bytes]) -> None:
        if len(self.at) + len(new) > MEMO:
            self.at = {c: i for c, i in self.at.items() if i < CORE}
        n = len(self.at)
        if n + len(new) >= len(self.bounds):  # one batch with more new pieces than the memo holds
            self.bounds = np.concatenate([self.bounds[: n + 1], np.zeros(len(new), np.int64)])
        is_plain = list(map(_PLAIN.fullmatch, new))
        plain = [c for c, p in zip(new, is_plain, strict=True) if p]
        other = [c for c, p in zip(new, is_plain, strict=True) if not p]
        parts, counts = [], []
        if plain:
            ids, count = self._model_ids(plain)
            parts.append(ids)
            counts.append(count)
        if other:
            got = [e.ids for e in self.whole.encode_batch_fast([c.decode() for c in other], add_special_tokens=False)]
            parts.append(np.fromiter(chain.from_iterable(got), np.uint32))
            counts.append(np.fromiter(map(len, got), np.int64, len(got)))
        ids = np.concatenate(parts)
        ends = self.bounds[n] + np.cumsum(np.concatenate(counts))
        if ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(int(ends[-1]) - len(self.ids), len(self.ids) // 2), np.uint32)])
        self.ids[self.bounds[n] : ends[-1]] = ids
        self.bounds[n + 1 : n + 1 + len(new)] = ends
        self.at.update(zip(chain(plain, other), range(n, n + len(new))))

    def _numbers(self, flat: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.at.get, flat, repeat(-1)), np.int64, len(flat))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        odd: dict[int, np.ndarray] = {}
        each = []
        for i, t in enumerate(texts):
            if self.lower_words:
                each.append(_WORD_PIECE.findall(t.lower()))  # ASCII only, as the vocabulary would
            elif _ODD_SPACE.search(t.decode()):
                odd[i] = np.array(self.whole.encode(t.decode(), add_special_tokens=False).ids, np.uint32)
                each.append([])
            else:
                each.append(_PIECE.findall(t))
        flat = list(chain.from_iterable(each))
        k = self._numbers(flat)
        if len(new := np.flatnonzero(k < 0)):
            unknown = list(map(flat.__getitem__, new.tolist()))
            before = len(self.at)
            self._learn(list(dict.fromkeys(unknown)))
            if len(self.at) > before:
                k[new] = self._numbers(unknown)
            else:
                k = self._numbers(flat)
            if len(lost := np.flatnonzero(k < 0)):  # the memo was cut down to its core
                self._learn(list(dict.fromkeys(map(flat.__getitem__, lost.tolist()))))
                k = self._numbers(flat)
        first, n = self.bounds[k], self.bounds[k + 1] - self.bounds[k]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(first - total[:-1], n) + np.arange(total[-1])]
        ends = total[np.cumsum([len(e) for e in each])] if each else np.zeros(0, np.int64)
        counts = np.diff(np.concatenate([[0], ends]))
        if odd:
            parts = np.split(ids, ends[:-1])
            for i, x in odd.items():
                parts[i], counts[i] = x, len(x)
            ids = np.concatenate(parts)
        return ids, counts


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, lower_words: bool) -> Encoder:
    """This worker's encoder; its memo serves all tasks of the worker."""
    if (path, lower_words) not in _encoders:
        _encoders.clear()
        _encoders[path, lower_words] = Encoder(path, lower_words)
    return _encoders[path, lower_words]
