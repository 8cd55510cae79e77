"""Whole-text token ids from the public tokenizers, for Arrow batches.

The pre-tokenisers of both supported files always cut a text where white space
begins after another character, and where a run of common punctuation begins
after a letter or digit.  A text's ids therefore are the concatenation of the ids
of its pieces between such places.  ``Encoder`` marks these places in a batch,
dictionary-encodes the pieces, asks the tokenizers library only for pieces it
doesn't remember, and gathers the ids with numpy.  A piece of letters only is one
pre-token, so it goes to the library's BPE model directly, its bytes written in
the byte-level alphabet; any other piece takes the library's whole way.  A text that
holds an added token's literal (such as ``<|endoftext|>``) goes there uncut.

A null text counts as empty and has no ids of its own; the end id is the
caller's business.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces of each of two generations that a worker remembers (together about 100 MB at most).
MEMORY = 200_000
#: Marks places to cut at; texts that hold it or an added token's literal go to the library whole.
MARK = "\x01"
AFTER_SPACE = r"[\s\p{Z}\x{0b}\x{85}][ ]"
SPACE_BEGINS = r"([^\s\p{Z}\x{0b}\x{85}])([ \n\t\r])"
PUNCTUATION_BEGINS = r'([\p{L}\p{N}])([.,;:!?*%$&#|")])'


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: visible Latin-1 characters stand for themselves, other bytes for 256 and up in order."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in visible]
    return {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Ids of texts; without ``spaced`` white space and ASCII case have no part in them."""

    def __init__(self, path: str, spaced: bool, memory: int = MEMORY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        literals = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: In any case of letters: a literal may be sought after the normaliser.
        self.uncut = "(?i)" + "|".join(map(re.escape, [MARK, *literals]))
        self.spaced = spaced
        self.memory = memory
        self.model, self.alphabet = self.tokenizer.model, byte_alphabet()
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _found(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces.  What hasn't been met for a generation is forgotten."""
        if len(self.new) > self.memory:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        out = list(map(new.get, pieces))
        missing = [k for k, x in enumerate(out) if x is None]
        ask = []
        for k in missing:
            x = old.get(pieces[k])
            if x is None:
                ask.append(k)
            else:
                out[k] = new[pieces[k]] = x
        ask = [k for k in ask if not self._letters(pieces[k], k, out)]
        for lo in range(0, len(ask), 4096):
            part = ask[lo : lo + 4096]
            for k, enc in zip(part, self.tokenizer.encode_batch_fast([pieces[k] for k in part], add_special_tokens=False), strict=True):
                out[k] = new[pieces[k]] = np.array(enc.ids, np.uint32).tobytes()
        return out

    def settle(self) -> None:
        """At a task's end: of the pieces remembered keep those of the last half generation at most, as a worker lives on."""
        self.old = {}
        if len(self.new) > self.memory // 2:
            self.new = {}

    def _letters(self, piece: str, k: int, out: list) -> bool:
        """Encode a piece of letters (after one space at most); says whether it was one."""
        word = piece[1:] if piece[:1] == " " else piece
        if not word.isalpha() or not (word.isascii() or self.spaced or (word == word.lower() and unicodedata.is_normalized("NFC", word))):
            return False
        text = (piece if self.spaced else word).encode().decode("latin-1").translate(self.alphabet)
        out[k] = self.new[piece] = np.array([t.id for t in self.model.tokenize(text)], np.uint32).tobytes()
        return True

    def _marked(self, texts: pa.Array) -> pa.Array:
        odd = pc.match_substring_regex(texts, AFTER_SPACE)
        marked = pc.replace_substring(texts, " ", MARK + " ")
        if pc.any(odd).as_py():
            where = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            other = pc.replace_substring_regex(texts.take(pa.array(where)), SPACE_BEGINS, rf"\1{MARK}\2")
            marked = pc.replace_with_mask(marked, odd, other)
        marked = pc.replace_substring_regex(marked, PUNCTUATION_BEGINS, rf"\1{MARK}\2")
        return marked if self.spaced else pc.ascii_lower(marked)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as uint32, offsets of each text in them, one more than texts)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        held = pc.match_substring_regex(texts, self.uncut)
        whole = np.flatnonzero(held.to_numpy(zero_copy_only=False))
        lists = pc.split_pattern(self._marked(pc.if_else(held, "", texts) if len(whole) else texts), MARK)
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        coded = pc.dictionary_encode(lists.flatten())
        codes = coded.indices.to_numpy()
        found = self._found(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        n = sizes[codes]
        ends = np.cumsum(n)
        place = np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - n), n)
        place += np.arange(len(place))
        ids = flat[place]
        offsets = np.concatenate([[0], ends])[bounds]
        if len(whole):
            ids, offsets = self._insert(texts, whole, ids, offsets)
        return ids, offsets

    def _insert(self, texts, whole, ids, offsets):
        parts, at, sizes = [], 0, np.diff(offsets)
        for row in whole:
            got = np.asarray(self._ids(texts[int(row)].as_py()), np.uint32)
            parts += [ids[at : offsets[row]], got]
            at, sizes[row] = offsets[row + 1], len(got)
        parts.append(ids[at:])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
