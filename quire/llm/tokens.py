"""Token ids of whole texts: an exact, fast front to the tokenizers library."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from quire.llm.common import held

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words that a worker remembers; about 100 MB.
CACHE_WORDS = 500_000
#: Words that are learnt together.
LEARN = 8192

# Texts of Latin letters and common signs are cut by numpy as the usual byte-level pre-tokenizer cuts them:
# '(?:s|t|re|ve|m|ll|d)| ?letters| ?digits| ?other signs|white space that a non-space doesn't follow|white space
_L = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
_N = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_OTHER = re.compile("[^\t\n\r\x20-\x7e\u00a1-\u00ac\u00ae-\u017f]")
# Any other text is cut before each space that a non-space follows, where that pre-tokenizer never joins.
_CUT = re.compile(r"(?=[ ]\S)")

#: Kinds of characters; BREAK is the zero byte that ends a text here (a text that holds one is another text).
SPACE, LETTER, DIGIT, SIGN, BREAK = range(5)
_KIND = np.array([BREAK, *(SPACE if c in " \t\r\n" else LETTER if re.match(f"[{_L}]", c) else DIGIT if re.match(f"[{_N}]", c) else SIGN for c in map(chr, range(1, 0x180)))], np.uint8)
#: The character that the byte-level pre-tokenizer writes for each byte: itself if it is printed, else one from U+0100 on.
_SHOWN = np.array([*range(33, 127), *range(161, 173), *range(174, 256)])
_SPELLED = np.arange(256, dtype="<u2")
_SPELLED[np.setdiff1d(_SPELLED, _SHOWN)] = np.arange(256, 512 - len(_SHOWN))


def word_starts(b: np.ndarray) -> np.ndarray:
    """Where the words of UTF-8 texts start, each of which a zero byte ends; such a byte is a word, too."""
    kind = _KIND[b]
    at = np.flatnonzero(b >= 0xC0)
    kind[at] = kind[at + 1] = _KIND[(b[at].astype(np.int64) & 0x1F) << 6 | b[at + 1] & 0x3F]
    start = kind == BREAK
    start[0] = True
    start[1:] |= kind[1:] != kind[:-1]
    # before a non-space, the last white space stands alone; a space is that word's first character
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != BREAK))
    start[last] = True
    start[last + 1] = b[last] != 0x20
    # a word that begins with an apostrophe may be a contraction
    at = np.flatnonzero(b == 0x27)
    at = at[start[at]]
    one, two = b[at + 1], b[np.minimum(at + 2, len(b) - 1)]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    start[at[short | long] + 1] = False
    start[at[short] + 2] = start[at[long] + 3] = True
    return np.flatnonzero(start)


class Encoder:
    """Encodes with a byte-level BPE file of the tokenizers library.

    ``ids`` gives exactly what ``Tokenizer.encode(text, add_special_tokens=False)``
    gives, as little-endian unsigned integers of ``width`` bytes. Texts are cut where the
    pre-tokenizer cuts them, and each distinct part goes to the library once while it is
    remembered: a word (bytes) straight to its model, as nothing is left to cut, a part of
    another text (str) through all of its steps. A text that spells one of the file's added
    tokens, and every text if the file has other steps than the usual ones, is encoded as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.path, self.tok = path, Tokenizer.from_file(path)
        self.model, steps = self.tok.model, self.tok.pre_tokenizer
        self.usual = isinstance(self.model, models.BPE) and not self.model.dropout and self.tok.normalizer is None and isinstance(steps, pre_tokenizers.ByteLevel) and steps.use_regex and not steps.add_prefix_space
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.words: dict[bytes | str, bytes] = {b"\0": b""}

    def _pack(self, ids) -> bytes:
        return np.asarray(ids, self.dtype).tobytes()

    def _learn(self, new: list[bytes] | list[str]) -> list[bytes]:
        words = self.words
        if len(words) + len(new) > CACHE_WORDS:
            # what was met first is mostly what is met often: keep that half
            for part in list(words)[CACHE_WORDS // 2 :]:
                del words[part]
        out: list[bytes] = []
        for i in range(0, len(new), LEARN):  # the library's own objects take many times a word's size
            some = new[i : i + LEARN]
            if isinstance(some[0], bytes):
                spelled = _SPELLED[np.frombuffer(b"\0".join(some), np.uint8)].tobytes().decode("utf-16-le")
                found = list(map(self.model.tokenize, spelled.split(chr(_SPELLED[0]))))
                flat = self._pack([t.id for e in found for t in e])
            else:
                found = self.tok.encode_batch_fast(some, add_special_tokens=False)
                flat = self._pack([i for e in found for i in e.ids])
            at = 0
            for e in found:
                end = at + self.width * len(e)
                out.append(flat[at:end])
                at = end
        words.update(zip(new, out, strict=True))
        return out

    def _known(self, parts: list[bytes] | list[str]) -> list[bytes]:
        """The ids of distinct parts; those that are new are learnt."""
        ids = list(map(self.words.get, parts))
        missing = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(missing, self._learn([parts[i] for i in missing]), strict=True):
            ids[i] = x
        return ids

    def _latin(self, texts: list[str]) -> list[bytes]:
        data = "\0".join([*texts, ""]).encode()
        starts = word_starts(np.frombuffer(data, np.uint8))
        offsets = pa.py_buffer(np.append(starts, len(data)))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        ids = np.array(self._known(words.dictionary.to_numpy(zero_copy_only=False).tolist()), object)
        ids = ids[words.indices.to_numpy()].tolist()
        out, at = [], 0
        for end in np.flatnonzero(np.frombuffer(data, np.uint8)[starts] == 0).tolist():
            out.append(b"".join(ids[at:end]))
            at = end + 1
        return out

    def many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; the words that are new in many of them are learnt in one call."""
        out: list[bytes] = [b""] * len(texts)
        at = 0
        while at < len(texts):
            latin, cut, size = [], {}, 0
            while at < len(texts) and size < 1 << 21:
                text = texts[at]
                if text and (not self.usual or any(a in text for a in self.added)):
                    out[at] = self._pack(self.tok.encode(text, add_special_tokens=False).ids)
                elif text:
                    if _OTHER.search(text):
                        cut[at] = _CUT.split(text)
                    else:
                        latin.append(at)
                    size += len(text)
                at += 1
            if latin:
                for k, ids in zip(latin, self._latin([texts[k] for k in latin]), strict=True):
                    out[k] = ids
            if cut:
                parts = list({p for c in cut.values() for p in c})
                ids = dict(zip(parts, self._known(parts), strict=True))
                for k, c in cut.items():
                    out[k] = b"".join(map(ids.__getitem__, c))
        return out

    def ids(self, text: str | None) -> bytes:
        return self.many([text])[0]


def encoder(path: str) -> Encoder:
    """The encoder of this Python process, for tasks that keep ``path``."""
    return held(path, lambda: Encoder(path))


def vocabulary(name: str) -> str:
    """Where a public tokenizer file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
