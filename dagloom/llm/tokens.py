"""Token ids of whole texts by a public tokenizer, chunk by chunk.

Both tokenizers cut a text before they merge, and never across the boundaries
used here, so every distinct chunk of a batch is encoded once by the tokenizers
library and its ids are laid out by index.  Texts with white space that such a
cut would change, and texts that hold the wording of a special token, are
encoded whole.  For the word tokenizer, words of plain letters skip its normalizer
and its regex, which leave them as they are.  Special tokens' wording gives
their ids, as the library does by default; ``plain`` reads it as ordinary text
instead.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Name of a tokenizer file -> how its texts may be cut.
WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"
#: Chunks that a worker keeps with their ids, and the longest one kept.
CACHE_CHUNKS, CACHE_CHARS = 1_200_000, 48
END_ID = 2
_PUNCT = frozenset(".,!?;:|*%&$#)")
_BLANKS = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_ODD = f"{_BLANKS} (?:{_BLANKS}|$)"
#: Words that the word tokenizer's normalizer leaves as they are, and that are one pre-token each.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
#: Letters of one byte; second bytes of letters after byte C3 (À to ÿ); marks that a word never goes on with; blanks.
_LETTER, _LATIN, _MARK, _BLANK = np.zeros((4, 256), bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LATIN[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True
_MARK[[x for x in range(33, 127) if not chr(x).isalnum() and chr(x) != "'"]] = True
_BLANK[[*range(9, 14), 32]] = True


def _letter(c: str) -> bool:
    """Whether a letter still ends in a letter once it is composed and lower-cased."""
    return c.isalpha() and (c.isascii() or unicodedata.normalize("NFC", c).lower()[-1].isalpha())


def _shown(words: str) -> str:
    """Words of :data:`_PLAIN` letters as byte-level vocabularies write their bytes."""
    if words.isascii():
        return words
    return words.encode().decode("latin-1").replace("\x9f", "\u0141").replace("\xa0", "\u0142").replace("\xad", "\u0143")


def apart(text: pa.Array) -> pa.Array:
    """``text`` with a blank between words of plain letters and the marks that end them.

    The word tokenizer cuts between a letter and a mark anyway.
    """
    text = text.cast(pa.large_string())
    if not len(text):
        return text
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int64, len(text) + 1, 8 * text.offset)
    if at[0] == at[-1]:
        return text
    b = np.frombuffer(data, np.uint8, at[-1] - at[0], at[0])
    letter = _LETTER[b]
    latin = _LATIN[b[1:]] & (b[:-1] == 0xC3)
    letter[1:] |= latin
    mark = _MARK[b]
    cuts = np.flatnonzero(letter[:-1] & mark[1:]) + 1
    letter[:-1] |= latin
    other, ends = np.concatenate(([-1], np.flatnonzero(~letter))), np.append(np.flatnonzero(mark[:-1] & ~mark[1:]) + 1, len(b))
    before, after = other[np.searchsorted(other, cuts) - 1], ends[np.searchsorted(ends, cuts, "right")]
    cuts = cuts[((before < 0) | _BLANK[b[before]]) & ((after == len(b)) | _BLANK[b[np.minimum(after, len(b) - 1)]])]
    at = at - at[0]
    at = at + np.searchsorted(cuts, at)
    return pa.Array.from_buffers(pa.large_string(), len(text), [None, pa.py_buffer(at), pa.py_buffer(np.insert(b, cuts, np.uint8(32)))])


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies (the default for path parameters)."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts by one tokenizer file; distinct chunks are encoded once."""

    def __init__(self, path: str, most: int = CACHE_CHUNKS, plain: bool = False):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.t = Tokenizer.from_file(path)
        self.t.encode_special_tokens = plain
        special = [] if plain else sorted(x.content for x in self.t.get_added_tokens_decoder().values())
        self.special = "|".join(re.escape(x) for x in special)
        self.most = most
        self.spaced = os.path.basename(path) == BYTE_BPE
        self.known: dict[str, int] = {}
        self.last = np.zeros(0, bool)  # ids that end a word, if the vocabulary tells them
        if not self.spaced:
            vocab = self.t.get_vocab()
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[k for w, k in vocab.items() if w.endswith("</w>")]] = True
        self.bare = None  # the same model for words that need no more than a cut at blanks
        if os.path.basename(path) == WORD_BPE:
            from tokenizers.pre_tokenizers import CharDelimiterSplit

            self.bare = Tokenizer(self.t.model)  # shared, not loaded again
            self.bare.pre_tokenizer = CharDelimiterSplit(" ")
        self.clear()

    def clear(self) -> None:
        self.known.clear()
        self.flat = np.empty(1 << 16, np.uint32)
        self.size = self.count = 0
        self.start = np.zeros(1 << 16, np.int64)  # where each chunk's ids begin, and after them where the last one's end

    def _raw(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.t.encode_batch_fast(chunks, add_special_tokens=False)]

    def _plain(self, words: list[str]) -> None:
        """Learn words that :data:`_PLAIN` matches, by the model alone."""
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            lines = [_shown(" ".join(part[j : j + 256])) for j in range(0, len(part), 256)]
            ids = np.fromiter(chain.from_iterable(e.ids for e in self.bare.encode_batch_fast(lines, add_special_tokens=False)), np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                self._keep(part, ids, ends)
            else:
                self._add(part, self._raw(part))

    def _words(self, words: list[str]) -> list[list[int]]:
        """As :meth:`_raw` for words of letters only: many in one text, cut where words end."""
        out: list[list[int]] = []
        for k in range(0, len(words), 256):
            part = words[k : k + 256]
            ids = np.array(self.t.encode(" ".join(part), add_special_tokens=False).ids, np.int64)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):
                out += self._raw(part)
            else:
                ids = ids.tolist()
                out += [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out

    def _add(self, chunks: list[str], ids: list[list[int]]) -> None:
        if chunks:
            ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
            self._keep(chunks, np.fromiter(chain.from_iterable(ids), np.uint32, int(ends[-1])), ends)

    def _keep(self, chunks: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """Keep chunks whose ids lie one after another in ``ids``, up to ``ends``."""
        first = self.count
        self.known.update(zip(chunks, range(first, first + len(chunks)), strict=True))
        ends = self.size + ends
        if first + len(chunks) >= len(self.start):
            self.start = np.concatenate((self.start, np.zeros(max(len(self.start), len(chunks)), np.int64)))
        if ends[-1] > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty(max(len(self.flat), int(ends[-1]) - self.size), np.uint32)))
        self.flat[self.size : ends[-1]] = ids
        self.start[first + 1 : first + 1 + len(chunks)] = ends
        self.size, self.count = int(ends[-1]), first + len(chunks)

    def _learn(self, chunks: list[str]) -> None:
        """Encode unknown chunks; a trailing punctuation mark is a pre-token of its own."""
        if self.bare:
            easy = [(c.isascii() and c.isalpha()) or _PLAIN.fullmatch(c) is not None for c in chunks]
            self._plain(list(compress(chunks, easy)))
            chunks = [c for c, x in zip(chunks, easy, strict=True) if not x]
        whole, stems, joined = [], {}, []
        for c in chunks:
            if len(c) > 2 and c[-1] in _PUNCT and _letter(c[-2]):
                stem = c[:-1]
                joined.append((c, stem, c[-1]))
                if stem not in self.known:
                    stems[stem] = None
                if c[-1] not in self.known:
                    stems[c[-1]] = None
            else:
                whole.append(c)
        todo = list(dict.fromkeys([*stems, *whole]))
        if not self.spaced:
            words = [c for c in todo if c.isalpha()]
            self._add(words, self._words(words))
            todo = [c for c in todo if not c.isalpha()]
        self._add(todo, self._raw(todo))
        self._add([c for c, _, _ in joined], [[*self._ids(s), *self._ids(p)] for _, s, p in joined])

    def _ids(self, chunk: str) -> np.ndarray:
        k = self.known[chunk]
        return self.flat[self.start[k] : self.start[k + 1]].tolist()

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin (one more entry)."""
        if len(self.known) > self.most:
            self.clear()
        ways = [x for x in (_ODD if self.spaced else "", self.special) if x]
        odd = np.flatnonzero(pc.match_substring_regex(text, "|".join(ways)).to_numpy(zero_copy_only=False)) if ways else np.empty(0, np.int64)
        lists = pc.split_pattern(text, " ") if self.spaced else pc.ascii_split_whitespace(pc.ascii_lower(apart(text) if self.bare else text))
        bounds = lists.offsets.to_numpy()
        bounds = bounds - bounds[0]
        coded = lists.flatten().dictionary_encode()
        words, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False)
        if self.spaced:  # all but a text's first chunk begin with the space
            first = np.zeros(len(code), bool)
            first[bounds[:-1][bounds[1:] > bounds[:-1]]] = True
            plain = np.unique(code[first])
            where = np.full(len(words), -1)
            where[plain] = len(words) + np.arange(len(plain))
            chunks = [" " + w for w in words] + [words[k] for k in plain]
            code = np.where(first, where[code], code)
        else:
            chunks = words
        get = self.known.get
        found = np.fromiter(map(get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(found < 0)
        if self.spaced and len(missing):  # a chunk may only be the space of one that no text has
            used = np.zeros(len(chunks), bool)
            used[code] = True
            missing = missing[used[missing]]
        if len(missing):
            self._learn([chunks[k] for k in missing])
            found[missing] = [get(chunks[k]) for k in missing]
        start = self.start
        kind = found[code]
        a = start[kind]
        n = start[kind + 1] - a
        ends = np.concatenate(([0], np.cumsum(n)))
        place = np.repeat(a - ends[:-1], n)
        place += np.arange(ends[-1])
        ids = self.flat[place]
        at = ends[bounds]
        if len(odd):
            whole = self._raw(text.take(pa.array(odd)).to_pylist())
            pieces, last = [], 0
            n = np.diff(at)
            for k, x in zip(odd, whole, strict=True):
                pieces += [ids[last : at[k]], np.array(x, np.uint32)]
                last, n[k] = at[k + 1], len(x)
            ids = np.concatenate([*pieces, ids[last:]])
            at = np.concatenate(([0], np.cumsum(n)))
        long = [c for c in (chunks[k] for k in missing) if len(c) > CACHE_CHARS]
        if len(long) > 1000 or sum(map(len, long)) > 4 << 20:
            self.clear()
        return ids, at

    def encode_documents(self, text: pa.Array, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode`, with ``end_id`` after every text."""
        ids, at = self.encode(text)
        return np.insert(ids, at[1:], np.uint32(end_id)), at + np.arange(len(at))


def encoder(path: str, most: int = CACHE_CHUNKS, plain: bool = False) -> Encoder:
    """This worker's encoder of ``path``; kept from task to task, with ``most`` chunks or so."""
    kept = sys.modules.setdefault("_dagloom_encoders", type(sys)("_dagloom_encoders")).__dict__
    if (path, plain) not in kept:
        kept[path, plain] = Encoder(path, most, plain)
    return kept[path, plain]
