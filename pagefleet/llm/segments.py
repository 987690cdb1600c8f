"""Exact tokenizer ids for whole texts, encoding each distinct segment once.

A segment is a run of characters between two single spaces, with the space
before it. The pre-tokenizers of the public vocabularies never look across
such a space, so a text's ids are its segments' ids joined. A text in which a
space touches another white-space character, or the ends of the text, has no
such cut; it is encoded whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct segments kept by a worker, in two generations of half of it each.
CACHE_SEGMENTS = 1_200_000


#: What str.split takes for white space and Unicode does not.
OTHER_SPACES = re.compile("[\x1c-\x1f]")


class GenerationalCache:
    """A dict of bounded size: a full generation replaces the one before it."""

    def __init__(self, limit: int = CACHE_SEGMENTS):
        self.half = max(1, limit // 2)
        self.young: dict = {}
        self.old: dict = {}

    def prepare(self, keys: set) -> list:
        """Make room, bring known ``keys`` into the young generation and return the others."""
        if len(self.young) + len(keys) > self.half and self.young:
            self.old, self.young = self.young, {}
        missing = keys.difference(self.young)
        if self.old and missing:
            old = self.old
            known = [k for k in missing if k in old]  # a set's intersection would walk the dict
            for k in known:
                self.young[k] = old[k]
            missing.difference_update(known)
        return list(missing)


class LibraryCodec:
    """The tokenizers library behind ``segments`` and ``whole``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.starts = self.ends.copy()
        for token, i in vocabulary.items():
            self.ends[i], self.starts[i] = token.endswith("</w>"), token.startswith("\u0120")
        self.word_ends = bool(self.ends.any())
        letters = "abcdefghijklmnopqrstuvwxyz"
        #: Whether case makes no difference.
        self.folds = self._ids(letters) == self._ids(letters.upper())

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def whole(self, text: str) -> bytes:
        return np.asarray(self._ids(text), dtype="<u4").tobytes()

    def split(self, text: str) -> list[str]:
        """Segments; at any white space where the tokenizer drops it (str.split knows four more)."""
        return text.split() or [""] if self.word_ends and not OTHER_SPACES.search(text) else text.split(" ")

    def segments(self, texts: list[str], lead: str) -> list[bytes]:
        out = []
        for lo in range(0, len(texts), 20_000):
            out += self._some(texts[lo:lo + 20_000], lead)
        return out

    def _some(self, texts: list[str], lead: str) -> list[bytes]:
        """Ids of segments, encoded as one text where its tokens show their borders."""
        if lead and not self.word_ends:  # a token that begins with a space begins a segment
            ids = np.asarray(self._ids("".join([lead + t for t in texts])), dtype="<u4")
            cut = np.append(np.flatnonzero(self.starts[ids]), len(ids))
        elif self.word_ends and all(map(str.isalpha, texts)):  # a word is letters only: one token ends it
            ids = np.asarray(self._ids(" ".join(texts)), dtype="<u4")
            cut = np.append(0, np.flatnonzero(self.ends[ids]) + 1)
        else:
            ids, cut = np.zeros(0, "<u4"), np.zeros(0, int)
        if len(cut) != len(texts) + 1:
            enc = self.tokenizer.encode([lead + t for t in texts], is_pretokenized=True, add_special_tokens=False)
            ids = np.asarray(enc.ids, dtype="<u4")
            cut = np.searchsorted(np.asarray(enc.word_ids, dtype=np.int64), np.arange(len(texts) + 1))
        raw, cut = ids.tobytes(), (cut * 4).tolist()
        return [raw[a:b] for a, b in zip(cut, cut[1:])]


class SegmentEncoder:
    """Whole texts to ids (little-endian unsigned 32-bit, as bytes)."""

    def __init__(self, codec, cache: int = CACHE_SEGMENTS):
        self.codec = codec
        self.first, self.rest = GenerationalCache(cache // 4), GenerationalCache(cache)
        #: Marks that pre-tokenizers cut from the letters before them, and their ids.
        self.tails = dict(zip(".,", codec.segments([".", ","], "")))

    def _fill(self, cache: GenerationalCache, keys: set, lead: str) -> None:
        """Make every key's ids known; None for one that white space touches.

        Letters with one mark behind them are the letters' ids and the mark's,
        and words are encoded in lower case where the tokenizer folds case.
        """
        missing = cache.prepare(keys)
        young, old, tails, folds = cache.young, cache.old, self.tails, self.codec.folds
        later, words, others = [], set(), []
        if not folds:
            words.update(filter(str.isalpha, missing))  # letters only: no mark, no white space
            missing = [k for k in missing if k not in words]
        for k in missing:
            if not k or k[0].isspace() or k[-1].isspace():
                young[k] = None
                continue
            tail = k[-1] if k[-1] in tails else ""
            word = k[:-1] if tail else k
            if not (word.isalpha() and (word.isascii() or word.lower().isalpha())):
                others.append(k)
                continue
            if folds and word.isascii():
                word = word.lower()
            later.append((k, word, tail))
            if word not in young:
                words.add(word)
        for w in words:
            if w in old:
                young[w] = old[w]
        fresh = [w for w in words if w not in young]
        young.update(zip(fresh, self.codec.segments(fresh, lead)))
        young.update(zip(others, self.codec.segments(others, lead)))
        for k, word, tail in later:
            young[k] = young[word] + tails[tail] if tail else young[word]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids; equal segments of a batch are looked up once."""
        if self.codec.word_ends:
            return self._joined(texts)
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        offsets, flat = lists.offsets.to_numpy(), lists.flatten()
        inner = np.ones(len(flat), bool)
        inner[offsets[:-1]] = False  # the first segment of a text has no space before it
        known = flat.filter(pa.array(inner)).dictionary_encode()
        # By way of numpy: many times faster than to_pylist().
        names, heads = (a.to_numpy(zero_copy_only=False).tolist() for a in (known.dictionary, flat.take(pa.array(offsets[:-1]))))
        self._fill(self.first, set(heads), "")
        self._fill(self.rest, set(names), " ")
        entries = [*map(self.rest.young.__getitem__, names), *map(self.first.young.__getitem__, heads)]
        which = np.empty(len(flat), np.int64)
        which[inner] = known.indices.to_numpy()
        which[offsets[:-1]] = len(names) + np.arange(len(texts))
        column = pa.array(entries, pa.large_binary())
        uncut = column.is_null().to_numpy(zero_copy_only=False)  # white space touches a cut
        _, places, data = column.buffers()
        size = np.diff(np.frombuffer(places, "<i8", len(entries) + 1)) // 4
        table = np.frombuffer(data, "<u4", int(size.sum()))
        start, n = np.cumsum(size) - size, size[which]
        ends = np.cumsum(n)
        ids = table[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[which] - (ends - n), n)]
        raw, cut = ids.tobytes(), np.append(0, ends)[offsets] * 4
        whole = np.logical_or.reduceat(uncut[which], offsets[:-1])
        return [self.codec.whole(t) if w else raw[a:b] for t, w, a, b in zip(texts, whole.tolist(), cut.tolist(), cut[1:].tolist())]

    def _joined(self, texts: list[str]) -> list[bytes]:
        split = [self.codec.split(t) for t in texts]
        words: set = set()
        for s in split:
            words.update(s[1:])
        self._fill(self.first, {s[0] for s in split}, "")
        self._fill(self.rest, words, " ")
        head, rest = self.first.young, self.rest.young
        out = []
        for text, s in zip(texts, split):
            try:
                out.append(b"".join([head[s[0]], *map(rest.__getitem__, s[1:])]))
            except TypeError:  # a None: white space that touches a cut
                out.append(self.codec.whole(text))
        return out


_ENCODERS: dict = {}


def encoder(path: str, codec=LibraryCodec) -> SegmentEncoder:
    """One encoder per worker process and vocabulary file; it outlives a task."""
    if (path, codec) not in _ENCODERS:
        _ENCODERS[path, codec] = SegmentEncoder(codec(path))
    return _ENCODERS[path, codec]


def batches(column, max_chars: int = 2_000_000):
    """Consecutive (start, texts) groups of an Arrow string column, nulls as empty texts."""
    group, size, start = [], 0, 0
    for i, t in enumerate(column):
        t = t.as_py() or ""
        if group and size + len(t) > max_chars:
            yield start, group
            group, size, start = [], 0, i
        group.append(t)
        size += len(t)
    if group:
        yield start, group
