"""Ids of whole texts by a ``tokenizers`` file, word by word where that is exact.

Both kinds of pre-tokenizer that are supported end a word at a lone space between two other
characters: ByteLevel gives the space to the next word, a Split that drops white space drops
it.  So a text without other white space beside a space, and without a special string, has
the ids of its words one after the other.  Line ends part words as well: they are dropped like
spaces, or begin the next word in a space's stead, unless other white space stands beside them
or more than two follow one another.  Arrow splits such texts and numbers their distinct
words; ids of words are kept (their
number is bounded) and gathered by numpy.  A sign after a word of Latin letters is an id of its
own, so the word is kept without it.  Words that aren't kept are encoded together: those of
Latin letters by the file's model alone, which shows in its ids where a word begins or ends;
the others by the whole tokenizer, a special string between them, which the library takes out
before it looks at what stands on either side.  Any other text is encoded whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpuscle.llm.support import held, trim

KEPT_WORDS = 500_000
KEPT_IDS = 1 << 26
STEP_BYTES = 4 << 20
LEARNT_TOGETHER = 1000
#: White space as the library's patterns know it: fixed ranges.
_SPACE = r"[\t-\r\x1c-\x1f \x{85}\p{Z}]"
_UNEVEN = rf"{_SPACE} | {_SPACE}|^ | $"
_OTHER_SPACE = r"[\t\x0b-\r\x1c-\x1f \x{85}\p{Z}]"  # the same without line ends
_UNEVEN_LINES = rf"{_OTHER_SPACE}\n|\n{_OTHER_SPACE}|\n\n\n|\n\n$"
#: Letters that run on as one word for every pattern, and stay single before and after composition.
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
_PLAIN = f"^ ?{_LETTERS}$"
_SIGNS = ".,;:!?"
_SIGNED = f"^(\n?{_LETTERS})[{_SIGNS}]$"
_PROBES = [*(f"{word}{sign}" for word in ("a", "Words", "Àÿßé", "iNTERNATIONALLY") for sign in ("", *_SIGNS))]


def _joined(arrays: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(arrays).astype(kind, copy=False) if arrays else np.zeros(0, kind)


class WordEncoder:
    """Ids of texts as arrays of little-endian unsigned integers of ``width`` bytes."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        first = self.tokenizer.pre_tokenizer
        self.byte_level = isinstance(first, pre_tokenizers.ByteLevel)
        self.lead = " " if self.byte_level else ""  # a word's own space
        self.between = next(((t.content, i) for i, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)), None)
        self.by_words = not (self.byte_level and first.add_prefix_space)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self._model_alone(path)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.starts, self.counts = np.zeros(1024, np.int32), np.zeros(1024, np.int32)  # of bounded words, so 32 bits hold them
        self.store, self.used = np.zeros(1 << 16, self.kind), 0

    def _model_alone(self, path: str) -> None:
        """A tokenizer that takes each line as one word, where the file's ids show a word's edge."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.model, self.plain = Tokenizer.from_file(path), False
        suffix = getattr(self.model.model, "end_of_word_suffix", None)
        if not self.between or not self.by_words or self.byte_level == bool(suffix):
            return
        self.model.normalizer = normalizers.Sequence([] if self.byte_level else [normalizers.Lowercase()])
        lines = pre_tokenizers.Split("\n", "removed")
        self.model.pre_tokenizer = pre_tokenizers.Sequence([lines, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        space = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(" ")[0][0]
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.edge[i] = token.startswith(space) if self.byte_level else token.endswith(suffix)
        signs = self._whole(list(_SIGNS))
        if any(len(ids) != 1 for ids in signs):
            return
        self.sign = np.zeros(256, self.kind)
        self.sign[[ord(c) for c in _SIGNS]] = np.concatenate(signs)
        self._forget()
        self.plain = True
        found = self._by_words(pa.array([f"a {p}" for p in _PROBES], pa.large_string()))
        self.plain = all(map(np.array_equal, found, self._whole([f"a {p}" for p in _PROBES])))

    def _by_model(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the plain words one after the other, and how many each has."""
        lines, out, sizes = words.to_pylist(), [], []
        for lo in range(0, len(lines), LEARNT_TOGETHER):
            ids = self._whole(["\n".join(lines[lo : lo + LEARNT_TOGETHER])], self.model)[0]
            edges = np.flatnonzero(self.edge[ids])
            sizes.append(np.diff(edges, append=len(ids)) if self.byte_level else np.diff(edges, prepend=-1))
            out.append(ids)
        return _joined(out, self.kind), _joined(sizes, np.int64)

    def _whole(self, texts: list[str], tokenizer: object = None) -> list[np.ndarray]:
        return [np.asarray(found.ids, dtype=self.kind) for found in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after the other, and how many each has."""
        words, out, sizes = words.to_pylist(), [], []
        if not self.between:
            out = self._whole(words)
            return _joined(out, self.kind), np.asarray([len(ids) for ids in out], np.int64)
        mark, number = self.between
        for lo in range(0, len(words), LEARNT_TOGETHER):
            ids = self._whole([mark.join(words[lo : lo + LEARNT_TOGETHER])])[0]
            cuts = np.flatnonzero(ids == number)
            sizes.append(np.diff(cuts, prepend=-1, append=len(ids)) - 1)
            out.append(ids[ids != number])
        return _joined(out, self.kind), _joined(sizes, np.int64)

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Keep the ids of new words, by the cheaper way where there is one; the words' places."""
        spaced = words
        if self.lead:
            spaced = pc.binary_join_element_wise(pa.scalar(self.lead, words.type), words, pa.scalar("", words.type))
            spaced = pc.if_else(pc.starts_with(words, "\n"), words, spaced)
        plain = pc.match_substring_regex(spaced, _PLAIN) if self.plain else pa.array([False] * len(words), pa.bool_())
        at = np.zeros(len(words), np.int64)
        for chosen, encode in ((plain, self._by_model), (pc.invert(plain), self._together)):
            if not pc.any(chosen).as_py():
                continue
            ids, sizes = encode(spaced.filter(chosen))
            first, end = len(self.place), self.used + len(ids)
            while first + len(sizes) > len(self.starts):
                self.starts, self.counts = np.concatenate([self.starts, np.zeros_like(self.starts)]), np.concatenate([self.counts, np.zeros_like(self.counts)])
            while end >= len(self.store):  # one place more than is used, see _by_words
                self.store = np.concatenate([self.store, np.zeros_like(self.store)])
            self.counts[first : first + len(sizes)] = sizes
            self.starts[first : first + len(sizes)] = self.used + np.cumsum(sizes) - sizes
            self.store[self.used : end] = ids
            self.used = end
            at[chosen.to_numpy(zero_copy_only=False)] = np.arange(first, first + len(sizes))
            self.place.update(zip(words.filter(chosen).to_pylist(), range(first, first + len(sizes))))
        return at

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where each of the distinct words' ids are kept."""
        texts = words.to_pylist()
        at = np.fromiter(map(self.place.get, texts, repeat(-1)), np.int64, len(texts))
        new = np.flatnonzero(at < 0)
        if len(self.place) + len(new) > KEPT_WORDS or self.used > KEPT_IDS:
            self._forget()
            new = np.arange(len(texts))
        if len(new):
            at[new] = self._learn(words.take(pa.array(new)))
        return at

    def _stems(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each of the distinct words are kept, but for a sign at its end; and that sign."""
        stems = pc.replace_substring_regex(words, _SIGNED, "\\1")
        ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)[1:]
        signs = np.zeros(len(words), np.uint8)
        cut = np.flatnonzero(pc.binary_length(words).to_numpy() > pc.binary_length(stems).to_numpy())
        signs[cut] = np.frombuffer(words.buffers()[2], np.uint8)[ends[cut] - 1]
        if not self.byte_level:  # such files take letters in lower case, which the probes have shown
            stems = pc.if_else(pc.match_substring_regex(stems, _PLAIN), pc.utf8_lower(stems), stems)
        numbered = stems.dictionary_encode()
        return self._places(numbered.dictionary)[numbered.indices.to_numpy()], signs

    def _by_words(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each of several even texts."""
        texts = pc.replace_substring(texts, "\n", " \n" if self.byte_level else " ")
        split = pc.split_pattern(texts, " ")
        words, ends = split.values, split.offsets.to_numpy().astype(np.int64)  # a first word's own space is missing
        if self.byte_level:
            ids, sizes = self._together(words.take(pa.array(ends[:-1])))
            firsts = np.split(ids, np.cumsum(sizes)[:-1])
        numbered = words.dictionary_encode()
        indices = numbered.indices.to_numpy()
        which, signs = self._stems(numbered.dictionary) if self.plain else (self._places(numbered.dictionary), np.zeros(len(numbered.dictionary), np.uint8))
        counts, starts = (self.counts[which] + (signs > 0))[indices], self.starts[which][indices]
        if self.byte_level:
            counts[ends[:-1]] = 0
        after = np.cumsum(counts, dtype=np.int32)  # a step's ids
        from_ = np.repeat(starts - (after - counts), counts)
        from_ += np.arange(len(from_), dtype=np.int32)
        ids = self.store[from_]
        signs = signs[indices]
        signed = np.flatnonzero((signs > 0) & (counts > 0))
        ids[after[signed] - 1] = self.sign[signs[signed]]  # until here, whatever stands after the word's own ids
        cuts = np.concatenate([[0], after])[ends].tolist()
        body = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        return [np.concatenate(pair) for pair in zip(firsts, body)] if self.byte_level else body

    def encode_many(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.equal(pc.binary_length(texts), 0)
        if self.by_words:
            odd = pc.or_(odd, pc.match_substring_regex(texts, f"{_UNEVEN}|{_UNEVEN_LINES}" if self.byte_level else _UNEVEN))
            for s in self.special:
                odd = pc.or_(odd, pc.match_substring(texts, s))
        else:
            odd = pa.array([True] * len(texts))
        whole = self._whole(texts.filter(odd).to_pylist())
        if len(whole) == len(texts):
            return whole
        even, whole_ = iter(self._by_words(texts.filter(pc.invert(odd)))), iter(whole)
        return [next(whole_ if o else even) for o in odd.to_pylist()]

    def in_steps(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """As ``encode_many``, a few million bytes at a time."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            done = int(sizes[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, done + STEP_BYTES, side="right")))
            yield from self.encode_many(texts.slice(at, end - at))
            trim()  # else a step's arrays stay with the worker
            at = end


def encoder(path: str) -> WordEncoder:
    return held(("encoder", path), lambda: WordEncoder(path))
