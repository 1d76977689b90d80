"""Exact, de-duplicated use of the public ``tokenizers`` vocabularies.

Texts are cut into *units* at blanks where a cut provably can't change the ids.  The distinct units of a batch are found by
Arrow; those of Latin letters and then ASCII marks are two pieces for either vocabulary, so the distinct runs of letters
are encoded together, in joined strings that are cut again at ids which only begin (or end) a word.  Every id comes from the
library; only repeated work is left out.  ``tests/llm`` holds the result against ``Tokenizer.encode(text,
add_special_tokens=False)``.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
END_ID = 1
#: Texts are encoded in groups of about so many bytes; a longer text is a group of its own.
GROUP_BYTES = 16 << 20
#: Words of a group whose ids are gathered at a time, and texts of a call of the library: what lies beside the group's own arrays.
STEP_WORDS, CALL_TEXTS = 1 << 18, 1 << 13

_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = r"^[A-Za-zÀ-ÖØ-öø-įı-ɏ]+$"  # Latin letters but for the one whose lower case is two characters
_RISKY = r" [\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]| \z"
_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")


def vocabulary(name: str) -> str:
    """Path of a vocabulary file of the installed ``public_tokenizers`` package, or `name` itself if it is a path."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _spread(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices of the items of slices (starts, lengths), one slice after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class Encoder:
    """ids of whole texts as little-endian unsigned integers, 16 bit where the vocabulary allows it."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(vocabulary(name))
        self.spaced = "word_bpe" not in name
        # for runs of letters (lower-cased already), the same model without the costly steps
        cut = pre_tokenizers.Split(" ", "merged_with_next") if self.spaced else pre_tokenizers.WhitespaceSplit()
        self.letters = Tokenizer.from_file(vocabulary(name))
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([cut, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.end = np.array([END_ID], self.dtype).tobytes()
        #: ids that begin a word with its blank, or that end a word: where joined runs of letters are cut again
        self.edge = np.zeros(self.size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.edge[i] = token.startswith("Ġ") if self.spaced else token.endswith("</w>")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids and their number for each text, by the library alone."""
        flat, counts = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for i in range(0, len(texts), CALL_TEXTS):
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts[i : i + CALL_TEXTS], add_special_tokens=False)]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat.append(np.fromiter(chain.from_iterable(ids), self.dtype, int(n.sum())))
            counts.append(n)
        return np.concatenate(flat), np.concatenate(counts)

    def _runs(self, runs: list[str], step: int = 200) -> tuple[np.ndarray, np.ndarray]:
        """ids and their number for each run of letters (for a spaced vocabulary, with the blank before it)."""
        groups = [runs[i : i + step] for i in range(0, len(runs), step)]
        between = " "
        flat, counts = [], []
        several = max(1, CALL_TEXTS // step)
        calls = (groups[i : i + several] for i in range(0, len(groups), several))
        for own, e in chain.from_iterable(zip(x, self.letters.encode_batch_fast([(between if self.spaced else "") + between.join(y) for y in x], add_special_tokens=False)) for x in calls):
            ids = np.array(e.ids, self.dtype)
            marked = np.flatnonzero(self.edge[ids])
            cuts = np.append(marked, len(ids)) if self.spaced else np.append(0, marked + 1)
            if len(cuts) == len(own) + 1 and cuts[0] == 0 and cuts[-1] == len(ids):
                n = np.diff(cuts)
            else:
                ids, n = self._each([(between if self.spaced else "") + x for x in own])
            flat.append(ids)
            counts.append(n)
        return np.concatenate([np.zeros(0, self.dtype), *flat]), np.concatenate([np.zeros(0, np.int64), *counts])

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids and their number for each distinct unit (without its blank)."""
        run = pc.ascii_rtrim(units, characters=_MARKS)
        plain = pc.match_substring_regex(run, _PLAIN)
        is_plain = plain.to_numpy(zero_copy_only=False).astype(bool)
        run = pc.filter(run, plain)
        rest = pc.binary_length(run).to_numpy(zero_copy_only=False)
        whole = pc.filter(units, plain)
        marks_n = pc.binary_length(whole).to_numpy(zero_copy_only=False) - rest
        marked = np.flatnonzero(marks_n)
        marks = [x[-n:] for x, n in zip(pc.take(whole, pa.array(marked)).to_pylist(), marks_n[marked].tolist())]
        if not self.spaced:
            run = pc.utf8_lower(run)
        coded = pc.dictionary_encode(run)
        run_ids, run_n = self._runs(coded.dictionary.to_pylist())
        kinds = {m: k for k, m in enumerate(dict.fromkeys(marks))}
        mark_ids, mark_n = self._each(list(kinds))
        odd_ids, odd_n = self._each([" " + x if self.spaced and x else x for x in pc.filter(units, pc.invert(plain)).to_pylist()])
        # every unit as two slices of one pool: its run (or the odd unit as a whole), and its marks
        pool = np.concatenate([run_ids, odd_ids, mark_ids])
        starts = np.concatenate([np.cumsum(run_n) - run_n, len(run_ids) + np.cumsum(odd_n) - odd_n, len(run_ids) + len(odd_ids) + np.cumsum(mark_n) - mark_n]).astype(np.int64)
        lengths = np.concatenate([run_n, odd_n, mark_n])
        first = np.zeros((len(units), 2), np.int64)
        n = np.zeros((len(units), 2), np.int64)
        which = np.empty(len(units), np.int64)
        which[is_plain] = coded.indices.to_numpy(zero_copy_only=False)
        which[~is_plain] = len(run_n) + np.arange(len(odd_n))
        first[:, 0], n[:, 0] = starts[which], lengths[which]
        if len(marked):
            at = np.flatnonzero(is_plain)[marked]
            k = len(run_n) + len(odd_n) + np.fromiter((kinds[m] for m in marks), np.int64, len(marks))
            first[at, 1], n[at, 1] = starts[k], lengths[k]
        return pool[_spread(n.ravel(), first.ravel())], n.sum(1)

    def _group(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of texts without nulls."""
        slow = np.zeros(len(texts), bool)
        for s in self.special:
            slow |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False).astype(bool)
        if self.spaced:
            slow |= pc.match_substring_regex(texts, _RISKY).to_numpy(zero_copy_only=False).astype(bool)
            fast = texts
        else:
            fast = pc.replace_substring(texts, "\n", " ")  # white space only separates here
        if slow.any():
            fast = pc.if_else(pa.array(slow), "", fast)
        parts = pc.split_pattern(fast, " ")
        counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        heads = np.cumsum(counts) - counts
        words = parts.flatten()
        coded = pc.dictionary_encode(words)
        ids, n = self._units(coded.dictionary)
        index = coded.indices.to_numpy(zero_copy_only=False)
        if self.spaced and len(texts):  # the first unit of a text has no blank before it
            head_ids, head_n = self._each(pc.take(words, pa.array(heads)).to_pylist())
            index = index.copy()
            index[heads] = len(n) + np.arange(len(texts))
            ids, n = np.concatenate([ids, head_ids]), np.concatenate([n, head_n])
        del fast, parts, words, coded
        starts = np.cumsum(n) - n
        flat = [np.zeros(0, self.dtype)]
        for i in range(0, len(index), STEP_WORDS):
            own = index[i : i + STEP_WORDS]
            flat.append(ids[_spread(n[own], starts[own])])
        total = np.add.reduceat(n.astype(np.int32)[index], heads, dtype=np.int64) if len(texts) else np.zeros(0, np.int64)
        cuts = np.concatenate([[0], np.cumsum(total)])
        del index
        raw, width = np.concatenate(flat).tobytes(), self.dtype.itemsize
        del flat
        for k in range(len(texts)):
            if slow[k]:
                yield self._slow(texts[k].as_py())
            else:
                yield raw[cuts[k] * width : cuts[k + 1] * width]

    def _slow(self, text: str) -> bytes:
        """A text with runs of white space or the name of a special token: cut only between words, or not at all."""
        units = [text] if any(s in text for s in self.special) else _SAFE_CUT.split(text)
        return self._each(units)[0].tobytes()

    def encode(self, texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        """The ids of each text, without an end id; a null text has none."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "")
        if len(texts):
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(texts):
                before = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + GROUP_BYTES, "right")))
                yield from self._group(texts.slice(at, to - at))
                at = to


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One per Python worker, kept between tasks."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def encoded(column: pa.Array, name: str, rows: int = 512) -> Iterator[tuple[int, list[bytes]]]:
    """First row and ids, with the end id, of successive runs of `rows` texts of a column."""
    e = encoder(name)
    at, held = 0, []
    for ids in e.encode(column):
        held.append(ids + e.end)
        if len(held) == rows:
            yield at, held
            at, held = at + rows, []
    if held:
        yield at, held
