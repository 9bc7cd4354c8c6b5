"""Character n-grams of a batch's distinct words, hashed into buckets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from terrane.llm import kernels as K


@dataclass
class Lexemes:
    """Distinct words of a slice and where each word of the text is among them."""

    words: K.Words
    buf: np.ndarray
    codes: np.ndarray  # of the distinct words
    sample: np.ndarray  # a place of each distinct word in ``words``
    index: np.ndarray  # of every word of the text


def lexemes(buf: np.ndarray, offs: np.ndarray) -> Lexemes:
    buf = K.lower_case(buf)
    words = K.find_words(buf, offs, K.NOT_LETTER)
    codes, sample, index = np.unique(K.word_codes(buf, words), return_index=True, return_inverse=True)
    return Lexemes(words, buf, codes, sample, index)


def padded(lex: Lexemes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the distinct words, each between '<' and '>', and their offsets."""
    s, e = lex.words.start[lex.sample], lex.words.end[lex.sample]
    offs = np.concatenate([[0], np.cumsum(e - s + 2)])
    out = np.empty(int(offs[-1]), np.uint8)
    out[offs[:-1]], out[offs[1:] - 1] = ord("<"), ord(">")
    out[K.ranges(offs[:-1] + 1, e - s)] = lex.buf[K.ranges(s, e - s)]
    return out, offs


def subword_buckets(lex: Lexemes, sizes: tuple[int, ...], buckets: int, affixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, owner) pairs in order of owner: the word itself, its n-grams and
    its prefixes and suffixes (told apart from the n-grams)."""
    text, offs = padded(lex)
    n = len(lex.codes)
    length = np.diff(offs)
    ids, owners = [lex.codes], [np.arange(n)]
    power = K.powers(K.BASE, max((*sizes, *affixes, 1)) + 2)
    value = K.BYTE_CODE[text]

    def hashed(at: np.ndarray, size: int) -> np.ndarray:
        h = np.full(len(at), size, np.uint64)
        for j in range(size):
            h = h + value[at + j] * power[j]
        return h

    for size in sizes:
        count = np.maximum(0, length - size + 1)
        ids.append(K.mix(hashed(K.ranges(offs[:-1], count), size)))
        owners.append(np.repeat(np.arange(n), count))
    for size in affixes:
        has = np.flatnonzero(length - 2 >= size)
        ids.append(K.mix(hashed(offs[has] + 1, size) + np.uint64(0xA5A5)))
        ids.append(K.mix(hashed(offs[has + 1] - 1 - size, size) + np.uint64(0x5A5A)))
        owners += [has, has]
    bucket, owner = np.concatenate(ids), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (bucket[order] % np.uint64(buckets)).astype(np.int64), owner[order]


def segment_sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by owner; owners ascend."""
    out = np.zeros((n, *values.shape[1:]), values.dtype)
    if len(owner):
        begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        out[owner[begin]] = np.add.reduceat(values, begin, axis=0)
    return out
