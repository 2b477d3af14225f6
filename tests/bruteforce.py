"""The tokenizer's rules over plain Python values, for tests only.

Stated as SURVEY lists them: one counter of windows (T02-T05), one sort key (T06), one set of
known texts (T09-T11), and encoding as passes that consume a sequence from its front (E01, E02).
"""

from collections import Counter

import regex

OFF = 1_114_112
# fixed value: the legal-token pattern
LEGAL = regex.compile(r"( ?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+|\s+)")


def spelled(window, words):
    return "".join(words.get(c) or chr(c) for c in window)


def rank(code):
    """Characters rank above tokens; characters by scalar value, tokens by id."""
    return (code < OFF, code)


def one_pass(codes, vocab, n):
    rest, out = codes[::-1], []
    while rest:
        window = tuple(rest[:-n - 1:-1])
        out.append(vocab.get(window, rest[-1]))
        del rest[-n if window in vocab else -1:]
    return out


def encode(codes, vocab, n):
    after = one_pass(codes, vocab, n)
    return codes if after == codes else encode(after, vocab, n)


def train(text, n, size, start=({}, {})):
    """(window -> code, code -> text) of a vocabulary trained on one text, from ``start`` on."""
    vocab, words = map(dict, start)
    codes = encode([ord(c) for c in text], vocab, n)
    while True:
        counted = Counter(zip(*(codes[i:] for i in range(n)), strict=False))
        repeated = [w for w, k in counted.items() if k > 1 and LEGAL.fullmatch(spelled(w, words))]
        repeated.sort(key=lambda w: (counted[w], [rank(c) for c in w]), reverse=True)
        by_text = {spelled(w, words): w for w in reversed(repeated)}      # the best window of a text
        known = set(words.values())
        fresh = [w for w in repeated if by_text[spelled(w, words)] == w and spelled(w, words) not in known]
        fresh = fresh[:size - len(vocab)]
        if not fresh:
            return vocab, words
        spelt = [spelled(w, words) for w in fresh]
        for w, t in zip(fresh, spelt, strict=True):
            words[OFF + len(vocab)] = t
            vocab[w] = OFF + len(vocab)
        codes = encode(codes, vocab, n)
