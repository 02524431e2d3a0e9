"""A public BPE vocabulary with word ends: normalisation, pre-tokens, exact merges, decoding.

The vocabulary file declares NFC, white space to one space, lower case; pre-tokens by a fixed pattern; bytes as
printable characters; merges with ``</w>`` on a word's last symbol; no decoder, so decoded tokens are joined by one
space.  A pre-token never spans white space, so a text's ids are those of its white-space-separated words, in order.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata

import regex
from tokenizers import Regex, normalizers, pre_tokenizers

from sluice.llm.common import at_hand

_SPECIAL = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
#: str.split() also splits at U+001C..1F, which are not white space to the vocabulary.
_CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f")
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


#: Beyond these the Unicode versions of Python and of the vocabulary's library may differ; the library decides.
_FAR = re.compile("[\u0250-\U0010ffff]")
_LIBRARY = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


def normalized(text: str) -> str:
    if text.isascii():
        return text.lower()
    if _FAR.search(text):
        return _LIBRARY.normalize_str(text)
    return unicodedata.normalize("NFC", text).lower()


def words(text: str) -> list[str]:
    """The normalised words of a text; a special token stands as a word in upper case, which no other word can be."""
    if "<|" in text:
        parts = _SPECIAL.split(text)
        if len(parts) > 1:
            return [w for i, p in enumerate(parts) for w in ([p.upper()] if i % 2 else words(p))]
    text = normalized(text)
    if any(c in text for c in _CONTROLS):
        return [w for w in _SPACE.split(text) if w]
    return text.split()


def _byte_alphabet() -> list[str]:
    """Printable bytes stand for themselves, the rest for characters from U+0100 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"].upper(): t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max(max(self.ids.values()), *self.special.values()) + 1)
        for t, i in self.ids.items():
            self.tokens[i] = t
        for t in spec["added_tokens"]:
            self.tokens[t["id"]] = t["content"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.end = model["end_of_word_suffix"]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern)
        self.far_pattern = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.byte = _byte_alphabet()

    def symbols(self, pre: str) -> list[str]:
        out = [self.byte[b] for b in pre.encode("utf-8", "replace")]
        out[-1] += self.end
        return out

    def merge(self, pre: str) -> list[int]:
        """Ids of one pre-token: the pair of least rank, leftmost first, until no pair merges."""
        s, rank = self.symbols(pre), self.rank
        if len(s) > 64:
            s = self._merge_long(s)
        elif len(s) > 1:
            never = len(rank)
            ranks = [rank.get(p, never) for p in zip(s, s[1:], strict=False)]
            while (best := min(ranks)) < never:
                at = ranks.index(best)
                s[at : at + 2] = [s[at] + s[at + 1]]
                del ranks[at]
                if not ranks:
                    break
                if at:
                    ranks[at - 1] = rank.get((s[at - 1], s[at]), never)
                if at < len(ranks):
                    ranks[at] = rank.get((s[at], s[at + 1]), never)
        return [self.ids[x] for x in s]

    def _merge_long(self, s: list[str]) -> list[str]:
        """The same in n log n: a heap of (rank, place) over a linked list; stale entries are skipped."""
        n, rank = len(s), self.rank
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(rank[p], i, *p) for i, p in enumerate(zip(s, s[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if not alive[i] or s[i] != a or (j := after[i]) >= n or s[j] != b:
                continue
            s[i], alive[j], after[i] = a + b, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (p := (s[i], s[after[i]])) in rank:
                    heapq.heappush(heap, (rank[p], i, *p))
            if before[i] >= 0 and (p := (s[before[i]], s[i])) in rank:
                heapq.heappush(heap, (rank[p], before[i], *p))
        return [x for x, live in zip(s, alive, strict=True) if live]

    def encode_word(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        return [i for pre in self.pre_tokens(word) for i in self.merge(pre)]

    def pre_tokens(self, word: str) -> list[str]:
        if not word.isascii() and _FAR.search(word):
            return [p for p, _ in self.far_pattern.pre_tokenize_str(word)]
        if word.isalpha():  # the two commonest cases, as the pattern has them
            return [word]
        if word[:-1].isalpha():
            return [word[:-1], word[-1]]
        return self.pattern.findall(word)

    def decode(self, ids) -> str:
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


@at_hand
@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
