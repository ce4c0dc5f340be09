"""Byte pair encoding of distinct words by a prefix-sharing trie.

The encoding of every prefix of a word ends in one definite token, and what stands before
that token is the encoding of the shorter prefix.  So the last token of each prefix is a state
that can be handed down a trie: a node's state follows from the states of its ancestors.  Words
are visited in sorted order, which is the depth-first order of their trie; the states of the
common prefix with the word before are kept, so each trie node is worked out once.  An Aho-Corasick
automaton, carried along with the states, names the tokens that can end at a node.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Iterator

#: The code points that stand for themselves when a byte is written as a character.
PRINTABLE_BYTES = (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100))


#: Bits of a symbol in an automaton step's key; steps kept at most.
SYMBOL_BITS, MOST_STEPS = 9, 2_000_000
NEVER = 1 << 60


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    own = {b for r in PRINTABLE_BYTES for b in r}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class WordTrieEncoder:
    """Encodes words with the merges of a byte-level BPE file.

    A symbol is one byte, written as the character of that number; with an end-of-word suffix
    the last byte of a word is another symbol, 256 higher.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        code = {c: chr(b) for b, c in enumerate(byte_characters())}

        def symbols(token: str) -> str:
            if self.suffix and token.endswith(self.suffix):
                inner = [code[c] for c in token[: -len(self.suffix)]]
                return "".join(inner[:-1]) + chr(ord(inner[-1]) + 256)
            return "".join(code[c] for c in token)

        self.text_of = {i: t for t, i in model["vocab"].items()}
        self.ids = {symbols(t): i for t, i in model["vocab"].items()}
        self.symbols_of = {i: s for s, i in self.ids.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            tail = right
            self.merges[model["vocab"][left], model["vocab"][tail]] = (rank, model["vocab"][left + tail])
        self._automaton()
        self.pairs: dict[int, bool] = {}
        self.histories: dict[int, list[tuple[int, int, int]] | None] = {}

    def _automaton(self) -> None:
        """Aho-Corasick automaton over the tokens: steps by (state, symbol), and the tokens that end in each state."""
        steps: dict[int, int] = {}
        token_at: dict[int, int] = {}
        depth, above = [0], [(0, 0)]
        for symbols, token in self.ids.items():
            state = 0
            for c in symbols:
                key = state << SYMBOL_BITS | ord(c)
                nxt = steps.get(key)
                if nxt is None:
                    nxt = steps[key] = len(depth)
                    depth.append(depth[state] + 1)
                    above.append((state, ord(c)))
                state = nxt
            token_at[state] = token
        fail = [0] * len(depth)
        #: By state: (token, its length), longest first.
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(depth)
        for state in sorted(range(1, len(depth)), key=depth.__getitem__):
            parent, symbol = above[state]
            if parent:
                back = fail[parent]
                while back and (back << SYMBOL_BITS | symbol) not in steps:
                    back = fail[back]
                fail[state] = steps.get(back << SYMBOL_BITS | symbol, 0)
            own = ((token_at[state], depth[state]),) if state in token_at else ()
            self.ends[state] = own + self.ends[fail[state]]
        self.steps, self.fail, self.most_steps = steps, fail, MOST_STEPS

    def _step(self, state: int, symbol: int) -> int:
        """A step that fails over to shorter suffixes; it is kept, within a bound."""
        back = state
        while back and (back << SYMBOL_BITS | symbol) not in self.steps:
            back = self.fail[back]
        nxt = self.steps.get(back << SYMBOL_BITS | symbol, 0)
        if len(self.steps) < self.most_steps:
            self.steps[state << SYMBOL_BITS | symbol] = nxt
        return nxt

    def merged(self, symbols: str, steps: list[tuple[int, int, int]] | None = None) -> list[int]:
        """Encoding of a short string by its merges, lowest rank first; the definition itself.

        ``steps`` gets, for each merge, its rank and the first and last part after it.
        """
        parts = [self.ids[c] for c in symbols]
        while len(parts) > 1:
            best = min(((self.merges[p][0], k) for k, p in enumerate(zip(parts, parts[1:])) if p in self.merges), default=None)
            if best is None:
                break
            rank, k = best
            parts[k : k + 2] = [self.merges[parts[k], parts[k + 1]][1]]
            if steps is not None:
                steps.append((rank, parts[0], parts[-1]))
        return parts

    def _history(self, token: int) -> list[tuple[int, int, int]] | None:
        """The merges that make a token of its bytes, led by the state before them; null if they make others."""
        if token not in self.histories:
            symbols = self.symbols_of[token]
            steps = [(-1, self.ids[symbols[0]], self.ids[symbols[-1]])]
            self.histories[token] = [*steps, (NEVER, 0, 0)] if self.merged(symbols, steps) == [token] else None
        return self.histories[token]

    def _pair(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their bytes are encoded together.

        Both sides' merges go on by rank, as they would alone, unless one across the border comes first.
        """
        if len(self.pairs) > self.most_steps:
            self.pairs.clear()
        a, b = self._history(left), self._history(right)
        ok = a is not None and b is not None
        i = j = 0
        while ok:
            across = self.merges.get((a[i][2], b[j][1]))
            rank, other = a[i + 1][0], b[j + 1][0]
            if across is not None and across[0] < rank and across[0] <= other:
                ok = False
            elif rank == other == NEVER:
                break
            elif rank <= other:
                i += 1
            else:
                j += 1
        self.pairs[left << 17 | right] = ok
        return ok

    def _whole(self, token: int) -> bool:
        return self._history(token) is not None

    def symbols(self, word: str) -> str:
        raw = word.encode("utf-8", "replace").decode("latin-1")
        return raw[:-1] + chr(ord(raw[-1]) + 256) if self.suffix and raw else raw

    def encode(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Each word with its token ids, in the depth-first order of the words' trie."""
        for word, size, tokens, spans in self._walk(words, False):
            ids = []
            while size:
                ids.append(tokens[size])
                size -= spans[size]
            ids.reverse()
            yield word, ids

    def count(self, words: Iterable[str]) -> Iterator[tuple[str, int]]:
        """Each word with its number of tokens.

        Each transition of the trie says by how much it changes the number of tokens emitted so far: the
        token that then stands last takes the place of those behind the prefix that it leaves.
        """
        for word, size, _, emitted in self._walk(words, True):
            yield word, emitted[size]

    def _walk(self, words: Iterable[str], counting: bool) -> Iterator[tuple[str, int, list[int], list[int]]]:
        """Each word with its length and, by prefix length, the last token and its length, or with ``counting`` the tokens emitted."""
        tokens, spans, states = [0], [0], [0]  # by prefix length: last token, its length or the tokens emitted, automaton's state
        before = ""
        steps, ends, pairs = self.steps.get, self.ends, self.pairs.get
        for word in sorted(words):
            s = self.symbols(word)
            size = len(s)
            shared = min(size, len(before))  # neighbours mostly differ near their ends
            while s[:shared] != before[:shared]:
                shared -= 1
            del tokens[shared + 1 :], spans[shared + 1 :], states[shared + 1 :]
            state, end = states[-1], shared
            for c in s[shared:]:
                end += 1
                symbol = ord(c)
                nxt = steps(state << SYMBOL_BITS | symbol)
                state = self._step(state, symbol) if nxt is None else nxt
                for token, n in ends[state]:
                    if n == end:
                        if self._whole(token):
                            break
                        continue
                    left = tokens[end - n]
                    ok = pairs(left << 17 | token)
                    if ok is None:
                        ok = self._pair(left, token)
                    if ok:
                        break
                tokens.append(token)
                spans.append(spans[end - n] + 1 if counting else n)
                states.append(state)
            before = s
            yield word, size, tokens, spans


def character_ranges(pattern: str) -> tuple[tuple[int, int], ...]:
    """The code points that one of the tokenizers library's character classes takes, as ranges."""
    from tokenizers import Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(f"{pattern}+"), "removed", invert=True)
    found: list[list[int]] = []
    for start in range(0, 0x110000, 256):
        block = "".join(chr(c) for c in range(start, start + 256) if not 0xD800 <= c < 0xE000)
        for run, _ in split.pre_tokenize_str(block) if block else ():
            if found and found[-1][1] == ord(run[0]) - 1:
                found[-1][1] = ord(run[-1])
            else:
                found.append([ord(run[0]), ord(run[-1])])
    return tuple(map(tuple, found))


@functools.cache
def classes() -> dict[str, tuple[tuple[int, int], ...]]:
    """Letters, numbers and white space as the tokenizers library knows them."""
    return {"letter": character_ranges(r"\p{L}"), "number": character_ranges(r"\p{N}"), "space": character_ranges(r"\s")}


def charset(ranges: Iterable[tuple[int, int]]) -> str:
    """Ranges as the inside of a character class of ``re``."""
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
