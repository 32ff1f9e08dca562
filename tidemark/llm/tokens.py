"""Token ids by the tokenizers library, with a memo of words.

Both vocabularies split a text into words before merging, and no token spans such a split. A text is therefore cut
at single spaces where the tokenizer is bound to split as well, each distinct piece is encoded once by the library,
and the ids are joined. Pieces whose ends might bind to their neighbours are joined to them first, so the ids equal
those of the whole text (tests compare the two on random texts).
"""

from __future__ import annotations

import functools
import itertools
import os

import numpy as np

os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task: Spark has the cores

#: How ByteLevel writes the bytes of letters from À on that don't stand for themselves.
_BYTES: dict[int, int] = {b: 290 + b - 128 for b in range(128, 161)} | {173: 323}
#: Marks of which a run after letters is a piece of its own (an apostrophe may bind to letters).
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Pieces that one Python worker remembers at most; then it starts anew.
MEMO = 1_500_000


class WordMemo:
    """Encodes texts to little-endian arrays of ids; word_bpe drops white space, byte_bpe keeps it in the tokens."""

    def __init__(self, path: str, keeps_space: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_space = keeps_space
        self.bytes_each = 2 if self.tokenizer.get_vocab_size() <= 65536 else 4
        self.kind = np.dtype(f"<u{self.bytes_each}")
        self.memo: dict[str, bytes] = {}
        self.lead = " " if keeps_space else ""
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # words are remembered here

        self.marks: dict[str, bytes] = {}
        self.line = self.direct(["\n"])[0]

    def direct(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, dtype=self.kind).tobytes() for x in found]

    @staticmethod
    def _plain(c: str) -> bool:
        return "!" <= c <= "~" or ("À" <= c <= "ɏ")

    def _cut(self, w: str) -> tuple[str, str] | None:
        """Letters of w and the run of marks after them, if w is that and both are short."""
        letters = w.rstrip(_MARKS)
        if letters.isalpha() and len(letters) < 64 and len(w) - len(letters) < 9 and (letters.isascii() or max(letters) <= "ÿ" and self._plain(letters[-1])):
            return letters, w[len(letters) :]
        return None

    def _mark(self, marks: str) -> bytes:
        found = self.marks.get(marks)
        if found is None:
            if len(self.marks) > 50_000:
                self.marks.clear()
            found = self.marks[marks] = self.direct([marks])[0]
        return found

    def _learn(self, new: list[str]) -> None:
        """Remembers new words. Marks after letters are a piece of their own, a newline between words is one in byte_bpe,
        and word_bpe lowers the case, so most words are put together from their letters (after a newline: under a space,
        which no word holds, and the letters)."""
        made, letters, others, memo, lower = [], {}, [], self.memo, not self.keeps_space
        for w in new:
            left, line, right = w.partition("\n") if self.keeps_space else (w, "", "")
            first, second = self._cut(left.lower() if lower else left), self._cut(right) if line else ("", "")
            if first is None or second is None:
                others.append(w)
                continue
            key = " " + second[0] if line else ""
            if first[0] not in memo:
                letters[first[0]] = None
            if line and key not in memo:
                letters[key] = None
            if first[0] != w:
                made.append((w, first, key, second[1]))
        self._learn_letters(list(letters))
        self.memo.update(zip(others, self.direct([self.lead + w for w in others]), strict=True))
        for w, (base, marks), key, more in made:
            ids = memo[base] + self._mark(marks) if marks else memo[base]
            if key:
                ids += memo[key] + self._mark(more) if more else memo[key]
            memo[w] = ids

    def _learn_letters(self, words: list[str]) -> None:
        """A word of letters is one piece to both splits, so the library's model has it as it is, in ByteLevel's letters."""
        lead, split, flat, ends = "Ġ" if self.keeps_space else "", self.model.tokenize, [], [0]
        for w in words:
            plain = w if w.isascii() else w.encode().decode("latin-1").translate(_BYTES)
            flat += [t.id for t in split(plain[1:] if plain[0] == " " else lead + plain)]
            ends.append(len(flat))
        data, n = np.array(flat, dtype=self.kind).tobytes(), self.bytes_each
        self.memo.update((w, (self.line if w[0] == " " else b"") + data[a * n : b * n]) for w, a, b in zip(words, ends[:-1], ends[1:], strict=True))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if "<|" in text:  # may hold a special token's string: as the library has it
            return self.direct([text])[0]
        if self.keeps_space:
            first, *words = text.split(" ")
        else:  # white space is dropped, so any space or newline is a cut
            first, words = "", text.replace("\n", " ").split(" ")
        get = self.memo.get
        found = list(map(get, words))
        if None in found:
            new = list(dict.fromkeys([w for w, x in zip(words, found, strict=True) if x is None]))
            if len(self.memo) + len(new) > MEMO:
                self.memo.clear()
            if self.keeps_space:
                new = [w for w in new if w and len(w) < 64 and self._plain(w[-1])]
            self._learn(new)
            found = [get(w) if x is None else x for w, x in zip(words, found, strict=True)]
        if not self.keeps_space:
            return b"".join(found)
        if None not in found and first and self._plain(first[-1]):
            return self.direct([first])[0] + b"".join(found)
        # A token never holds white space after another character: before a space that follows a plain one is a cut.
        out, run, cut = [], first, bool(first) and self._plain(first[-1])
        for w, ids in zip(words, found, strict=True):
            if cut:
                if run is not None:
                    out.append(self.direct([run])[0])
                    run = None
                if ids is not None:
                    out.append(ids)
                else:
                    run = " " + w
            else:
                run += " " + w
            cut = bool(w) and self._plain(w[-1])
        if run is not None:
            out.append(self.direct([run])[0])
        return b"".join(out)


    def encode_all(self, texts: list[str], together: int = 64) -> list[bytes]:
        """Texts that share one look-up and one lesson of new words; those that need more care are encoded one by one."""
        out: list[bytes] = []
        for at in range(0, len(texts), together):
            some = texts[at : at + together]
            cut = [[] if not t or "<|" in t else (t if self.keeps_space else t.replace("\n", " ")).split(" ") for t in some]
            firsts = [c.pop(0) if c and self.keeps_space else "" for c in cut]
            flat = list(itertools.chain.from_iterable(cut))
            found = list(map(self.memo.get, flat))
            missing = [i for i, x in enumerate(found) if x is None]
            if missing:
                new = list(dict.fromkeys([flat[i] for i in missing]))
                if len(self.memo) + len(new) > MEMO:
                    self.memo.clear()
                if self.keeps_space:
                    new = [w for w in new if w and len(w) < 64 and self._plain(w[-1])]
                self._learn(new)
                for i in missing:
                    found[i] = self.memo.get(flat[i])
            heads = self.direct(firsts) if self.keeps_space else [b""] * len(some)
            end = 0
            for text, words, first, head in zip(some, cut, firsts, heads, strict=True):
                start, end = end, end + len(words)
                own = found[start:end]
                if not words and not first or None in own or self.keeps_space and not (first and self._plain(first[-1])):
                    out.append(self.encode(text))
                else:
                    out.append(head + b"".join(own))
        return out


@functools.cache
def memo(path: str, keeps_space: bool) -> WordMemo:
    """One per Python worker."""
    return WordMemo(path, keeps_space)
