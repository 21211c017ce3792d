"""Token ids by a public byte-pair vocabulary whose words stand alone.

The vocabulary drops white space, lowers letters and merges within runs of letters, single
digits and runs of other signs only, so the ids of a text are those of its space-separated
words, and the ids of a word those of its runs, one after another.  Runs are found here in texts
of Latin-1 characters, which lowering and composing keep apart; of other texts, words of other
characters and with the string of a special token go to the tokenizer.  A Python worker keeps the
tokenizer and the ids of runs it has met, up to ``REMEMBERED_BYTES``; a full memory learns no
more, and is emptied when a task begins.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import types

from ._shared import pieces_of

VOCABULARY = "word_bpe_49k.json"
#: What a worker remembers of runs, in bytes.
REMEMBERED_BYTES = 48 << 20
#: What an entry takes besides its run and ids: two object heads and its share of the table.
ENTRY_BYTES = 190
#: Longer runs are merged each time they are met.
LONGEST_REMEMBERED = 64

#: The vocabulary's runs, in lowered text of Latin-1 characters.
_RUN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-z0-9ªµºß-öø-ÿ²³¹¼½¾]+")
_BEYOND = re.compile("[^\x00-\xff]")
_SPECIAL = "<|"


def worker_memory() -> dict:
    """A dict that lives as long as the Python worker, whichever task runs in it."""
    return sys.modules.setdefault("statloom_worker_memory", types.ModuleType("statloom_worker_memory")).__dict__


def _letters_of_bytes() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}


class Memory(dict):
    """Ids by run, found by ``find`` where they are new; bounded by bytes."""

    def __init__(self, find):
        super().__init__()
        self.find, self.held = find, 0

    def __missing__(self, run: str) -> bytes:
        ids = self.find(run)
        if len(run) <= LONGEST_REMEMBERED and self.held < REMEMBERED_BYTES:
            self[run] = ids
            self.held += len(run) + len(ids) + ENTRY_BYTES
        return ids

    def emptied_if_full(self) -> None:
        if self.held >= REMEMBERED_BYTES:
            self.clear()
            self.held = 0


class WordTokenizer:
    """Encodes UTF-8 texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = _letters_of_bytes()
        self.ids = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.known = Memory(self._run)

    @classmethod
    def of_worker(cls, path: str | None = None) -> WordTokenizer:
        """The worker's own tokenizer."""
        memory = worker_memory()
        if (key := f"tokenizer {path}") not in memory:
            memory[key] = cls(path)
        memory[key].known.emptied_if_full()
        return memory[key]

    def _run(self, run: str) -> bytes:
        plain = run.isascii() and run.isprintable()
        found = [t.id for t in self.merge(run if plain else run.encode().decode("latin-1").translate(self.letters))]
        return struct.pack(f"<{len(found)}I", *found)

    def _runs(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, _RUN.findall(text.lower())))

    def _word(self, word: str) -> bytes:
        if _SPECIAL not in word and not _BEYOND.search(word):
            return self._runs(word)
        found = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(found)}I", *found)

    def encode(self, text: bytes | None) -> bytes:
        out = []
        for piece in pieces_of(text or b""):
            said = piece.decode()
            if _SPECIAL not in said and (said.isascii() or not _BEYOND.search(said)):
                out.append(self._runs(said))
            else:
                out += [self._word(w.decode()) for w in piece.split()]
        return b"".join(out)
