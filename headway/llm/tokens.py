"""Token ids of whole texts, and their order by document id."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from headway.llm.common import map_rows

END = 1
#: Rows in a run, about, and runs at most.
RUN, RUNS = 2000, 20_000
#: Words that a Python worker remembers the ids of, of each kind.
REMEMBERED = 400_000

#: Latin letters, then marks that are one token run: for these, lower case and byte spelling are known without the normaliser.
_PLAIN = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,;:!?&%$#*]*)")


class Encoder:
    """Ids of texts by a tokenizer file, as little-endian bytes of ``kind``.

    For a tokenizer that splits at white space and drops it, the ids of a text are those of its words in a row, so words are
    encoded once and remembered. A word of Latin letters goes to the tokenizer's model, any other to the whole tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.bytes_of = [x.tobytes() for x in np.arange(size, dtype=self.kind)]
        self.words: dict[str, bytes] = {"": b""}
        self.runs: dict[str, bytes] = {"": b""}
        probe = "aß Éb-c's\n12"
        split = [i for w in re.split("[ \n]", probe) for i in self.tokenizer.encode(w, add_special_tokens=False).ids]
        self.by_word = split == self.tokenizer.encode(probe, add_special_tokens=False).ids
        letters = [chr(c) for c in (*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100))]
        spelt = {x: self.tokenizer.pre_tokenizer.pre_tokenize_str(x) for x in letters} if self.by_word else {}
        self.spelling = {ord(x): s[0][0] for x, s in spelt.items() if len(s) == 1}
        self.tokenize = self.tokenizer.model.tokenize
        self.ascii_as_is = all(self.spelling.get(c) == chr(c) for c in range(97, 123))
        # the model is asked directly only if that gives the same ids for a few words of such letters
        tried = ("a", "the", "été", "straße", "ñandú", "internationalisation")
        self.direct = self.by_word and all(self._model(x) == self._whole(x) for x in tried)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _model(self, run: str) -> bytes:
        spelt = run if self.ascii_as_is and run.isascii() else run.translate(self.spelling)
        return b"".join([self.bytes_of[t.id] for t in self.tokenize(spelt)])

    def _run(self, run: str, encode) -> bytes:
        found = self.runs.get(run)
        if found is None:
            found = encode(run)
            if len(run) <= 40:
                if len(self.runs) >= REMEMBERED:
                    self.runs = {"": b""}
                self.runs[run] = found
        return found

    def _word(self, word: str) -> bytes:
        plain = _PLAIN.fullmatch(word) if self.direct else None
        if plain:
            letters, marks = plain.groups()
            found = self._run(letters.lower(), self._model)
            if marks:
                found += self._run(marks, self._whole)
        else:
            found = self._whole(word)
        if len(word) <= 40:
            if len(self.words) >= REMEMBERED:
                self.words = {"": b""}
            self.words[word] = found
        return found

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if not self.by_word:
            return self._whole(text)
        words = text.replace("\n", " ").split(" ")
        known = list(map(self.words.get, words))
        if None in known:
            known = [k if k is not None else self.words.get(w) or self._word(w) for w, k in zip(words, known)]
        return b"".join(known)


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


def id_bounds(docs: DataFrame, rows: int = RUN, runs: int = RUNS) -> list[int]:
    """Ids that part the rows into runs of ascending doc_id of about ``rows`` rows, or into ``runs`` larger ones.

    Only the ids are read. The driver gets fewer numbers than ``runs``. The parts follow from the ids alone, not from settings of the session.
    """
    parts = min(runs, -(-docs.count() // rows))
    if parts < 2:
        return []
    at = docs.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], max(10_000, 10 * parts)).alias("at")).first()["at"]
    return sorted(set(at or []))


def encoded_in_order(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """(run, doc_id, ids): each text's ids and one ``end``, dealt so that each partition is one run of ascending doc_id, sorted.

    The ids are shuffled, not the texts. A null text is empty; a null doc_id sorts first; rows that repeat an id are
    ordered by their ids' bytes.
    """
    bounds = id_bounds(docs)

    def make():
        enc = encoder(path)
        last = np.array([end], enc.kind).tobytes()

        def step(c):
            numbers = np.array([x if x is not None else np.iinfo(np.int64).min for x in c[0]], np.int64)
            return {"run": np.searchsorted(np.array(bounds, np.int64), numbers).astype(np.int32), "doc_id": c[0], "ids": [enc.encode(t) + last for t in c[1]]}

        return step

    rows = map_rows(docs, ["doc_id", "text"], make, "run int, doc_id long, ids binary")
    return rows.repartitionById(len(bounds) + 1, F.col("run")).sortWithinPartitions("doc_id", "ids")

