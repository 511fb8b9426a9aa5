"""Order-preserving packing: window cuts that minimise padding and truncation penalties, by dynamic programming."""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from headway.llm.tokens import END, encoded_in_order, encoder

WINDOW = 2048
#: What a cut costs, in tokens of padding: at a sentence's end, elsewhere in a document, and each window's own cost.
SENTENCE, INSIDE, OPEN = 2, 8, 4
#: Ids that are planned at once; a plan ends at a document's end.
PLAN = 1 << 20


def choose_cuts(candidates: list[int], penalties: list[int], window: int = WINDOW, own: int = OPEN) -> list[int]:
    """The best ascending subset of ``candidates`` (from 0 to the end) as window bounds.

    A window of n ids costs its padding, which is ``window`` - n but 0 at a power of two, the penalty of the cut at its end, and ``own``. With
    best[i] = penalty[i] + own + min over j of (best[j] + at[j]) + window - at[i], the minimum runs over the
    candidates up to ``window`` before i: a monotone queue holds those that can still be it. Windows of a power of two are
    tried besides. Neighbouring candidates must not be farther apart than ``window``.
    """
    place = {at: i for i, at in enumerate(candidates)}
    powers = [1 << k for k in range(window.bit_length())]
    large = [p for p in powers if 64 <= p < window]
    best, back = [0] * len(candidates), [0] * len(candidates)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (best + at, index), ascending in the first
    end = candidates[-1]
    for i in range(1, len(candidates)):
        at = candidates[i]
        while candidates[queue[0][1]] < at - window:
            queue.popleft()
        low, j = queue[0]
        low += window - at
        for power in large if at < end - window else powers:
            k = place.get(at - power)
            if k is not None and best[k] < low:
                low, j = best[k], k
        best[i], back[i] = low + penalties[i] + own, j
        key = best[i] + at
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, i))
    cuts, i = [end], len(candidates) - 1
    while i:
        i = back[i]
        cuts.append(candidates[i])
    return cuts[::-1]


def plan(ends: np.ndarray, stops: np.ndarray, window: int = WINDOW, sentence: int = SENTENCE, inside: int = INSIDE, own: int = OPEN) -> np.ndarray:
    """Window bounds over ids whose documents end at ``ends`` and whose sentences end at ``stops``.

    Documents' and sentences' ends are candidates. So are, at the price of a cut inside, every multiple of ``window`` and the binary
    steps before the end, so windows without padding are always among the choices.
    """
    n = int(ends[-1])
    steps = [n - (n % window & ((1 << k) - 1)) for k in range(window.bit_length())]
    cost = {int(at): inside for at in [*range(0, n, window), *steps]}
    cost |= dict.fromkeys(stops.tolist(), sentence)
    cost |= dict.fromkeys(ends.tolist(), 0)
    cost[0] = 0
    at = sorted(cost)
    return np.array(choose_cuts(at, [cost[x] for x in at], window, own))


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, sentence: int = SENTENCE, inside: int = INSIDE, plan_ids: int = PLAN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents stay in ascending doc_id order. Each run of ids is planned in parts of about ``plan_ids`` that end with a document; a part's last
    window may take padding, which the binary steps keep small. ``sequence_id`` is unique and ascends with the order. A null or
    empty text is the end id alone. Rows that repeat an id are packed each. An empty table gives no rows. Where the runs of ids
    are parted follows from the ids (``tokens.id_bounds``), so other rows may shift windows and ``sequence_id``, but settings of the session don't.
    """
    rows = encoded_in_order(docs, tokenizer, end)
    enc = encoder(tokenizer)
    kind = enc.kind
    marks = [i for token, i in enc.tokenizer.get_vocab().items() if re.fullmatch(r"[.!?]+(</w>)?", token)]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    names = [x.split()[0] for x in schema.split(", ")]

    def pieces(run: int, sequence: int, doc_ids: list, raws: list[bytes]) -> tuple[pa.RecordBatch, int]:
        sizes = np.array([len(x) for x in raws], np.int64) // kind.itemsize
        ids = np.frombuffer(b"".join(raws), kind)
        ends = np.cumsum(sizes)
        stop = np.zeros(1 << 16 if kind.itemsize == 2 else int(ids.max()) + 1, bool)
        stop[[m for m in marks if m < len(stop)]] = True
        cuts = plan(ends, np.flatnonzero(stop[ids]) + 1, window, sentence, inside)
        begin = np.union1d(cuts[:-1], ends[:-1])
        size = np.diff(np.append(begin, ends[-1]))
        doc = np.searchsorted(ends, begin, side="right")
        seq = np.searchsorted(cuts, begin, side="right") - 1
        wide = ids.astype("<u4").tobytes()
        crc = [zlib.crc32(wide[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), size.tolist())]
        columns = [[doc_ids[d] for d in doc], begin - (ends - sizes)[doc], size, crc, sizes[doc], (run << 40) + sequence + seq, begin - cuts[seq]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names), sequence + len(cuts) - 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, raws, held, sequence, run = [], [], 0, 0, 0
        for batch in batches:
            for r, name, raw in zip(*(c.to_pylist() for c in batch.columns)):
                run = r
                doc_ids.append(name)
                raws.append(raw)
                held += len(raw) // kind.itemsize
                if held >= plan_ids:
                    out, sequence = pieces(run, sequence, doc_ids, raws)
                    yield out
                    doc_ids, raws, held = [], [], 0
        if raws:
            yield pieces(run, sequence, doc_ids, raws)[0]

    return rows.mapInArrow(work, schema)
