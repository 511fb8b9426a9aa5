"""Language-model scores by context-tree weighting over bytes, beside a unigram base."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from headway.llm.common import cut, shared_path

#: Bytes of context.
DEPTH = 5
#: Bytes that UTF-8 never has: the context before a text, and the end of a text.
BEFORE, END = 0xFE, 0xFF
#: Bytes handled at once; counts held in a task; contexts weighed at once, about; keys broadcast at most.
CHUNK, HELD, BRANCH, FREQUENT = 1 << 20, 600_000, 150_000, 500_000

_TOKEN = np.uint64(1 << 63)
#: Bytes of context that all of a branch share.
_TOP = 3


def is_held_out(doc_id: Column) -> Column:
    """Whether the CRC32 of the id as text leaves 1 on division by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def grams(bodies: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte and end with its context as one number, the byte lowest; and the number of these in each body."""
    pad = bytes([BEFORE]) * depth
    raw = np.frombuffer(b"".join(pad + b + bytes([END]) for b in bodies), np.uint8)
    codes = np.zeros(len(raw) - depth, np.uint64)
    for i in range(depth + 1):
        codes = codes << np.uint64(8) | raw[i : len(raw) - depth + i]
    sizes = np.array([len(b) + 1 for b in bodies])
    # drop the numbers that end in a pad
    ends = np.cumsum(sizes + depth) - depth
    keep = np.ones(len(codes), bool)
    for i in range(depth):
        keep[ends[:-1] + i] = False
    return codes[keep], sizes


def hashed(words: list[bytes]) -> np.ndarray:
    """A key for each token: 63 bits of its hash below a one, so that it is none of the codes. The end is the empty word."""
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)) | _TOKEN


def keys_of(words: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The codes of some texts and how many each has, and the tokens' keys and how many each has."""
    codes, sizes = grams([b" ".join(w) for w in words], depth)
    counts = np.array([len(w) + 1 for w in words])
    return codes, sizes, hashed([x for w in words for x in (*w, b"")]), counts


def texts_of(batch: pa.RecordBatch) -> Iterator[str | None]:
    for at in range(0, batch.num_rows, 256):
        yield from batch.column("text").slice(at, 256).to_pylist()


def chunks(texts: Iterator[str | None]) -> Iterator[list[list[bytes]]]:
    """The texts' words, in lists of about CHUNK bytes of text."""
    held, size = [], 0
    for text in texts:
        held.append(words_of(text))
        size += len(text or "") + 1
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def count(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, n, m) over all rows (text, held_out): how often each byte in context and each token occurs, n in the rows that aren't held out, m in all.

    A task adds up what it reads before it sends anything; what it holds is bounded by HELD, beyond which it sends and goes on.
    """

    def summed(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, *(np.bincount(where, np.concatenate([p[i] for p in parts]), len(keys)).astype(np.int64) for i in (1, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []

        def sent() -> pa.RecordBatch:
            keys, n, m = summed(parts)
            parts.clear()
            return pa.RecordBatch.from_pydict({"key": keys.view(np.int64), "n": n, "m": m})

        for batch in batches:
            held = batch.column("held_out")
            for out in (False, True):
                for words in chunks(texts_of(batch.filter(held if out else pa.compute.invert(held)))):
                    codes, _, tokens, _ = keys_of(words, depth)
                    keys, m = np.unique(np.concatenate([codes, tokens]), return_counts=True)
                    parts.append((keys, m * 0 if out else m, m))
                    if sum(len(p[0]) for p in parts) > 2 * HELD:
                        parts[:] = [summed(parts)]
                        if len(parts[0][0]) > HELD:
                            yield sent()
        if parts:
            yield sent()

    return docs.select("text", "held_out").mapInArrow(run, "key long, n long, m long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


# The context tree. A node is a context of d bytes and the bits of the next byte so far (1 and then those bits); its key is
# context << 8 | bits. It counts the zeros and ones that followed. A node that was never seen has counted none: its estimate is a
# half, and so is all that its subtree gives. Bytes in context that are only to be scored stand in the tree as such nodes.


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, moved up by 8."""
    shift = np.log(np.prod([x + i for i in range(8)], axis=0))
    x = x + 8
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - shift


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The Krichevsky-Trofimov log probability of a sequence of so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - math.log(math.pi) - _log_gamma(zeros + ones + 1.0)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple:
    unique, where = np.unique(keys, return_inverse=True)
    return unique, where, *(np.bincount(where, v, len(unique)) for v in values)


class Level:
    """The nodes of one depth: keys (ascending), zeros, ones, log of the weighted probability, own share in it, and each
    node's row in the level above."""

    def __init__(self, keys, zeros, ones, below=None):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        own = _log_kt(zeros, ones)
        self.weighted = own if below is None else math.log(0.5) + np.logaddexp(own, below)
        self.share = np.ones(len(keys)) if below is None else np.exp(math.log(0.5) + own - self.weighted)
        self.estimate = (ones + 0.5) / (zeros + ones + 1)
        self.parent = None

    def above(self, depth: int) -> Level:
        """The level of contexts of ``depth`` bytes, one fewer than here."""
        mask = np.uint64((1 << 8 * (depth + 1)) - 1)
        keys, self.parent, zeros, ones, below = _summed(self.keys & mask, self.zeros, self.ones, self.weighted)
        return Level(keys, zeros, ones, below)

    def passed(self, done: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the mixture has and what it leaves to deeper nodes once these nodes have taken their share."""
        return done + left * self.share * self.estimate, left * (1 - self.share)


def leaves(codes: np.ndarray, counts: np.ndarray) -> Level:
    """The nodes of the deepest level."""
    codes = codes.astype(np.uint64)
    symbol, context = codes & np.uint64(255), codes >> np.uint64(8) << np.uint64(8)
    keys = np.concatenate([context | (np.uint64(1 << k) | symbol >> np.uint64(8 - k)) for k in range(8)])
    bit = np.concatenate([symbol >> np.uint64(7 - k) & np.uint64(1) for k in range(8)]).astype(np.int64)
    n = np.tile(counts, 8)
    keys, _, zeros, ones = _summed(keys, n * (1 - bit), n * bit)
    return Level(keys, zeros, ones)


def branch(codes: np.ndarray, counts: np.ndarray, depth: int, top: int) -> list[Level]:
    """The levels from contexts of ``top`` bytes to those of ``depth``."""
    levels = [leaves(codes, counts)]
    for d in range(depth - 1, top - 1, -1):
        levels.insert(0, levels[0].above(d))
    return levels


def code_logs(codes: np.ndarray, levels: list[Level], done: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The log10 probability of each code's byte in its context: the mixture over all depths for each of its bits.

    ``done`` and ``left`` are what the levels above have added and left over for the first level's nodes.
    """
    for i, level in enumerate(levels):
        if i:
            done, left = done[level.parent], left[level.parent]
        done, left = level.passed(done, left)
    symbol, context = codes & np.uint64(255), codes >> np.uint64(8) << np.uint64(8)
    logs = np.zeros(len(codes))
    for k in range(8):
        p = done[np.searchsorted(levels[-1].keys, context | (np.uint64(1 << k) | symbol >> np.uint64(8 - k)))]
        logs += np.log10(np.where(symbol >> np.uint64(7 - k) & np.uint64(1), p, 1 - p))
    return logs


def whole_tree(codes: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
    """The log10 probability of each code, where all fit into memory."""
    levels = branch(codes, counts, depth, 0)
    return code_logs(codes, levels, np.zeros(len(levels[0].keys)), np.ones(len(levels[0].keys)))


def weigh(codes: DataFrame, depth: int = DEPTH, branch_rows: int = BRANCH) -> DataFrame:
    """(code, log) from rows (code, n), of which each code has one: the log10 probability of each code's byte in its context.

    Contexts that share their last three bytes form a branch, and a task weighs some whole branches at a time, from the
    leaves up. A branch has at most 256 ** 3 codes, however large the corpus. Its uppermost nodes then meet by their last
    two bytes, at most 65,280 of them for one such pair, and give the nodes of one byte, of which the driver weighs at most 65,280.
    What the upper levels add to the mixture goes the same way back down.
    """
    if not _TOP <= depth <= 6:
        raise ValueError("the context is three to six bytes")
    last = lambda key, n: F.shiftrightunsigned(key, 8).bitwiseAND((1 << 8 * n) - 1)
    parts = F.lit(-(-codes.count() // branch_rows) or 1)
    part = lambda key, n: F.pmod(F.xxhash64(last(key, n)), parts).alias("part")
    branches = codes.select("code", "n", part("code", 3)).groupBy("part")

    def arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return table.column("code").to_numpy().astype(np.uint64), table.column("n").to_numpy()

    def tops(table: pa.Table) -> pa.Table:
        top = branch(*arrays(table), depth, _TOP)[0]
        return pa.table({"key": top.keys.astype(np.int64), "zeros": top.zeros, "ones": top.ones, "below": top.weighted})

    nodes = cut(branches.applyInArrow(tops, "key long, zeros double, ones double, below double"))
    met = nodes.select("*", part("key", 2)).groupBy("part")

    def second(table: pa.Table) -> tuple[np.ndarray, np.ndarray, Level]:
        """The nodes of three bytes, the row of each in the level of two, and that level."""
        keys, *values = (table.column(c).to_numpy() for c in ("key", "zeros", "ones", "below"))
        keys = keys.astype(np.uint64)
        two, parent, zeros, ones, below = _summed(keys & np.uint64(0xFFFFFF), *values)
        return keys, parent, Level(two, zeros, ones, below)

    def firsts(table: pa.Table) -> pa.Table:
        two = second(table)[2]
        keys, _, zeros, ones, below = _summed(two.keys & np.uint64(0xFFFF), two.zeros, two.ones, two.weighted)
        return pa.table({"key": keys.astype(np.int64), "zeros": zeros, "ones": ones, "below": below})

    sums = met.applyInArrow(firsts, "key long, zeros double, ones double, below double").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).orderBy("key").toArrow()
    one = Level(sums.column("key").to_numpy().astype(np.uint64), *(sums.column(c).to_numpy() for c in ("zeros", "ones", "below")))
    none = one.above(0)
    state = none.passed(np.zeros(len(none.keys)), np.ones(len(none.keys)))
    upper = (one.keys, *one.passed(state[0][one.parent], state[1][one.parent]))

    def down(table: pa.Table) -> pa.Table:
        keys, parent, two = second(table)
        at = np.searchsorted(upper[0], two.keys & np.uint64(0xFFFF))
        done, left = two.passed(upper[1][at], upper[2][at])
        return pa.table({"key": keys.astype(np.int64), "done": done[parent], "left": left[parent]})

    states = met.applyInArrow(down, "key long, done double, left double").select("*", part("key", 3)).groupBy("part")

    def logs(table: pa.Table, state: pa.Table) -> pa.Table:
        codes, n = arrays(table)
        levels = branch(codes, n, depth, _TOP)
        order = np.argsort(state.column("key").to_numpy())  # the same keys as the first level's
        done, left = (state.column(c).to_numpy()[order] for c in ("done", "left"))
        return pa.table({"code": codes.astype(np.int64), "log": code_logs(codes, levels, done, left)})

    return branches.cogroup(states).applyInArrow(logs, "code long, log double")


def frequent(model: DataFrame, most: int) -> pa.Table:
    """The rows of the model (key, value, m) that occur most often, at most ``most``: those with m above a bound that few enough pass.

    The bound comes from a histogram of m, which has a row for each of a few hundred ranges.
    """
    scale = F.floor(F.log2("m") * 8).cast("int")
    found, bound = 0, 1 << 30
    for r in sorted(model.groupBy(scale.alias("range")).count().collect(), reverse=True):
        found += r["count"]
        if found > most:
            break
        bound = r["range"]
    return model.filter(scale >= bound).select("key", "value").toArrow()


def lm_score(docs: DataFrame, depth: int = DEPTH, branch_rows: int = BRANCH, most: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    The text that is scored is its words, A-Z in lower case, with single spaces between and an end behind; null is empty. Rows that
    aren't held out are counted, all of them: each byte in its context of ``depth`` bytes for the context tree, each token (by 63 bits of its hash) for
    the base. Counts and values are a table as large as the corpus makes it. The ``most`` frequent keys at most are broadcast with their values, and a pass over the documents adds up
    what they give; of what else a document has, each distinct key is a row that meets the table in a join, and as all these are rarer than the broadcast ones, none is
    a hot key. The pass is written once, with numbers for its rows, and the rows' sums go on from there.

    Rows that repeat an id are scored each; an empty table gives no rows. A byte in a context that never occurred gets what the mixture has left for
    unknown nodes, an even chance a bit; a table without a row to learn from gives every bit an even chance, and 0 as ``base_score``.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", is_held_out(F.col("doc_id")).alias("held_out"))
    path = shared_path(spark, "lm-counts")
    count(rows, depth).write.parquet(path)
    counts = spark.read.schema("key long, n long, m long").parquet(path)
    tokens, codes = counts.filter("key < 0"), counts.filter("key >= 0")
    total, kinds = tokens.filter("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    below = total + 0.5 * (kinds + 1)
    logs = weigh(codes.select(F.col("key").alias("code"), "n"), depth, branch_rows).select(F.col("code").alias("key"), F.col("log").alias("value"))
    path = shared_path(spark, "lm-values")
    codes.select("key", "m").join(logs, "key").unionByName(tokens.select("key", "m", F.col("n").cast("double").alias("value"))).write.parquet(path)
    model = spark.read.schema("key long, m long, value double").parquet(path)
    known = frequent(model, most)
    shared = spark.sparkContext.broadcast((known.column("key").to_numpy(), known.column("value").to_numpy()))

    def summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, np.cumsum(sizes) - sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = shared.value
        table = Table(keys.view(np.uint64), values)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = {k: [] for k in ("n_tokens", "n_known", "base", "score", "bytes", "keys", "times")}
            for words in chunks(texts_of(batch)):
                codes, sizes, tokens, counts = keys_of(words, depth)
                score, no_code = table.find(codes)
                c, no_token = table.find(tokens)
                c = np.where(no_token, 0.0, c)
                base = np.where(no_token, 0.0, np.log10((c + 0.5) / below)) if total else c
                out["n_tokens"].append(counts)
                out["n_known"].append(summed((c > 0).astype(np.int64), counts))
                out["base"].append(summed(base, counts))
                out["score"].append(summed(np.where(no_code, 0.0, score), sizes))
                out["bytes"].append(sizes - 1 + (sizes == 1))
                # what is left of each text, its distinct keys and how often each stands there
                at = np.concatenate([np.repeat(np.arange(len(words)), sizes)[no_code], np.repeat(np.arange(len(words)), counts)[no_token]])
                left = np.concatenate([codes[no_code], tokens[no_token]])
                order = np.lexsort((left, at))
                at, left = at[order], left[order]
                first = np.flatnonzero(np.r_[True, (left[1:] != left[:-1]) | (at[1:] != at[:-1])]) if len(at) else at
                times = np.diff(np.append(first, len(at)))
                ends = np.searchsorted(at[first], np.arange(len(words) + 1))
                for name, x in (("keys", left[first].view(np.int64)), ("times", times)):
                    out[name].append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int64())))
            n = batch.num_rows
            columns = [pa.array(np.arange(row, row + n)), batch.column("doc_id"), batch.column("held_out")]
            columns += [pa.array(np.concatenate(out[k]), t) for k, t in (("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("bytes", pa.int64()))]
            columns += [pa.concat_arrays(out[k]) for k in ("keys", "times")]
            row += n
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "bytes", "keys", "times"])

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, bytes long, keys array<long>, times array<long>"
    path = shared_path(spark, "lm-scores")
    rows.select("doc_id", "text", "held_out").mapInArrow(run, schema).write.parquet(path)
    done = spark.read.schema(schema).parquet(path)
    each = done.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.times").alias("times")).join(model.select("key", "value"), "key")
    is_token, times, value = F.col("key") < 0, F.col("times"), F.col("value")
    zero = F.lit(0).cast("long")
    base = F.when(is_token, times * F.log10((value + 0.5) / F.lit(float(below)))).otherwise(0.0) if total else F.lit(0.0)
    rest = each.select("row", F.when(is_token & (value > 0), times).otherwise(zero).alias("n_known"), base.alias("base"), F.when(is_token, 0.0).otherwise(times * value).alias("score"))
    rest = rest.groupBy("row").agg(*[F.sum(c).alias(f"{c}_") for c in ("n_known", "base", "score")])
    both = done.drop("keys", "times").join(rest, "row", "left")
    score = F.col("score") + F.coalesce("score_", F.lit(0.0))
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("n_known_", zero)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_", F.lit(0.0))).alias("base_score"), score.alias("score"), (-score / math.log10(2) / F.col("bytes")).alias("bits_per_byte"),
    )


class Table:
    """Values by distinct 64-bit keys, found by open addressing for whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(1.25 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.free = np.uint64(2**64 - 1)  # no code is all ones, and no token, as good as
        self.keys, self.values = np.full(1 << bits, self.free, np.uint64), np.zeros(1 << bits)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            empty = np.flatnonzero(self.keys[slot] == self.free)
            self.keys[slot[empty]] = keys[todo[empty]]  # of several for one slot, the last is in
            self.values[slot[empty]] = values[todo[empty]]
            out = self.keys[slot] != keys[todo]
            todo, slot = todo[out], (slot[out] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's value, and whether it has none."""
        slot = self._slot(keys)
        out, here = self.values[slot], self.keys[slot]
        none = here == self.free
        todo = np.flatnonzero((here != keys) & ~none)
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            here = self.keys[slot]
            hit, gone = here == keys[todo], here == self.free
            out[todo[hit]] = self.values[slot[hit]]
            none[todo[gone]] = True
            going = ~(hit | gone)
            todo, slot = todo[going], slot[going]
        return out, none
