"""Operators against brute force, exact round trips and held-out accuracy, and their defined results at the edges."""

import math
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from headway.llm import chat, common, ctw, decontam, exact, langid, licenses, packing, pfor, queries, simhash, tokens, toxicity

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "une phrase assez longue pour une fenêtre entière de dix mots et plus encore. " * 400
EDGE = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "a  b\tc"), (None, "x y z"), (5, " "), (6, LONG), (7, LONG + "fin")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "fr", "s", 0) for i, t in EDGE], SCHEMA).withColumn("keep_id", F.lit(9)).withColumn("key", F.lit("k"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, DIR).toPandas()
    order = list(got.columns)  # the first column needn't be a key
    assert got.sort_values(order).reset_index(drop=True).astype(str).equals(want[got.columns].sort_values(order).reset_index(drop=True).astype(str))


def test_exact_edges(edge, empty):
    got = sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_dedup(edge).collect())
    assert got == [(0, None, 1, True), (1, 1, 2, True), (2, 1, 2, False), (3, 3, 3, True), (3, 3, 3, True), (4, 3, 3, False), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 1, True)]
    assert exact.exact_dedup(empty).count() == 0


def test_exact_splits_collisions(edge):
    """With a hash that hardly tells texts apart, comparing the texts gives the same groups."""
    plain = sorted(map(str, exact.exact_dedup(edge).collect()))
    for hashed in (lambda digest: F.lit(b"x"), lambda digest: F.substring(digest, 1, 1).cast("binary")):
        assert sorted(map(str, exact.exact_dedup(edge, hashed).collect())) == plain


@pytest.mark.parametrize("n", [0, 1, 700, 20000])
def test_sieve_loses_no_key(spark, n):
    """Every key passes, few other rows do, and columns named like the sieve's own come through."""
    rows = spark.range(40000).select("id", F.lit("b").alias("block"), F.lit("x").alias("bits"), F.when(F.col("id") % 9 > 0, F.col("id")).alias("some"))
    keys = spark.range(n).select(F.xxhash64("id").alias("h"))
    out = common.sieved(rows, F.xxhash64("id"), keys, "maybe")
    assert out.columns == [*rows.columns, "maybe"]
    passed = {r["id"] for r in out.filter("maybe").collect()}
    assert set(range(n)) <= passed and len(passed) <= n + 0.03 * (40000 - n)
    assert out.count() == 40000 and out.filter("block = 'b' AND bits = 'x'").count() == 40000
    assert out.filter("NOT maybe").count() == 40000 - len(passed)


def test_full_sieve_changes_no_result(edge, monkeypatch):
    plain = sorted(map(str, exact.exact_dedup(edge).collect()))
    monkeypatch.setattr(common, "MOST_BITS", 8)
    monkeypatch.setattr(common, "BLOCK", 8)
    assert sorted(map(str, exact.exact_dedup(edge).collect())) == plain


def test_decontaminate_edges(spark, edge, empty):
    bench = spark.createDataFrame([(1, "A b C!", 0), (2, None, 0), (None, "x y z", 0), (3, " ".join(LONG.split()[:12]), 0)], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontam.decontaminate(edge, bench).collect()}
    n = len(decontam.words_of(LONG))
    assert {(1, 0, 0, ()), (2, 0, 0, ()), (3, 3, 3, ("1",)), (4, 3, 3, ("1",)), (None, 3, 3, ()), (5, 0, 0, ())} <= got
    assert {(d, w, i) for d, w, _, i in got if d in (6, 7)} == {(6, n, ("3",)), (7, n + 1, ("3",))}
    assert decontam.decontaminate(empty, bench).count() == 0 and decontam.decontaminate(edge, bench.limit(0)).filter("n_hit > 0").count() == 0


def brute_hits(text, items):
    words = decontam.words_of(text)
    hit, found = set(), set()
    for name, item in items:
        other = decontam.words_of(item)
        n = min(10, len(other))
        windows = {tuple(other[p : p + n]) for p in range(len(other) - n + 1)} if n else set()
        for p in range(len(words) - n + 1 if n else 0):
            if tuple(words[p : p + n]) in windows:
                hit.update(range(p, p + n))
                found.add(str(name))
    return len(words), len(hit), sorted(found)


def test_decontaminate_is_brute_force(spark, monkeypatch):
    """Passages shared by many documents and many items, copies of both, items shorter than a window; with full filters too."""
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 40, n))
    common = word(25)
    items = [(i, word(rng.integers(1, 60))) for i in range(30)] + [(100 + i, f"{word(5)} {common} {word(3)}") for i in range(20)] + [(200 + i, common) for i in range(20)] + [(300, "w1"), (301, "w2 w3")]
    texts = [word(rng.integers(0, 200)) for _ in range(40)] + [f"{word(30)} {common[3:80]} {word(9)} {items[k][1]}" for k in range(40)] + [common] * 30
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: brute_hits(t, items) for i, t in enumerate(texts)}
    for most in (decontam.MOST, 2):
        monkeypatch.setattr(decontam, "MOST", most)
        monkeypatch.setattr(decontam, "LEAST", min(most, decontam.LEAST))
        got = {r["doc_id"]: r for r in decontam.decontaminate(docs, bench).collect()}
        assert {i: (r["n_words"], r["n_hit"], r["items"]) for i, r in got.items()} == want
        assert all(r["n_hit"] == sum(b - a for a, b in zip(r["spans"][::2], r["spans"][1::2])) for r in got.values())


def test_filters_are_bounded(spark):
    """A benchmark of many times the bound still has filters of its size: 64 bits a word, MOST words."""
    rows = spark.range(300_000).select(F.xxhash64("id").alias("h1"))
    old = decontam.MOST
    try:
        decontam.MOST = 1 << 11
        made = decontam.filter_of(rows, "h1")
        assert made.table.nbytes == 8 << 11 and made.has(np.array([r["h1"] for r in rows.limit(1000).collect()]).view(np.uint64)).all()
    finally:
        decontam.MOST = old


def test_words_are_those_of_the_pattern():
    """Every character below 256 and some above, in between letters and alone; null and texts without a word have none."""
    chars = [chr(c) for c in range(256)] + list("\u2028\u3000\u0130\u0416\u212a\ud800\U0001f600")
    for text in [None, "", " \n", *chars, *(f"aB{c}Cd {c}" for c in chars), "".join(chars), LONG]:
        want = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        words = decontam.words_of(text)
        assert words == [w.encode("utf-8", "surrogatepass") for w in want] == decontam.words_of(text and text.encode("utf-8", "surrogatepass"))
        hashes = decontam.word_hashes(words)
        assert hashes.dtype == np.uint64 and hashes.tolist() == [xxhash.xxh64_intdigest(w) for w in words]


def test_words_cost_less_than_a_pattern():
    """Cutting a text that isn't ASCII takes less CPU than the pattern alone takes on the text in lower case."""
    text = "Ein Fluß, the River " * 20_000
    low, pattern = text.lower(), re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def seconds(f):
        start = time.process_time()
        f()
        return time.process_time() - start

    assert min(seconds(lambda: decontam.words_of(text)) for _ in range(7)) < min(seconds(lambda: pattern.findall(low)) for _ in range(7))


def brute_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids, root = list(prints), {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_is_brute_force(docs, texts):
    prints = {i: brute_print(t) for i, t in sorted(texts.items())}
    want = brute_components(prints)
    for block, per_key in ((1024, 64), (8, 1)):
        got = simhash.near_dedup(docs, block=block, per_key=per_key).collect()
        assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in got} == {i: (prints[i], want[i]) for i in prints}


def test_simhash_edges(edge, empty):
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.near_dedup(edge).collect())
    assert len(got) == len(EDGE) and (1, 1) in got and (2, 1) in got and (5, 1) in got
    assert simhash.near_dedup(empty).count() == 0


TOKENIZER = Tokenizer.from_file(queries.TOKENIZER)


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, docs, texts, edge, empty):
    want, start = {}, 0
    for i in sorted(texts):
        ids = ids_of(texts[i])
        want[i] = (start, len(ids), crc(ids))
        start += len(ids)
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op5_token_output(spark, DIR).collect()} == want
    rows = pfor.read_ids(spark, pfor.write_ids(edge, queries.TOKENIZER)).collect()
    want = sorted(((i, crc(ids_of(t))) for i, t in EDGE), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    rows = sorted(rows, key=lambda r: r["start"])
    assert sorted((r["doc_id"] or 0, r["ids_crc32"]) for r in rows) == sorted((i or 0, c) for i, c in want) and [r["doc_id"] for r in rows] == [i for i, _ in want]
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows[:-1]]]).tolist()
    assert pfor.read_ids(spark, pfor.write_ids(empty, queries.TOKENIZER)).count() == 0


def test_token_files_read_a_range(spark, docs, texts):
    path = pfor.write_ids(docs, queries.TOKENIZER, file_ids=20_000)
    whole = [x for i in sorted(texts) for x in ids_of(texts[i])]
    for first, last in ((0, 5), (19_990, 60_100), (len(whole) - 3, len(whole) + 9), (7, 7)):
        assert [x for r in pfor.read_range(spark, path, first, last).orderBy("start").collect() for x in r["ids"]] == whole[first:last]


@pytest.mark.parametrize("ids", [[], [5], [7] * 300, [1 << 31, 0, 3], list(range(1000)), [0] * 255 + [65535] * 30])
def test_blocks_round_trip(ids):
    names, back = pfor.decode_file(pfor.encode_file([1, None], [np.array(ids, np.int64), np.array([2], np.int64)]))
    assert names == [1, None] and back[0].tolist() == ids and back[1].tolist() == [2]


def test_encoder_equals_library():
    enc = tokens.Encoder(queries.TOKENIZER)
    for text in ("Straße, naïve ÀB?!x", "a'b don't 12 3,4", "İstanbul ſ K", "", " \t\n", "日本語 text", "é é", "x" * 300):
        assert np.frombuffer(enc.encode(text), enc.kind).tolist() == ids_of(text)[:-1]


def test_encoder_equals_library_on_odd_strings():
    enc, rng = tokens.Encoder(queries.TOKENIZER), np.random.default_rng(5)
    letters = list("abcXYZ .,;'-_!?0123\n\t") + list("éßñÀÇİıſœ") + list("日本кий́ ") + ["\x00", "\u200b", "\ufeff", "😀"]
    for _ in range(3000):
        text = "".join(rng.choice(letters, rng.integers(1, 25)))
        assert np.frombuffer(enc.encode(text), enc.kind).tolist() == ids_of(text)[:-1]


def check_pieces(rows, want):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(want)
    for i, pieces in by_doc.items():
        at = 0
        for start, length, check, total in sorted(pieces):
            assert start == at and total == len(want[i]) and check == crc(want[i][start : start + length])
            at += length
        assert at == len(want[i])
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding / sum(map(len, want.values()))


def test_packing(docs, texts, empty):
    assert check_pieces(packing.pack(docs, queries.TOKENIZER).collect(), {i: ids_of(t) for i, t in texts.items()}) < 0.02
    assert packing.pack(empty, queries.TOKENIZER).count() == 0


def test_packing_edges(edge):
    """Null ids, null and empty texts, repeated rows, and a text of more ids than are planned at once: every id lies in one piece."""
    rows = packing.pack(edge, queries.TOKENIZER, plan_ids=3000).collect()
    want = sorted((i or 0, len(ids_of(t))) for i, t in EDGE)
    held = {}
    for r in rows:
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + r["length"]
    assert held == {i: sum(n for j, n in want if j == (i or 0)) for i in held} and len(held) == len({i for i, _ in EDGE})
    assert max(len(ids_of(t)) for _, t in EDGE) > 3000
    for seq in {r["sequence_id"] for r in rows}:
        pieces = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == seq)
        assert [o for o, _ in pieces] == np.cumsum([0, *[n for _, n in pieces[:-1]]]).tolist() and sum(n for _, n in pieces) <= 2048


def test_cuts_are_optimal():
    def cost(cuts, price, window):
        total = 0
        for a, b in zip(cuts, cuts[1:]):
            n = b - a
            total += price[b] + packing.OPEN + (0 if n & (n - 1) == 0 and n >= 64 else window - n)
        return total

    rng = np.random.default_rng(1)
    for _ in range(20):
        at = [0, *np.cumsum(rng.integers(1, 60, 9)).tolist()]
        price = {x: int(rng.integers(0, 9)) for x in at}
        got = packing.choose_cuts(at, [price[x] for x in at], 128)
        best = {0: 0}
        for i, b in enumerate(at[1:], 1):
            best[b] = min(best[a] + cost([a, b], price, 128) for a in at[:i] if b - a <= 128)
        assert got[0] == 0 and got[-1] == at[-1] and cost(got, price, 128) <= best[at[-1]]


def test_chat_round_trip_and_attachments(spark, empty):
    hard = "<|im_end|><|im_start|>assistant <\\| <\\\\|x <|image|>\n"
    rows = [(1, 1, "user", [("text", hard, None, None), ("image", None, "u", 3)]), (1, 2, "assistant", [("text", hard, None, None)]), (2, None, None, None), (2, None, "a\\n\nb", [("video", None, "v", None)])]
    rows += [(3, 1, "assistant", [("audio", None, "s", 4), ("document", None, "d", 2), ("text", "<|audio|> x", None, None), ("image", None, None, None), ("text", "", None, None), ("text", "y", None, None)]), (4, 1, "user", [("text", LONG * 50, None, None)])]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = {r["conv_id"]: r for r in chat.format_chats(turns).select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("mask")).alias("loss")).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", hard), ("assistant", hard)] and got[1]["loss"] == [hard]
    assert [tuple(p) for p in got[1]["turns"][0]["parts"]] == [("text", hard), ("image", None)]
    assert [(a["kind"], a["ref"], a["tokens"]) for a in got[1]["attachments"]] == [("image", "u", 768)] and got[1]["expanded_tokens"] == 768
    assert [t["role"] for t in got[2]["turns"]] == ["", "a\\n\nb"] and got[4]["turns"][0]["text"] == LONG * 50
    # placeholders bear no loss, wherever they stand in an assistant's turn, and a text that looks like one is a text
    assert got[3]["loss"] == ["<|audio|> x", "", "y"] and got[3]["expanded_tokens"] == 4 * 25 + 2 * 512 + 256
    assert [tuple(p) for p in got[3]["turns"][0]["parts"]] == [("audio", None), ("document", None), ("text", "<|audio|> x"), ("image", None), ("text", "y")]
    assert [(a["kind"], a["ref"], a["position"]) for a in got[3]["attachments"]] == [("audio", "s", 0), ("document", "d", 0), ("image", None, 0)]
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_language_id(docs, edge, empty):
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in langid.language_id(docs).collect() if r["held_out"] and r["lang_pred"] != "und"]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.95
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.language_id(edge).collect()}
    assert got[1] == got[2] == got[5] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values())
    assert langid.language_id(empty).count() == 0


def brute_profile(text, dimensions):
    """The bundle of a text's trigrams, one at a time."""
    clean = "".join(x if x.isalpha() else " " for x in text)
    low = "".join(x.lower() if len(x.lower()) == 1 else x for x in clean)
    line, out = f" {' '.join(low.split())} ", np.zeros(dimensions)
    vector = lambda x: langid._vector(ord(x), dimensions).astype(float)
    for a, b, c in zip(line, line[1:], line[2:]):
        out += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
    return out


def test_language_profiles_are_brute_force(monkeypatch):
    texts = ["Abc abd, ABC", "x", "Été à la plage 12 fois", "日本語の文章", "a-b"]
    monkeypatch.setattr(langid, "SLICE", 3)
    got = langid.profiles(texts, 64)
    assert np.allclose(got, [brute_profile(t, 64) for t in texts])


def test_language_profiles_take_little_memory():
    import tracemalloc

    text = "".join(map(chr, np.random.default_rng(2).integers(0x4E00, 0x9FA5, 1_000_000)))
    tracemalloc.start()
    langid.profiles([text], langid.DIMENSIONS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500_000_000


def test_language_id_is_the_nearest_prototype(docs, texts):
    """Prototypes as the sum of the learned rows' profiles, each of length one; the greatest cosine wins."""
    rows = docs.collect()
    train = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["lang"] is not None and r["text"] is not None]
    names = sorted({r["lang"] for r in train})
    unit = langid.unit
    table = unit(np.array([sum(unit(langid.profiles([r["text"]], langid.DIMENSIONS))[0].astype(float) for r in train if r["lang"] == n) for n in names]))
    for r in langid.language_id(docs).collect():
        text = texts[r["doc_id"]] or ""
        if any(x.isalpha() for x in text):
            cosine = unit(langid.profiles([text], langid.DIMENSIONS))[0] @ table.T
            assert r["lang_pred"] == names[int(cosine.argmax())] and abs(r["score"] - max(0, cosine.max())) < 1e-3
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)


def test_language_labels_are_bounded(spark):
    rows = [(i, "abc def", f"l{i % 50}") for i in range(400)] + [(1000 + i, "xyz", "big") for i in range(30)]
    names, _ = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), languages=3)
    assert names == ["big", "l0", "l1"]


def brute_ftrl(rows, base, passes):
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0)) <= toxicity.L1:
            return 0.0
        return (math.copysign(toxicity.L1, z[i]) - z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(passes):
        for features, label in rows:
            w = {i: weight(i) for i in features}
            gradient = 1 / (1 + math.exp(-(base + sum(w.values())))) - label
            for i in features:
                rate = (math.sqrt(n.get(i, 0) + gradient**2) - math.sqrt(n.get(i, 0))) / toxicity.ALPHA
                z[i] = z.get(i, 0) + gradient - rate * w[i]
                n[i] = n.get(i, 0) + gradient**2
    return {i: weight(i) for i in z if weight(i)}


def test_toxicity_is_brute_force(spark, docs):
    """One learner's weights are those of the plain algorithm, whatever number of learners are asked for that get no rows."""
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    model = toxicity.learn(docs, labels, learners=1, passes=2)
    features = toxicity.Features()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    rows = docs.filter(F.col("doc_id").isin(list(truth))).orderBy(F.xxhash64("doc_id", F.lit(1))).collect()
    bad = sum(truth[r["doc_id"]] for r in rows)
    base = math.log((bad + 0.5) / (len(rows) - bad + 0.5))
    want = brute_ftrl([(features(r["text"]).tolist(), truth[r["doc_id"]]) for r in rows], base, 2)
    assert abs(model.base - base) < 1e-12 and np.allclose([want[i] for i in model.features.tolist()], model.weights) and len(want) == len(model.weights)


def test_toxicity_with_few_labels(spark, edge, empty):
    """No label: every score is 0. One or two labels: learners without rows don't thin the state, and clean texts aren't called toxic."""
    labels = spark.createDataFrame([(3, 1, 0), (6, 1, 1), (6, 1, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    none = toxicity.toxicity(edge, labels.limit(0)).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.0, 0)} and len(none) == len(EDGE)
    assert toxicity.toxicity(edge, labels.filter("doc_id = 99")).filter("predicted = 1").count() == 0
    learned = [i for i in (3, 6) if zlib.crc32(str(i).encode()) % 4 != 2]
    many, one = (toxicity.learn(edge, labels, learners=k, passes=30) for k in (50, 1))
    assert learned and many.base == one.base and len(many.weights) >= 0.5 * len(one.weights)
    assert len({r["score"] for r in toxicity.toxicity(edge, labels).collect() if r["doc_id"] in (1, 2, 5)}) == 1  # texts without words
    assert toxicity.toxicity(empty, labels).count() == 0


@pytest.mark.parametrize("sf, auc, recall", [("sf0.01", 0.84, 0.6), ("sf0.1", 0.93, 0.65)])
def test_toxicity_on_held_out_rows(spark, sf, auc, recall):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).filter("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    good, bad = ([r["score"] for r in rows if r["toxic"] == x] for x in (1, 0))
    found, alarms = (np.mean([r["predicted"] for r in rows if r["toxic"] == x]) for x in (1, 0))
    ranked = np.mean([g > b for g in good for b in bad])
    print(f"{sf}: AUC {ranked:.3f}, recall {found:.3f} of {len(good)}, false alarms {alarms:.4f} of {len(bad)}")
    assert ranked > auc and found > recall and alarms < 0.02


def brute_tree(history, depth):
    """The KT counts of every node (context, bits so far) that pairs of context and byte make."""
    seen = {}
    for context, byte in history:
        bits = f"{byte:08b}"
        for d in range(depth + 1):
            for k in range(8):
                seen.setdefault((context[len(context) - d :], bits[:k]), [0, 0])[int(bits[k])] += 1
    return seen


def brute_logs(history, asked, depth):
    """Context-tree weighting by its recursion, a node at a time."""
    seen, known = brute_tree(history, depth), {}
    below = {}
    for context, bits in seen:
        if context:
            below.setdefault((context[1:], bits), []).append((context, bits))

    def kt(zeros, ones):
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.log(math.pi) - math.lgamma(zeros + ones + 1)

    def weighted(node):
        if node not in known:
            own = kt(*seen[node])
            deeper = sum(weighted(x) for x in below.get(node, ()))
            known[node] = own if len(node[0]) == depth else math.log(0.5) + np.logaddexp(own, deeper)
        return known[node]

    def one(context, bits, d=0):
        node = (context[len(context) - d :], bits)
        if node not in seen:
            return 0.5
        zeros, ones = seen[node]
        estimate = (ones + 0.5) / (zeros + ones + 1)
        if d == depth:
            return estimate
        share = math.exp(math.log(0.5) + kt(zeros, ones) - weighted(node))
        return share * estimate + (1 - share) * one(context, bits, d + 1)

    out = []
    for context, byte in asked:
        bits = f"{byte:08b}"
        out.append(sum(math.log10(p if b == "1" else 1 - p) for k, b in enumerate(bits) for p in [one(context, bits[:k])]))
    return out


def pairs_of(text, depth):
    raw = bytes([ctw.BEFORE]) * depth + b" ".join(ctw.words_of(text)) + bytes([ctw.END])
    return [(raw[i - depth : i], raw[i]) for i in range(depth, len(raw))]


def test_ctw_is_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(["Abra  cadabra", "abracadabra é", "the cat sat", "The hat\tsat the cat", None, "", "zebra <日本語>", "the cat " * 30, "xyz"])]
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    assert len(train) < len(rows)
    for depth, most in ((3, 10), (5, 0), (5, 10_000)):
        history = [p for t in train for p in pairs_of(t, depth)]
        got = {r["doc_id"]: r for r in ctw.lm_score(spark.createDataFrame(rows, "doc_id long, text string"), depth, branch_rows=20, most=most).collect()}
        for i, t in rows:
            assert abs(got[i]["score"] - sum(brute_logs(history, pairs_of(t, depth), depth))) < 1e-6
        # over all that may come next, a context's probabilities add up to one
        for text in ("the cat sat", "zzz"):
            context = int.from_bytes(pairs_of(text, depth)[-1][0], "big")
            asked = [context << 8 | b for b in range(256)]
            codes, counts = np.unique(np.array([int.from_bytes(c, "big") << 8 | b for c, b in history] + asked, np.uint64), return_counts=True)
            counts = counts - np.isin(codes, np.array(asked, np.uint64))
            logs = ctw.whole_tree(codes, counts, depth)
            assert abs((10 ** logs[codes >> np.uint64(8) == context]).sum() - 1) < 1e-9


def test_ctw_edges(edge, empty, spark):
    rows = ctw.lm_score(edge).collect()
    assert len(rows) == len(EDGE) and ctw.lm_score(empty).count() == 0
    none = sorted(r["score"] for r in rows if r["doc_id"] in (1, 2, 5))
    assert none[0] == none[2] < 0 and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 5)} == {1}
    assert len({r["score"] for r in rows if r["doc_id"] == 3}) == 1  # repeated rows score alike
    unlearned = ctw.lm_score(spark.createDataFrame([(i, "ab") for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")).collect()
    assert all(abs(r["score"] - 24 * math.log10(0.5)) < 1e-9 and r["train_tokens"] == 0 and r["base_score"] == 0 for r in unlearned)


@pytest.mark.parametrize("sf, better", [("sf0.01", False), ("sf0.1", True)])
def test_ctw_against_the_base(spark, sf, better):
    """On the held-out texts of sf0.01 five bytes of context don't yet beat whole words; on those of sf0.1 they do."""
    got = ctw.lm_score(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert (got[0] > got[1]) is better and got[0] > 1.03 * got[1]


def test_ctw_base(docs, texts):
    words = lambda t: [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), ""]
    from collections import Counter
    from math import log10

    seen = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in words(t))
    n, v = sum(seen.values()), len(seen)
    for r in ctw.lm_score(docs).collect():
        ws = words(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(seen[w] > 0 for w in ws), n)
        assert abs(r["base_score"] - sum(log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) < 1e-6 * max(1, abs(r["base_score"]))


def test_licenses(spark, docs, texts, empty):
    model = licenses.learn(docs)
    lines = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl"}
    want = {i: sorted({f for line, f in lines.items() if line in t}) for i, t in texts.items()}
    assert {r["doc_id"]: r["families"] for r in licenses.scan(docs, model).collect()} == want
    odd = spark.createDataFrame([(1, None), (2, "he lost his driving license"), (3, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"), (3, "")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["families"]) for r in licenses.scan(odd, model).collect()) == [(1, []), (2, []), (3, []), (3, ["mit"])]
    assert licenses.scan(empty, model).count() == 0


def test_license_probabilities_are_reliable(spark, docs):
    """On notices with a word left out or replaced, which were not learned, the mean probability is near the share of right families.

    Words that only one family's templates have stay, as without them nothing tells the families apart.
    """
    model = licenses.learn(docs)
    rows = []
    for family, notices in licenses.TEMPLATES.items():
        for notice in notices:
            words = notice.split()
            own = set(words) - {w for f, others in licenses.TEMPLATES.items() if f != family for t in others for w in t.split()}
            for i in (i for i in range(0, len(words), 2) if words[i] not in own):
                rows += [(family, words[:i] + words[i + 1 :]), (family, [*words[:i], "thing", *words[i + 1 :]])]
    asked = spark.createDataFrame(rows, "family string, words array<string>").withColumn("grams", licenses.known_grams(F.col("words")))
    found = asked.select("family", model.probabilities(F.col("grams")).alias("p")).collect()
    top = [(max(r["p"]), model.families[int(np.argmax(r["p"]))] == r["family"]) for r in found]
    assert all(abs(sum(r["p"]) - 1) < 1e-9 for r in found)
    right, sure = np.mean([ok for _, ok in top]), np.mean([p for p, _ in top])
    assert right > 0.8 and abs(sure - right) < 0.1, (right, sure)  # 0.82 and 0.89 when this was written


def test_license_scores_are_brute_force(spark, docs):
    """Probabilities and coverages of single lines against plain loops over grams."""
    model = licenses.learn(docs)
    lines = ["Released under the MIT License.", "He lost his driving license last year", "under the terms of the GNU Affero General Public License, version 3", "This software is free of charge to any person"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").withColumn("grams", licenses.known_grams(F.get(licenses.paragraphs(F.col("line")), 0)))
    got = rows.select("line", "grams", model.probabilities(F.col("grams")).alias("p"), *[licenses.coverage(F.col("grams"), F.lit(f)).alias(f) for f in licenses.TEMPLATES]).collect()
    for r in got:
        words = re.findall("[a-z0-9]+", r["line"].lower())
        grams = {" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)} & set(licenses.VOCABULARY)
        assert set(r["grams"]) == grams
        logits = np.array(model.logits(sorted(grams))) / model.temperature
        assert np.allclose(r["p"], np.exp(logits) / np.exp(logits).sum())
        for family, notices in licenses.TEMPLATES.items():
            pairs = [{" ".join(x) for x in zip(t.split(), t.split()[1:])} for t in notices]
            assert abs(r[family] - max(len(p & grams) / len(p) for p in pairs)) < 1e-9


def test_real_notices(spark, docs):
    """The openings of common notices as they are shipped, wrapped; and near misses."""
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License."
    agpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published\nby the Free Software Foundation, either version 3 of the License, or"
    free = "This is free and unencumbered software released into the public domain."
    rows = list(enumerate([isc, bsd, apache, agpl, free, "The software may be used by any person for a fee.", "A license to drive, released last year.", f"{LONG}\n\n{isc}\n\n{LONG * 20}"]))
    got = {r["doc_id"]: r["families"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.learn(docs)).collect()}
    assert got == {0: ["isc"], 1: ["bsd"], 2: ["apache"], 3: ["agpl"], 4: ["unlicense"], 5: [], 6: [], 7: ["isc"]}


def test_wrapped_licenses(spark, docs):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
    gpl = "you can redistribute it and/or modify\r\n# it under the terms of the GNU General Public License as published by\r\n# the Free Software Foundation"
    word = mit.replace(",", "").replace(" ", "\n")
    rows = [(1, mit), (2, "This program is free software:\n" + gpl), (3, "A line of prose above.\n" + mit + "\nAnd one below."), (4, word), (5, mit.replace("copy\n", "copy\n\n"))]
    rows += [(6, "Released under the Apache License.\n" + mit), (7, gpl.replace("GNU General", "GNU Lesser\r\n# General")), (8, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.learn(docs)).collect()}
    want = {1: ["mit"], 2: ["gpl"], 3: ["mit"], 4: ["mit"], 5: [], 6: ["apache", "mit"], 7: ["lgpl"], 8: ["cc-by-nc", "mit"]}
    assert {i: r["families"] for i, r in got.items()} == want
    assert [(h["paragraph"], h["family"]) for h in got[3]["hits"]] == [(1, "mit")] and (got[3]["n_paragraphs"], got[3]["n_rejected"]) == (4, 0)


def test_pipeline_is_brute_force(spark, docs, texts):
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if r["text"] and any(c.isalpha() for c in r["text"])}
    first = {}
    for i in sorted(rows):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", rows[i]), i)
    rows = {i: rows[i] for i in first.values()}
    prints = {i: brute_print(rows[i]) for i in sorted(rows)}
    rows = {i: rows[i] for i, root in brute_components(prints).items() if i == root}
    items = [decontam.words_of(r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    windows = {tuple(w[p : p + min(10, len(w))]) for w in items if w for p in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}

    def leaks(text):
        w = decontam.words_of(text)
        return any(tuple(w[p : p + n]) in windows for n in sizes for p in range(len(w) - n + 1))

    rows = {i: t for i, t in rows.items() if not leaks(t)}
    check_pieces(corpus_pipeline.run(spark, DIR).collect(), {i: ids_of(t) for i, t in rows.items()})


def leaves(spark, name, rows, schema=SCHEMA, **extra):
    """What a stage leaves of some rows, as rows; extra columns with odd names must come through."""
    docs = spark.createDataFrame(rows, schema).withColumns({k: F.lit(v) for k, v in extra.items()})
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, DIR)
    assert out.columns == docs.columns
    return out.collect()


CLASHES = {"key_id": 1, "key_text": "x", "digest": "d", "lang_pred": "p", "score": 2, "times": 3, "print": 4, "root": 5, "found": 6, "row": 7, "keep_id": 8, "text_md5": "m"}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:4]])
def test_pipeline_stages_at_the_edges(spark, name):
    assert leaves(spark, name, []) == []
    rows = [(i, t, "fr", "s", 0) for i, t in EDGE]
    left = leaves(spark, name, rows, **CLASHES)
    assert 0 < len(left) <= len(rows) and all(r["digest"] == "d" and r["row"] == 7 for r in left)
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in left)
    if name == "language_id":
        assert {0, 6, 7} <= {i for i, _ in kept} <= {0, 3, 4, 6, 7}
    if name == "exact_dedup":
        assert [i for i, _ in kept] == [0, 1, 3, 5, 6, 7]
    if name == "simhash":
        assert (1, "") in kept and (2, "") not in kept and [i for i, _ in kept].count(3) <= 1
    if name == "decontaminate":
        assert len(kept) == len(rows)


def test_pipeline_judges_rows_not_ids(spark):
    """Rows that share an id and differ in text are judged apart."""
    item = max((r["text"] for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()), key=len)
    clean = "a wholly other text that no item has, with enough words to fill a window and more"
    rows = [(3, item, "en", "s", 0), (3, clean, "en", "s", 0), (None, item, "en", "s", 0), (None, clean + " too", "en", "s", 0)]
    assert sorted(r["text"] for r in leaves(spark, "decontaminate", rows)) == [clean, clean + " too"]
    assert sorted(r["text"] for r in leaves(spark, "language_id", [(3, None, "en", "s", 0), (3, clean, "en", "s", 0), (4, "12", None, "s", 0)])) == [clean]
    near = [(3, LONG, "fr", "s", 0), (3, clean, "en", "s", 0), (3, LONG, "fr", "s", 0), (4, LONG + "fin", "fr", "s", 0)]
    assert sorted(r["text"] for r in leaves(spark, "simhash", near)) == sorted([LONG, clean])
    copies = [(3, clean, "en", "s", 0), (3, item, "en", "s", 0), (4, clean.replace(" ", "  "), "en", "s", 0), (3, clean, "en", "s", 0)]
    assert sorted(r["text"] for r in leaves(spark, "exact_dedup", copies)) == sorted([clean, item])


def test_pipeline_language_stage_writes_what_it_finds(spark, docs):
    """An unlabelled corpus passes, but for texts without a letter; with labels, null ones are filled in."""
    blank = docs.withColumn("lang", F.lit(None).cast("string"))
    stage = corpus_pipeline.identify_language
    with_letters = docs.filter(F.col("text").rlike(r"\p{L}")).count()
    assert stage(spark, blank, DIR).count() == with_letters
    some = docs.withColumn("lang", F.when(F.col("doc_id") % 4 > 0, F.col("lang")))
    out = stage(spark, some, DIR)
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    filled = [r for r in out.collect() if r["doc_id"] % 4 == 0]
    assert filled and np.mean([r["lang"] == truth[r["doc_id"]] for r in filled]) > 0.9
    assert out.count() >= 0.97 * with_letters
