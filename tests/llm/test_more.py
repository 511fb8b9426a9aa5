"""Collocations, clusters and mixes against plain loops, and long or odd inputs of chats, licences and languages."""

import hashlib
import random
import re
import time
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from headway.llm import chat, hamerly, langid, licenses, mixing, phrases

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def brute_phrases(rows, least, longest, swallow, top):
    """Each lang's phrases as the operator's docstring defines them, by dictionaries."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang or "und"] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    counts.setdefault(lang or "und", Counter())[tuple(words[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            longer = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * b >= swallow * a for b in longer):
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_phrases_are_brute_force(spark, monkeypatch, longest):
    rng = random.Random(longest)
    words = ["the", "The", "a", "née", "zug", "b c", "x|y", "of", "and", "so", " "]
    rows = [(rng.choice(["de", "en", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ";"]) for _ in range(rng.randrange(60)))) for _ in range(120)]
    rows += [("en", "the the the the the " * 50), ("en", None), ("fr", ""), ("fr", " .,\n"), (None, "of the so " * 40)]
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    for limit in (1 << 30, 20):  # with and without first words that are dealt over parts
        monkeypatch.setattr(phrases, "PART_MOST", limit)
        monkeypatch.setattr(phrases, "PART_SHARE", 1 if limit > 20 else 1 << 12)
        got = phrases.collocations(frame.withColumns({"rank": F.lit(1), "ids": F.lit("x")}), 4, longest, 50, 25).collect()
        assert sorted(tuple(r) for r in got) == brute_phrases(rows, 4, longest, 50, 25)


def test_phrases_at_the_edges(spark, docs, monkeypatch):
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")).count() == 0
    want = sorted(tuple(r) for r in phrases.collocations(docs, 5, 3, 50, 50).collect())
    assert want == brute_phrases([(r["lang"], r["text"]) for r in docs.collect()], 5, 3, 50, 50)
    # small chunks and dictionaries change nothing, nor do hashes that collide at first
    real = phrases.word_id
    monkeypatch.setattr(phrases, "CHUNK", 1000)
    monkeypatch.setattr(phrases, "REMEMBERED", 500)
    assert sorted(tuple(r) for r in phrases.collocations(docs, 5, 3, 50, 50).collect()) == want
    seeds = []
    monkeypatch.setattr(phrases, "word_id", lambda lang, word, seed: (seeds.append(seed), F.lit(7).cast("long") if seed == 0 else real(lang, word, seed))[1])
    assert sorted(tuple(r) for r in phrases.collocations(docs, 5, 3, 50, 50).collect()) == want and max(seeds) == 1


def brute_clusters(rows, k, rounds, seed):
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        at = assigned()
        for j in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, at) if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own)]
    at = assigned()
    each = Counter()
    for d, c in at:
        each[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((str(i), c, d, each[c], sum(each.values()), sha[c]) for (i, _), (d, c) in zip(kept, at)))


VECTORS = "vec_id long, embedding array<float>"


def test_clusters_are_brute_force(spark):
    rng = np.random.default_rng(2)
    middles = rng.normal(0, 1, (12, 64))
    rows = [(i, (middles[i % 12] + rng.normal(0, 0.4, 64)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 360)]  # copies, so distances tie
    rows += [(7, rows[8][1]), (7, rows[9][1]), (None, rows[3][1]), (None, [0.0] * 64), (500, None), (501, [1.0] * 63), (502, [1.0] * 63 + [None]), (503, [float("nan")] * 64), (504, [float("inf")] * 64), (505, [])]
    frame = spark.createDataFrame(rows, VECTORS).withColumns({"cluster": F.lit(1), "rid": F.lit(2)}).repartition(4)
    got = sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in hamerly.centroid_clusters(frame).collect())
    assert got == brute_clusters(rows, 8, 10, 3)


def test_clusters_at_the_edges(spark):
    assert hamerly.centroid_clusters(spark.createDataFrame([], VECTORS)).count() == 0
    few = [(i, [float(i)] * 64) for i in range(3)]
    got = hamerly.centroid_clusters(spark.createDataFrame(few, VECTORS)).collect()
    assert len(got) == 3 and {r["distance"] for r in got} == {0} and len({r["cluster"] for r in got}) == 3
    same = [(i, [0.5] * 64) for i in range(20)]  # equal first centroids: the smaller number gets all
    got = hamerly.centroid_clusters(spark.createDataFrame(same, VECTORS)).collect()
    assert {(r["cluster"], r["distance"]) for r in got} == {(0, 0)} and len(got) == 20
    with pytest.raises(Exception, match="too large"):
        hamerly.centroid_clusters(spark.createDataFrame([(1, [1e9] * 64)], VECTORS)).count()


def test_bounds_leave_most_vectors_alone():
    """After the first rounds few vectors are scanned, and none that is not decided keeps its side."""
    rng = np.random.default_rng(4)
    middles = rng.integers(-3000, 3000, (8, 64))
    x = (middles[rng.integers(0, 8, 4000)] + rng.integers(-300, 300, (4000, 64))).astype(np.int64)
    now, before, scanned = x[:8].copy(), None, []
    state = None
    for _ in range(8):
        centres = hamerly.Centres(now, before)
        if state is None:
            cluster, least, second = centres.scan(x)
            state = cluster, np.sqrt(least) * (1 + hamerly.SLACK), np.sqrt(second) * (1 - hamerly.SLACK)
        else:
            real, asked = centres.scan, []
            centres.scan = lambda rows, real=real, asked=asked: (asked.append(len(rows)), real(rows))[1]
            state = centres.assign(x, *state)
            scanned.append(sum(asked))
            assert (state[0] == real(x)[0]).all()
        before, now = now, np.array([x[state[0] == j].sum(0) // max(1, (state[0] == j).sum()) if (state[0] == j).any() else now[j] for j in range(8)])
    assert scanned[-1] < 400


def brute_mix(rows):
    sizes = [(i, t, s, len(re.findall("[^\x20\x09-\x0d]+", t or ""))) for i, t, s in rows]
    sources = sorted({s for _, _, s, _ in sizes}, key=lambda s: (s is None, s or ""))
    of = {s: sum(n for _, _, x, n in sizes if x == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    budget, full, target = Fraction(3, 2) * sum(of.values()), set(), {}
    while True:
        free = [s for s in sources if s not in full]
        left = budget - sum(2 * of[s] for s in full)
        target = {s: Fraction(2 * of[s]) for s in full} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if target[s] >= 2 * of[s]}
        if not above or above == set(free):
            return sizes, of, target if not above else {s: Fraction(2 * of[s]) for s in sources}
        full |= above


def test_mix_meets_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(["a"] * 10 + ["é", "z", "Z", None, "b"])) for i in range(2000)]
    rows += [(5000, "only one", "lone"), (5001, None, "void"), (5002, "", None), (None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "bucket": F.lit(0)}).repartition(6)
    got = mixing.mix(frame).collect()
    sizes, of, target = brute_mix(rows)
    assert len(got) == len(rows) and Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((i, s, n) for i, _, s, n in sizes)
    taken = Counter()
    for r in got:
        assert r["source_size"] == of[r["source"]] and abs(r["target"] - float(target[r["source"]])) < 1e-6 * max(1, r["target"])
        assert r["taken"] == r["times"] * r["size"] and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in target.items():
        largest = max((n for _, _, x, n in sizes if x == s), default=0)
        assert abs(taken[s] - t) <= Fraction(largest, 2) + Fraction(1, 1000), (s, taken[s], float(t))
    again = mixing.mix(frame.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    more = {r["doc_id"]: r["times"] for r in mixing.mix(frame, share=1.8).collect()}
    # budgets are nested: what a source took of a smaller target it takes of a larger
    grown = {s for s in of if float(brute_target(rows, 1.8)[s]) >= float(target[s])}
    assert all(more[r["doc_id"]] >= r["times"] for r in got if r["source"] in grown and r["doc_id"] is not None)


def brute_target(rows, share):
    sizes, of, _ = brute_mix(rows)
    sources = sorted(of, key=lambda s: (s is None, s or ""))
    level, weight = 0.0, {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    low, high = 0.0, 2.0 * sum(of.values())
    for _ in range(200):  # the level by halving
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * of[s], level * weight[s]) for s in of) < share * sum(of.values()) else (low, level)
    return {s: min(2 * of[s], level * weight[s]) for s in of}


def test_mix_refines_a_bucket_and_repeats_rows(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 7), "one" if i % 3 else "two") for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(str, mixing.mix(frame).collect()))
    monkeypatch.setattr(mixing, "STEP", 2)  # many rounds of refinement
    assert sorted(map(str, mixing.mix(frame).collect())) == want
    monkeypatch.setattr(mixing, "FEW", 0)  # sources joined, not broadcast
    found = mixing.mix(frame)
    assert sorted(map(str, found.collect())) == want
    out = mixing.repeated(frame, found)
    assert out.columns == frame.columns and out.count() == found.agg(F.sum("times")).first()[0]
    assert mixing.mix(frame.limit(0)).count() == 0


def test_a_conversation_of_many_turns(spark):
    """50,000 turns take seconds, not hours: the time grows with their number."""
    turn = F.col("id")
    rows = spark.range(50_000).select(F.lit(1).alias("conv_id"), turn.alias("turn"), F.when(turn % 2 == 0, "user").otherwise("assistant").alias("role"), chat.text_parts(F.concat(F.lit("é<|\U0001f600"), turn.cast("string"))).alias("parts"))
    start = time.time()
    out = chat.format_chats(rows)
    row = out.select(F.size("mask").alias("n"), F.array_join(chat.read_loss(F.col("formatted"), F.col("mask")), "").alias("loss"), F.size(chat.read_turns(F.col("formatted"))).alias("turns")).first()
    assert (row["n"], row["turns"]) == (25_000, 50_000)
    assert row["loss"] == "".join(f"é<|\U0001f600{i}" for i in range(1, 50_000, 2))
    assert time.time() - start < 90


@pytest.fixture(scope="module")
def model(docs):
    return licenses.learn(docs)


def test_many_licence_lines(spark, model):
    rows = [(1, "Released under the MIT License.\n" * 20_000)]
    start = time.time()
    row = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).selectExpr("n_paragraphs", "size(hits) AS n", "n_rejected", "families").first()
    assert tuple(row) == (20_000, 20_000, 0, ["mit"]) and time.time() - start < 120


def test_licences_as_people_write_them(spark, model):
    lines = {
        "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": ["gpl"],
        "Apache License\nVersion 2.0, January 2004": ["apache"],
        "The MIT License (MIT)": ["mit"],
        "License: MIT": ["mit"],
        "license = \"Apache-2.0\"": ["apache"],
        "SPDX-License-Identifier: GPL-2.0-only": ["gpl"],
        "// SPDX-License-Identifier: LGPL-2.1-or-later": ["lgpl"],
        "SPDX-License-Identifier: MIT OR Apache-2.0": ["apache", "mit"],
        "SPDX-License-Identifier: (BSD-3-Clause AND Zlib) OR EPL-2.0": ["bsd", "epl", "zlib"],
        "CC BY-SA 3.0": ["cc-by-sa"],
        "Licensed under CC BY 3.0.": ["cc-by"],
        "Distributed under the Boost Software License, Version 1.0.": ["boost"],
        "Eclipse Public License - v 2.0": ["epl"],
        "GNU Free Documentation License, Version 1.3": ["gfdl"],
        "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE": ["wtfpl"],
        "In no event will the authors be held liable for any damages\narising from the use of this software.": ["zlib"],
        "This file is not released under the MIT license.": [],
        "The code is no longer distributed under the Apache License, Version 2.0.": [],
        "SPDX-License-Identifier: Nonsense-9.9": [],
        "License: see the manual": [],
        "He has a license to drive, released last year.": [],
    }
    got = {r["doc_id"]: r["families"] for r in licenses.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), model).collect()}
    assert {t: got[i] for i, t in enumerate(lines)} == lines


def test_hits_by_lines_are_brute_force(spark, model):
    """The hits of runs of lines against a plain loop over all pairs of what was judged."""
    rng = random.Random(9)
    parts = [w for f in ("mit", "gpl", "lgpl", "apache") for t in licenses.TEMPLATES[f][:3] for w in ("\n".join(t.split()[:6]), t, t.replace(" ", "\n", 3))]
    rows = [(i, "\n".join(rng.choice([*parts, "a line of prose", ""]) for _ in range(12))) for i in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    parts_ = licenses.segments(frame).select("doc_id", F.explode("seen").alias("s")).select("doc_id", "s.*")
    seen = parts_.join(licenses.judged(parts_.select("grams").distinct(), model), "grams").collect()
    for r in licenses.scan(frame, model).collect():
        own = {(s["paragraph"], s["last"], s["family"]): (s["probability"], s["coverage"]) for s in seen if s["doc_id"] == r["doc_id"] and not s["negated"]}
        found = {k: v for k, v in own.items() if v[0] >= licenses.CERTAIN and v[1] >= licenses.COVERED}
        fewest = {k: v for k, v in found.items() if not any(o != k and o[2] == k[2] and o[0] >= k[0] and o[1] <= k[1] for o in found)}
        left = {k for k, v in fewest.items() if k[0] == k[1] or not any(o[2] != k[2] and o[0] <= k[1] and o[1] >= k[0] and w[1] > v[1] for o, w in fewest.items())}
        assert sorted((h["paragraph"], h["family"]) for h in r["hits"]) == sorted((p, f) for p, _, f in left)
        lines = {k[0] for k in own if k[0] == k[1]}
        assert r["n_rejected"] == len([p for p in lines if not any(a <= p <= b for a, b, _ in left)])


FOREIGN = [
    "これは日本語の文章です。とても長いテキストになります。東京は日本の首都です。",
    "Это довольно длинный русский текст, который написан для проверки определения языка документа.",
    "Αυτό είναι ένα αρκετά μεγάλο ελληνικό κείμενο για τον έλεγχο της γλώσσας.",
    "zzxq qqxz wvvk kkqj xqzv jjqx wwkz qzxj vvkq xxzj qkwz kkxw jqzz",
    "fjdksla fjdksla vcmxnz rueiwoq vbcmnxz yturieow qpwozm xncbvk",
]


def test_the_language_stage_does_real_work(spark):
    """Foreign scripts and junk go and are never labelled, texts too short to judge stay unlabelled, and texts of the learned languages stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = [(10_000_000 + i, t, None, "odd", 0) for i, t in enumerate([*FOREIGN, "ok", "Miosra " * 300, "12 34", None])]
    rows = docs.unionByName(spark.createDataFrame(odd, SCHEMA))
    out = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, rows, DIR).collect()}
    left = {i: lang for i, lang in out.items() if i >= 10_000_000}
    assert set(left) == {10_000_000 + len(FOREIGN), 10_000_001 + len(FOREIGN)} and set(left.values()) == {None}
    real = docs.filter(F.col("text").rlike(r"\p{L}")).select("doc_id").collect()
    assert sum(r["doc_id"] in out for r in real) > 0.99 * len(real)


def test_verdicts():
    deviation = 1024**-0.5
    assert langid.verdict_of("x" * 500, 0.0, 0.0, 1024) == langid.UNSURE  # one trigram, however long
    assert langid.verdict_of(FOREIGN[1], 3.9 * deviation, 0.0, 1024) == langid.NONE
    assert langid.verdict_of("ok", 4.1 * deviation, 0.0, 1024) == langid.FOUND
    assert langid.verdict_of("ok", 4.1 * deviation, 3.9 * deviation, 1024) == langid.UNSURE


def test_texts_that_are_not_looked_through_have_nothing(spark):
    """Which texts and lines have a known pair of words is told as the grams tell it; what a line declares is found wherever it stands."""
    pairs = [g for g in licenses.VOCABULARY if g.count(" ") == 1]
    near = [f"{a}x {b}" for a, b in map(str.split, pairs[:40])] + ["", "-", "zlib", "qq the", "of\nthe", "the-MIT  license", "été of, the", "of thexyz", "x" * 5000]
    texts = [*pairs, *(g.upper().replace(" ", " -- ") for g in pairs[:40]), *near]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")
    for r in frame.select("text", licenses.has_pair(F.lower("text")).alias("got"), (F.size(licenses.known_grams(words)) > 0).alias("want")).collect():
        assert r["got"] == r["want"], r["text"]
    named = spark.createDataFrame([(1, "License: MIT\nqq\n\nww"), (2, "qq\r\nlicence = ISC\r\nqq"), (3, "a\n\nb\r\n--\rc"), (4, None)], "doc_id int, text string")
    got = {r["doc_id"]: (r["n_paragraphs"], [s["grams"] for s in r["seen"]]) for r in licenses.segments(named).collect()}
    assert got[3] == (3, []) and got[4] == (0, [])
    assert got[1][0] == 3 and any("identifier mit" in g for g in got[1][1]) and any("identifier isc" in g for g in got[2][1])
