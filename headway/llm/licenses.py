"""License scans: a trained paragraph classifier over word n-grams, confirmed by comparison with templates."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headway.llm.common import cut

UNKNOWN = "unknown"
#: Notices and leading sentences of public licences, by family, in lower case as words of a-z and 0-9.
TEMPLATES = {
    "agpl": (
        "licensed under the gnu affero general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu affero general public license",
        "gnu affero general public license version 3 19 november 2007",
    ),
    "apache": (
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license",
        "distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "released under the apache license",
        "apache license version 2 0 january 2004",
    ),
    "boost": (
        "boost software license version 1 0 august 17th 2003",
        "distributed under the boost software license version 1 0",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistributions of source code must retain the above copyright notice",
        "released under the bsd license",
        "licensed under the bsd 3 clause license",
    ),
    "cc-by": (
        "licensed under cc by 4 0",
        "this work is licensed under a creative commons attribution 4 0 international license",
    ),
    "cc-by-nc": (
        "licensed under cc by nc 4 0",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    ),
    "cc-by-sa": (
        "licensed under cc by sa 4 0",
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    ),
    "epl": (
        "eclipse public license v 2 0",
        "the accompanying materials are made available under the terms of the eclipse public license",
    ),
    "gfdl": (
        "gnu free documentation license version 1 3",
        "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license",
    ),
    "cc0": (
        "to the extent possible under law the author has waived all copyright and related rights to this work",
        "released under cc0 1 0 universal",
    ),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu general public license",
        "released under the gnu gpl version 3",
        "gnu general public license version 3 29 june 2007",
        "gnu general public license version 2 june 1991",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "licensed under the isc license",
    ),
    "lgpl": (
        "this library is licensed under the gnu lesser general public license version 3",
        "under the terms of the gnu lesser general public license",
        "gnu lesser general public license version 3 29 june 2007",
        "gnu lesser general public license version 2 1 february 1999",
    ),
    "mit": (
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the mit license mit",
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "licensed under the mozilla public license version 2 0",
        "mozilla public license version 2 0",
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain",
        "released under the unlicense",
    ),
    "wtfpl": (
        "do what the fuck you want to public license",
        "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed",
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty",
        "in no event will the authors be held liable for any damages arising from the use of this software",
        "licensed under the zlib license",
    ),
}
#: The short identifiers of licences, by family.
IDENTIFIERS = {
    "agpl": ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"),
    "apache": ("Apache-2.0",),
    "boost": ("BSL-1.0",),
    "bsd": ("BSD-2-Clause", "BSD-3-Clause"),
    "cc-by": ("CC-BY-2.0", "CC-BY-2.5", "CC-BY-3.0", "CC-BY-4.0"),
    "cc-by-nc": ("CC-BY-NC-2.0", "CC-BY-NC-2.5", "CC-BY-NC-3.0", "CC-BY-NC-4.0"),
    "cc-by-sa": ("CC-BY-SA-2.0", "CC-BY-SA-2.5", "CC-BY-SA-3.0", "CC-BY-SA-4.0"),
    "cc0": ("CC0-1.0",),
    "epl": ("EPL-1.0", "EPL-2.0"),
    "gfdl": ("GFDL-1.2", "GFDL-1.3", "GFDL-1.3-only", "GFDL-1.3-or-later"),
    "gpl": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"),
    "isc": ("ISC",),
    "lgpl": ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "mit": ("MIT",),
    "mpl": ("MPL-2.0",),
    "unlicense": ("Unlicense",),
    "wtfpl": ("WTFPL",),
    "zlib": ("Zlib",),
}
#: The words that stand before an identifier, however the line names it.
DECLARES = "spdx license identifier"


def _with_identifiers() -> dict[str, tuple[str, ...]]:
    """The notices of each family, and a template for each of its identifiers; those of Creative Commons stand alone, too."""
    out = {}
    for family, notices in TEMPLATES.items():
        short = [re.sub("[^a-z0-9]+", " ", x.lower()) for x in IDENTIFIERS[family]]
        alone = [x for x in short if x.startswith("cc by")]
        out[family] = tuple(dict.fromkeys([*notices, *(f"{DECLARES} {x}" for x in short), *alone, *(f"licensed under {x}" for x in alone)]))
    return out


#: What a line is compared with: notices and identifiers.
PATTERNS = _with_identifiers()
#: Sentences near to the subject that grant nothing.
OTHERS = (
    "he lost his driving license last year",
    "the license plate was found near the river",
    "a general public meeting was held in the hall",
    "all members of the public may use this path",
    "the warranty of this product ends after two years",
    "the terms of the contract are known to any person",
    "version 2 0 of the program was released in may",
    "the work is subject to change without notice",
    "copyright law differs between countries",
    "the film was released under the title of the book",
    "permission to use the hall is granted by the council for any purpose",
    "the software is distributed free of charge to any person who asks for it",
    "the song was released into the public domain last year",
    "you may not use this file after the date of the notice",
    "the general public may redistribute the leaflet without any fee",
    "the software is not released under the license of the institute",
    "this version 2 0 of the document is provided as is by the office",
    "do what you want to do in public",
)
#: A notice that says what does not hold.
NEGATED = r"\b(not|never|nor|neither|no longer|isn t|aren t|wasn t|cannot be)( [a-z0-9]+){0,2} (released|licensed|distributed|available|provided|offered|published|covered|redistributed)\b"
#: A line that names licences by their identifiers, and what parts these.
DECLARED, PARTED = r"(?:spdx-license-identifier|licen[sc]e)[\"']?\s*[:=]\s*(\S.*)$", r"\s+(?:or|and|with)\s+|[()/,|]+"
#: What parts lines.
LINES = "\r\n|\n|\r"
#: Rows of the corpus that stand for no licence, at most about; grams in a row; rows of the calibration fold, one in so many.
NEGATIVES, FOLD = 2000, 4
#: Least calibrated probability; share of a template's pairs of words that must occur; passes and L1 strength of the fit.
CERTAIN, COVERED, PASSES, STRENGTH = 0.5, 0.7, 40, 0.0005
TEMPERATURES = tuple(2 ** (k / 2) for k in range(-8, 7))


def _grams(words: list[str]) -> list[str]:
    """Distinct pairs and triples of neighbours, in order."""
    return list(dict.fromkeys(" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)))


#: The grams that the classifier knows: every one of a template or of the other sentences.
VOCABULARY = sorted({g for x in (*(t for family in PATTERNS.values() for t in family), *OTHERS) for g in _grams(x.split())})
#: Words of the longest template; the words that begin a gram, and those that come second.
LONGEST = max(len(t.split()) for family in PATTERNS.values() for t in family)
HEADS = sorted({g.split()[0] for g in VOCABULARY})
SECONDS = sorted({g.split()[1] for g in VOCABULARY})


def _either(phrases: set[str]) -> str:
    """A pattern of the phrases that reads what they begin with in common once; where they have a space, whatever parts two words may stand."""
    after = {c: {p[1:] for p in phrases if p[:1] == c} for c in sorted({p[0] for p in phrases if p})}
    tails = "|".join(("[^a-z0-9]++" if c == " " else c) + _either(rest) for c, rest in after.items())
    # a phrase may end where another goes on: a letter that goes on can't be an end
    return f"(?:{tails})?+" if tails and "" in phrases else f"(?:{tails})" if len(after) > 1 else tails


#: A space and a lower-cased text with two neighbouring words that are a gram, on one line or over several.
ANY_PAIR = f"[^a-z0-9](?=[a-z0-9]){_either({g for g in VOCABULARY if g.count(' ') == 1})}(?![a-z0-9])"


def has_pair(low: Column) -> Column:
    """Whether a lower-cased text has two neighbouring words that are a gram. One without has no longer gram."""
    return F.concat(F.lit(" "), low).rlike(ANY_PAIR)


def paragraphs(text: Column) -> Column:
    """The lines of a text that have a word, each as its words; null has none."""
    lines = F.split(F.lower(F.coalesce(text, F.lit(""))), "[\n\r]+")
    return F.filter(F.transform(lines, lambda x: F.filter(F.split(x, "[^a-z0-9]+"), lambda w: w != "")), lambda words: F.size(words) > 0)


def blocks(low: Column) -> Column:
    """The lines of a lower-cased text that have a word, as (words, opens, pair, declared): a line opens a block if it is the first or the one before has no word; ``pair`` tells
    whether it may have a gram; ``declared`` has, for each identifier of a line that names licences by them, the words of a line that would name it alone."""

    def declared(x: Column) -> Column:
        parts = F.split(F.regexp_extract(x, DECLARED, 1), PARTED)
        words = F.filter(F.transform(parts, lambda p: F.filter(F.split(p, "[^a-z0-9]+"), lambda w: w != "")), lambda w: F.size(w) > 0)
        named = F.transform(words, lambda w: F.concat(F.array(*map(F.lit, DECLARES.split())), w))
        return F.when(F.contains(x, F.lit("licen")) & x.rlike(DECLARED), named).otherwise(F.array().cast("array<array<string>>"))

    raw = F.transform(F.split(low, LINES), lambda x: F.struct(F.filter(F.split(x, "[^a-z0-9]+"), lambda w: w != "").alias("words"), has_pair(x).alias("pair"), declared(x).alias("declared")))

    def numbered(raw: Column) -> Column:
        lines = F.transform(raw, lambda s, i: F.struct(s["words"].alias("words"), (F.coalesce(F.size(F.get(raw, i - 1)["words"]), F.lit(0)) <= 0).alias("opens"), s["pair"].alias("pair"), s["declared"].alias("declared")))
        return F.filter(lines, lambda s: F.size(s["words"]) > 0)

    return _let(raw, numbered)


def negated(words: Column) -> Column:
    """Whether the words say that something is not licensed."""
    return F.array_join(words, " ").rlike(NEGATED)


#: Lines of a text that are judged together, the grams in them, and whether they deny.
SEGMENTS = "array<struct<paragraph:int,last:int,grams:array<string>,negated:boolean>>"


def windows(lines: Column, own: Column) -> Column:
    """(paragraph, last, grams, negated) of each run of two or more lines of a block in which a wrapped template may stand.

    A run goes on from its first line until as many words follow as the longest template has. It starts only at a line with a known gram
    (``own`` has their number in each line) or with a last word that begins one: no other line has a part of a template before its end.
    """
    kind = SEGMENTS
    none = F.array().cast(kind)

    def words(some: Column) -> Column:
        return F.flatten(F.transform(some, lambda x: x["words"]))

    def runs(s: Column, i: Column) -> Column:
        def of(after: Column) -> Column:
            stop = F.array_position(F.transform(after, lambda x: x["opens"]), True).cast("int")
            n = F.when(stop > 0, stop - 1).otherwise(F.size(after))
            sizes = F.transform(after, lambda x: F.size(x["words"]))
            ends = _let(sizes, lambda z: F.filter(F.sequence(F.lit(1), n), lambda k: F.aggregate(F.slice(z, F.lit(1), k - 1), F.lit(0), lambda a, v: a + v) < LONGEST))
            def joined(k: Column) -> Column:
                return _let(F.concat(s["words"], words(F.slice(after, F.lit(1), k))), lambda w: F.struct(i.alias("paragraph"), (i + k).alias("last"), known_grams(w).alias("grams"), negated(w).alias("negated")))

            made = F.transform(ends, joined)
            return F.when(n > 0, made.cast(kind)).otherwise(none)

        starts = (F.get(own, i) > 0) | F.element_at(s["words"], -1).isin(HEADS)
        return F.when(starts, _let(F.slice(lines, i + 2, F.lit(LONGEST)), of)).otherwise(none)

    # the shortest template has three pairs of words, and fewer grams than two cover none
    return F.filter(F.flatten(F.transform(lines, runs)), lambda s: F.size(s["grams"]) > 1)


def known_grams(words: Column) -> Column:
    """The distinct grams of the vocabulary in a paragraph. Only words that begin one are followed up."""
    def grams(words: Column) -> Column:
        def at(w: Column, i: Column) -> Column:
            two, three = F.concat_ws(" ", w, F.get(words, i + 1)), F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2))
            return F.when(w.isin(HEADS) & F.get(words, i + 1).isin(SECONDS), F.array(two, three)).otherwise(F.array().cast("array<string>"))

        return F.array_distinct(F.filter(F.flatten(F.transform(words, at)), lambda g: g.isin(VOCABULARY)))

    return _let(words, grams)


def _let(value: Column, use) -> Column:
    """An expression over a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _sum(grams: Column, values: dict[str, float]) -> Column:
    """The sum of the values of the grams that have one."""
    if not values:
        return F.lit(0.0)
    table = F.create_map(*[F.lit(x) for item in values.items() for x in item])
    return F.aggregate(grams, F.lit(0.0), lambda a, g: a + F.coalesce(F.element_at(table, g), F.lit(0.0)))


@dataclass
class Model:
    """Families (the first is unknown), an intercept and sparse gram weights for each, and the temperature."""

    families: list[str]
    intercepts: list[float]
    weights: list[dict[str, float]]
    temperature: float

    def logits(self, grams: list[str]) -> list[float]:
        """Of one paragraph, before the temperature."""
        return [b + sum(w.get(g, 0.0) for g in grams) for b, w in zip(self.intercepts, self.weights)]

    def probabilities(self, grams: Column) -> Column:
        """Calibrated, in the order of the families."""
        logits = F.array(*[(F.lit(b) + _sum(grams, w)) / self.temperature for b, w in zip(self.intercepts, self.weights)])
        def shares(powers: Column) -> Column:
            return _let(F.aggregate(powers, F.lit(0.0), lambda a, v: a + v), lambda total: F.transform(powers, lambda v: v / total))

        def powers(x: Column) -> Column:
            return _let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))

        return _let(_let(logits, powers), shares)


def _shares(grams: Column, family: str) -> list[Column]:
    """For each of the family's templates, the share of its pairs of words that is among the grams."""
    pairs = [[g for g in _grams(t.split()) if g.count(" ") == 1] for t in PATTERNS[family]]
    return [F.size(F.array_intersect(grams, F.array(*map(F.lit, p)))) / len(p) for p in pairs]


def coverage(grams: Column, family: Column) -> Column:
    """The greatest share of the pairs of words of one of the family's templates that is among the grams."""
    out = F.lit(0.0)
    for name in TEMPLATES:
        out = F.when(family == name, F.greatest(*_shares(grams, name))).otherwise(out)
    return out


def _training_rows(spark: SparkSession, docs: DataFrame, negatives: int) -> DataFrame:
    """(label, words, fold): the templates, whole and in part, the other sentences, and a sample of the corpus' paragraphs.

    The sample takes ids by hash, one paragraph of each, at most about ``negatives``; a paragraph that covers a template is left out.
    """
    made = []
    for label, (_, texts) in enumerate([(UNKNOWN, OTHERS), *PATTERNS.items()]):
        for text in texts:
            words = text.split()
            cuts = {(0, len(words))} | {(a, a + n) for n in (len(words) * 3 // 4, len(words) - 1) for a in range(len(words) - n + 1) if n >= 5}
            # whole ones are always learned; of the parts, one in FOLD is kept for the calibration
            made += [(float(label), words[a:b], 1 if (a, b) == (0, len(words)) else i % FOLD) for i, (a, b) in enumerate(sorted(cuts))]
    share = min(1.0, negatives / max(1, docs.count()))
    taken = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    lines = taken.select("doc_id", paragraphs(F.col("text")).alias("all")).filter(F.size("all") > 0)
    one = lines.select(F.get("all", F.pmod(F.xxhash64("doc_id"), F.size("all")).cast("int")).alias("words"), F.pmod(F.xxhash64("doc_id"), F.lit(FOLD)).cast("int").alias("fold"))

    def is_free(grams: Column) -> Column:
        return F.greatest(*[x for name in TEMPLATES for x in _shares(grams, name)]) < 0.5

    free = _let(known_grams(F.col("words")), is_free)
    return spark.createDataFrame(made, "label double, words array<string>, fold int").unionByName(one.filter(free).select(F.lit(0.0).alias("label"), "words", "fold"))


def learn(docs: DataFrame, negatives: int = NEGATIVES, passes: int = PASSES, strength: float = STRENGTH) -> Model:
    """Fit the multinomial logistic regression with L1, and its temperature on a fold of its own."""
    spark = docs.sparkSession
    rows = _training_rows(spark, docs.select("doc_id", "text"), negatives).select("label", "fold", known_grams(F.col("words")).alias("grams"))
    # rows of one label and grams weigh together, so that the fit sees few rows and in one order
    rows = rows.groupBy("label", "fold", "grams").agg(F.count("*").cast("double").alias("weight")).coalesce(1).sort("label", "fold", "grams")
    known = rows.collect()  # about as many rows as there are parts of templates
    rows = spark.createDataFrame(known, rows.schema).coalesce(1)
    counted = CountVectorizerModel.from_vocabulary(VOCABULARY, inputCol="grams", outputCol="features").setBinary(True).transform(rows)
    fitted = LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=strength, maxIter=passes, standardization=False, weightCol="weight").fit(counted.filter("fold > 0"))
    table = fitted.coefficientMatrix.toArray()
    weights = [{VOCABULARY[i]: float(table[k, i]) for i in table[k].nonzero()[0]} for k in range(table.shape[0])]
    model = Model([UNKNOWN, *TEMPLATES], [float(x) for x in fitted.interceptVector], weights, 1.0)
    held = [(r["label"], r["weight"], model.logits(r["grams"])) for r in known if r["fold"] == 0]

    def loss(temperature: float) -> float:
        return sum(w * (math.log(sum(math.exp((v - max(x)) / temperature) for v in x)) - (x[int(label)] - max(x)) / temperature) for label, w, x in held)

    model.temperature = min(TEMPERATURES, key=lambda t: (round(loss(t), 9), abs(t - 1)))
    return model


def segments(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs and the parts of the text to judge: lines with a known gram, identifiers that a line declares, and runs of lines. Each text is handled by
    itself and its lines are formed once. Of a text without a known pair of words, which names no licence, the lines are counted and no more; nor are grams looked for in such lines."""

    def of(lines: Column) -> Column:
        def alone(s: Column, i: Column) -> Column:
            def one(w: Column) -> Column:
                return F.struct(i.alias("paragraph"), i.alias("last"), known_grams(w).alias("grams"), negated(w).alias("negated"))

            def bare(w: Column) -> Column:
                return F.struct(i.alias("paragraph"), i.alias("last"), F.array().cast("array<string>").alias("grams"), F.lit(False).alias("negated"))

            return F.concat(F.transform(F.array(s["words"]), lambda w: F.when(s["pair"], one(w)).otherwise(bare(w))), F.transform(s["declared"], one))

        def all_(single: Column) -> Column:
            parts = F.filter(F.flatten(single), lambda x: F.size(x["grams"]) > 0).cast(SEGMENTS)
            runs = _let(F.transform(single, lambda x: F.size(F.get(x, 0)["grams"])), lambda own: windows(lines, own))
            return F.struct(F.size(lines).cast("long").alias("n_paragraphs"), F.concat(parts, runs).alias("seen"))

        return _let(F.transform(lines, alone), all_)

    def none(low: Column) -> Column:
        lines = F.filter(F.split(low, LINES), lambda x: x.rlike("[a-z0-9]"))
        return F.struct(F.size(lines).cast("long").alias("n_paragraphs"), F.array().cast(SEGMENTS).alias("seen"))

    low = F.lower(F.coalesce("text", F.lit("")))
    # the branch is taken per row and its expressions are not shared with other branches
    seen = _let(low, lambda x: F.when(has_pair(x) | F.contains(x, F.lit("licen")), _let(blocks(x), of)).otherwise(none(x)))
    return docs.select("doc_id", seen.alias("s")).select("doc_id", "s.n_paragraphs", "s.seen")


def judged(kinds: DataFrame, model: Model) -> DataFrame:
    """(grams, family, probability, coverage) of distinct sets of grams: the most probable family, and how much of one of its templates is there."""
    names = F.array(*map(F.lit, model.families))

    def first_best(p: Column) -> Column:
        return _let(F.array_max(p), lambda top: F.struct(F.get(names, (F.array_position(p, top) - 1).cast("int")).alias("family"), top.alias("probability")))

    best = kinds.select("grams", _let(model.probabilities(F.col("grams")), first_best).alias("b")).select("grams", "b.*")
    return best.filter(F.col("family") != UNKNOWN).withColumn("coverage", coverage(F.col("grams"), F.col("family")))


def scan(docs: DataFrame, model: Model, certain: float = CERTAIN, covered: float = COVERED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_paragraphs, n_rejected, families, hits.

    ``hits`` lists (paragraph from 0, family, probability, coverage) of each line that the classifier gives to a family with
    at least the probability ``certain``, that covers ``covered`` of a template's pairs of words and doesn't deny it; ``families`` are theirs,
    distinct and sorted. A line that declares identifiers has a hit for each family that they name. A notice that wraps is judged over the lines together (``windows``) and listed with its first line, unless fewer of
    these lines are a hit of the family already or another family's hit on one of them covers more. ``n_rejected`` counts the lines given to a family that no template confirmed, that deny it or that
    were too uncertain, and that no hit has. A line without a known gram is unknown. Null
    and empty texts have no paragraphs; repeated rows repeat; an empty table gives none.

    Texts are cut into parts where they are. Equal sets of grams are judged once. Hits of a text meet by their first line, each looking at no more than the lines
    that a template may span, so the time grows with their number and not with its square.
    """
    rows = cut(segments(docs).withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", F.explode("seen").alias("s")).select("row", "s.*")
    kinds = cut(judged(each.select("grams").distinct(), model))
    known = cut(each.join(kinds, "grams").groupBy("row", "paragraph", "last", "family", "negated").agg(F.max("probability").alias("probability"), F.max("coverage").alias("coverage")))
    found = known.filter((F.col("probability") >= certain) & (F.col("coverage") >= covered) & ~F.col("negated"))
    inside = Window.partitionBy("row", "family").orderBy(F.desc("paragraph"), "last").rowsBetween(Window.unboundedPreceding, -1)
    fewest = found.withColumn("_least", F.min("last").over(inside)).filter("_least IS NULL OR _least > last").drop("_least")
    near = Window.partitionBy("row").orderBy("paragraph").rangeBetween(-LONGEST, LONGEST)
    fewest = fewest.withColumn("_near", F.collect_list(F.struct("family", "paragraph", "last", "coverage")).over(near))
    # a hit of another family on a line of the run covers more, as where the run cuts an LGPL notice off and looks like GPL
    better = F.exists("_near", lambda o: (o["family"] != F.col("family")) & (o["paragraph"] <= F.col("last")) & (o["last"] >= F.col("paragraph")) & (o["coverage"] > F.col("coverage")))
    hits = fewest.filter((F.col("paragraph") == F.col("last")) | ~better).drop("_near")
    lines = known.filter("paragraph = last").select("row", "paragraph", F.lit(None).cast("int").alias("_to")).distinct()
    reach = F.max("_to").over(Window.partitionBy("row").orderBy("paragraph").rangeBetween(Window.unboundedPreceding, 0))
    marked = lines.union(hits.select("row", "paragraph", F.col("last").alias("_to"))).withColumn("_reach", reach).filter("_to IS NULL")
    rejected = marked.filter("_reach IS NULL OR _reach < paragraph").groupBy("row").agg(F.count("*").alias("n_rejected"))
    listed = hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("paragraph", "family", "probability", "coverage"))).alias("hits"))
    out = rows.join(rejected, "row", "left").join(listed, "row", "left")
    hits_ = F.coalesce("hits", F.array().cast("array<struct<paragraph:int,family:string,probability:double,coverage:double>>"))
    return out.select("doc_id", "n_paragraphs", F.coalesce("n_rejected", F.lit(0)).alias("n_rejected"), F.array_sort(F.array_distinct(F.transform(hits_, lambda h: h["family"]))).alias("families"), hits_.alias("hits"))


def license_scan(docs: DataFrame) -> DataFrame:
    """Learn from the templates and a bounded sample of the corpus, and scan all rows."""
    return scan(docs, learn(docs))

