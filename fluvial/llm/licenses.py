"""Licence scans with a trained paragraph classifier.

A sparse logistic regression over word 1- and 2-grams is trained on template
paragraphs of each licence family, altered copies of them, and paragraphs that
are no licences. Log-odds are calibrated by a temperature on altered copies
kept back; a paragraph whose best family is not probable enough, or whose words
do not cover a template of it, is ``unknown``. Scoring is one projection: lines
that no family can win, whatever their other words are, are passed over by one
pattern. Adjacent lines that are left, and that no family is sure of, are judged
once more as one paragraph, so a notice wrapped over lines is found.

Edge cases: null and empty texts have no paragraphs; a paragraph is a line, or
adjacent lines (reported at the first) that are a licence only together; a
document without licence paragraphs has empty arrays; ties go to the family
that sorts first; very long lines are judged whole. Repeated rows give repeated
results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fraction_key

#: Short notices of each licence family.
TEMPLATES = {
    "agpl": ["licensed under the gnu affero general public license version 3", "this program is free software you can redistribute it under the terms of the gnu affero general public license", "agpl 3.0 license", "this work is licensed under the gnu affero general public license version 3"],
    "apache": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the license you may obtain a copy at apache org licenses license 2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "released under the apache license", "apache 2.0 license", "this work is licensed under the apache license version 2.0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "released under the bsd license", "licensed under the bsd 3 clause license", "bsd 2 clause license"],
    "cc-by": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "creative commons attribution license", "released under cc by 3.0"],
    "cc-by-nc": ["licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license", "licensed under cc by nc sa 4.0", "released under cc by nc nd 4.0", "creative commons attribution non commercial license"],
    "cc-by-sa": ["licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license", "text is available under the creative commons attribution share alike license", "released under cc by sa 3.0"],
    "cc0": ["released under cc0 1.0 universal", "to the extent possible under law the author has waived all copyright and related rights to this work", "dedicated to the public domain under cc0", "this work is in the public domain", "licensed under cc0 1.0"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "released under the gpl", "gpl v3 license", "you should have received a copy of the gnu general public license along with this program"],
    "lgpl": ["licensed under the gnu lesser general public license version 3", "this library is free software you can redistribute it under the terms of the gnu lesser general public license", "released under the lgpl", "lgpl 2.1 license", "this work is licensed under the gnu lesser general public license version 2.1"],
    "mit": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "mit license", "this work is licensed under the mit license"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0", "if a copy of the mpl was not distributed with this file you can obtain one at mozilla org mpl 2.0", "released under the mpl 2.0"],
    "proprietary": ["all rights reserved", "copyright all rights reserved", "no part of this publication may be reproduced distributed or transmitted without the prior written permission of the publisher", "confidential and proprietary unauthorized copying of this file is strictly prohibited", "may not be reproduced without permission"],
}
#: Sentences that have words of licences, and are none.
OTHERS = [
    "she has a driving license and a library card", "the permission was given by the school", "the rights of all people are equal", "he sold his software to a company", "the general said that the public was safe", "the new version will be released in june", "a copy of the letter was sent under the terms of the treaty",
    "the common good is created by many", "he made a commercial for the product", "all of them were reserved and quiet", "free of charge for any person under ten", "the source of the river is in the mountains", "modification of the law is not permitted", "he works at mit in boston", "the apache helicopter is in the air",
    "this work is about the law of the sea", "the name of the author is not known", "the public library is free", "they distribute food and clothes", "the domain of the function is the real line",
]
#: Words of two letters or more, or with a digit.
WORD = r"[a-z0-9]+(?:\.[0-9]+)*"


def normal_words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def grams(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words[:-1], words[1:], strict=True)]


@dataclass
class Model:
    families: list[str]  # the last one is "none"
    vocabulary: dict[str, np.ndarray]
    bias: np.ndarray
    temperature: float
    gate: str  # a lower-cased line without this pattern is in no family, by the weights


def fit(background: list[str], seed: int = 11, steps: int = 400, copies: int = 8) -> Model:
    """Trains on templates, altered copies of them, and other paragraphs."""
    rng = np.random.default_rng(seed)
    families = [*sorted(TEMPLATES), "none"]
    none = len(families) - 1
    filler = [w for b in background[:200] for w in normal_words(b)] or ["the"]
    train: list[tuple[list[str], int]] = []
    kept: list[tuple[list[str], int]] = []
    for k, family in enumerate(families[:-1]):
        for t in TEMPLATES[family]:
            words = normal_words(t)
            train += [(words, k)] * 3
            for c in range(copies):
                some = [w for w in words if rng.random() > 0.1] or words
                if rng.random() < 0.5:
                    extra = [filler[i] for i in rng.integers(0, len(filler), 4)]
                    some = extra[:2] + some + extra[2:]
                (kept if c == copies - 1 else train).append((some, k))
    for k, t in enumerate([*OTHERS * 4, *background]):
        (kept if k % 8 == 7 else train).append((normal_words(t), none))
    counts: dict[str, int] = {}
    for words, k in train:
        if k != none:
            for g in set(grams(words)):
                counts[g] = counts.get(g, 0) + 1
    known = {w for ts in TEMPLATES.values() for t in ts for w in grams(normal_words(t))}
    names = sorted(g for g in counts if g in known)
    index = {g: i for i, g in enumerate(names)}

    def matrix(rows: list[tuple[list[str], int]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(names)), np.float32)
        for i, (words, _) in enumerate(rows):
            x[i, [index[g] for g in set(grams(words)) if g in index]] = 1
        return x, np.eye(len(families), dtype=np.float32)[[k for _, k in rows]]

    x, y = matrix(train)
    w, b = np.zeros((len(names), len(families)), np.float32), np.zeros(len(families), np.float32)
    for _ in range(steps):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - y) / len(x)
        w -= 20 * (x.T @ g + 1e-5 * w)
        b -= 20 * g.sum(0)
    z, target = (lambda m: (m[0] @ w + b, m[1]))(matrix(kept))

    def loss(t: float) -> float:
        s = z / t
        return float((np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - (s * target).sum(1)).mean())

    temperature = min(np.geomspace(0.25, 8, 40), key=loss)
    return Model(families, {g: w[i] for g, i in index.items()}, b, float(temperature), gate_pattern(names, w, b, background))


def gate_pattern(names: list[str], w: np.ndarray, b: np.ndarray, background: list[str]) -> str:
    """A pattern that each lower-cased line has for which a family's log-odds can reach those of none.

    Words are left out of it, those first that are frequent and say little, as long as all that they and
    their pairs speak for a family together stays under what speaks for none.
    """
    lift = np.maximum(np.round(w.astype(float), 6)[:, :-1] - np.round(w.astype(float), 6)[:, -1:], 0)
    margin = float(b[-1]) - b[:-1].astype(float) - 1e-3
    words = {g: lift[i] for i, g in enumerate(names) if " " not in g}
    pairs = [(set(g.split(" ")), lift[i]) for i, g in enumerate(names) if " " in g]
    often: dict[str, int] = {}
    for line in background:
        for x in set(normal_words(line)):
            often[x] = often.get(x, 0) + 1
    out: set[str] = set()
    total = np.zeros(len(margin))
    for x in sorted(words, key=lambda x: (-often.get(x, 0) / (0.1 + float(words[x].max())), x)):
        more = total + words[x] + sum((v for p, v in pairs if x in p and p <= out | {x}), np.zeros(len(margin)))
        if (more < margin).all():
            out.add(x)
            total = more
    by: dict[str, list[str]] = {}
    for x in sorted(set(words) - out):
        # a word with a full stop may be followed by letters; a word may follow one that ends with digits
        by.setdefault(x[0], []).append(re.escape(x[1:]) + ("" if "." in x else "(?![a-z0-9])"))
    return "(?<![a-z])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items()) + ")"


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", documents: int = 200, lines: int = 2000) -> Model:
    """Fits with a bounded sample of other paragraphs: at most ``lines`` lines of about ``documents`` documents, by hash of the id."""
    total = docs.count()
    some = docs.where(fraction_key(F.col(key), 6) < min(1.0, documents / max(total, 1))).select(F.explode(F.split(text, "\n")).alias("line"))
    found = some.where(F.trim("line") != "").groupBy("line").count().orderBy(F.xxhash64("line"), "line").limit(lines).collect()
    templates = [set(grams(normal_words(t))) for ts in TEMPLATES.values() for t in ts]
    rest = [r["line"] for r in found if not any(len(t & set(grams(normal_words(r["line"])))) > 0.5 * len(t) for t in templates)]
    return fit(rest)


def _literal_map(model: Model) -> Column:
    keys = list(model.vocabulary)
    quoted = ",".join("'" + k + "'" for k in keys)
    values = ",".join("array(" + ",".join(f"{v:.6f}D" for v in model.vocabulary[k]) + ")" for k in keys)
    return F.expr(f"map_from_arrays(array({quoted}), array({values}))")


def _classified(rows: DataFrame, own: list[str], units: str, model: Model, least: float, cover: float) -> DataFrame:
    """``own`` columns and ``__found``: families of the units (array of line, t) that are not "none"."""
    words = F.transform(units, lambda x: F.struct(x["line"].alias("line"), F.regexp_extract_all(x["t"], F.lit(f"({WORD})")).alias("w")))
    rows = rows.select(*own, F.size(units).alias("__n"), words.alias("__w"))
    pairs = F.expr("""transform(__w, x -> struct(x.line as line, array_distinct(concat(x.w, if(size(x.w) > 1, transform(sequence(1, size(x.w) - 1), i -> concat(element_at(x.w, i), ' ', element_at(x.w, i + 1))), cast(array() as array<string>)))) as g))""")
    known = F.expr("array(" + ",".join("'" + g + "'" for g in model.vocabulary) + ")")  # other 1-2-grams have no weight, and no template has them
    rows = rows.select(*own, "__n", pairs.alias("__g"))
    rows = rows.select(*own, "__n", F.transform("__g", lambda x: F.struct(x["line"].alias("line"), F.array_intersect(x["g"], known).alias("g"))).alias("__g"))
    zero = "array(" + ",".join(f"{v:.6f}D" for v in model.bias) + ")"
    weights = _literal_map(model)
    logits = F.transform("__g", lambda x: F.struct(x["line"].alias("line"), x["g"].alias("g"), F.aggregate(F.filter(F.transform(x["g"], lambda g: F.try_element_at(weights, g)), lambda v: v.isNotNull()), F.expr(zero), lambda a, v: F.zip_with(a, v, lambda p, q: p + q)).alias("z")))
    rows = rows.select(*own, F.when(F.col("__n") > 0, logits).otherwise(F.expr("cast(array() as array<struct<line:int,g:array<string>,z:array<double>>>)")).alias("__z"))
    t = model.temperature
    shares = F.transform("__z", lambda x: F.struct(x["line"].alias("line"), x["g"].alias("g"), F.transform(x["z"], lambda v: F.exp((v - F.array_max(x["z"])) / F.lit(t))).alias("e")))
    rows = rows.select(*own, shares.alias("__e"))
    names = F.array(*(F.lit(f) for f in model.families))
    best = F.transform("__e", lambda x: F.struct(x["line"].alias("line"), x["g"].alias("g"), F.element_at(names, F.array_position(x["e"], F.array_max(x["e"])).cast("int")).alias("family"), (F.lit(1.0) / F.aggregate(x["e"], F.lit(0.0), lambda a, v: a + v)).alias("p")))
    rows = rows.select(*own, F.filter(best, lambda x: x["family"] != "none").alias("__b"))

    def covers(x: Column) -> Column:
        """Whether the words cover most of one of the family's templates."""
        test = F.lit(False)
        for family, texts in TEMPLATES.items():
            inner = F.lit(False)
            for w in texts:
                ours = sorted(set(grams(normal_words(w))))
                inner = inner | (F.size(F.array_intersect(x["g"], F.expr("array(" + ",".join("'" + g + "'" for g in ours) + ")"))) >= F.lit(cover * len(ours)))
            test = F.when(x["family"] == family, inner).otherwise(test)
        return test

    checked = F.transform("__b", lambda x: F.struct(x["line"].alias("line"), x["family"].alias("guess"), x["p"].alias("probability"), covers(x).alias("confirmed")))
    rows = rows.select(*own, F.when(F.size("__b") > 0, checked).otherwise(F.expr("cast(array() as array<struct<line:int,guess:string,probability:double,confirmed:boolean>>)")).alias("__f"))
    final = F.transform("__f", lambda x: F.struct(x["line"].alias("line"), F.when((x["probability"] >= least) & x["confirmed"], x["guess"]).otherwise("unknown").alias("family"), x["probability"].alias("probability"), x["confirmed"].alias("confirmed")))
    return rows.select(*own, final.alias("__found"))


def _runs() -> Column:
    """Adjacent lines of ``__rest``, two or more of them, as one paragraph each: its first and last line, and its text."""
    at = lambda i: F.element_at("__rest", i)["line"]
    n = F.size("__rest")
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: F.when(i == 1, F.lit(True)).otherwise(at(F.greatest(i - 1, F.lit(1))) + 1 != at(i)))
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.when(i == n, F.lit(True)).otherwise(at(F.least(i + 1, n)) - 1 != at(i)))
    pairs = F.filter(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda p: p["e"] > p["s"])
    joined = F.transform(pairs, lambda p: F.struct(at(p["s"]).alias("line"), at(p["e"]).alias("last"), F.array_join(F.transform(F.slice("__rest", p["s"], p["e"] - p["s"] + 1), lambda x: x["t"]), " ").alias("t")))
    return F.when(n > 1, joined).otherwise(F.expr("cast(array() as array<struct<line:int,last:int,t:string>>)"))


def scan(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: float = 0.5, cover: float = 0.6) -> DataFrame:
    """One row a document: ``keep``, ``n_licences``, ``n_unknown``, ``families`` (sorted, without unknown) and ``found``: array of struct(line, family, probability, confirmed)."""
    named = [f"__k{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(k).alias(n) for k, n in zip(keep, named, strict=True)), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("__t"))
    cand = F.filter(F.transform(F.split("__t", "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("t"))), lambda x: x["t"].rlike(model.gate))
    none = F.expr("cast(array() as array<struct<line:int,t:string>>)")
    rows = rows.select(*named, F.when(F.col("__t").rlike(model.gate), cand).otherwise(none).alias("__c"))  # most texts end here
    rows = _classified(rows, [*named, "__c"], "__c", model, least, cover)
    # lines that no family is sure of are judged together with their neighbours: a notice may be wrapped
    rest = F.filter("__c", lambda c: ~F.exists("__found", lambda f: (f["line"] == c["line"]) & (f["family"] != "unknown")))
    rows = rows.select(*named, F.col("__found").alias("__one"), F.when(F.size("__c") > 1, rest).otherwise(none).alias("__rest"))
    rows = _classified(rows.select(*named, "__one", _runs().alias("__runs")), [*named, "__one", "__runs"], "__runs", model, least, cover)
    rows = rows.select(*named, "__one", "__runs", F.filter("__found", lambda f: f["family"] != "unknown").alias("__whole"))
    inside = lambda f: F.exists("__runs", lambda r: f["line"].between(r["line"], r["last"]) & F.exists("__whole", lambda w: w["line"] == r["line"]))
    rows = rows.select(*named, F.when(F.size("__whole") > 0, F.array_sort(F.concat(F.filter("__one", lambda f: ~inside(f)), "__whole"))).otherwise(F.col("__one")).alias("found"))
    sure = F.filter("found", lambda x: x["family"] != "unknown")
    return rows.select(
        *(F.col(n).alias(k) for n, k in zip(named, keep, strict=True)),
        F.size(sure).cast("long").alias("n_licences"),
        (F.size("found") - F.size(sure)).cast("long").alias("n_unknown"),
        F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))).alias("families"),
        "found",
    )
