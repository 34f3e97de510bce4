"""License scans: planted notices, texts that only talk of licences, odd rows."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from engram.llm import license

SCHEMA = "doc_id long, text string"


def test_planted_notices_and_clean_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = {"Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit",
            "This work is licensed under the GNU General Public License, version 3.": "gpl",
            "Licensed under CC BY-NC 4.0.": "cc-by-nc", "All rights reserved.": "reserved"}
    plant = [(10 ** 6 + i, f"Some words here.\n{t}\nMore.") for i, t in enumerate([
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."])]
    talk = [(2 * 10 ** 6 + i, t) for i, t in enumerate([
        "He lost his driving license in the public park.", "Permission to speak was granted.",
        "The general public works under a version of the same rules.", "A warranty of three years comes with the car."])]
    df = docs.union(spark.createDataFrame(plant + talk, SCHEMA)).withColumn("score", F.lit("x"))
    out = {r["doc_id"]: r for r in license.scan(df).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(out) == len(texts) + len(plant) + len(talk)
    for i, t in texts.items():
        lines = {want[x] for x in t.split("\n") if x in want}
        assert (out[i]["license"] in lines) if lines else out[i]["license"] is None, (i, t[-80:])
        assert out[i]["n_paragraphs"] == sum(bool(x.strip(" ")) for x in t.split("\n"))
    assert [out[i]["license"] for i, _ in plant] == ["bsd", "mpl"]
    assert all(out[i]["license"] is None for i, _ in talk)


def test_odd_rows(spark):
    rnd = random.Random(1)
    filler = [(i, " ".join(f"w{rnd.randint(0, 99)}" for _ in range(30))) for i in range(60)]
    rows = [*filler, (100, None), (101, ""), (102, "\n\n"), (None, "Released under the MIT License."),
            (103, "x " * 50000 + "\nReleased under the MIT License."), (103, "x " * 50000 + "\nReleased under the MIT License.")]
    out = license.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["n_paragraphs"] == 0 and by[i]["license"] is None for i in (100, 101, 102))
    assert by[None]["license"] == by[103]["license"] == "mit" and by[103]["n_licensed"] == 1
    assert license.scan(spark.createDataFrame([], SCHEMA)).collect() == []


MIT = """Permission is hereby granted, free of charge, to any person obtaining
a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License."""


def test_wrapped_prefixed_and_embedded_notices(spark):
    rnd = random.Random(2)
    filler = lambda n: " ".join(f"w{rnd.randint(0, 999)}" for _ in range(n))
    rows, want = [(i, filler(30)) for i in range(60)], {}
    for family, notice in (("mit", MIT), ("bsd", BSD), ("apache", APACHE),
                           ("gpl", "This work is licensed under\nthe GNU General Public\nLicense, version 3.")):
        for form in (f"Name\n\n{notice}\n\n{filler(50)}", "\n".join(f"# {x}" for x in notice.split("\n")) + "\ncode()",
                     "/*\n" + "\n".join(f" * {x}" for x in notice.split("\n")) + "\n */",
                     f"{filler(400)} {notice.replace(chr(10), ' ')} {filler(400)}"):
            want[len(rows)] = family
            rows.append((len(rows), form))
    rows.append((len(rows), f"{filler(300)}. Released under the MIT License. {filler(300)}"))
    want[len(rows) - 1] = "mit"
    out = {r["doc_id"]: r for r in license.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: out[i]["license"] for i in out if out[i]["license"]} == want
    assert all(out[i]["n_licensed"] >= 1 for i in want)


def test_likeness_is_the_share_of_word_pairs(spark):
    own = license.pairs(license.words(F.col("p")))
    rows = [("released under the MIT license",), ("Released under the license MIT",), ("",), (None,)]
    got = [r["s"] for r in spark.createDataFrame(rows, "p string").select(
        license.likeness(F.coalesce(own, F.array().cast("array<string>")), "mit").alias("s")).collect()]
    assert got == [1.0, 0.5, 0.0, 0.0]


def test_the_unknown_class_is_every_paragraph_of_the_corpus(spark, monkeypatch):
    rnd = random.Random(4)
    some = ["of the", "in the", "public license", "warranty", "released under", "this is free"]
    line = lambda i: " ".join([f"w{rnd.randint(0, 99)}", *rnd.sample(some, i % 4), f"w{i}"])
    rows = [(i, "\n".join(line(i + k) for k in range(i % 3)) if i % 50 else None) for i in range(1500)]
    rows.append((1500, "Released under the MIT License."))
    w = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")

    def brute(p):
        x = w.findall(p.lower())
        return tuple(sorted({t for t in [*x, *map(" ".join, zip(x, x[1:], strict=False))] if t in license.VOCABULARY}))

    want = Counter(brute(p) for _, t in rows for p in (t or "").split("\n") if p.strip(" "))
    learned = {}
    keep = license.written
    monkeypatch.setattr(license, "written", lambda df, name: learned.setdefault(name, keep(df, name)))
    license.train(spark.createDataFrame(rows, SCHEMA))
    got = {tuple(r["terms"]): r["n"] for r in learned["license-sets"].collect()}
    assert got == want and sum(got.values()) == sum(len(t.split("\n")) for _, t in rows if t)
