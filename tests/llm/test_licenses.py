import pytest
from pyspark.sql import functions as F

from caseloom.llm import licenses
from caseloom.llm.tables import read

SF = "/root/testdata/sf0.01"
PLANTED = {
    "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache",
    "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "All rights reserved.": "reserved",
}


@pytest.fixture(scope="module")
def model(spark):
    return licenses.train_license_model(read(spark, SF, "documents"))


def test_planted_statements_and_nothing_else(spark, model):
    docs = read(spark, SF, "documents")
    got = {r.doc_id: r for r in licenses.license_scan(docs, model=model).collect()}
    assert len(got) == docs.count()
    for d in docs.collect():
        want = sorted({f for line in d.text.split("\n") for p, f in PLANTED.items() if line == p})
        assert got[d.doc_id].confirmed_families == ",".join(want), d.doc_id
        assert got[d.doc_id].n_paragraphs == sum(1 for line in d.text.split("\n") if line.strip())
    assert sum(bool(r.families) for r in got.values()) <= 1.1 * sum(bool(r.confirmed_families) for r in got.values())


def test_statements_in_other_words(spark, model, documents):
    texts = {
        "This file is licensed under the Apache License, version 2.0, see the notice": "apache",
        "The library is released under the terms of the MIT license by its authors": "mit",
        "You can redistribute it under the GNU General Public License, version 3 or later": "gpl",
        "The man with the driving license has a right to work here.": "", "An ordinary sentence.": "", "": "",
    }
    got = licenses.license_scan(documents(list(texts)), model=model).orderBy("doc_id").collect()
    assert [r.families for r in got] == list(texts.values())
    other = licenses.license_scan(documents(["Licensed under the Nobody Knows License, see the license file."]), model=model).first()
    assert other.families == "unknown" and other.n_confirmed == 0


def test_scan_loses_no_feature(spark, model, documents):
    """Scoring every paragraph gives what scoring the scanned ones gives."""
    docs = read(spark, SF, "documents")
    lines = docs.select("doc_id", F.posexplode(licenses.paragraphs(F.col("text"))))
    grams = lines.select("doc_id", "pos", F.explode(licenses.gram_list(licenses.word_list(F.col("col")))).alias("gram"))
    every = grams.join(model.weights, "gram").select("doc_id", "pos").distinct().count()
    scanned, _ = licenses.license_paragraphs(docs, model, "text", [F.col("doc_id").alias("id")])
    assert scanned.select(F.explode("found")).count() >= every


def test_native(spark, model):
    plan = licenses.license_scan(read(spark, SF, "documents"), model=model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_rows(spark, odd_documents):
    got = licenses.license_scan(odd_documents).collect()
    assert len(got) == 10 and all(r.families == "" and r.best_probability is None for r in got)
    assert licenses.license_scan(odd_documents.limit(0)).count() == 0


WRAPPED = {
    "mit": """MIT License

Copyright (c) 2019 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell""",
    "bsd": """# Copyright 2011 A. Person
#
# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are
# met:
#
#    * Redistributions of source code must keep this notice.""",
    "gpl": """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */
int main() { return 0; }""",
    "agpl": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU Affero General Public License as published
    by the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.""",
    "apache": """REM Licensed under the Apache License, Version 2.0 (the "License");
REM you may not use this file except in compliance with the License.
REM You may obtain a copy of the License at""",
    "": """The man with the driving license has a right
to work here.""",
}


def test_wrapped_notices(model, documents):
    texts = [f"{before}{text}{after}" for text in WRAPPED.values() for before, after in (("", ""), ("Some words.\nOther words.\n", "\nThe end.\nOf it."))]
    got = licenses.license_scan(documents(texts), model=model).orderBy("doc_id").collect()
    assert [r.confirmed_families for r in got] == [f for f in WRAPPED for _ in range(2)]
    for r, text in zip(got, texts):
        assert r.n_paragraphs == sum(1 for line in text.split("\n") if line.strip())
    twice = WRAPPED["gpl"] + "\n" + WRAPPED["bsd"]
    assert licenses.license_scan(documents([twice]), model=model).first().confirmed_families == "bsd,gpl"
    one, two = (licenses.license_scan(documents([WRAPPED["bsd"]] * 1 if k == 1 else [WRAPPED["bsd"] + "\n\n" + WRAPPED["bsd"]]), model=model).first().n_confirmed for k in (1, 2))
    assert (one, two) == (1, 2)
