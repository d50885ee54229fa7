"""Licenses: every template by its own name, and the alignment against a search over all places in plain Python."""

import random

import pytest
from llm_rows import prose

from auctionstream.llm import licenses, queries

INDEX = licenses.build_index(licenses.TEMPLATES)
CASES = [(name, text) for name, texts in licenses.TEMPLATES.items() for text in texts]
CONTEXTS = [
    "{}", "{}.", "\n{}\n", f"{prose(1, 30)} {{}}", f"{{}} {prose(2, 30)}", f"{prose(3, 25)}\n{{}}\n{prose(4, 25)}",
    "Copyright 2024 Someone. {}", "* {}\n* See the file.", f"{prose(5, 200)} ({{}}) {prose(6, 200)}",
]


def found(text, least=licenses.LEAST_COVERAGE):
    return licenses.find(text, INDEX, least)


@pytest.mark.parametrize("name, text", CASES)
def test_every_template_has_its_own_name_in_every_context(name, text):
    for context in CONTEXTS:
        whole = context.format(text)
        hits = found(whole)
        assert [h[0] for h in hits] == [name], whole
        begin, end = hits[0][1], hits[0][2]
        assert text.lower().startswith(whole[begin:end].lower()[:20]) and hits[0][3] == 1.0


@pytest.mark.parametrize("text, name", [
    ("Licensed under CC BY 3.0", None), ("Licensed under CC BY-ND 4.0", None), ("licensed under the GNU General Public License, version 1", None),
    ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
     "published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.", "LGPL-3.0"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
     "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "GPL-2.0"),
    ("some rights reserved", None), ("", None),
])
def test_what_is_near_a_template(text, name):
    assert [h[0] for h in found(text)] == ([name] if name else [])


def common(template, words):
    """The longest common subsequence of two word lists."""
    best = [0] * (len(words) + 1)
    for word in template:
        before = best[:]
        for j, other in enumerate(words):
            best[j + 1] = before[j] + 1 if word == other else max(before[j + 1], best[j])
    return best[-1]


def test_alignment_equals_a_search_over_all_places():
    rng = random.Random(2)
    for _, text in rng.sample(CASES, 12):
        template = licenses.WORD.findall(text.lower())
        edited = [w for w in template if rng.random() > 0.06]
        document = licenses.WORD.findall(prose(rng.random(), 15).lower()) + edited + licenses.WORD.findall(prose(rng.random(), 15).lower())
        ids = [INDEX.vocabulary.get(w, 0) for w in document]
        wanted = [INDEX.vocabulary[w] for w in template]
        # Deletions move the diagonal; a band over all places sees every alignment.
        widest = licenses.align(wanted, ids, 15, len(ids))[0]
        assert widest == common(wanted, ids) >= len(edited)
        assert licenses.align(wanted, ids, 15)[0] <= widest


def test_the_short_notices_of_the_table_are_found(spark, folder):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op9_licenses(spark, folder).collect()
    for name, text in CASES:
        # A passage written word for word is found, unless a longer one holds it.
        for doc_id, whole in texts.items():
            at = whole.lower().find(text.lower())
            alone = at >= 0 and not (whole[at - 1 : at].isalnum() or whole[at + len(text) : at + len(text) + 1].isalnum())
            if alone:
                assert any(r.doc_id == doc_id and r.begin <= at and r.end >= at + len(text) - 1 for r in rows), (name, doc_id)
