import re

from channelgraph.llm import licences

TEXTS = [
    "Licensed under the Apache License, Version 2.0 (the \"License\")", "ALL RIGHTS-reserved all rights reserved. All Rights", "CC BY-NC 4.0, cc by, c c by", None, "",
    "This work is licensed under the GNU General Public License, version 3. general public license general public license", "cc", "by cc", "-cc by", "ccé by cc by é",
    "cc\x00by\x7fcc{by", "the Kelvin all rights reserved İ", "Released under the MIT License. Permission is hereby granted, free of charge, to any person",
    "gnu lesser general public license", "word " * 30_000 + "all rights reserved", "free and unencumbered software released into the public domain", "apache license version 3",
    "9cc by", "cc by9", "This is free and unencumbered software released into the public  domain",
]
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def base(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    starts, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.encode().split()
        here = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += here
        labels |= {label} if here else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), words


def test_base_against_all_places(spark, small, docs_of, clashing):
    rows = licences.op10_rare_token_index(spark, small(documents=clashing(docs_of(list(enumerate(TEXTS)))))).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        n_words, n_base, first, last, labels, words = base(TEXTS[r["doc_id"]])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n_words, n_base, first, last, labels)
        own = set(labels.split(",")) - {""}
        for t in licences.NOTICES:
            p = [w.encode() for w in t.phrase]
            if any(words[i : i + len(p)] == p for i in range(len(words))):
                own.add(t.label)
        assert r["labels"] == ",".join(sorted(own))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(own)


def test_share_of_the_template_in_place(docs_of):
    docs = docs_of([(1, "licensed under the apache license version 2 0 the license"), (2, "some apache license version 2"), (3, "nothing")])
    score = {r["id"]: r["score"] for r in licences.scan(docs, licences.NOTICES).collect()}
    assert score[1] == 1.0 and score[2] == 0.4 and score[3] == 0.0


def test_entries_are_the_rarest_words(docs_of):
    docs = docs_of([(i, "license general") for i in range(20)] + [(100, "public license")])
    idf = licences.word_idf(docs, licences.BASE)
    assert idf["reserved"] > idf["public"] > idf["general"] > idf["license"]
    gpl = next(t for t in licences.BASE if t.label == "gpl")
    assert {w for w, _ in licences._entries(gpl, idf)} == {"public", "general"}


def test_every_occurrence_whatever_the_counts(docs_of):
    """Words that all documents have still lead to their phrases."""
    docs = docs_of([(i, "cc by cc by all rights reserved") for i in range(50)])
    rows = licences.scan(docs).collect()
    assert all(sorted(f["start"] for f in r["found"] if f["base"]) == [0, 2, 4] for r in rows)


def test_repeated_rows_null_ids_and_empty_table(docs_of):
    rows = licences.scan(docs_of([(1, "cc by"), (1, "cc by"), (None, "cc by")])).collect()
    assert [len(r["found"]) for r in rows] == [1, 1, 1]
    assert licences.scan(docs_of([])).collect() == []


def test_templates_hold_their_phrases():
    for t in licences.BASE + licences.NOTICES:
        assert t.words[t.start : t.start + len(t.phrase)] == t.phrase and len(t.phrase) >= 2
