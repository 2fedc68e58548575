import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from channelgraph.llm.packing import CAPACITY, WordTokens, op1_best_fit_packing, pack, packed, plan_slots, sequences, tokenized_pieces

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = "don't WE'LL <|endoftext|> a|b x--y $$$abc!!! 12ab ÀÉß ΣΑΣ K\x1fk\x1ck  widé éa ≠ 日本語 İstanbul \x00z ​q ...'s"


OWN = WordTokens(PATH)


def reference(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40) | st.lists(st.sampled_from(ODD.split(" ")), max_size=12).map(" ".join))
def test_word_tokens_equal_the_tokenizer(text):
    own = WordTokens(PATH)
    for _ in range(2):  # the second time from memory
        assert np.frombuffer(own.ids(text), dtype="<u4").tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=255) | st.sampled_from("''''sstmdrevell .,É9"), max_size=30) | st.sampled_from(ODD.split(" ")), max_size=6))
def test_ids_of_many_texts_equal_the_tokenizer(texts):
    got = OWN.all_ids(texts)
    assert [np.frombuffer(ids, dtype="<u4").tolist() for ids in got] == [OWN.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_piece_is_tokenised_once_however_the_words_around_it_are_marked():
    own, asked = WordTokens(PATH), []
    make = own.pieces.make
    own.pieces.make = lambda piece: asked.append(piece) or make(piece)
    marks = [".", ",", "!!", "***", "(", ";"]
    texts = [f"Été{m} {m}été it's{m} ÉTÉ{n}" for n, m in enumerate(marks)]
    for _ in range(2):
        assert [np.frombuffer(ids, dtype="<u4").tolist() for ids in own.all_ids(texts)] == [reference(t)[:-1] for t in texts]
    assert len(asked) == len(set(asked)) and not own.words  # é was no plain letter before: each marked word went to the tokenizer


def best_fit(lengths, capacity):
    """Plain best-fit decreasing."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            i = min(fits, key=lambda i: room[i])
            room[i] -= n
        else:
            room.append(capacity - n)
    return len(room)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_plan_is_best_fit_and_fills_each_slot_once(lengths):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    taken, used = defaultdict(set), defaultdict(int)
    for length, first, last, per, sequence, offset in plan_slots(histogram, 50):
        for k in range(first, last + 1):
            s = sequence + (k - first) // per
            at = offset + (k - first) % per * length
            cells = set(range(at, at + length))
            assert not cells & taken[s] and at + length <= 50
            taken[s] |= cells
            used[length] += 1
    assert dict(used) == histogram
    assert all(c == set(range(len(c))) for c in taken.values())
    assert len(taken) == best_fit(lengths, 50)


def check(rows, texts, capacity=CAPACITY):
    by_sequence = defaultdict(list)
    by_doc = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["id"]].append(r)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, parts in by_doc.items():
        ids = reference(texts[doc])
        parts.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        for r in parts:
            own = np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()
            assert zlib.crc32(own) == r["ids_crc32"]
        assert sum(r["length"] for r in parts) == len(ids)
        assert all(r["length"] == capacity for r in parts[:-1])


def test_pack_documents(docs_of, clashing):
    texts = {1: "hello world", 2: None, 3: "", 4: "word " * 9000, 5: ODD, 6: "tie one", 7: "tie two"}
    check(pack(clashing(docs_of(list(texts.items())))).collect(), texts)


def test_repeated_rows_and_null_ids_are_documents_of_their_own(docs_of):
    rows = pack(docs_of([(1, "same text")] * 3 + [(None, "same text")])).collect()
    assert len(rows) == 4 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 4


def test_empty_table(docs_of):
    assert pack(docs_of([])).collect() == []


def test_sequences_hold_the_ids(docs_of):
    docs = docs_of([(i, f"document number {i} " * (i % 7 + 1)) for i in range(60)])
    pieces = tokenized_pieces(docs, 32, with_ids=True)
    whole = {r["sequence_id"]: r for r in sequences(packed(pieces, 32)).collect()}
    assert sum(r["n_tokens"] for r in whole.values()) == sum(len(reference(f"document number {i} " * (i % 7 + 1))) for i in range(60))
    assert all(r["n_tokens"] == len(r["ids"]) <= 32 for r in whole.values())


def test_query(spark, small, docs_of):
    texts = {i: f"text {i % 5} " * (i % 11) for i in range(40)}
    rows = op1_best_fit_packing(spark, small(documents=docs_of(list(texts.items())))).withColumnRenamed("doc_id", "id").collect()
    check(rows, texts)
