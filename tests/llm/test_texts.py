"""Token ids, leaked items and pieces of texts, against the public libraries and brute force."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.llm import leaks
from codeloom.llm import texts as TX
from codeloom.llm.bpe import Encoder, load_ranks, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.tiktoken")
needs = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer")
ODD = ["", " ", "a", "<|endoftext|>", "it's  we'll\r\n\r\nX", "½ ² Ⅷ ٣x", "a​b ﻿", "\x1c\x1d a\x85b c　d", "𝒳𝟙 🧑‍🚀" * 9, "a" * 5000, "漢字かな交じり文。" * 300, "\n\n\n   \n\tx", "İstanbul ẞß"]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(load_ranks(PATH))


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(PATH), special_tokens={})


@needs
def test_ids_of_odd_texts(encoder, reference):
    ids, begins = encoder.encode_block(ODD)
    for k, text in enumerate(ODD):
        assert ids[begins[k] : begins[k + 1]].tolist() == reference.encode_ordinary(text)


@needs
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_ids_of_any_text(texts):
    import tiktoken

    ranks = load_ranks(PATH)
    e = Encoder(ranks)
    ref = tiktoken.Encoding("own", pat_str=r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=ranks, special_tokens={})
    ids, begins = e.encode_block(texts)
    for k, t in enumerate(texts):
        # a code point that only one side's Unicode tables know is split otherwise; the bytes stay
        own = ids[begins[k] : begins[k + 1]].tolist()
        assert b"".join(e.bytes_of[i] for i in own) == t.encode()
        if all(ord(c) < 0x3000 for c in t):
            assert own == ref.encode_ordinary(t)


@needs
def test_ids_operator(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (3, "hello world")], "doc_id long, text string").withColumn("ids", F.lit("x"))
    assert sorted(map(tuple, TX.token_ids(df).collect())) == [(1, []), (2, []), (3, [31373, 995]), (3, [31373, 995])]
    assert TX.token_ids(df.limit(0)).count() == 0


@needs
def test_pieces_make_up_the_text(spark, encoder):
    rng = random.Random(5)
    para = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma,", "delta.", "Überfluß", "x1"]) for _ in range(n))
    texts = [*ODD, "# A\n\n" + "\n\n".join(para(90) for _ in range(20)) + "\n\n## B\n\n- one\n- two\n\n" + para(700), para(3000), "\n".join(para(12) for _ in range(300)), "🧑‍🚀" * 900, "y" * 9000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("piece", F.lit(0))
    rows = {}
    for r in TX.split_texts(df).collect():
        rows.setdefault(r.doc_id, []).append(r)
    for k, text in enumerate(texts):
        ids, _ = encoder.encode_block([text])
        pieces = sorted(rows.get(k, []), key=lambda r: r.piece)
        assert bool(pieces) == (len(ids) > 512)
        if pieces:
            assert [p.piece for p in pieces] == list(range(1, len(pieces) + 1)) and all(p.n_tokens <= 512 for p in pieces)
            assert "".join(p.text[p.overlap_chars :] for p in pieces) == text
            for a, b in zip(pieces, pieces[1:]):
                assert b.overlap_tokens == 32 and b.start_token == a.start_token + a.n_tokens - 32
            assert pieces[-1].start_token + pieces[-1].n_tokens == len(ids)
    heading = [p for p in rows[len(ODD)] if p.text[p.overlap_chars :].startswith("## B")]
    assert len(heading) == 1
    with pytest.raises(ValueError):
        TX.split_texts(df, 100, 60)


ITEM = "the zorvex planner replays plimdo moves until the grand quistel quota is spent for a nubrato panel older than wexofin seconds"
OTHER = "the later brimkat gives its folmund marks to prestovi for one tidal cycle of the garnupel clock near the dropsil gate"


def edited(words, k, rng):
    words = list(words)
    for _ in range(k):
        i = rng.randrange(2, len(words) - 2)
        words[i : i + 1] = rng.choice([["changed"], [], [words[i], "added"]])
    return words


def test_leaks(spark):
    rng = random.Random(3)
    w = ITEM.split()
    quiz = "Read the note and name the part that has to change before it can be closed. "
    items = [(1, quiz + ITEM.capitalize() + "."), (2, quiz + OTHER + "."), (3, None), (4, "")]
    shuffled = w[:]
    rng.shuffle(shuffled)
    docs = [
        (1, "Intro. " + ITEM.upper() + " outro"),
        (2, "> the zorvex planner\n> replays, plimdo moves\n> until the gr​and quistel quota is spent\n> for a nubrato"),
        (3, "x " + " ".join(edited(w, 3, rng)) + " y"),
        (4, " ".join(w[:9]) + " and then something else entirely"),
        (5, " ".join(shuffled)),
        (6, quiz * 3),
        (7, None),
        (8, ""),
        (9, "a " * 50_000 + " ".join(w[3:15])),
        (10, "say " + " ".join(w) + " and " + OTHER),
        (1, "Intro. " + ITEM.upper() + " outro"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(0))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("suite", F.lit(None).cast("string"))
    assert {tuple(r) for r in TX.leaked_items(d, i).collect()} == {(1, 1), (2, 1), (3, 1), (9, 1), (10, 1), (10, 2)}
    assert {(r.item_id, r.n_documents) for r in TX.leak_report(d, i).collect()} == {(1, 5), (2, 1)}
    assert TX.leaked_items(d.limit(0), i).count() == 0 and TX.leaked_items(d, i.limit(0)).count() == 0


def test_items_of_one_text(spark):
    d = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    i = spark.createDataFrame([(1, ITEM), (5, ITEM.upper() + "!"), (2, OTHER)], "item_id long, text string")
    assert {tuple(r) for r in TX.leaked_items(d, i).collect()} == {(1, 1), (1, 5)}
    near = spark.createDataFrame([(1, ITEM), (5, ITEM + " now"), (6, ITEM + " then")], "item_id long, text string")
    assert {tuple(r) for r in TX.leaked_items(d, near).collect()} >= {(1, 1)}


def test_items_near_each_other(spark):
    quiz = "Read the note and name the part that has to change before it can be closed. "
    w = ITEM.split()
    changed = " ".join("changed" if k in (5, 11, 17) else x for k, x in enumerate(w))
    ask = "What would the operator of such a planner have to watch for during the {}?"
    items = [(1, ITEM), (5, ITEM + " now"), (6, ITEM + " then"), (7, changed), (8, ITEM + ". It is {} only then.".format("paid")), (9, ITEM + ".")]
    items += [(11, f"{quiz}{OTHER}. {ask.format('night')}"), (12, f"Say why. {OTHER}. {ask.format('flood')}"), (13, f"{quiz}Nothing of the sort is told of {' '.join(map('q{}'.format, range(12)))}.")]
    d = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, quiz * 2)], "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in TX.leaked_items(d, i).collect()} == {(1, k) for k in (1, 5, 6, 7, 8, 9)} | {(2, 11), (2, 12)}


def test_turns_of_phrase_show_no_item(spark):
    phrase = "If {} cannot reach the placid {} host before {} beats, all entries under {} fade after {} hours"
    i = spark.createDataFrame([(1, phrase.format("Leraye", "Bazicleye", 924, "Kakaba", 88)), (2, phrase.format("Tribaye", "Diyerapu", 907, "Vodise", 602))], "item_id long, text string")
    d = spark.createDataFrame([(1, phrase.format("Leraye", "Bazicleye", 924, "Kakaba", 88))], "doc_id long, text string")
    assert {tuple(r) for r in TX.leaked_items(d, i).collect()} == {(1, 1)}


def test_leaks_with_any_map(spark):
    d = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, "x " * 700 + ITEM + " y" * 700)], "doc_id long, text string")
    i = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, "short")], "item_id long, text string")
    for bits in (6, 24):  # the smallest map lets nearly everything through
        assert {tuple(r) for r in TX.leaked_items(d, i, bits).collect()} == {(1, 1), (2, 2), (3, 1)}


@pytest.mark.parametrize("n", [240, 1000, 5000])
def test_passages_word_for_word(spark, n):
    """Twenty words of an item among others are found however many items there are, and only where one stands."""
    rng = random.Random(n)
    weights = [1 / k for k in range(1, 20_001)]
    vocabulary = [f"w{k}" for k in range(20_000)]
    items = [rng.choices(vocabulary, weights, k=60) for _ in range(n)]
    docs, true = [], set()
    for doc in range(300):
        k, at = rng.randrange(n), rng.randrange(40)
        docs.append((doc, " ".join(rng.choices(vocabulary, weights, k=150) + items[k][at : at + 20] + rng.choices(vocabulary, weights, k=150))))
        true.add((doc, k))
    docs += [(1000 + k, " ".join(rng.choices(vocabulary, weights, k=300))) for k in range(100)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    assert {tuple(r) for r in TX.leaked_items(d, i).collect()} == true


def test_a_shared_turn_counts_for_none_that_is_farther(spark):
    """Of two items with one frame, a copy with errors shows the nearer one; word for word it shows both."""
    frame = "whenever the {} planner replays a pending {} move the {} host writes one silver line and rests"
    i = spark.createDataFrame([(1, "Zorvex says so, and " + frame.format("blue", "tall", "kind")), (2, "Nobody else did it. " + frame.format("gray", "thin", "wise")), (3, "again and again " + frame.format("blue", "tall", "kind") + " at noon")], "item_id long, text string")
    d = spark.createDataFrame([(1, "we heard: " + frame.format("blue", "tall", "kind").replace("pending", "settled"))], "doc_id long, text string")
    assert {tuple(r) for r in TX.leaked_items(d, i).collect()} >= {(1, 1), (1, 3)}


def brute(pattern, text):
    row = [0] * (len(text) + 1)
    for a in pattern:
        new = [row[0] + 1]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_distances_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        p, t = [rng.randrange(4) for _ in range(rng.randrange(1, 30))], [rng.randrange(4) for _ in range(rng.randrange(1, 40))]
        size = rng.randrange(1, min(len(p), 31) + 1)
        got = leaks.distances(p, size, t)
        for s in range(len(p) - size + 1):
            assert min(size, got[:, s].min()) == brute(p[s : s + size], t)
