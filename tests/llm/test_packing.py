import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import packing as K

FILE = public_tokenizers.path("byte_bpe_50k.json")


LIBRARY = Tokenizer.from_file(FILE)
LIBRARY.encode_special_tokens = True


def reference(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_as_the_tokenizers_library():
    r = random.Random(1)
    texts = ["", "Hello  world\n\n don't 12345 été", "日本語 текст 👍🏽 ‍ x y", "<|endoftext|> a", "a" * 3000, " \t\r\n  ", "\x00\x07"]
    texts += ["".join(chr(r.choice([r.randint(1, 0x250), r.randint(0x3000, 0x3100), 32, 10, r.randint(0x1F300, 0x1F700)])) for _ in range(200)) for _ in range(30)]
    assert [x.tolist() for x in K.encode(texts, FILE)] == [reference(t) for t in texts]


def test_best_fill_as_brute_force():
    r = random.Random(2)
    for _ in range(200):
        counts = {}
        for _ in range(r.randint(1, 7)):
            counts[n] = counts.get(n := r.randint(1, 20), 0) + 1 if (n := r.randint(1, 20)) else 0
        items = [n for n, c in counts.items() for _ in range(c)]
        longest = max(items)
        rest = list(items)
        rest.remove(longest)
        best = max(longest + sum(s) for k in range(len(rest) + 1) for s in itertools.combinations(rest, k) if longest + sum(s) <= 30)
        fill = K.best_fill(counts, 30)
        assert sum(n * c for n, c in fill.items()) == best and all(c <= counts[n] for n, c in fill.items())


def checked(spark, docs, size=2048):
    rows = [x.asDict() for x in K.pack(docs, FILE, size).collect()]
    ids = {}
    for d in docs.collect():
        ids.setdefault((d.doc_id, tuple(reference(d.text))), 0)
        ids[d.doc_id, tuple(reference(d.text))] += 1
    texts = {}
    for (doc, t), n in ids.items():
        texts.setdefault(doc, []).extend([t] * n)
    by_doc = {}
    for x in rows:
        by_doc.setdefault(x["doc_id"], []).append(x)
    assert by_doc.keys() == texts.keys()
    for doc, own in by_doc.items():
        assert sum(x["length"] for x in own) == sum(map(len, texts[doc]))
        for x in own:
            assert any(len(t) == x["doc_tokens"] and zlib.crc32(np.array(t[x["start"]:x["start"] + x["length"]], "<u4").tobytes()) == x["ids_crc32"] for t in texts[doc])
        if len(texts[doc]) == 1:
            at = 0
            for x in sorted(own, key=lambda x: x["start"]):
                assert x["start"] == at
                at += x["length"]
    padded, total = 0, 0
    for _, own in itertools.groupby(sorted(rows, key=lambda x: (x["sequence_id"], x["offset"])), key=lambda x: x["sequence_id"]):
        at = 0
        for x in own:
            assert x["offset"] == at
            at += x["length"]
        assert at <= size
        total += at
        padded += 0 if at & (at - 1) == 0 else size - at
    return padded, total


def test_pieces(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    padded, total = checked(spark, docs)
    assert padded <= 0.01 * total


def test_small_windows_nulls_repeats_empty(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "a b c d e f g h i j k", 5), (2, "a b c d e f g h i j k", 5), (3, "", 5), (3, "x", 5), (4, "word " * 50, 5)], "doc_id long, text string, start int")
    padded, _ = checked(spark, docs, 16)
    assert padded == 0
    assert K.pack(docs.limit(0), FILE).count() == 0


def test_hot_lengths_need_no_padding():
    r = random.Random(3)
    cases = [{1500: 100}, {1500: 10_000}, {1500: 10_000, 952: 3}, {n: 500 for n in range(1025, 1100)}, {2047: 100_000, 1: 5}]
    for n in (300, 3_000, 30_000):
        counts = {1500: n // 3}
        for _ in range(n - n // 3):
            x = r.randint(1, 2047)
            counts[x] = counts.get(x, 0) + 1
        cases.append(counts)
    for counts in cases:
        rows, sequences, tail = K.plan_rows(counts, 2048)
        filled = sum((high - low) * cut for _, low, high, _, cut, first, *_ in rows if first >= 0)
        assert filled == 2048 * sequences and filled + tail == sum(n * c for n, c in counts.items())
        assert tail <= 64 * 2048


def test_copies_of_a_hot_length_are_cut_whole(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([*((i, text) for i in range(3_000)), *((None, f"{text} {i % 3}") for i in range(300)), (7, text)], "doc_id long, text string")
    padded, total = checked(spark, docs, 19)
    assert padded == 0 and total > 64 * 19


def test_special_tokens_as_the_library_by_default(spark):
    library = Tokenizer.from_file(FILE)
    texts = ["<|endoftext|> a", "a  <|endoftext|>\n b<|endoftext|><|endoftext|>", "<|endoftext", "plain  text\n 1"]
    want = [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert [x.tolist() for x in K.encode(texts, FILE, special=True)] == want
    got = {}
    for x in K.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), FILE).collect():
        got.setdefault(x.doc_id, []).append((x.start, x.length, x.ids_crc32, x.doc_tokens))
    for doc, t in enumerate(want):
        assert sum(n for _, n, _, _ in got[doc]) == len(t)
        assert all(crc == zlib.crc32(np.array(t[a:a + n], "<u4").tobytes()) and k == len(t) for a, n, crc, k in got[doc])
