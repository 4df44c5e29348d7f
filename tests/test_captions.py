"""Caption text, file names, phrases and flashes by cases."""

from pyspark.sql import functions as F

from tidemark.functions import layout as L
from tidemark.operators import captions, sequences, words


def test_text_and_names(spark):
    cases = [("a{b}", "a\\{b\\}"), ("C:\\N", "C:\\\u200bN"), ("x\r\ny", "x\\Ny"), ("", "")]
    df = spark.createDataFrame(cases, "a string, b string")
    assert [r.got for r in df.select(L.caption_text(F.col("a")).alias("got")).collect()] == [b for _, b in cases]
    cases = [("a/b: c", "a_b_ c"), ("  two   words. ", "two words"), ("...", "none"), (None, "none"), ("con.txt", "_con.txt"), ("COM0", "COM0"), ("lpt9", "_lpt9"), ("conn", "conn"), ("abcdefghijkl", "abcdefghij"), ("abcdefghi. x", "abcdefghi"), ("a\tb", "a_b"), ("a\u00a0 b", "a b")]
    df = spark.createDataFrame(cases, "a string, b string")
    assert [r.got for r in df.select(L.segment_name(F.col("a"), "none", 10).alias("got")).collect()] == [b for _, b in cases]


def test_document(spark):
    rows = [(1, 1, 0, 2.0, 3.5, "b"), (1, 0, 0, 0.0, 61.0, "{a}"), (1, 2, 1, 0.0, 1.0, None)]
    r = captions.documents(spark.createDataFrame(rows, "clip long, idx long, layer int, start_s double, end_s double, text string"), "clip", "{\\an5}").first()
    body = r.document.split("[Events]\n")[1].splitlines()[1:]
    assert r.n_lines == 3 and body == ["Dialogue: 0,0:00:00.00,0:01:01.00,Caption,,0,0,0,,{\\an5}\\{a\\}", "Dialogue: 0,0:00:02.00,0:00:03.50,Caption,,0,0,0,,{\\an5}b", "Dialogue: 1,0:00:00.00,0:00:01.00,Caption,,0,0,0,,{\\an5}"]
    assert ",1,6,2,5,40,40,40,1\n" in r.document and [captions.pixels(v) for v in (6.0, 2.5, -1.0)] == ["6", "2.5", "0"]


def test_phrases(spark):
    u = lambda *t: [(x, float(k), k + 1.0, 1.0 - k / 10) for k, x in enumerate(t)]
    assert words.collapse(u("So", "(Point", "blank!)", "ok"), [(["point", "blank"], "Point Blank")]) == [("So", 0.0, 1.0, 1.0), ("Point Blank!)", 1.0, 3.0, 0.8), ("ok", 3.0, 4.0, 0.7)]
    # not overlapping; what was collapsed to one word takes part in later phrases
    assert [x[0] for x in words.collapse(u("a", "a", "a"), [(["a", "a"], "b")])] == ["b", "a"]
    assert [x[0] for x in words.collapse(u("a", "a", "a"), [(["a", "a"], "b"), (["b", "a"], "c")])] == ["c"]
    assert words.collapse([], [(["a", "b"], "c")]) == [] and len(words.collapse(u("b", "a"), [(["a", "b"], "c")])) == 2
    df = spark.createDataFrame([(7, k, *x) for k, x in enumerate(u("x", None, "y", "z."))], "clip long, idx int, text string, start_s double, end_s double, confidence double")
    store = spark.createDataFrame([(1, "y z", "W"), (0, "x", "q"), (2, "", "q"), (3, "x y", None)], "pos int, wrong string, right string")
    assert [(r.clip, r.idx, r.text) for r in words.phrase_collapse(df, "clip", store).orderBy("idx").collect()] == [(7, 0, "x"), (7, 1, ""), (7, 2, "W.")]


def test_flashes():
    near = lambda got, want: all(abs(a - b) < 1e-9 for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))
    # two flashes against the word at 3: a second for both, by their letters
    assert near(sequences.respread(["a", "bbb", "c", "d"], [0.0, 2.9, 2.95, 3.0], [1.0, 2.95, 3.0, 4.0], 4.0), ([0.0, 2.0, 2.75, 3.0], [1.0, 2.75, 3.0, 4.0]))
    # boxed in: left alone; at the end: up to the clip's end
    assert near(sequences.respread(["a", "b", "c"], [0.0, 1.0, 1.1], [1.0, 1.1, 2.0], 2.0), ([0.0, 1.0, 1.1], [1.0, 1.1, 2.0]))
    assert near(sequences.respread(["a"], [0.0], [0.1], 9.0), ([8.5], [9.0]))
    assert sequences.respread([], [], [], 1.0) == ([], [])
