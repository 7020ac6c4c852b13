"""Cases that earlier versions got wrong: colliding strings, long names, deep nesting, crowded rows, quoted attributes."""

import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rankwell.llm import chat, htmltext, langid, minhash, packing, quality, tokenout, tokens, warc
from rankwell.llm import textvec as tv


def morse(n, a="a", b="b"):
    """The first n letters of the Thue-Morse sequence over two letters."""
    return "".join(b if bin(i).count("1") & 1 else a for i in range(n))


PAIRS = [(morse(n), morse(n, "b", "a")) for n in (8, 14, 16, 64, 256, 1024, 2048, 4096)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_colliding_strings_have_hashes_of_their_own():
    for n in (15, 16, 63, 64, 65, 1024, 4096):
        words = [morse(n), morse(n, "b", "a"), morse(n, "x", "y"), "a" * n, "a" * (n - 1), "a" * n + "\0"]
        raw = np.frombuffer("".join(words).encode(), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        assert len(set(tv.span_hashes(raw, ends - [len(w) for w in words], ends).tolist())) == len(words)
    raw = np.frombuffer(b"xaby" * 3 + b"ab", np.uint8)
    assert len(set(tv.span_hashes(raw, np.array([1, 5, 12]), np.array([3, 7, 14])).tolist())) == 1


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_colliding_pieces(file):
    texts = [x for p in PAIRS for x in (*p, " ".join(p), "A" + p[0] + "é" + p[1])] + ["exactly fifteen", " b2345678901234", "b23456789012345", "b234567890123456", "b2345678901234\0"]
    enc = tokens.PieceEncoder.of(tokens.default_path(file))
    for _ in range(2):  # pieces not met before, and known ones
        for i, ids in tokens.encode_texts(pa.array(texts), tokens.default_path(file)):
            assert list(ids) == enc.tok.encode(texts[i], add_special_tokens=False).ids, texts[i][:40]


def test_table_of_pieces_starts_over(monkeypatch):
    monkeypatch.setattr(tokens, "SLOTS", 64)
    enc = tokens.PieceEncoder(tokens.default_path("byte_bpe_50k.json"))
    texts = [" ".join(f"w{i * j}" for j in range(60)) for i in range(8)]
    for s in tv.slices(pa.array(texts)):
        ids, first = enc.encode(s)
        for i in range(len(s)):
            assert ids[first[i] : first[i + 1]].tolist() == enc.tok.encode(texts[s.lo + i], add_special_tokens=False).ids


def test_operators_on_colliding_strings(spark):
    a, b = PAIRS[-1]
    turns = spark.createDataFrame([(1, 0, "user", a), (1, 1, "assistant", b), (2, 0, "user", b), (2, 1, "assistant", a)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_conversations(turns).collect()}
    assert got[1].turns_sha256 != got[2].turns_sha256 and got[1].loss_sha256 != got[2].loss_sha256
    docs = spark.createDataFrame([(1, a, "en", "s", 1), (2, b, "en", "s", 1), (3, f"{a}\n{b}\n{a}", "en", "s", 1), (4, f"{a} {b} {a} {b} {b}", "en", "s", 1), (5, f"{b} {a} {b} {a} {a}", "en", "s", 1)], DOCS)
    shards = {r.doc_id: r for r in tokenout.token_output(docs).collect()}
    assert shards[1].ids_crc32 != shards[2].ids_crc32
    packed = {r.doc_id: r for r in packing.best_fit_packing(docs.where("doc_id < 3")).collect() if r.piece == 0}
    assert packed[1].ids_crc32 != packed[2].ids_crc32
    counts = quality.base_counts(next(tv.slices(pa.array([f"{a}\n{b}\n{a}", f"{a}\n{b}", f"{a} {b} {a} {b} {a} {a}"]))))
    assert counts["n_dup_lines"].tolist() == [1, 0, 0] and counts["n_repeat_words"].tolist() == [0, 0, 5]
    assert {r.doc_id: r.kept for r in minhash.near_duplicates(docs).collect()} == dict.fromkeys(range(1, 6), True)


def test_packing_is_optimised_by_its_own_method():
    """On the table's lengths the optimised plan needs no more sequences than the greedy one."""
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").combine_chunks()
    lengths = Counter()
    for _, ids in tokens.encode_texts(texts, tokens.default_path("word_bpe_49k.json")):
        n = len(ids) + 1
        lengths[2048] += n // 2048
        lengths[n % 2048] += n % 2048 > 0
    histogram = {k: v for k, v in lengths.items() if k and v}
    own, greedy = packing._plan(dict(histogram), 2048, 512, True), packing._plan(dict(histogram), 2048, 256, False)
    assert own[0] <= greedy[0] and sum(b - a + 1 for _, a, b, _, _ in own[1]) == sum(histogram.values())


def test_page_long_names():
    for n in (10, 560, 5000):
        page = f"<body><div class='sidebar {'x' * n}'><p>one two three</p></div><article><p>four five</p></article></body>"
        assert htmltext.main_text(page) == "four five", n


def test_page_deep_nesting():
    """100,000 elements in each other with stray end tags, and as many that are never closed."""
    for opening in ("<nav></span>w ", "<div class='sidebar'>v </i>", "<span></div>u"):
        page = opening * 100_000 + "<article><p>four five</p></article>"
        start = time.process_time()
        htmltext.main_text(page)
        assert time.process_time() - start < 10
    nested = "<aside>" * 300 + "<p>x y</p>" + "</aside>" * 300 + "<article><p>four five</p></article>"
    assert htmltext.main_text(nested) == "four five"


def test_quoted_attributes():
    page = "<article><p title='a > b' data-x = \"</p> > \">one <a title=\"a > b\" href=\"x\">two</a> three</p><p class=it's>four > five</p></article>"
    assert warc.page_text(page) == "one two three\nfour > five"
    assert htmltext.main_text(page) == "one two three\nfour > five"
    assert len(warc.LINK.findall("<a title='href=' class=x>no</a><a title=\"a > b\" href=x>yes</a><abbr href=y><a\nhref = 'z'>yes</a>")) == 2


def test_language_of_crowded_rows(spark):
    """Languages whose rows share one doc_id, and text too, still have their profile."""
    for doc in range(5):
        df = spark.range(4000).select(F.lit(doc).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, "the cat and the dog").otherwise("le chat et le chien").alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("fr").alias("lang"))
        profiles = langid.train(df, rows=150)
        assert set(profiles) == {"en", "fr"}
    assert langid.train(df.limit(0)) == {}
