"""T09-T13 edge cases (hand-made documents; one token per word under the word rule)."""

from pyspark.sql import functions as F

from corpusforge.functions import text as tx
from corpusforge.operators.chunk import chunk_documents


def sent(n, word="w"):
    """A sentence of n tokens: n-1 words and the full stop."""
    return " ".join([word] * (n - 1)) + "."


def run(docs, text):
    out = chunk_documents(docs([(1, text)]), keep=("doc_id",)).orderBy("chunk_no").collect()
    return [(r.chunk_no, r.n_tokens, r.n_sentences) for r in out], out


def test_token_count_counts_specials(docs):
    d = docs([(1, "a b, c.")])
    assert d.select(tx.token_count("text", specials=2)).first()[0] == 7  # a b , c . + 2


def test_exactly_510_tokens_passes_through(docs):
    text = sent(255) + "\n" + sent(255)
    chunks, rows = run(docs, text)
    assert chunks == [(0, 510, 1)]
    assert rows[0].text == text  # unchanged, whitespace kept


def test_511_tokens_is_packed(docs):
    text = sent(256) + " " + sent(255)
    chunks, _ = run(docs, text)
    # 256 + 255 = 511 <= 512: one packed chunk of both sentences
    assert chunks == [(0, 511, 2)]


def test_first_sentence_oversize_no_empty_chunk(docs):
    text = sent(600) + " " + sent(300)
    chunks, _ = run(docs, text)
    assert chunks[0] == (0, 600, 1)  # oversize chunk, never split, no empty chunk before it
    assert all(n > 0 for _, n, _ in chunks)


def test_middle_sentence_oversize(docs):
    text = " ".join([sent(300), sent(700), sent(300)])
    chunks, _ = run(docs, text)
    assert [c[1] for c in chunks[:2]] == [300, 700]


def test_tail_255_takes_sentences_in_front(docs):
    # chunk 1: 257 + 255 = 512; chunk 2: 255 -> back-fill takes the 255 before it
    text = " ".join([sent(257), sent(255), sent(255)])
    chunks, _ = run(docs, text)
    assert chunks == [(0, 512, 2), (1, 510, 2)]


def test_tail_256_is_kept(docs):
    text = " ".join([sent(257), sent(255), sent(256)])
    chunks, _ = run(docs, text)
    assert chunks == [(0, 512, 2), (1, 256, 1)]


def test_tail_neighbour_is_one_sentence_chunk(docs):
    # chunk 0 is one 400-token sentence; the tail (100) back-fills from it
    text = " ".join([sent(400), sent(300), sent(300), sent(100)])
    chunks, _ = run(docs, text)
    assert chunks[-1][1] >= 256


def test_single_packed_chunk(docs):
    text = sent(200) + " " + sent(311)
    chunks, _ = run(docs, text)
    assert chunks == [(0, 511, 2)]


def test_chunk_token_total_without_overlap(docs, spark):
    rows = [(i, " ".join(sent(50 + (i * 37) % 300) for _ in range(8))) for i in range(20)]
    d = docs(rows)
    total = d.select(F.sum(tx.token_count("text"))).first()[0]
    c = chunk_documents(d, keep=("doc_id",), tail_min=0)
    assert c.select(F.sum("n_tokens")).first()[0] == total
