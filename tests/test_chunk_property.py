"""Chunking against a brute-force model of the declared semantics on random documents."""

import random

from corpusforge.operators.chunk import chunk_documents


def model(lens, limit=512, tail_min=256):
    """Greedy inclusive packing (no empty chunk), then the clean tail back-fill."""
    if sum(lens) + 2 <= limit:
        return "passthrough"
    starts, cur = [1], 0
    for i, x in enumerate(lens, start=1):
        if cur + x > limit and cur > 0:
            starts.append(i)
            cur = x
        else:
            cur += x
    last = starts[-1]
    i = last
    while i > 1 and sum(lens[i - 1:]) < tail_min:
        i -= 1
    bounds = [(s, (starts[k + 1] - 1) if k + 1 < len(starts) else len(lens)) for k, s in enumerate(starts)]
    bounds[-1] = (i, len(lens))
    return [sum(lens[a - 1:b]) for a, b in bounds]


def make_doc(rng):
    n = rng.randint(1, 40)
    lens = [rng.choice([rng.randint(2, 30), rng.randint(30, 200), rng.randint(200, 700)]) for _ in range(n)]
    text = " ".join(" ".join(["w"] * (k - 1)) + "." for k in lens)  # k tokens: k-1 words and the stop
    return lens, text


def test_chunker_matches_brute_force(spark):
    rng = random.Random(7)
    docs = [make_doc(rng) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(docs)], "doc_id long, text string")
    got = {}
    for r in chunk_documents(df, keep=("doc_id",)).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_no, r.n_tokens, r.n_sentences))
    packed = 0
    for i, (lens, _) in enumerate(docs):
        want = model(lens)
        rows = sorted(got[i])
        if want == "passthrough":
            assert len(rows) == 1 and rows[0][1] == sum(lens)
            continue
        packed += 1
        assert [n for _, n, _ in rows] == want, (i, lens)
        # every chunk but the back-filled tail respects the limit unless it is one oversize sentence
        for _, n, s in rows[:-1]:
            assert n <= 512 or s == 1
    assert packed > 200
