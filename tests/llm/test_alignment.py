"""Token alignment against a byte-by-byte version."""

import hashlib
import random
from collections import Counter

import pytest

from triagelake.llm import alignment


def tokens_of(of, text):
    """(end offset, id) of each token by A and by B, of the whole text at once; None where the bytes differ."""
    out = []
    for ids, known in ((of.a.encode(" " + text, add_special_tokens=False).ids, of.bytes[0]), (of.b.encode(text), of.bytes[1])):
        raw = [known[i].as_py() for i in ids]
        if b"".join(raw) != b" " + text.encode():
            return None
        at, found = 0, []
        for i, r in zip(ids, raw):
            at += len(r)
            found.append((at, i))
        out.append(found)
    return out


def expected(texts):
    of, every, counts = alignment.pair(*alignment.vocabularies()), [], Counter()
    for text in texts:
        both = tokens_of(of, text) if text else None
        if both is None:
            every.append(None)
            continue
        spans = []
        for side in both:
            starts = [0, *(e for e, _ in side)]
            spans.append([(s, e, i) for s, (e, i) in zip(starts, side)])
        owner = [[i for i, (s, e, _) in enumerate(side) for _ in range(e - s)] for side in spans]
        links = sorted(set(zip(*owner)))
        links = [(both[0][i][1], both[1][j][1]) for i, j in links]
        counts.update(links)
        common = {e for e, _ in both[0]} & {e for e, _ in both[1]}
        groups, at = [], [0, 0]
        for end in sorted(common):
            held = []
            for side in (0, 1):
                first = at[side]
                while at[side] < len(both[side]) and both[side][at[side]][0] <= end:
                    at[side] += 1
                held.append(",".join(str(i) for _, i in both[side][first : at[side]]))
            groups.append("|".join(held))
        every.append((len(both[0]), len(both[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(n, top.get(b, 0))
    return [(0,) * 6 + ("",) if x is None else (x[0], x[1], x[2], len(x[3]), sum(counts[p] == top[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), x[4]) for x in every]


def odd_texts(seed=2):
    rng = random.Random(seed)
    signs = list("abcdeinrst ABéüß½ﬁ…—“”漢字かな한국😀👩‍🚀0123456789.,;:!?'\"()<>\n\t\r\x00\x1c\x85\xa0 　") + ["the ", " of", "ing ", "'s ", "  ", "   ", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 120))) for _ in range(150)]
    return texts + [None, "", " ", "  a", "a ", "\n", "▁", "a▁b", "x" * 3000, "the internationalisation of words " * 40, texts[0], texts[0]]


@pytest.mark.parametrize("part,block,sent", [(alignment.PART, alignment.BLOCK, alignment.SENT), (8, 200, 30)])
def test_alignment_equals_a_version_by_bytes(spark, part, block, sent):
    texts = odd_texts()
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, links string, row int")
    got = alignment.alignment(docs, part=part, block=block, sent=sent)
    found = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got.collect()}
    want = dict(enumerate(expected(texts)))
    assert {k: (texts[k], found[k], v) for k, v in want.items() if found[k] != v} == {}
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] and found[151][6] == ""


def test_repeated_null_and_missing_rows(spark):
    rows = [(1, "some words"), (1, "some words"), (None, "some words"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, alignment.alignment(docs).collect()))
    assert len(got) == 4 and got[0] == got[1] and "doc_id=None, n_a=0" in "".join(got)
    assert alignment.alignment(docs.limit(0)).collect() == []


def test_words_of_the_given_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = dict(zip((i for i, _ in rows), expected([t for _, t in rows])))
    found = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.query(spark, data).collect()}
    assert found == want


def test_parts_are_cut_where_neither_tokenizer_merges(spark):
    of = alignment.pair(*alignment.vocabularies())
    for text in filter(None, odd_texts(5)):
        parts = alignment.parts_of(text, 5)
        assert " ".join(parts) == text
        whole, split = of.encode([text]), of.encode(parts)
        assert [x.values.to_pylist() for x in whole] == [x.values.to_pylist() for x in split]
