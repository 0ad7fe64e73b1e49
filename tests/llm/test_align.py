import hashlib
import os
import random
import time
from collections import Counter

os.environ["TOKENIZERS_PARALLELISM"] = "false"

import numpy as np
import pytest
import sentencepiece
from helpers import AWKWARD, docs, rows
from tokenizers import Tokenizer

from molmill.llm.align import SPACE, TOKENIZER_A, TOKENIZER_B, Aligner, Pieces, _squeezed, _unsqueezed, aligned_tokens, alignment_digest, read_byte_vocabulary, shared_cuts
from molmill.llm.tokens import _pattern, encode_whole

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    (50, "<|endoftext|> <s>x</s> <unk> <0x41>"), (51, "a▁b"), (52, "▁"), (53, "é́ \U0001f600\U0001f600 ｆｕｌｌ ﬁ"), (54, " lead and trail "), (55, "   "), (56, "\t\n\x00 z\r\n\r\n"), (57, " "),
    (58, "x" * 3000), (59, "日本語 のテキスト"), (60, "it's we'll I'D 12345 3.14"), (61, "same text here"), (62, "same text here"), (63, " " * 5000 + "y" + "\n" * 3000), (64, "　 \x85 a"), (65, "á" * 500),
]


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(TOKENIZER_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=TOKENIZER_B)


@pytest.fixture(scope="module")
def aligner():
    with open(TOKENIZER_B, "rb") as f:
        return Aligner(read_byte_vocabulary(TOKENIZER_A), _pattern(), f.read())


def plain(models, given):
    """As the contract says it: the libraries' own whole encodings, offsets token by token."""
    a_model, b_model = models
    own = [b for b in range(256) if chr(b).isprintable() and chr(b) != " " and b != 173]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    per_doc, counts = [], Counter()
    for i, text in given:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        a_bytes = [bytes(byte[c] for c in a_model.id_to_token(x)) for x in a]
        b_bytes = [bytes([int(b_model.id_to_piece(x)[3:5], 16)]) if b_model.is_byte(x) else b_model.id_to_piece(x).replace(SPACE, " ").encode() for x in b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            per_doc.append((i, [], [], [], [], []))
            continue
        spans = []
        for side in (a_bytes, b_bytes):
            at, out = 0, []
            for t in side:
                out.append((at, at + len(t)))
                at += len(t)
            spans.append(out)
        links, j = [], 0
        for k, (s, e) in enumerate(spans[0]):
            while spans[1][j][1] <= s:
                j += 1
            m = j
            while m < len(b) and spans[1][m][0] < e:
                links.append((a[k], b[m]))
                m += 1
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, x, y = [], 0, 0
        for c in cuts:
            one, other = [], []
            while x < len(a) and spans[0][x][1] <= c:
                one.append(a[x])
                x += 1
            while y < len(b) and spans[1][y][1] <= c:
                other.append(b[y])
                y += 1
            groups.append((one, other))
        counts.update(links)
        per_doc.append((i, a, b, groups, links, None))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for i, a, b, groups, links, _ in per_doc:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=repr)


def test_digest_over_awkward_texts(spark, models):
    given = AWKWARD + ODD
    frame = docs(spark, given).selectExpr("*", "1 as pack", "2 as pair", "3 as n_a")
    assert rows(alignment_digest(frame.repartition(3)), *COLUMNS) == plain(models, given)
    assert alignment_digest(docs(spark, [])).count() == 0
    assert rows(alignment_digest(docs(spark, [(1, None), (2, "")])), *COLUMNS) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_digest_over_whole_documents(spark, models, monkeypatch):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain(models, [(r.doc_id, r.text) for r in frame.collect()])
    assert rows(alignment_digest(frame), *COLUMNS) == want
    monkeypatch.setattr("molmill.llm.align.PACK", 20_000)
    monkeypatch.setattr("molmill.llm.align.BATCH", 3_000)
    assert rows(alignment_digest(frame.repartition(3)), *COLUMNS) == want


def test_aligned_tokens(spark, models):
    got = {r.doc_id: r for r in aligned_tokens(docs(spark, AWKWARD + ODD)).collect()}
    for i, text in AWKWARD + ODD:
        if i in (None, 7):
            continue
        r = got[i]
        if r.a_ids:
            assert r.a_ids == models[0].encode(" " + text, add_special_tokens=False).ids and r.b_ids == models[1].encode(text)
            assert len(r.a_cuts) == len(r.b_cuts) and (r.a_cuts[-1], r.b_cuts[-1]) == (len(r.a_ids), len(r.b_ids))
        else:
            assert not text or SPACE in text


def test_cuts_of_any_ends():
    rng = random.Random(3)
    for _ in range(300):
        texts = [rng.randint(1, 60) for _ in range(rng.randint(1, 4))]
        a, b, first, last, at = [], [], [], [], 0
        for n in texts:
            first.append(len(a))
            a += sorted({*(at + x for x in rng.sample(range(1, n + 1), rng.randint(1, n))), at + n})
            b += sorted({*(at + x for x in rng.sample(range(1, n + 1), rng.randint(1, n))), at + n})
            last.append(len(a))
            at += n
        cuts = shared_cuts(*(np.array(x) for x in (a, b, first, last)))
        assert [a[i] for i in cuts] == sorted(set(a) & set(b))


def test_long_texts_without_shared_ends_take_little_time(aligner):
    n = 1_000_000
    a = np.concatenate([np.arange(2, 2 * n, 2), [2 * n + 1]])
    b = np.concatenate([np.arange(3, 2 * n, 2), [2 * n + 1]])
    began = time.perf_counter()
    assert shared_cuts(a, b, np.array([0]), np.array([len(a)])).tolist() == [len(a) - 1]
    assert time.perf_counter() - began < 20
    text = "word and " * 500_000 + "\n" * 300_000 + "z" * 300_000 + "\U0001f600" * 100_000
    began = time.perf_counter()
    got = aligner.align(aligner.encode([text]))
    assert got.n_a[0] and len(got.written()[0]) and len(got.links()[0]) == got.n_links[0]
    assert time.perf_counter() - began < 60


def test_words_apart_are_pieces_of_the_whole(models):
    rng = random.Random(4)
    pool = [chr(c) for c in [*range(32, 600), 0, 9, 10, 13, 0x1F600, 0x4E00, 0x3000]] + [" ", "  ", "ab", "the", " of", "▁"] * 40
    with open(TOKENIZER_B, "rb") as f:
        pieces = Pieces(f.read(), known=50)
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))).replace(SPACE, "") for _ in range(4000)]
    for i in range(0, len(texts), 100):
        assert pieces.encode(texts[i : i + 100]) == models[1].encode(texts[i : i + 100])


def test_first_tokenizer_is_the_files(models, aligner):
    rng = random.Random(5)
    pool = [chr(c) for c in [*range(0, 600), 0x1680, 0x180E, 0x2000, 0x2028, 0x202F, 0x3000, 0x200B, 0xFEFF, 0x660, 0x2160, 0x1F600]] + ["'s", "'LL", "<|endoftext|>", " ", "\n", "1"] * 40
    for _ in range(4000):
        text = " " + "".join(rng.choice(pool) for _ in range(rng.randint(1, 30)))
        assert encode_whole(aligner.a, text, 3) == models[0].encode(text, add_special_tokens=False).ids


def test_squeezed_numbers_come_back():
    for x in (np.array([], dtype=np.int64), np.arange(10), np.array([0, 2**32 - 1, 70000])):
        assert _unsqueezed(_squeezed(x)).tolist() == x.tolist()
