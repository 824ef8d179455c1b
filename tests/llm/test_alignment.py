"""Tokenizer alignment against a plain reading of whole texts."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cargolake.llm import alignment
from cargolake.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_of():
    """Byte-level characters, by encoding each byte's own character through the library's decoder."""
    table, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            table[chr(b)] = b
        else:
            table[chr(spare)] = b
            spare += 1
    return table


@pytest.fixture(scope="module")
def plain():
    a, b, table = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_of()
    a.encode_special_tokens = True

    def groups(text):
        if not text:
            return []
        enc = a.encode(" " + text, add_special_tokens=False)
        left = [(i, bytes(table[c] for c in t)) for i, t in zip(enc.ids, enc.tokens)]
        right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
                 for i, p in ((i, b.id_to_piece(i)) for i in b.encode(text))]
        want = (" " + text).encode()
        if b"".join(x for _, x in left) != want or b"".join(x for _, x in right) != want:
            return []
        cuts = []
        for side in (left, right):
            at, places = 0, []
            for _, x in side:
                at += len(x)
                places.append(at)
            cuts.append(places)
        common, found, i, j = sorted(set(cuts[0]) & set(cuts[1])), [], 0, 0
        for cut in common:
            one = ([], [])
            while i < len(left) and cuts[0][i] <= cut:
                one[0].append(left[i][0])
                i += 1
            while j < len(right) and cuts[1][j] <= cut:
                one[1].append(right[j][0])
                j += 1
            found.append(one)
        return found

    return groups


def expected(groups, rows):
    found = [groups(text) for _, text in rows]
    links = [[(x, y) for g in doc for x in g[0] for y in g[1]] for doc in found]
    held = Counter(p for doc in links for p in set(doc))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for (key, _), doc, pairs in zip(rows, found, links):
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in doc)
        out.append((key, sum(len(g[0]) for g in doc), sum(len(g[1]) for g in doc), len(doc), len(pairs),
                    sum(held[p] == top[p[0]] for p in pairs), sum(held[p] for p in pairs), sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=str)


ODD = [(1, None), (2, ""), (3, " "), (4, "  two  gaps  "), (4, "  two  gaps  "), (None, "no id"), (5, "a▁b is read as a space"),
       (6, "漢字 𝔘 ① ﬁ é é ​ x"), (7, "<|endoftext|> <s></s> <unk> <0x0A>"), (8, "tab\t \n line \n\n \r end\n"),
       (9, "x" * 3000 + "é" * 500), (10, "don't we'll 'tis I'M  x"), (11, "\x00\x1c \x1d a  b　 c"), (12, " lead and trail "),
       (13, "the cat the cat the"), (14, "\U0001f600\U0001f601 \U0001f600" * 20)]


def test_odd_texts(docs_of, plain):
    assert result(alignment.align(docs_of(ODD), A, B)) == expected(plain, ODD)


def test_random_texts_with_a_small_memo_and_head(docs_of, plain, monkeypatch):
    random.seed(4)
    alphabet = [*"abcdeè漢.,'!-09", *[" "] * 8, "\n", "\t", "  ", " ", "▁", "\U0001f600", "the ", " and", "\r\n"]
    rows = [(i, "".join(random.choice(alphabet) for _ in range(random.randint(0, 120)))) for i in range(400)]
    rows += [(i, "one text held by a third of all rows, " * 3) for i in range(200)]
    want = expected(plain, rows)
    monkeypatch.setattr(alignment, "MEMO", 50)
    assert result(alignment.align(docs_of(rows), A, B)) == want
    for head in (0, 40):  # pairs beyond the head come by the other way
        assert result(alignment.align(docs_of(rows), A, B, head=head)) == want


def test_rows_beyond_the_memo_are_given_up(monkeypatch):
    monkeypatch.setattr(alignment, "MEMO", 10)
    memo = alignment.Alignments(A, B)
    for turn in range(3):
        memo.learn([f" word{turn}x{i}" for i in range(30)] + [" " + "long" * 40])
        assert memo.kept == 10 and len(memo.names) == len(memo.rows) == len(memo.text) == len(memo.numbers) == (31 if turn == 0 else 41)
        assert memo.starts[-1] == len(memo.links) == memo.numbers[:, 3].sum()


def test_empty(docs_of):
    assert alignment.align(docs_of([]), A, B).count() == 0
    assert result(alignment.align(docs_of([(1, None)]), A, B)) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_query(spark, plain):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert result(QUERIES["op11_tokenizer_alignment"](spark, "/root/testdata/sf0.001")) == expected(plain, rows)
