"""Ranked search against scoring every document in plain Python, and SentencePiece against its library."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from specloom.llm import pieces, queries, ranked

SMALL = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _ranked(documents, items, best=20):
    """Every score of every document, by the contract's formula."""
    docs = [(d, Counter(_terms(t))) for d, t in documents]
    n = sum(bool(c) for _, c in docs)
    words = sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = Counter()
    for item, text in {(i, t) for i, t in items}:
        asked = Counter(_terms(text))
        scores = []
        for d, c in docs:
            m = 100 - 25 + 25 * c.total() * n // words if words else 0
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in asked.items() if c[t])
            if s > 0:
                scores.append((-s, d is not None, d or 0))
        out.update((item, r + 1, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(scores)[:best]))
    return out


def _table(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("tiers", [(256, 4096), (3, 40), (1,)])
def test_ranks_equal_plain_scores(spark, tiers):
    documents, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    documents = documents.select("doc_id", "text").repartition(3)
    got = Counter(_table(ranked.rank(documents, items, tiers=tiers)))
    assert got == _ranked(_table(documents), _table(items.select("item_id", "text")))


def test_queries_fall_through_only_without_proof(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 40))) + (" rareone raretwo rarethree" * rng.randint(1, 3) if i % 40 == 0 else "")) for i in range(2000)]
    docs += [(5000 + i, "w1 w2 w3 copied text") for i in range(700)]
    items = [(1, "rareone raretwo RARETHREE w7"), (2, "w1 w2 w3 w4 w5 copied"), (3, "nowhere"), (4, "w9 " * 30 + "w10"), (5, "")]
    every = []
    scored = ranked._scored
    monkeypatch.setattr(ranked, "_scored", lambda rows, index, block, everywhere, best: every.append((len(block.ids), list(everywhere))) or scored(rows, index, block, everywhere, best))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = Counter(_table(ranked.rank(df, spark.createDataFrame(items, "item_id long, text string"), tiers=(64, 512))))
    assert got == _ranked(docs, items)
    assert any(not e for _, e in every) and any(e for _, e in every)  # some proven, some from all vectors


def test_search_in_blocks_and_odd_rows(spark, odd_documents, no_documents):
    items = [(1, "quick brown FOX"), (1, "quick brown FOX"), (2, "w5 w6 é"), (None, "dog"), (3, None), (4, "...")]
    df = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, row int")
    want = _ranked(_table(odd_documents.select("doc_id", "text")), [(i, t) for i, t in items if t])
    for pairs in (1 << 18, 2):
        got = ranked.rank(odd_documents, df, pairs=pairs)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and Counter(_table(got)) == want
    assert ranked.rank(no_documents, df).count() == 0 and ranked.rank(odd_documents, df.filter("false")).count() == 0


def _encoded(text):
    own = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    ids = own.encode(text or "", add_bos=True, add_eos=True)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()


def test_pieces_equal_the_library(spark, odd_documents, no_documents):
    rng = random.Random(2)
    alphabet = ["a", "b", " ", " ", "  ", "▁", "the", "\n", "\t", "é", "字", "\U0001f600", "0", "</s>", "\x00", "Ａ", "ing", "."]
    odd = ["", " ", "   ", "▁", "▁▁ ", " a", "a ", "a  b", "<s> </s> <unk> <0x0A>", "x" * 5000, " 　"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(odd)] + [(9001, None), (None, "none"), (3, "repeated"), (3, "repeated")]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, block int, chunk string").repartition(3)
    got = Counter((r[0], *tuple(r)[1:]) for r in pieces.encode_digests(df, queries.PIECES).collect())
    assert got == Counter((d, *_encoded(t)) for d, t in rows)
    small = spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(odd_documents, allowMissingColumns=True)
    got = Counter((r[0], *tuple(r)[1:]) for r in pieces.encode_digests(small, queries.PIECES).collect())
    assert got == Counter((d, *_encoded(t)) for d, t in _table(small.select("doc_id", "text")))
    assert pieces.encode_digests(no_documents, queries.PIECES).count() == 0


def test_blocks_and_whole_texts(spark, monkeypatch):
    rows = [(i, f"some text number {i} and  more") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 100)
    assert {r[0]: tuple(r)[1:] for r in pieces.encode_digests(df, queries.PIECES).collect()} == {d: _encoded(t) for d, t in rows}
    monkeypatch.setattr(pieces, "can_split", lambda processor: False)  # as for a vocabulary whose pieces cross markers
    assert {r[0]: tuple(r)[1:] for r in pieces.encode_digests(df, queries.PIECES).collect()} == {d: _encoded(t) for d, t in rows}


def test_decoded_texts(spark):
    df = spark.createDataFrame([(1, "  two  blanks\n"), (2, None)], "doc_id long, text string")
    back = pieces.decode(pieces.encode(df, queries.PIECES), queries.PIECES)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {1: "  two  blanks\n", 2: ""}
    assert pieces.decode(back.select("doc_id", F.lit(None).cast("binary").alias("ids")), queries.PIECES).filter("text = ''").count() == 2
