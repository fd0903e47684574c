from __future__ import annotations

import hashlib
import itertools
import pickle
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from specloom.llm import bpe, common, embeddings, lengths, lmscore, packing, pii, quality, queries, sharding, simhash, toxicity
from tests.compare import database, difference

SMALL = "/root/testdata/sf0.001"


def texts(n: int = 200) -> list[str]:
    return [t or "" for t in pq.read_table(f"{SMALL}/documents.parquet")["text"].to_pylist()[:n]]


def strings(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("aab  \n.'tsé日\U0001f600019<|") for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def encoding():
    ranks = {t: i for i, t in enumerate(bpe.load_ranks(queries.RANKS))}
    return tiktoken.Encoding("own", pat_str=bpe.public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_exact_and_round_trips(encoding):
    tokens = bpe.load_ranks(queries.RANKS)
    encoder = bpe.Encoder(tokens, *bpe.split_tokens(tokens))
    for t in [*texts(), *strings(400, 1), "a" * 5_000, "ab" * 3_000, " " * 300]:
        ids = encoder.encode(t)
        assert ids == encoding.encode_ordinary(t)
        assert encoder.decode(ids) == t.encode()


def test_bpe_rows(odd_documents, no_documents):
    rows = bpe.encode_digests(odd_documents, queries.RANKS).collect()
    assert len(rows) == odd_documents.count()
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4)} == {0}
    assert next(r for r in rows if r["doc_id"] == 4)["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.encode_digests(no_documents, queries.RANKS).collect() == []
    back = bpe.decode_texts(bpe.encode_ids(odd_documents, queries.RANKS), queries.RANKS).collect()
    assert sorted(bytes(r["bytes"]) for r in back) == sorted((r["text"] or "").encode() for r in odd_documents.collect())


def test_sharding(odd_documents, no_documents, spark):
    tree = sharding.Tree.balanced(24)
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).unionByName(odd_documents.select("doc_id", "text"))
    rows = sharding.shard(docs, tree, tree.grown()).collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert sorted(by) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) < 1.25 * len(rows) / 24
    assert 0.5 / 25 < sum(r["grown_shard"] == 24 for r in rows) / len(rows) < 2 / 25
    changed = {r["doc_id"]: r["shard"] for r in sharding.shard(docs, tree.reweighted(5, 3.0)).collect()}
    assert all(changed[r["doc_id"]] in (r["shard"], *range(0, 8)) for r in rows if r["shard"] > 7 or changed[r["doc_id"]] != r["shard"])
    assert sharding.shard(no_documents, tree).collect() == []


def test_sharding_by_a_plain_descent(spark, odd_documents):
    """Every row of the query against a descent in Python; the draws' uniforms come from Spark's own hash."""
    tree = sharding.Tree.balanced(24)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(80).unionByName(odd_documents.select("doc_id", "text"))
    names = {(a,) for r in range(4) for a in [f"'region', {r}"]} | {(f"'rack', {r}, {c}",) for r in range(4) for c in range(2)} | {(f"'shard', {s}",) for s in range(25)}
    names = sorted(n[0] for n in names)
    rows = docs.selectExpr("doc_id", "text", *[f"xxhash64(doc_id, {n}) AS `{n}`" for n in names]).collect()

    def down(row, t):
        def first(children):
            draws = [(-np.log(((row[name] & (1 << 64) - 1) >> 11) + 0.5) + 53 * np.log(2)) / weight for name, weight, _ in children]
            return children[int(np.argmin(draws))][2]

        r = first([(f"'region', {i}", sum(w for rack in region for _, w in rack), i) for i, region in enumerate(t.regions)])
        c = first([(f"'rack', {r}, {i}", sum(w for _, w in rack), i) for i, rack in enumerate(t.regions[r])])
        return first([(f"'shard', {s}", w, s) for s, w in t.regions[r][c]])

    want = sorted(((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode()), "key", down(r, tree), down(r, tree.grown())) for r in rows), key=str)
    got = sharding.shard(docs.withColumn("shard", F.lit(1)).withColumn("slot", F.lit(1)), tree, tree.grown()).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got), key=str) == want
    for n in (24, 25, 30, 31, 40):
        assert sharding.Tree.balanced(n).grown() == sharding.Tree.balanced(n + 1) and sharding.Tree.balanced(n).shards == list(range(n))
    assert sharding.Tree.balanced(11).shards == list(range(11))


def test_lm_scores_by_brute_force(spark, encoding):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("doc_id < 60").unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "only here zxqj"), (7, "again 7")], "doc_id long, text string"), allowMissingColumns=True)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    rows = [(r["doc_id"], encoding.encode_ordinary(r["text"] or "")) for r in docs.collect()]

    def counted(x):
        pairs = list(zip([50_256, *x], x, strict=False))
        return [Counter(pairs), Counter(b for _, b in pairs), Counter(a for a, _ in pairs)]

    totals = [[Counter(), Counter(), Counter()], [Counter(), Counter(), Counter()]]
    for doc, x in rows:
        for m in (0, 1) if doc in good else (0,):
            for table, own in zip(totals[m], counted(x), strict=True):
                table.update(own)

    def loss(doc, x, m):
        own = counted(x) if m == 0 or doc in good else [Counter()] * 3
        others = sum(totals[m][1].values()) - sum(own[1].values())
        out = 0.0
        for a, b in zip([50_256, *x], x, strict=False):
            pair, single, context = (totals[m][k][key] - own[k][key] for k, key in enumerate(((a, b), b, a)))
            w = lmscore.WEIGHT if context > 0 else 0.0
            plain = single / others if others > 0 else 1 / 50_256
            out -= np.log2(w * pair / max(1, context) + (1 - w) * ((1 - lmscore.FLOOR) * plain + lmscore.FLOOR / 50_256))
        return out / len(x)

    want = sorted((doc, len(x), *((loss(doc, x, 1), loss(doc, x, 0)) if x else (0.0, 0.0))) for doc, x in rows)
    got = sorted((r["doc_id"], r["n_tokens"], r["target_loss"] or 0.0, r["background_loss"] or 0.0, r["score"]) for r in lmscore.score(docs.repartition(3), labels, queries.RANKS).collect())
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2:4] for r in got], [r[2:] for r in want], atol=1e-9) and np.allclose([r[4] for r in got], [r[3] - r[2] for r in want], atol=1e-9)


def test_lm_scores_tell_copies_apart(spark):
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(60))
    texts = [text() for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), *((100 + i, texts[i]) for i in range(10))], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in lmscore.score(docs, spark.createDataFrame([(i, 1) for i in range(20, 60)], "doc_id long, quality int"), queries.RANKS).collect()}
    copied = [scores[i] for i in (*range(10), *range(100, 110))]
    assert max(copied) < min(scores[i] for i in range(10, 20))


def test_lm_scores_of_odd_rows(odd_documents, no_documents, labels):
    assert lmscore.score(odd_documents, labels, queries.RANKS).count() == odd_documents.count()
    assert lmscore.score(no_documents, labels, queries.RANKS).count() == 0


def _components(n, links):
    root = list(range(n))
    for a, b in links:
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    out = []
    for i in range(n):
        while root[i] != i:
            i = root[i]
        out.append(i)
    return out


def test_embeddings_by_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v], int(i % 3)) for i, v in enumerate(rng.normal(size=(120, 16)))]
    for k in range(120, 260):
        a = np.array(rows[int(rng.integers(0, k))][1])
        rows.append((k, [float(x) for x in a + rng.normal(size=16) * rng.choice([0, 0.05, 0.2])], int(rng.integers(0, 2))))
    n = len(rows)
    x = np.array([r[1] for r in rows])
    x /= np.sqrt((x * x).sum(1))[:, None]
    links = [(i, j) for i, j in itertools.combinations(range(n), 2) if rows[i][2] == rows[j][2] and x[i] @ x[j] >= 0.98]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, rows[0][1], None), (None, rows[0][1], 0), (904, [], 1)]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    want = _components(n, links)
    for i in range(n):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (sum(i in l for l in links), want[i], want[i] == i)
    assert all((got[i]["n_links"], got[i]["component_id"]) == (0, i) for i in (900, 901, 902, 903, 904)) and not got[None]["kept"]
    tiled = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(df, tile_rows=3).collect()}
    assert all(tiled[i] == got[i]["n_links"] for i in range(n))
    assert embeddings.near_duplicates(df.filter("false")).collect() == []


def test_embeddings_of_odd_tables(spark):
    rows = [(1, [1.0, 0.0], 1, "x"), (1, [2.0, 0.0], 1, "y"), (2, [3.0, 0.0], 1, None), (3, [0.0, 1.0], 1, "z"), (4, [1.0], 1, "z"), (5, [1e-30, 1e-36], 1, ""), (6, [1e38, 0.0], 1, ""), (7, [1.0, 0.0], 2, "")]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, node string").withColumn("copies", F.lit(1)).withColumn("vec", F.lit("a"))
        got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect())
        assert got == [(1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 4, 1, False), (6, 4, 1, False), (7, 0, 7, True)]


def test_embeddings_prune_before_vectors_are_fetched(spark):
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    x, label = embeddings.rotated_units(np.array(table["embedding"].to_pylist())), table["label"].to_numpy()
    candidates = every = 0
    for k in np.unique(label):
        own = x[label == k]
        every += len(own) * (len(own) - 1) // 2
        for cut in embeddings.blocks_of(x.shape[1]):
            candidates += embeddings.near_members(np.ascontiguousarray(own[:, cut], "f4"), np.zeros(len(own)), False, embeddings.budget(cut, x.shape[1], 0.98) + embeddings.SINGLE)[1]
    assert 0 < candidates < 0.02 * every


def test_near_members_by_brute_force():
    rng = np.random.default_rng(6)
    x, chunk = rng.normal(size=(1_500, 3)).astype("f4"), rng.integers(0, 2, 1_500)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    for crossing in (False, True):
        near = np.triu((d <= 0.05) & ((chunk[:, None] != chunk[None]) | (not crossing)), 1)
        mask, pairs, _ = embeddings.near_members(x, chunk, crossing, 0.05)
        assert pairs == pytest.approx(near.sum(), abs=3) and (mask != (near.any(0) | near.any(1))).sum() <= 3


def test_larger_labels_compare_a_smaller_part_of_their_pairs():
    """One label of the test table's shape, made larger by noise of its own spread: pairs compared in two of the eight blocks, times four, of all pairs."""
    x = embeddings.rotated_units(np.array(pq.read_table("/root/testdata/sf0.1/embeddings.parquet")["embedding"].to_pylist()))
    rng, shares = np.random.default_rng(9), []
    for n in (20_000, 100_000):
        y = embeddings.rotated_units(x[rng.integers(0, len(x), n)] + rng.normal(size=(n, x.shape[1])) * x.std(0))
        compared = sum(embeddings.near_members(np.ascontiguousarray(y[:, cut], "f4"), np.zeros(n), False, embeddings.budget(cut, y.shape[1], 0.98) + embeddings.SINGLE)[2] for cut in embeddings.blocks_of(y.shape[1])[:2])
        shares.append(4 * compared / (n * (n - 1) / 2))
    assert shares[1] < shares[0] and shares[1] < 0.1, shares


def test_embeddings_in_grids_and_tiles(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 24))
    x = np.concatenate([base, base + 0.02 * rng.normal(size=base.shape), base + 0.2 * rng.normal(size=base.shape)])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    want = sorted(map(tuple, embeddings.near_duplicates(df).collect()))
    assert sum(r[1] for r in want) > 100
    for rows in (4, 30):  # twelve and six steps of the grid, with cells that are dealt out
        assert sorted(map(tuple, embeddings.near_duplicates(df, tile_rows=rows).collect())) == want


def test_join_by_class_broadcasts_hot_classes(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(30)], "k long, i long")
    classes = spark.createDataFrame([(0, 10, "a"), (1, 10, "b"), (2, 10, "c"), (3, 99, "d")], "k long, n long, v string")
    want = sorted(map(tuple, rows.join(classes, "k").collect()))
    for hot in (5, 9, 10, 50, 100):
        assert sorted(map(tuple, common.join_by_class(rows, classes, ["k"], "n", hot).collect())) == want


def test_packing(odd_documents, no_documents, spark):
    docs = odd_documents.unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").filter("doc_id > 10"), allowMissingColumns=True)
    rows = packing.pack(docs, queries.TOKENIZER).collect()
    whole = Tokenizer.from_file(queries.TOKENIZER)
    ids = [[*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.collect()]
    by, pieces_of = {}, {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces_of.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(by) == list(range(len(by))) and 2048 * len(by) < 1.05 * sum(map(len, ids)) + 2048
    # every piece has the checksum of its document's ids there, and the pieces of each id's documents cover all of them once
    wanted = {}
    for d, x in zip(docs.collect(), ids, strict=True):
        wanted.setdefault(d["doc_id"], []).append(x)
    assert sorted(pieces_of, key=str) == sorted(wanted, key=str)
    for doc, pieces in pieces_of.items():
        assert sum(length for _, length, _, _ in pieces) == sum(map(len, wanted[doc]))
        for start, length, crc, total in pieces:
            assert any(len(x) == total and zlib.crc32(np.array(x[start : start + length], "<u4").tobytes()) == crc and start + length <= total for x in wanted[doc])
        if len(wanted[doc]) == 1:
            ends = sorted((start, start + length) for start, length, _, _ in pieces)
            assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False)) and ends[-1][1] == len(wanted[doc][0])
    assert packing.pack(no_documents, queries.TOKENIZER).collect() == []


def test_packing_patterns_cover_demand():
    rng = np.random.default_rng(5)
    for demand in (rng.integers(0, 40, 64), np.zeros(64, int), np.eye(64, dtype=int)[63] * 7):
        found = packing.patterns(demand.astype(np.int64), 64)
        assert np.array_equal(sum((p * n for p, n in found), np.zeros(64, np.int64)), demand)
        assert all(p @ np.arange(1, 65) <= 64 for p, _ in found)
    a = rng.normal(size=(40, 40))
    assert np.allclose(packing.inverted(a) @ a, np.eye(40), atol=1e-8)


def test_token_counts(spark, odd_documents, no_documents, encoding):
    n = sorted(len(encoding.encode_ordinary(r["text"] or "")) for r in odd_documents.collect())
    sums = lengths.suffix_sums(lengths.histogram(odd_documents, queries.RANKS))
    for r in sums.collect():
        k = r["n_tokens"]
        assert (r["docs_from"], r["tokens_from"], r["truncated"]) == (sum(x >= k for x in n), sum(x for x in n if x >= k), sum(min(x, k) for x in n))
    for r in lengths.truncated_totals(sums, [0, 1, 7, 30, 10**6]).collect():
        assert r["tokens"] == sum(min(x, r["limit"]) for x in n)
    for r in lengths.quantiles(sums, [0.0, 0.1, 0.5, 0.99, 1.0]).collect():
        assert r["n_tokens"] == next(x for x in n if sum(y <= x for y in n) >= r["share"] * len(n))
    none = lengths.suffix_sums(lengths.histogram(no_documents, queries.RANKS))
    assert none.collect() == [] and [tuple(r) for r in lengths.truncated_totals(none, [5]).collect()] == [(5, 0)] and lengths.quantiles(none, [0.5]).first()["n_tokens"] is None


def test_token_counts_of_a_whole_table(spark, encoding):
    n = Counter(len(encoding.encode_ordinary(t)) for t in texts(10**9))
    sums = common.materialize(lengths.suffix_sums(lengths.histogram(spark.read.parquet(f"{SMALL}/documents.parquet"), queries.RANKS)), "sums")
    rows = sums.collect()
    assert {r["n_tokens"]: r["n_docs"] for r in rows} == n and all(r["quantile"] == pytest.approx(sum(m for k, m in n.items() if k <= r["n_tokens"]) / n.total()) for r in rows)
    for r in lengths.truncated_totals(sums, list(range(0, 3_000, 97))).collect():
        assert r["tokens"] == sum(min(k, r["limit"]) * m for k, m in n.items())


def test_quality(spark, odd_documents, no_documents):
    assert difference(queries.op7_quality(spark, SMALL), database(SMALL), queries.ORACLE_SQL["op7_quality"]) == ""
    measured = common.materialize(quality.measures(spark.read.parquet(f"{SMALL}/documents.parquet")), "m")
    few, many = (sorted((r["doc_id"], r["kept"]) for r in quality.judge(measured, host_limit=0.05, few_hosts=n).collect()) for n in (10**6, 0))
    assert few == many
    rows = {(r["doc_id"], r["n_words"]): r for r in quality.quality_verdicts(odd_documents).collect()}
    assert rows[5, 20_000]["n_repeat_words"] == 20_000 and rows[5, 20_000]["base_failed"] and rows[3, 0]["base_failed"]
    assert quality.keep_good(odd_documents).columns == odd_documents.columns
    assert quality.quality_verdicts(no_documents).collect() == [] and quality.keep_good(no_documents).collect() == []


def test_pii_base_spans_by_plain_patterns():
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rng = random.Random(8)
    made = ["".join(rng.choice(["a", "@", ".", "1", "25", "+", " ", "-", "(", ")", "b.c", "4111111111111111", "@x.y", "\n", "é"]) for _ in range(rng.randrange(30))) for _ in range(3_000)]
    for t in [*made, *texts(), "9" * 6_000, "1." * 3_000]:
        want = [(k, *m.span()) for k, p in plain.items() for m in re.finditer(p, t) if pii.valid(k, m[0])]
        assert pii.base_spans(t) == want


def test_pii_viterbi_and_pruning():
    rng = np.random.default_rng(8)
    moves, opening = rng.normal(size=(3, 3)), rng.normal(size=3)
    for n in (1, 2, 5):
        e = rng.normal(size=(1, n, 3))
        score = lambda path: opening[path[0]] + e[0, np.arange(n), path].sum() + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False))  # noqa: B023, E731
        assert tuple(pii.viterbi(e, np.array([n]), moves, opening)[0]) == max(itertools.product(range(3), repeat=n), key=lambda p: score(np.array(p)))
    field = pii.train()
    data = "\n".join(t for t, _ in pii.labelled_rows(1, 5)).encode()
    w = pii.words_of(data)
    pruned, e = field.decode(w), field.emissions(w)
    for s in range(w.sentence[-1] + 1):
        own = np.flatnonzero(w.sentence == s)
        assert np.array_equal(pii.viterbi(e[own][None], np.array([len(own)]), field.moves, field.opening)[0], pruned[own])


def test_pii_held_out_rows():
    field = pii.train()
    hit = found = real = 0
    for t, spans in pii.labelled_rows(3, 99):
        got = set(pii.added_spans([t], field)[0])  # the field by itself: base spans go before its own where they overlap
        want = {s for s in spans if s[0] != "card" or pii.valid("card", t[s[1] : s[2]])}
        hit, found, real = hit + len(got & want), found + len(got), real + len(want)
    assert hit / found > 0.9 and hit / real > 0.9


def test_pii_sentences_of_other_shapes():
    """Sentences written by hand, unlike the templates of the labelled table; [kind:...] marks what is to be found."""
    marked = [
        "If anything breaks over the weekend, text me at [phone:(212) 555-0198] and I'll call back.", "Customer support can be reached under [phone:+44 20 7946 0958] from nine to five.",
        "Our new fax is [phone:555-201-8834], the old one no longer works.", "Ich bin unter [phone:+49 (301) 555-7788] zu erreichen, meistens abends.",
        "Please forward the signed copy to [email:anna.meier@lab.example.org] before Friday.", "Questions? [email:help_desk@tools.example.com] answers within a day!",
        "The gateway answered from [ip:10.42.7.19] with a timeout, so we moved on.", "Blocked hosts so far: [ip:203.0.113.77] and [ip:198.51.100.4].",
        "She paid with [card:4539 1488 0343 6467] and left.", "Refund to the card ending in 6467, number [card:4539148803436467], was approved.",
        'export token = "[secret:sk_9fKq2LmZ81xPaWvT0bYcRu7DsGhE4n]"', "secret: '[secret:3f786850e387550fdab836ed7e6dc881de23001b]'",
        "The meeting on 2019-04-12 had 4500 visitors and cost $12,300.", "Version 3.11.2 fixes 17 bugs; see chapter 10.4 for details.",
        "In 1914 the population was 1200345, in 1950 it was 2400981.", "He said: call me maybe, then hung up the phone.", "commit 9fceb02 and commit 1a2b3c4d fix the token parser",
        "The key to success = hard work and patience.", "Row 12 | 34 | 56 | 78 sums to 180.", "Le total est de 12 500 euros pour 2021-2022.",
    ]
    field, hit, found, real = pii.train(), 0, 0, 0
    for m in marked:
        text, want = "", set()
        for part in re.split(r"(\[[a-z]+:[^\]]*\])", m):
            kind, _, value = part[1:-1].partition(":") if re.fullmatch(r"\[[a-z]+:[^\]]*\]", part) else ("", "", part)
            if kind:
                want.add((kind, len(text), len(text) + len(value)))
            text += value
        got = {(k, a, b) for k, a, b in pii.spans_of([text], field)[0][1]}
        hit, found, real = hit + len(got & want), found + len(got), real + len(want)
    print(f"precision {hit / found:.2f}, recall {hit / real:.2f}")
    assert hit / found > 0.7 and hit / real > 0.7


def test_pii_time_is_linear_in_spans():
    field, one = pii.train(), 'Ä call (212) 555-0198 or a.b@c.de now.\ntoken = "sk_9fKq2LmZ81xPaWvT0bYcRu7DsGhE4n"\n'
    few = pii.spans_of([one], field)[0][1]
    began = time.monotonic()
    base, every = pii.spans_of([one * 35_000], field)[0]
    assert time.monotonic() - began < 60 and len(base) == 35_000 and len(every) == 35_000 * len(few) >= 100_000
    assert sorted((k, a % len(one), b - a) for k, a, b in every[:: len(few)])[0][0] in pii.KINDS
    spans = [("x", a, a + n) for a in range(30) for n in (1, 3)]
    assert pii.overlapping(spans, [("y", 4, 9), ("y", 6, 7), ("z", 20, 21)]) == [any(s[1] < b and a < s[2] for a, b in ((4, 9), (6, 7), (20, 21))) for s in spans]


def test_pii_rows(odd_documents, no_documents, spark):
    rows = {r["doc_id"]: r for r in pii.find(odd_documents).collect()}
    assert (rows[6]["n_email"], rows[6]["n_phone"]) == (1, 1) and rows[3]["spans"] == "" and rows[4]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = pii.redact(odd_documents)
    assert clean.columns == odd_documents.columns
    assert next(r for r in clean.collect() if r["doc_id"] == 6)["text"] == "mail <EMAIL> or <PHONE> now"
    assert pii.find(no_documents).collect() == [] and pii.redact(no_documents).collect() == []
    assert len(pii.train(pii.labelled_table(spark)).weights) == len(pii.COLUMNS)


def test_pii_redacts_a_batch_in_slices(monkeypatch):
    """No more than ROWS rows are held at once, and all rows come out in their order."""
    field, given = pii.train(), [None if i % 50 == 7 else f"{t[:300]} write to ann{i}@example.org" for i, t in enumerate(texts(2 * pii.ROWS + 9))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(given))), pa.array(given, pa.string())], ["doc_id", "text"])
    sizes, plain = [], pii.spans_of
    monkeypatch.setattr(pii, "spans_of", lambda some, field: sizes.append(len(some)) or plain(some, field))
    out = pa.Table.from_batches(pii.redacted_batches(iter([batch, batch.slice(0, 0)]), 1, field))
    assert sum(sizes) == len(given) and max(sizes) <= pii.ROWS
    assert out["doc_id"].to_pylist() == list(range(len(given)))
    assert out["text"].to_pylist() == [t if t is None else pii.redacted(t, plain([t], field)[0][1]) for t in given]


def test_toxicity_search_is_exact():
    rng = np.random.default_rng(9)
    often = np.array([*range(40)] * 12 + [*range(40, 2_000)])
    examples = []
    for i in range(900):
        at = np.unique(rng.choice(often, 30))
        examples.append((i, int(rng.random() < 0.3), at.astype(np.int32), rng.integers(1, 4, len(at)).astype(np.int32)))
    examples += [(900, 0, np.zeros(0, np.int32), np.zeros(0, np.int32)), (901, 1, *examples[5][2:])]
    index = pickle.loads(pickle.dumps(toxicity.Index(np.arange(2_000, dtype=np.uint64), rng.random(2_000) + 0.1, examples)))
    index.open()
    assert sorted(index.ids.tolist()) == list(range(902)) and index.dense.shape[1] < len(index.terms)
    dense = np.zeros((len(index.ids), 2_000))
    for r in range(len(index.ids)):
        at, w = index.unit(r)
        dense[r, at] = w
    queries = [index.unit(r) for r in range(200)]
    for skip in ([None] * 200, list(range(200))):
        for r, (rows, found) in enumerate(index.search(queries, 15, skip)):
            cos = dense @ dense[r]
            if skip[r] is not None:
                cos[r] = 0
            want = np.lexsort((index.ids, -cos.round(12)))[:15]
            want = want[cos[want] > 0]
            assert np.array_equal(rows, want) and np.allclose(found, cos[want])


def test_toxicity_skips_blocks_of_other_words():
    rng = np.random.default_rng(3)
    examples = [(i, 0, np.unique(rng.integers(i % 4 * 200, i % 4 * 200 + 200, 20)).astype(np.int32)) for i in range(2_048)]
    index = toxicity.Index(np.arange(800, dtype=np.uint64), np.ones(800), [(*e, np.ones(len(e[2]), np.int32)) for e in examples])
    index.open()
    scored = np.isfinite(index._rough([index.unit(r) for r in range(0, 2_048, 64)], 15, [None] * 32)[0]).mean()
    assert scored < 0.3


def test_toxicity_index_is_made_with_little_beside_it():
    """A task opens the broadcast index beside another one: what is held for a while does not grow with the postings."""
    rng, n_terms = np.random.default_rng(3), 20_000
    examples = [(i, i % 2, np.flatnonzero(rng.random(n_terms) < 0.05).astype(np.int32), None) for i in range(3_000)]
    examples = [(i, y, at, rng.integers(1, 9, len(at)).astype(np.uint16)) for i, y, at, _ in examples]
    whole = toxicity.Index(np.arange(n_terms, dtype=np.uint64), np.ones(n_terms), examples)
    raw = pickle.dumps(whole)
    assert len(whole.term) > 10 * toxicity.PART
    tracemalloc.start()
    try:
        index = pickle.loads(raw)
        kept, most = tracemalloc.get_traced_memory()
        assert most - kept < 2 * len(raw)
        tracemalloc.reset_peak()
        index.open()
        kept, most = tracemalloc.get_traced_memory()
        assert most - kept < 8 * len(whole.term)  # a whole count of the terms takes a copy of eight bytes each
    finally:
        tracemalloc.stop()
    assert (index.term == whole.term).all() and (index.n == whole.n).all() and (index.starts == whole.starts).all()
    assert (index._holders() == np.bincount(whole.term, minlength=n_terms)).all()
    whole.open()
    for name in ("row", "weight", "dense", "most", "first"):
        assert (getattr(index, name) == getattr(whole, name)).all(), name


def test_toxicity_index_in_parts_of_one_posting(monkeypatch):
    """Parts smaller than an example, and examples without words, give the index of one part."""
    rng = np.random.default_rng(4)
    ends = [(i, i % 2, np.sort(rng.choice(700, i % 7, False)).astype(np.int32), rng.integers(1, 9, i % 7).astype(np.uint16)) for i in range(200)]
    made = []
    for part in (toxicity.PART, 5, 1):
        monkeypatch.setattr(toxicity, "PART", part)
        index = pickle.loads(pickle.dumps(toxicity.Index(np.arange(700, dtype=np.uint64), np.ones(700), ends)))
        index.open()
        made.append(index)
    for other in made[1:]:
        for name in ("ids", "labels", "term", "n", "lengths", "row", "weight", "dense", "most", "first"):
            assert (getattr(made[0], name) == getattr(other, name)).all(), name


def test_toxicity_words_are_those_of_the_pattern(monkeypatch):
    """Words are cut without the pattern where a text allows it, and are its matches in every text."""
    rng, kinds = random.Random(5), ["a", "Z", "7", "_", " ", "\n", "\x00", "\x1c", "'", "é", "İ", "ß", "Σ", "’", "–", "\u00a0", "\u0301", "界", "٣", "½", "😀", "\u2028"]
    texts = [None, "", "_", "é_", "_ a_b", "it’s It's", "ΑΣ ΑΣ’", *("".join(rng.choices(kinds, k=rng.randrange(1, 60))) for _ in range(3_000))]
    texts += ["a" + chr(i) + "b" + chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for text in texts:
        want = Counter(w.encode() for w in re.findall(r"\w+", (text or "").lower()))
        assert toxicity.words_of(text) == want and toxicity.distinct_words(text) == want.keys(), text
    asked = []
    monkeypatch.setattr(toxicity, "WORD", type("Asked", (), {"findall": lambda self, text: asked.append(text) or re.findall(r"\w+", text)})())
    found = toxicity.words_of("Plain, plain text_1. Größe der Straße: it’s")
    assert found == Counter({w.encode(): 1 for w in ("text_1", "größe", "der", "straße", "it", "s")}) + Counter({b"plain": 2})
    assert asked == ["it’s"]


def test_toxicity_looks_up_a_group_at_once(monkeypatch):
    """One ascending lookup for the words of many texts; exact cosines weigh only the terms that both texts hold."""
    rng = np.random.default_rng(6)
    examples = [(i, i % 2, np.sort(rng.choice(4_000, 400, False)).astype(np.int32), np.ones(400, np.uint16)) for i in range(300)]
    index = toxicity.Index(np.arange(0, 40_000, 10, dtype=np.uint64), np.ones(4_000), examples)
    index.open()
    texts = [(np.sort(rng.choice(40_000, n, False)).astype(np.uint64), rng.integers(1, 9, n)) for n in (0, 50, 500, 1)]
    asked, weighed, find, damped = [], [], toxicity.Index.find, toxicity.damped
    monkeypatch.setattr(toxicity.Index, "find", lambda self, h: asked.append(h) or find(self, h))
    found = list(index.raw(texts))
    assert len(asked) == 1 and (np.diff(asked[0].astype(np.int64)) >= 0).all()
    for (h, n), (at, weight, other, times) in zip(texts, found, strict=True):
        known = h % 10 == 0
        assert (at == h[known] // 10).all() and (weight == damped(n[known])).all() and (other == h[~known]).all() and (times == n[~known]).all()
    assert list(index.raw([])) == []
    monkeypatch.setattr(toxicity, "damped", lambda n: weighed.append(len(n)) or damped(n))
    rows, cosines = index.search([(found[2][0], found[2][1] / np.linalg.norm(found[2][1]))], 15)[0]
    assert len(rows) == 15 and (np.diff(cosines) <= 0).all() and sum(weighed) < 15 * 400 / 4


def test_toxicity_rows(spark, odd_documents, no_documents, labels):
    rows = toxicity.toxicity(odd_documents, labels).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.toxicity(no_documents, labels.filter("false")).collect() == []
    assert toxicity.keep_clean(odd_documents, labels.filter("false")).columns == odd_documents.columns
    assert toxicity.keep_clean(odd_documents.withColumn("_own", F.lit(1)).withColumn("_task", F.lit(2)), labels.filter("false")).count() == odd_documents.count()
    d = "/root/testdata/sf0.1"
    docs, marks = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = toxicity.toxicity(docs, marks).filter("held_out").join(marks.filter("toxic IS NOT NULL"), "doc_id").collect()
    right, found, real = sum(r["predicted"] * r["toxic"] for r in held), sum(r["predicted"] for r in held), sum(r["toxic"] for r in held)
    assert right > 0.8 * real and right > 0.95 * found
    assert np.mean([(r["score"] - r["toxic"]) ** 2 for r in held]) < 0.02  # 0.1 by the base rate


def test_toxicity_whole_scores_by_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 9)
    texts = {i: " ".join([word() for _ in range(rng.randrange(0, 40))] + (["vile"] if i % 7 == 0 else []) + [f"Only{i}"] * (i % 3)) for i in range(300)}
    texts[300], texts[301] = None, texts[7]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    marks = [(i, int(i % 7 == 0)) for i in range(0, 300, 2)]
    learnt = {i: y for i, y in marks if zlib.crc32(str(i).encode()) % 5}
    words = {i: Counter(re.findall(r"\w+", (t or "").lower())) for i, t in texts.items()}
    df = Counter(w for c in words.values() for w in c)
    toxic, clean = (Counter(w for i, y in learnt.items() if y == mark for w in words[i]) for mark in (1, 0))

    def vector(i):
        v = {w: (1 + np.log(n)) * (np.log((1 + len(texts)) / (1 + df[w])) + 1) * np.log2(2 + toxic[w] / max(1, clean[w])) for w, n in words[i].items()}
        return {w: x / np.sqrt(sum(y * y for y in v.values())) for w, x in v.items()}

    vectors, base = {i: vector(i) for i in texts}, (sum(learnt.values()) + 0.5) / (len(learnt) + 1)

    def vote(i, others):
        cosines = {j: sum(x * vectors[j].get(w, 0) for w, x in vectors[i].items()) for j in others}
        near = sorted((j for j in cosines if cosines[j] > 0), key=lambda j: (-round(cosines[j], 12), j))[: toxicity.NEIGHBOURS]
        w = [cosines[j] ** 2 for j in near]
        return (sum(x * learnt[j] for x, j in zip(w, near, strict=True)) + toxicity.PRIOR * base) / (sum(w) + toxicity.PRIOR), near

    slope, shift = toxicity.curve(np.array([vote(i, learnt.keys() - {i})[0] for i in learnt]), np.array(list(learnt.values()), float))
    for r in toxicity.toxicity(docs, spark.createDataFrame(marks, "doc_id long, toxic int")).collect():
        v, near = vote(r["doc_id"], learnt)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(slope * np.log(v / (1 - v)) + shift))), rel=1e-6)
        assert r["evidence"] == near and r["predicted"] == int(r["score"] >= 0.5)


def test_toxicity_sample_is_bounded_by_words(spark):
    docs = spark.createDataFrame([(i, f"a{i} b{i} c{i}") for i in range(40)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert 3 <= len(toxicity.fit(docs, marks).ids) and len(toxicity.fit(docs, marks, max_words=10).ids) == 3 and len(toxicity.fit(docs, marks, max_examples=2).ids) == 2


def test_toxicity_of_one_word_in_a_long_text(spark):
    long = " ".join(f"plain{i}" for i in range(3_000)) + " vile"
    rows = [(i, "vile") for i in range(1, 40)] + [(i, f"calm words number{i}") for i in range(40, 80)] + [(100, long), (101, "vile"), (102, "nothing known")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i < 40)) for i in range(1, 70)], "doc_id long, toxic int")
    base = toxicity.base_rate(toxicity.fit(docs, marks))
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, marks).collect()}
    assert got[101]["score"] > 0.9 and len(got[100]["evidence"]) == toxicity.NEIGHBOURS
    assert abs(got[100]["score"] - got[102]["score"]) < 0.05 and abs(base - 0.5) < 0.2


def test_nothing_is_dropped_when_nothing_can_be_learnt(spark, odd_documents):
    held = next(i for i in range(1, 100) if zlib.crc32(str(i).encode()) % 5 == 0)
    for rows in ([], [(1, None), (2, None)], [(held, 1)], [(99_999, 1)]):
        kept = toxicity.keep_clean(odd_documents, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert sorted(map(repr, kept.collect())) == sorted(map(repr, odd_documents.collect()))


def test_simhash_by_brute_force(spark, odd_documents, no_documents):
    def slow(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [simhash.xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    near = docs.filter("doc_id % 5 = 0").select((F.col("doc_id") + 10_000).alias("doc_id"), F.concat("text", F.lit(" x")).alias("text"))
    rows = sorted(docs.unionByName(near).unionByName(odd_documents.filter("doc_id IS NOT NULL AND doc_id > 2").select((F.col("doc_id") + 20_000).alias("doc_id"), "text")).collect())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fps = [slow(r["text"]) for r in rows]
    roots = _components(len(rows), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3])
    got = {r["doc_id"]: r for r in simhash.simhash_components(df).collect()}
    for r, fp, root in zip(rows, fps, roots, strict=True):
        assert (got[r["doc_id"]]["fingerprint"], got[r["doc_id"]]["component_id"]) == (f"{fp:016x}", rows[root]["doc_id"])
    distinct = simhash.fingerprints(df).select("fp").distinct()
    for hot in (2, 10**6):
        links = simhash.fingerprint_links(distinct, hot=hot)
        assert common.connected_components(links, "a", "b").count() == common.connected_components(simhash.fingerprint_links(distinct), "a", "b").count()
    kept = simhash.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [1, 3, 5, 6, 7]
    assert simhash.simhash_components(no_documents).collect() == []


def test_simhash_keeps_one_of_each_component_when_ids_repeat(spark):
    a, b, c = "one two three four five", "red green blue black white", "north south east west middle"
    for rows, want in (([(5, None), (5, a)], [(5, None), (5, a)]), ([(5, a), (5, b), (3, b)], [(3, b), (5, a)]), ([(5, b), (5, a), (3, b), (None, c), (None, c)], [(3, b), (5, a), (None, c)]), ([(5, a), (5, a)], [(5, a)])):
        kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, want))


def test_simhash_keeps_the_same_of_equal_texts(spark):
    rows = [(5, "one two three", "b", 2), (5, "one two three", "a", 9), (5, "one two three", None, 1), (5, "one two three", "a", 10)]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        kept = simhash.keep_one(spark.createDataFrame(order, "doc_id long, text string, source string, n long").repartition(3)).collect()
        assert [tuple(r) for r in kept] == [(5, "one two three", "a", 10)]


def test_simhash_deals_out_a_large_close_family(spark):
    spread = [0, 5, 11, 16, 22, 27, 33, 38, 44, 49, 55, 60]
    fps = [sum((i >> k & 1) << b for k, b in enumerate(spread)) for i in range(0, 4096, 2)]
    lone = [sum(1 << b for b in range(k, 64, 7)) for k in range(1, 5)]
    distinct = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps + lone], "fp long")
    hot = 100
    rows = simhash.dealt(distinct, simhash.plan(distinct), hot)
    assert rows.groupBy(*simhash.KEYS).count().agg(F.max("count")).first()[0] <= 3 * hot
    links = simhash.fingerprint_links(distinct, hot=hot).collect()
    at = {f - (f >> 63 << 64): i for i, f in enumerate(fps + lone)}
    roots = _components(len(at), {(at[r["a"]], at[r["b"]]) for r in links})
    everything = fps + lone
    want = _components(len(at), [(i, j) for i, j in itertools.combinations(range(len(at)), 2) if (everything[i] ^ everything[j]).bit_count() <= simhash.LIMIT])
    assert roots == want


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(1_000, 1_000 + i) for i in range(1, 50)] + [(None, 3), (5, 5)], "a long, b long")
    roots = {r["node"]: r["root"] for r in common.connected_components(edges, "a", "b").collect()}
    assert all(roots[i] == 0 for i in range(61)) and all(roots[1_000 + i] == 1_000 for i in range(50))
