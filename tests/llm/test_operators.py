"""Operators against brute force, and their defined cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import collections
import hashlib
import random
from collections import Counter
import re
import zlib

import numpy as np
import pytest

from docloom.llm import encoder, extraction, minhash, mixing, pieces, quality, separators, sharding, suffixes, tokenfiles, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = "key long, id long, rep long, size long, tie long, spans string, row string, sig string, copy int, pid int"


def corpus():
    rnd = random.Random(5)
    vocabulary = ["w%d" % i for i in range(300)] + ["Été", "ÄÖ", "x"]
    make = lambda n: " ".join(rnd.choice(vocabulary) + rnd.choice(["", ".", "\n"]) for _ in range(n))
    texts = [make(rnd.randint(1, 90)) for _ in range(40)]
    passage = make(70)
    for i in range(12):
        words = texts[i].split(" ")
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [make(20) + passage + make(20) for _ in range(5)] + [texts[0]] * 4 + ["", None, "   \n\t", "one two", "ONE two", "q" * 1500, make(6000)]
    rows = [(i, t, f"s{i % 4}" if i % 9 else None) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, texts[1], "s1"), (None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, s, 1, 2, 3, 4, 5, "a", "b", "c", 6, 7) for i, t, s in corpus()]
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {CLASHING}").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], f"doc_id long, text string, source string, {CLASHING}")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(docs, width):
    rows = corpus()
    sets = []
    for _, text, _ in rows:
        w = WORD.findall(lowered(text or ""))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    top = {i: i for i, _, _ in rows if i is not None}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for (i, _, _), a in zip(rows, sets, strict=True):
        for (j, _, _), b in zip(rows, sets, strict=True):
            if None not in (i, j) and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    got = minhash.near_duplicates(docs, width).collect()
    assert len(got) == len(rows)
    size = {i: len(s) for (i, _, _), s in zip(rows, sets, strict=True)}
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (size[r.doc_id], find(r.doc_id), find(r.doc_id) == r.doc_id)


def test_near_duplicates_in_chunks(spark, monkeypatch):
    """A bucket larger than a chunk, whose members are linked through others only."""
    monkeypatch.setattr(minhash, "CHUNK", 8)
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[k * 4 : k * 4 + 120])) for k in range(60)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert {r.component_id for r in got} == {0}


def test_estimate_and_select():
    rnd = np.random.default_rng(1)
    a = np.unique(rnd.integers(0, 1 << 63, 3000, dtype=np.uint64))
    b = np.concatenate([a[:2700], np.unique(rnd.integers(0, 1 << 63, 300, dtype=np.uint64))])
    _, packed = minhash.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    assert abs(float(minhash.estimated(packed[0], packed[1:])[0]) - 2700 / 3300) < 0.16


def test_suffix_dedup(docs):
    rows, length = corpus(), 200
    seen = collections.Counter()
    for _, t, _ in rows:
        b = (t or "").encode()
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    want = collections.defaultdict(list)
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(b) else 0
        want[i].append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()).hexdigest()))
    got = collections.defaultdict(list)
    for r in suffixes.deduplicate(docs).collect():
        got[r.doc_id].append(tuple(r)[1:])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_hot_anchors_and_texts_kept(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 3)
    rnd = random.Random(8)
    line = "".join(rnd.choice("abcdefghij é") for _ in range(400))
    rows = [(i, "".join(rnd.choice("klmno ") for _ in range(rnd.randint(0, 300))) + line[rnd.randint(0, 9) : 380 - rnd.randint(0, 9)] + "".join(rnd.choice("klmno") for _ in range(rnd.randint(0, 300)))) for i in range(60)]
    rows += [(99, line), (100, line), (101, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    seen = collections.Counter()
    for _, t in rows:
        b = t.encode()
        seen.update(b[k : k + 200] for k in range(len(b) - 199))
    for r in suffixes.deduplicate(df).collect():
        b = dict(rows)[r.doc_id].encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        assert r.n_removed == gone.sum()
    kept = {r.doc_id: r.text for r in suffixes.without_repeats(df).collect()}
    assert 99 not in kept and 100 not in kept and kept[101] == "" and len(kept) == 61
    assert all(line[20:360] not in t for t in kept.values())


def test_suffix_family_merges():
    rnd = np.random.default_rng(2)
    family, seen, want = suffixes.SuffixFamily(8), collections.defaultdict(list), set()
    for step in range(40):
        data = rnd.integers(0, 3, 60).astype(np.uint8)
        starts = np.arange(53)
        family.add(data, starts, starts + 1000 * step)
        for s in starts:
            seen[data[s : s + 8].tobytes()].append(int(s) + 1000 * step)
    for own in seen.values():
        if len(own) > 1:
            want.update(own)
    assert set(family.matched().tolist()) == want
    assert sum(x is not None for x in family.levels) <= 12


def test_quality_counts_and_field(spark, docs, empty):
    field = quality.Field(np.stack([np.eye(len(quality.FEATURES))[0], np.zeros(len(quality.FEATURES))]), np.zeros((2, 2)), np.zeros(2))
    rows = {i: t for i, t, _ in corpus()}
    for r in quality.rate(docs, field).collect():
        if r.doc_id is None:
            continue
        text = rows[r.doc_id] or ""
        w = WORD.findall(text)
        grams = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        repeated = {j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
        assert tuple(r)[1:6] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == failed and r.kept == (not failed)
    assert quality.rate(empty, field).count() == 0
    assert quality.keep_good(docs, field).columns == docs.columns


def test_viterbi_against_all_paths():
    rnd = np.random.default_rng(3)
    width = len(quality.FEATURES)
    field = quality.Field(rnd.normal(size=(2, width)), rnd.normal(size=(2, 2)), rnd.normal(size=2))
    sizes = [0, 1, 5, 3, 0, 7]
    features = rnd.normal(size=(sum(sizes), width))
    of = np.concatenate([[0], np.cumsum(sizes)])
    states = field.decoded(features, of)
    for a, b in zip(of[:-1], of[1:], strict=True):
        best = max(range(1 << (b - a)), key=lambda path: _score(field, features[a:b], [path >> k & 1 for k in range(b - a)]), default=0)
        assert [best >> k & 1 for k in range(b - a)] == states[a:b].tolist()


def _score(field, x, path):
    if not path:
        return 0
    return field.first[path[0]] + sum(float(x[k] @ field.emit[s]) for k, s in enumerate(path)) + sum(field.move[a, b] for a, b in zip(path, path[1:], strict=False))


def _lines(states, rnd):
    """Features and words of lines, boilerplate ones full of symbols."""
    width = len(quality.FEATURES)
    f = np.concatenate([np.ones((len(states), 1)), 0.8 * np.array(states)[:, None], rnd.random((len(states), width - 2)) * 0.1], 1)
    return f, np.full(len(states), 10)


def test_field_learns_lines_from_labels_of_documents():
    """Good documents hold some boilerplate, bad ones some content; no line is labelled, yet each is told."""
    rnd = np.random.default_rng(4)
    made = []
    for k in range(80):
        bad = k % 4 == 0
        states = (rnd.random(int(rnd.integers(4, 90))) < (0.75 if bad else 0.15)).astype(int)
        if len(states) and (states.mean() > 0.5) == bad:
            made.append((*_lines(states, rnd), int(bad)))
    field = quality.fitted(made)
    states = [0, 0, 1, 0, 1, 1, 0, 0, 0]
    assert field.decoded(_lines(states, rnd)[0], np.array([0, 9])).tolist() == states
    for label, share in ((0, [1] * 6), (1, [0] * 6)):  # a label that contradicts all lines turns the least that it must
        f, words = _lines(share, rnd)
        got = quality.agreeing(field, f, np.array([0, 6]), words, np.array([label]))
        assert ((got == 0).mean() >= 0.5) == (label == 0)


def test_documents_of_mixed_lines(spark):
    """After training on labels of documents, junk lines within good documents are marked, and good lines within bad ones."""
    rnd = random.Random(9)
    good = lambda: " ".join(rnd.choice(["this", "story", "goes", "on", "with", "words"]) + str(rnd.randint(0, 99)) for _ in range(12)) + "."
    junk = lambda: " ".join(rnd.choice(["win", "buy", "now"]) + rnd.choice(["***", "$$$", "%%%"]) + str(rnd.randint(0, 99)) for _ in range(12))
    rows, labels = [], []
    for i in range(60):
        bad = i % 3 == 0
        rows.append((i, "\n".join((junk if (rnd.random() < 0.8) == bad else good)() for _ in range(12))))
        labels.append((i, 0 if bad else 1))
    rows += [(100, "\n".join([good(), good(), junk(), good(), good()])), (101, "\n".join([junk(), junk(), good(), junk(), junk()])), (None, None), (0, rows[0][1]), (0, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = quality.train(docs, spark.createDataFrame([*labels, (None, 1), (5, 7), (999, 0)], "doc_id long, quality int"))
    got = {r.doc_id: r for r in quality.rate(docs, field).collect()}
    assert (got[100].content_words, got[100].kept) == (48, True)
    assert (got[101].content_words, got[101].kept) == (12, False)
    none = quality.train(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.kept for r in quality.rate(docs.filter("doc_id > 99"), none).collect()} == {True}


def test_mix(spark, docs, empty):
    rows = corpus()
    size = lambda t: len(WORD.findall(t or ""))
    total = sum(size(t) for _, t, _ in rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and {r.source for r in got} == {s for _, _, s in rows}
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(1.5 * total)
    largest = max(size(t) for _, t, _ in rows)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= largest
        assert all(r.taken in (0, r.size, 2 * r.size) for r in own)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mix(empty).count() == 0
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns and copies.count() == sum(r.taken // r.size for r in got if r.size)


def test_targets(spark):
    def shared_out(sizes, weights, budget):
        sums = spark.createDataFrame([(f"{i:03d}", x) for i, x in enumerate(sizes)], "source string, size long")
        return [r.target for r in sorted(mixing.shared_out(sums, weights, budget, 2.0).collect())]

    assert shared_out([100, 100, 100], (5, 2, 1), 450) == pytest.approx([200, 500 / 3, 250 / 3])
    assert shared_out([0, 10], (5, 1), 15) == pytest.approx([0, 15])
    rnd = random.Random(2)
    sizes = [rnd.randint(0, 50) for _ in range(200)]
    got = shared_out(sizes, (5, 2, 1), 1.5 * sum(sizes))
    # brute force: share out, cap, share the excess again
    want, left, free = [0.0] * 200, 1.5 * sum(sizes), set(range(200))
    while True:
        level = left / sum((5, 2, 1)[i % 3] for i in free)
        over = {i for i in free if level * (5, 2, 1)[i % 3] >= 2 * sizes[i]}
        if not over:
            break
        for i in over:
            want[i] = 2.0 * sizes[i]
        left, free = left - sum(want[i] for i in over), free - over
    for i in free:
        want[i] = level * (5, 2, 1)[i % 3]
    assert got == pytest.approx(want)


def test_shards(spark, docs, empty):
    rows = corpus()
    got = sharding.shard_documents(docs).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    held = collections.defaultdict(list)
    for r in got:
        held[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in held.values())
    counts = [len(held[s]) for s in range(16)]
    assert max(counts) - min(counts) <= 1
    assert sharding.shard_documents(empty).count() == 0


def test_ring_bounds_and_movement():
    rnd = random.Random(6)
    counts = collections.Counter(rnd.randrange(sharding.PLACES) for _ in range(20000))
    runs = sharding.walk(counts, [1300] * 16)  # a little more room than keys
    assert sum(e - f for _, f, e, _, _ in runs) == 20000
    before = {(p, k): s for p, f, e, s, _ in runs for k in range(f, e)}
    more = dict(counts)
    more[17] = more.get(17, 0) + 20
    after = {(p, k): s for p, f, e, s, _ in sharding.walk(more, [1300] * 16) for k in range(f, e)}
    assert sum(after[k] != s for k, s in before.items()) < 1000


def test_large_shards_are_ranked_in_parts(spark):
    keys = spark.range(30000).withColumnRenamed("id", "n").selectExpr("n", "xxhash64(n % 7) AS key")
    got = sharding.sharded(keys, 5, part_rows=1).toPandas()
    assert sorted(got.groupby("shard").size()) == [6000] * 5 and all(set(g.slot) == set(range(6000)) for _, g in got.groupby("shard"))


def test_top_k(spark):
    rnd = np.random.default_rng(7)
    rows = [(int(i), [float(x) for x in rnd.normal(size=6)], 1) for i in range(0, 900, 3)]
    rows += [(1000, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (1020, [float("nan")] * 6, 1), (1040, None, 1), (None, [1.0] * 6, 1), (1060, [], 1), (1080, [2.0, 1.0], 1), (rows[0][0], rows[0][1], 1)]
    rows += [(2000 + i, [3.0] * 6, 1) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score long")
    vectors = []
    for i, e, _ in rows:
        if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e):
            v = np.zeros(6, np.int64)
            v[: len(e)] = np.floor(64 * np.array(e, float)).astype(np.int64)
            vectors.append((i, v))
    want = []
    for row, (q, w) in enumerate(vectors):
        if q % 20 == 0:
            best = sorted((-int(w @ v), i) for k, (i, v) in enumerate(vectors) if k != row)[:20]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e15, 1.0]), (1, [1e15, -1.0]), (2, [-1e300, 0.0]), (3, [1e15, 3.0]), (4, [1e15, 2.0]), (5, [1e308, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    # scores of 1, 3 and 4 are beyond a long, and differ in the last digits only; 64 times the last vector isn't finite
    assert [(r.vec_id, r.rank) for r in sorted(got, key=lambda r: r.rank)] == [(3, 1), (4, 2), (1, 3), (2, 4)]
    assert [r.score for r in sorted(got, key=lambda r: r.rank)] == [(1 << 63) - 1] * 3 + [-(1 << 63)]
    numbers = [0, 1, -1, 255, 256, -255, -256, 1 << 900, -(1 << 900), 12345678901234567890]
    assert sorted(numbers) == sorted(numbers, key=topk.sortable)


@pytest.mark.parametrize("decay, most", [(0.6, 0.5), (0.9, 0.9), (1.0, 1.0)])
def test_nra_stops_early_and_is_exact(decay, most):
    """With a decaying spectrum only a part of the lists' entries is read."""
    rnd = np.random.default_rng(9)
    vectors = np.round(rnd.normal(size=(4000, 32)) * 500 * decay ** np.arange(32))
    lists = topk.Lists(vectors)
    queries = np.round(rnd.normal(size=(20, 32)) * 500 * decay ** np.arange(32))
    for q, found, scores in topk.search(lists, np.arange(4000), queries, [None] * 19 + [7], 5):
        want = sorted((-int(s), i) for i, s in enumerate(vectors @ queries[q]) if q < 19 or i != 7)[:5]
        assert [(-s, i) for s, i in want] == [(s, i) for s, i in zip(scores, found.tolist(), strict=True)]
    assert lists.entries_read <= most * 20 * vectors.size


@pytest.mark.parametrize("decay, most", [(0.6, 0.1), (0.9, 0.4), (1.0, 0.8)])
def test_nra_reads_where_lists_fall(decay, most):
    rnd = np.random.default_rng(9)
    vectors, queries = (np.round(rnd.normal(size=(n, 32)) * 500 * decay ** np.arange(32)) for n in (4000, 20))
    lists = topk.Lists(vectors)
    assert len(list(topk.search(lists, np.arange(4000), queries, [None] * 20, 5))) == 20
    assert lists.entries_read < most * 20 * vectors.size


@pytest.mark.parametrize("scale", [8, 5000])
def test_queries_read_lists_together(monkeypatch, scale):
    """Floats or doubles, several groups of queries, ties: a few reads for all queries, exact, and only a part of the entries."""
    rnd = np.random.default_rng(11)
    vectors = np.round(rnd.normal(size=(3000, 24)) * scale * 0.9 ** np.arange(24))
    vectors[100:160] = vectors[7]
    queries, own = vectors[:600], list(range(600))
    ids, lists, reads, read = np.arange(3000) // 2, topk.Lists(vectors), [], topk.Lists.read
    monkeypatch.setattr(topk.Lists, "read", lambda self, weights, seen: (reads.append((len(weights), seen.dtype)), read(self, weights, seen))[1])
    got = {q: (found.tolist(), scores) for q, found, scores in topk.search(lists, ids, queries, own, 20)}
    for q in range(600):
        scores = (vectors @ queries[q]).astype(np.int64)
        best = [i for i in np.lexsort((ids, -scores)).tolist() if i != q][:20]
        assert got[q] == (best, scores[best].tolist())
    assert {kind for _, kind in reads} == {np.dtype(np.float32 if scale == 8 else np.float64)}
    assert len(reads) < 60 and max(n for n, _ in reads) > 200
    assert lists.entries_read < 0.6 * 600 * vectors.size


def _batch(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def odd_texts():
    rnd = random.Random(1)
    parts = ["a", "b", "s", "t", "re", "ll", "'", " ", "  ", "\n", "\t", "1", "²", "é", "ß", "!", "$", "ª", "<|endoftext|>", "'s", "日", " ", "̀", "\x1c", "the", "▁", "\U0001f600", "x" * 60]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(3000)]


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    held, library = encoder.Encoder(encoder.default_tokenizer()), Tokenizer.from_file(encoder.default_tokenizer())
    texts = [*odd_texts(), "a <|endoftext|> b"]
    ids, of = held(*_batch(texts))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(of[:-1], of[1:], strict=True)] == want


def test_token_files(docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = encoder.default_tokenizer()
    library = Tokenizer.from_file(path)
    files, got = tokenfiles.token_files(docs, path, 0, folder=str(tmp_path / "t"), file_ids=500)
    got = sorted(got.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(i for i, _, _ in corpus() if i is not None)
    assert [r.doc_id is None for r in got] == sorted(r.doc_id is None for r in got)
    start, texts = 0, {i: t for i, t, _ in corpus()}
    for r in got:
        assert r.start == start
        start += r.n_tokens
        if r.doc_id is not None:
            ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [0]
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    own = tokenfiles.TokenFile(files.first().path)
    assert [len(own.ids(i)) for i in range(len(own))] == np.diff(np.concatenate([[0], own.ends.all()]).astype(int)).tolist()
    assert tokenfiles.token_files(empty, path, 0)[1].count() == 0


def test_separator_scan(spark, docs, empty, tmp_path):
    path = encoder.default_tokenizer()
    got = separators.count_tokens(docs, path, 50256, folder=str(tmp_path / "f"), block_ids=37, file_ids=900)
    held, texts = encoder.Encoder(path, special_as_text=True), {i: t for i, t, _ in corpus()}
    for r in got.collect():
        if r.doc_id is not None:
            assert r.n_tokens == len(held.tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids) + 1
    assert got.count() == len(corpus()) and separators.count_tokens(empty, path, 50256).count() == 0
    rnd = np.random.default_rng(3)
    ids = rnd.integers(0, 4, 5000).astype("<u2")
    (tmp_path / "one").write_bytes(ids.tobytes())
    (tmp_path / "none").write_bytes(b"")
    names = spark.createDataFrame([(str(tmp_path / "one"),), (str(tmp_path / "none"),)], "path string")
    found = sorted(tuple(r)[1:] for r in separators.count_flat(names, 0, block_ids=64).collect())
    ends = [int(x) + 1 for x in np.flatnonzero(ids == 0)]
    ends += [5000] if ends[-1] != 5000 else []
    assert found == [(k, a, b - a) for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False))]


def test_pieces_against_brute_force(docs, empty):
    path = pieces.default_model()
    held = pieces.Model(path)
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    known = {library.id_to_piece(i): (max(library.get_score(i), held.unknown + 10), i) for i in range(library.get_piece_size()) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))}

    def brute(text):
        s = "▁" + text.replace("▁", "\0").replace(" ", "▁") if text else ""
        best = [(0.0, [])] + [None] * len(s)
        for e in range(1, len(s) + 1):
            options = [(best[e - n][0] + known[s[e - n : e]][0], [*best[e - n][1], known[s[e - n : e]][1]]) for n in range(min(16, e), 0, -1) if s[e - n : e] in known]
            char = "▁" if s[e - 1] == "\0" else s[e - 1]
            top = max(options, key=lambda o: o[0], default=None)
            spelled = (best[e - 1][0] + held.unknown, best[e - 1][1] + [int(held.bytes[b]) for b in char.encode()])
            best[e] = top if top and top[0] > spelled[0] else spelled
        return best[-1][1]

    texts = odd_texts()[:800]
    ids, of = held.encode(*_batch(texts))
    assert [ids[a:b].tolist() for a, b in zip(of[:-1], of[1:], strict=True)] == [brute(t) for t in texts]
    flat, at = held.decode(ids, of)
    assert [flat[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:], strict=True)] == texts
    got = pieces.encode(docs, path)
    assert all(r.round_trip for r in got.collect())
    back = {r.doc_id: r.text for r in pieces.decode(got, path).collect()}
    assert all(back[i] == (t or "") for i, t, _ in corpus() if i is not None)
    assert pieces.encode(empty, path).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header><h2>Site</h2></header>
<nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><div id="cookie-notice">We use cookies here, all of them.</div>
<div class=layout><div class="sidebar"><p>Side text that is long enough to matter here, really.</p></div><div class="post-content"><h1>Title &eacute; &amp &am</h1>
<p>First para with <a href=x>link</a>
  and <b>bold</b>.<br>Next<p>Second&nbsp;para.<ul><li>one<li>two</ul><!-- no --><div class="ad-box">Buy</div><table><tr><td>c1<td>c2</table>
<form><input> Send</form></div><section id=comments><p>I like it, this comment is long enough to matter, yes.</p></section></div><footer>&copy; foo</footer>"""


def test_extraction(spark):
    want = "Title é & &am\nFirst para with link and bold. Next\nSecond para.\none\ntwo\nc1\nc2"
    rows = [(1, "u", PAGE, 1), (1, "u", PAGE, 1), (2, None, None, 1), (3, "v", "", 1), (None, "w", "plain  text", 1), (4, "x", "<div>" * 3000 + "deep", 1), (5, "y", "<p>a<p>b<a href='cut", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in extraction.extract(df).collect()))
    assert got == [(0, "plain text", 10), (1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0), (4, "deep", 4), (5, "a\nb", 3)]
    assert extraction.extract(df.limit(0)).count() == 0
    article = "<body><p>before it all</p><article class='main'><header><h1>H</h1></header><p>One two three four five.</p><aside>no</aside></article></body>"
    assert extraction.main_text(article) == "H\nOne two three four five."


def test_mix_by_row(spark):
    """Of rows with one id, source and size, or with no id, each comes as often as the mix takes it."""
    rows = [(None, f"a{i} b{i}", "s") for i in range(7)] + [(4, f"c{i} d{i} e{i}", "t") for i in range(3)] + [(5, "f g h", "u")] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(docs, share=0.6).collect()
    want, units = collections.Counter(), collections.Counter()
    for r in got:
        want[r.doc_id, r.source] += r.taken // r.size
    copies = mixing.mixed_documents(docs, share=0.6).collect()
    for r in copies:
        units[r.doc_id, r.source] += 1
    assert units == +want and 0 < len(copies) < len(rows)
    assert sum(len(r.text.split()) for r in copies) <= 0.6 * sum(len(t.split()) for _, t, _ in rows)


STORY = "<p>" + "This is a sentence of the story, which goes on for a while as stories do. " * 4 + "</p>"


@pytest.mark.parametrize(
    "page",
    [
        "<div class='content-sidebar-wrap'><div class='post'>{}</div></div>",
        "<div class='page has-sidebar'><article>{}</article></div>",
        "<div class='privacy-study'>{}</div>",
        "<section class='search-results-story'>{}</section>",
        "<div class='article-body'><div id='disclaimer-history'>{}</div></div>",
        "<article class=x>{}</article><div class='cookie-notice'>" + "We use cookies. " * 100 + "</div>",
    ],
)
def test_names_that_are_wrong(page):
    html = "<body><nav><a href=/>Home</a></nav>" + page.format(STORY * 3) + "<div class=ad>Buy this</div><footer>f</footer></body>"
    assert extraction.main_text(html) == "\n".join([STORY[3:-5]] * 3)


def test_names_within_an_article():
    html = "<body><article><div class='entry-header'><h1>Title</h1></div>" + STORY + "<section id='related-work'><p>Other work.</p></section><p class='legal-opinion'>An opinion.</p><div class='ad-box'>Buy</div><div id='comments'>Nice</div></article></body>"
    assert extraction.main_text(html) == "Title\n" + STORY[3:-5] + "\nOther work.\nAn opinion."


def test_density_decides(monkeypatch):
    """On pages with and without an article element, what is taken depends on the densities."""
    links = "<div>" + "".join(f"<p><a href={i}>Some link of the page, number {i}</a></p>" for i in range(30)) + "</div>"
    plain = f"<body><div>{links}</div><div><div>{STORY * 3}</div></div></body>"
    story = "\n".join([STORY[3:-5]] * 3)
    several = f"<body><div><article>{links}</article><article>{STORY * 3}</article></div></body>"
    assert extraction.main_text(plain) == extraction.main_text(several) == story
    monkeypatch.setattr(extraction, "density", lambda chars, tags, link_chars, link_tags, share: link_chars / max(1, tags))
    assert "number 3" in extraction.main_text(plain) and story not in extraction.main_text(plain)
    assert "number 3" in extraction.main_text(several) and story not in extraction.main_text(several)


def test_densities_against_brute_force():
    """Counts and densities of random trees, by walking each element's subtree."""
    rnd = random.Random(12)

    def tree(depth):
        tag = rnd.choice(["div", "section", "span", "a", "b"])
        inner = [tree(depth - 1) if depth and rnd.random() < 0.6 else rnd.choice(["", "xy z", "words of text"]) for _ in range(rnd.randint(0, 4))]
        return (tag, inner)

    def markup(t):
        return t if isinstance(t, str) else f"<{t[0]}>" + "".join(map(markup, t[1])) + f"</{t[0]}>"

    def walk(t, link):
        """(characters, tags, characters in links, link tags) within t, and the same of all its elements in order."""
        if isinstance(t, str):
            size = len(" ".join(t.split()))
            return (size, 0, size if link else 0, 0), []
        link = link or t[0] == "a"
        own, below = [0, 0, 0, 0], []
        for c in t[1]:
            got, more = walk(c, link)
            is_element = not isinstance(c, str)
            own = [own[0] + got[0], own[1] + got[1] + is_element, own[2] + got[2], own[3] + got[3] + (is_element and c[0] == "a")]
            below += more
        return tuple(own), [tuple(own), *below]

    for _ in range(60):
        top = ("div", [tree(4) for _ in range(3)])
        _, want = walk(("body", [top]), False)
        held = extraction.Densities(extraction.Page("<body>" + markup(top) + "</body>"))
        got = [(held.chars[i], held.tags[i], held.link_chars[i], held.link_tags[i]) for i in range(1, held.n)]
        assert got == want
        for i in range(1, held.n):
            c, t, lc, lt = got[i - 1]
            share = want[0][2] / max(1, want[0][0])
            by_hand = c / max(1, t) * max(0.0, np.log(max(1.0, c * max(1, t) / (max(1, lc) * max(1, lt))))) / np.log(c * lc / max(1, c - lc) + c * share + np.e) if c else 0.0
            assert held.of(i) == pytest.approx(by_hand)


def thue_morse(n=2048):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_texts_that_collide_in_polynomial_hashes(spark):
    from tokenizers import Tokenizer

    one, other = thue_morse()
    texts = [one, other, f"{one}\n{other}", "x" * 3000, "x" * 3001]
    library = Tokenizer.from_file(encoder.default_tokenizer())
    ids, of = encoder.Encoder(encoder.default_tokenizer())(*_batch(texts))
    assert [ids[a:b].tolist() for a, b in zip(of[:-1], of[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    held = pieces.Model(pieces.default_model())
    ids, of = held.encode(*_batch(texts))
    flat, at = held.decode(ids, of)
    assert [flat[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:], strict=True)] == texts
    assert quality.measured(*_batch(texts)).n_dup_lines.tolist() == [0] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in minhash.near_duplicates(df, 4).collect()}
    assert got[0].component_id == 0 and got[1].component_id == 1
    gone = {r.doc_id: r.n_removed for r in suffixes.deduplicate(df, length=1500).collect()}
    assert (gone[0], gone[1], gone[2]) == (2048, 2048, 4096)  # only with themselves in the third text
    gone = {r.doc_id: r.n_removed for r in suffixes.deduplicate(df.filter("doc_id < 2"), length=1600).collect()}
    seen = collections.Counter(t[k : k + 1600] for t in (one, other) for k in range(2048 - 1599))
    assert all(v == 1 for v in seen.values()) and gone == {0: 0, 1: 0}
    counts = {r.doc_id: r.n_tokens for r in separators.count_tokens(df, encoder.default_tokenizer(), 50256).collect()}
    assert counts == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_cache_compares_bytes(monkeypatch):
    """Strings whose keys are equal are still told apart."""
    from docloom.llm import common

    init = common.Spans.__init__

    def poor(self, *args):
        init(self, *args)
        self.keys = self.keys % np.uint64(3)

    monkeypatch.setattr(common.Spans, "__init__", poor)
    texts = [t for t in odd_texts()[:300] if "\U0001f600" not in t]
    held = encoder.Encoder(encoder.default_tokenizer())
    for _ in range(2):
        ids, of = held(*_batch(texts))
        assert [ids[a:b].tolist() for a, b in zip(of[:-1], of[1:], strict=True)] == [e.ids for e in held.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_repeats_longer_than_eight_bits_of_windows(spark):
    rnd = random.Random(3)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(900))
    rows = [(i, "".join(rnd.choice("ijklm") for _ in range(50)) + passage + "".join(rnd.choice("nopq") for _ in range(50))) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (200, 400, 800):
        windows = Counter(t[k : k + length] for _, t in rows for k in range(len(t) - length + 1))
        want = {i: len({x for k in range(len(t) - length + 1) if windows[t[k : k + length]] > 1 for x in range(k, k + length)}) for i, t in rows}
        assert min(want.values()) >= 900  # letters beside the passage may agree too
        assert {r.doc_id: r.n_removed for r in suffixes.deduplicate(df, length=length).collect()} == want


def test_long_words_are_cut_where_no_piece_spans():
    held = pieces.Model(pieces.default_model())
    rnd = random.Random(4)
    for text in ("日本語の文章" * 60, "".join(rnd.choice("ab日") for _ in range(500)), "ab" * 300):
        ids, of = held.encode(*_batch([text]))
        uncut, pieces.UNCUT = pieces.UNCUT, 10**6
        try:
            want, _ = pieces.Model(pieces.default_model()).encode(*_batch([text]))
        finally:
            pieces.UNCUT = uncut
        assert ids.tolist() == want.tolist()


def test_words_remembered_are_few_and_forgotten_by_other_tasks():
    from docloom.llm import common

    held = pieces.Model(pieces.default_model())
    assert held.cache.most <= 300_000 and pieces.BLOCK <= 1 << 19
    want = held.encode(*_batch(["some words to keep"]))[0].tolist()
    known = held.cache.known
    assert known and list(common.tidy(iter, caches=True)([])) == [] and held.cache.known == known
    assert list(common.tidy(iter)([])) == [] and held.cache.known == 0 and len(held.cache.flat) == 0
    assert held.encode(*_batch(["some words to keep"]))[0].tolist() == want
