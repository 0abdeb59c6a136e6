"""Empty tables, nulls, ties, repeated rows and clashing columns, for every operator; small cases with known results."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from keyweave.llm import chat_format, decontamination, exact_dedup, jaccard, quality, sentencepiece_codec, sharding, suffix_dedup, token_counts, token_files
from keyweave.llm.common import prepared, shared_folder
from keyweave.llm.queries import PIECES, WORDS

LONG = " ".join(f"word{i % 97}x{i % 13}" for i in range(30_000))
DOCS = [
    (1, "The quick brown fox jumps over the lazy dog and then it runs far away from here.", "a"),
    (2, None, "b"),
    (3, "", "b"),
    (4, "The quick  brown\tfox jumps over the lazy dog and then it runs far away from here.", "c"),
    (4, "The quick  brown\tfox jumps over the lazy dog and then it runs far away from here.", "c"),
    (5, LONG, "d"),
    (6, "   ", None),
    (None, "a null id", "e"),
    (7, "x" * 5000, "e"),
    (8, "Été — naïve ▁▁ \x00   日本語テキスト 🎉🎉 <s> </s> [INST] \\ ok", "f"),
]
SCHEMA = "doc_id bigint, text string, score string"  # a column named like one that an operator makes


@pytest.fixture(scope="module")
def docs(spark):
    return prepared(spark).createDataFrame(DOCS, SCHEMA).withColumn("spans", F.lit(1)).withColumn("node", F.lit("n")).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return prepared(spark).createDataFrame([], SCHEMA)


BENCH = [(1, "the LAZY dog and then it runs far away from here now"), (2, "null id"), (3, None), (4, ""), (5, "--")]


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id bigint, text string")


@pytest.fixture(scope="module")
def model(spark):
    texts = [(i, ("good plain words here, and more of them. " * (1 + i % 5)) if i % 2 else "### $$$ BAD!! " * (3 + i % 7)) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    return quality.fit(df, spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, None)], "doc_id bigint, quality int"))


def results(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_empty_tables(spark, none, bench, model):
    folder = shared_folder(spark, "empty")
    empty_bench = bench.limit(0)
    made = [
        sentencepiece_codec.encode_digests(none, PIECES), sentencepiece_codec.encode(none, PIECES), exact_dedup.duplicate_groups(none), exact_dedup.drop_duplicates(none), suffix_dedup.kept_bytes(none),
        quality.score(none, model), quality.keep_good(none, model), sharding.shard(none, 3, f"{folder}/map"), decontamination.find(none, bench), decontamination.find(none, empty_bench),
        token_counts.count_tokens(none, PIECES), jaccard.similarity_classes(none), jaccard.first_of_each(none), token_files.sequences_of(spark, none, WORDS, f"{folder}/s", f"{folder}/m"),
        chat_format.digests(chat_format.read_back(chat_format.format_chats(chat_format.conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))))),
    ]
    assert [df.count() for df in made] == [0] * len(made)


def test_sentencepiece_is_the_library(docs, spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r: t or "" for r, t, _ in DOCS}
    encoded = sentencepiece_codec.encode(docs, PIECES)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    want = {r: [sp.bos_id(), *sp.encode(t), sp.eos_id()] for r, t in texts.items()}
    assert got == want and encoded.count() == len(DOCS)
    assert {r.doc_id: r.text for r in sentencepiece_codec.decode(encoded, PIECES).collect()} == {r: sp.decode(i) for r, i in want.items()}
    ends = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in sentencepiece_codec.encode_digests(docs, PIECES).collect()}
    assert ends == {r: (len(i), hashlib.sha256(sp.decode(i).encode()).hexdigest()) for r, i in want.items()}


def test_bounded_chunk_table():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    table = sentencepiece_codec.ChunkTable(PIECES, table_entries=5)
    texts = ["a b  c ", " ", "  x", "trailing ", "\n\n a", LONG[:2000]] * 3
    assert [len(x) // 4 for x in table.encode(texts)] == [len(sp.encode(t)) for t in texts]
    assert [len(x) // 4 for x in table.encode(texts)] == [len(sp.encode(t)) for t in texts]


@pytest.mark.parametrize(("split", "block"), [(1 << 17, 1 << 16), (40, 7), (0, 1)])
def test_token_counts_are_the_library(docs, split, block):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [r for r in DOCS if block > 1 or len(r[1] or "") < 6000]
    some = docs.where(F.length(F.coalesce("text", F.lit(""))) < 6000) if block == 1 else docs
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(some, PIECES, split=split, block=block).collect()), key=repr)
    assert got == sorted(((r, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for r, t, _ in rows), key=repr)


def test_transitions_carry_what_is_emitted():
    """What transitions emit adds up to the library's count, for each prefix; states that know the same are one."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    t = token_counts.Transducer(PIECES)
    words = ["internationalization", "internationally", "naïve日本", "x1🎉z9qqq"]
    emitted = []
    for word in words:
        t.walk(token_counts.MARK + word)
        state = total = 0
        for k, char in enumerate(token_counts.MARK + word):
            key = state << 21 | ord(char)
            state, more = t.move[key], t.emit[key]
            total += more
            emitted.append(more)
            assert k == 0 or total == len(sp.encode(word[:k]))
    assert min(emitted) < 0 < max(emitted)
    prefixes = {w[:k] for w in words for k in range(1, len(w) + 1)}
    assert len(t.known) == len(set(t.known)) <= 2 + len(prefixes) == 1 + len(t.move)
    t.walk(token_counts.MARK + "".join(f"x1🎉z9qqq{k}" for k in range(50)))
    states = len(t.known)
    t.walk(token_counts.MARK + "".join(f"x1🎉z9qqq{k}" for k in range(50)) * 3)
    assert len(t.known) <= states + 20


def test_compiled_arrays_count_alone():
    """Once words are compiled, the arrays count them without the slow walk."""
    t = token_counts.Transducer(PIECES)
    chunks = [token_counts.MARK + w for w in "the quick brown fox, naïve 日本 x1🎉z9qqq".split()]
    first = t.run(chunks).tolist()
    t._arrays()
    t.walk = None
    assert t.run(chunks).tolist() == first and t.run([]).tolist() == []


def test_blocks_compose_in_any_way():
    t = token_counts.Transducer(PIECES, states=50)
    texts = [t_ or "" for _, t_, _ in DOCS if len(t_ or "") < 6000] + ["a  b   c    ", " " * 40 + "x", "ab" * 300]
    for text in texts:
        assert {t.composed(t.scan(list(token_counts.blocks(text, b)))) for b in (1, 3, 17, 1000, 1 << 16)} == set(t.counts([text]))


def test_exact_dedup(docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r, t, _ in DOCS:
        groups[norm(t)].append(r)
    got = results(exact_dedup.duplicate_groups(docs).select("doc_id", "keep_id", "group_size", "text_sha256"))
    want = [(r, min((i for i in groups[norm(t)] if i is not None), default=None), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for r, t, _ in DOCS]
    assert got == sorted(want, key=repr)
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 5, 6, 7, 8, None} and kept.count() == 7


def test_collisions_are_compared(spark, docs):
    """With tiny primes nearly all fingerprints agree; the comparison still tells texts apart."""
    want = results(exact_dedup.duplicate_groups(docs))
    same_length = spark.createDataFrame([(i, t, "") for i, t in enumerate(["ab", "cd", "ab", "ef", "cd", "ab"])], SCHEMA)
    assert results(exact_dedup.duplicate_groups(docs, primes=(2, 3))) == want
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.duplicate_groups(same_length, primes=(2, 2)).collect()}
    assert got == {0: (0, 3), 1: (1, 2), 2: (0, 3), 3: (3, 1), 4: (1, 2), 5: (0, 3)}


def test_fingerprints_compose():
    import numpy as np

    p = exact_dedup.Polynomial(exact_dedup.PRIMES[0], exact_dedup.BASES[0])
    data = np.frombuffer(LONG.encode(), dtype=np.uint8)
    for cut in (1, 4096, 5000, 123_457):
        a, b = data[:cut], data[cut:]
        assert p.combine(p.text(a), p.text(b), len(b)) == p.text(data)


def brute_kept(rows, size=100):
    seen, out = set(), []
    for r, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - size + 1):
            w = raw[k : k + size]
            if w in seen:
                gone[k : k + size] = b"\1" * size
            else:
                seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        out.append((r, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_dedup(spark, docs, monkeypatch):
    passage = "".join(f"{i * 7919 % 10007:05d}" for i in range(60))
    more = [(100 + i, f"begin {i} {i * i} " + passage[i % 40 :] + f" end {i % 3} " + "z" * (i % 250), "") for i in range(60)]
    more += [(300 + i, (passage + "tail") * 3 if i else passage * 2, "") for i in range(4)]
    distinct = {(r, t) for r, t, _ in DOCS + more}
    df = spark.createDataFrame(DOCS + more, SCHEMA).repartition(5)
    want = brute_kept(distinct)
    assert sorted(set(results(suffix_dedup.kept_bytes(df))), key=repr) == want
    assert suffix_dedup.kept_bytes(df).count() == len(DOCS) + len(more)


def test_suffix_dedup_of_repeated_rows(spark):
    """Copies of a document that comes first keep a passage which a later document shares; only the later one loses it."""
    passage = "".join(hashlib.sha256(f"p{k}".encode()).hexdigest() for k in range(6))
    rows = [(i, f"begin {c} {c * 30} " + passage + f" {c * 30} end {c}", "") for i, c in ((1, "a"), (1, "a"), (1, "a"), (2, "b"), (2, "b"), (None, "c"), (None, "c"))]
    df = prepared(spark).createDataFrame(rows, SCHEMA).repartition(3)
    want = brute_kept({(i, t) for i, t, _ in rows})
    got = results(suffix_dedup.kept_bytes(df))
    assert sorted(set(got), key=repr) == want and len(got) == len(rows)
    assert {r[0]: r[2] >= len(passage) for r in got} == {None: False, 1: True, 2: True}


def test_suffix_dedup_of_texts_without_an_id(spark):
    """Texts under the null id whose 32-bit hashes (Murmur3) agree are two documents: only the one with a repeat is cut."""
    digits = lambda *names: "".join(hashlib.sha256(n.encode()).hexdigest() for n in names)
    rows = []
    for i, j in ((406, 66580), (36490, 91164)):
        rows += [(None, digits(f"a{i} 0", f"a{i} 1") * 2, ""), (None, digits(*(f"b{j} {k}" for k in range(4))), "")]
    df = prepared(spark).createDataFrame(rows, SCHEMA)
    assert df.select(F.hash("text")).distinct().count() == 2 and len({t for _, t, _ in rows}) == 4
    assert results(suffix_dedup.kept_bytes(df)) == brute_kept({(i, t) for i, t, _ in rows})


def test_suffix_buckets_of_any_size():
    """Small blocks and buckets, so that groups cross borders, against one bucket."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    words = rng.integers(0, 4, (200, 3)).astype(np.uint64)
    order = suffix_dedup.multikey_order(words)
    assert [tuple(w) for w in words[order]] == sorted(map(tuple, words))
    batches = [pa.RecordBatch.from_pydict({"k": sorted(rng.integers(0, 9, 300).tolist())})]
    batches = [batches[0].slice(i, 7) for i in range(0, 300, 7)]
    parts = list(suffix_dedup._groups(iter(batches), "k", 40))
    assert [k for t, _ in parts for k in t["k"].to_pylist()] == batches and False or sum(t.num_rows for t, _ in parts) == 300
    closed = [set(t["k"].to_pylist()) for t, open_ in parts if not open_]
    assert sum(len(c) for c in closed) == len(set().union(*closed)) if closed else True


def test_long_texts_in_pieces(monkeypatch):
    import numpy as np

    data = np.frombuffer((LONG + LONG[:300]).encode(), dtype=np.uint8)
    whole = suffix_dedup.anchors(data, np.array([len(data)]))
    windows = lambda x: {i for low, high in zip(x[4].tolist(), x[5].tolist(), strict=True) for i in range(low, high + 1)}
    assert windows(whole) == set(range(len(data) - suffix_dedup.SIZE + 1))
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1 << 12)
    pieces = suffix_dedup.anchors(data, np.array([len(data)]))
    assert windows(pieces) == windows(whole) and set(pieces[3].tolist()) == set(whole[3].tolist())


def test_quality(docs, model):
    got = {r.doc_id: r for r in quality.score(docs, model, keep=("score",)).select("doc_id", "held_out", "predicted").collect()}
    assert len(got) == len({r for r, _, _ in DOCS})
    assert all(got[r].held_out == (zlib.crc32(("" if r is None else str(r)).encode()) % 5 == 0) for r in got)
    scores = [r.score for r in quality.score(docs.drop("score"), model).collect()]
    assert len(scores) == len(DOCS) and all(0 <= s <= 1 for s in scores)
    assert quality.keep_good(docs, model).columns == docs.columns


def test_quality_without_a_class(spark, docs):
    labels = spark.createDataFrame([(i, 1) for i in range(1, 9)], "doc_id bigint, quality int")
    assert {r.score for r in quality.score(docs.drop("score"), quality.fit(docs, labels)).collect()} == {1.0}
    assert {r.score for r in quality.score(docs.drop("score"), quality.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (prepared(spark).read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs, quality.fit(docs, labels)).where("held_out").join(labels, "doc_id")
    right = scored.groupBy("quality").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("x"))
    assert all(r.x >= 0.98 for r in right.collect())


def test_sharding(spark, docs):
    folder = shared_folder(spark, "shards")
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('y', cast(id % 97 as int))").alias("text"))
    placed = sharding.shard(many, 7, f"{folder}/map").cache()
    by = placed.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.countDistinct("slot").alias("d")).collect()
    assert len(by) == 7 and max(r.b for r in by) <= 1.01 * min(r.b for r in by)
    assert all((r.low, r.high, r.d) == (0, r.n - 1, r.n) for r in by)
    old = sharding.load_map(spark, f"{folder}/map")
    sharding.save_map(sharding.grown_map(old, 2), f"{folder}/map")
    new = sharding.load_map(spark, f"{folder}/map")
    moved = old.alias("o").join(new.alias("n"), "vslot").where("o.shard <> n.shard")
    assert {r[0] for r in moved.select("n.shard").distinct().collect()} == {7}
    loads = {r.shard: r.b for r in new.groupBy("shard").agg(F.sum("n_bytes").alias("b")).collect()}
    assert len(loads) == 8 and max(loads.values()) <= 1.1 * sum(loads.values()) / 8
    assert sharding.load_map(spark, f"{folder}/map", 1).count() == old.count()
    odd = sharding.shard(docs, 3, f"{folder}/odd")
    assert odd.count() == len(DOCS)
    assert {(r.doc_id, r.size, r.text_crc32) for r in odd.collect()} == {(r, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for r, t, _ in DOCS}


def brute_hits(docs, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    out = []
    for r, t, *_ in docs:
        w, hit, named = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    named |= found
                    hit.update(range(k, k + n))
        out.append((r, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_decontamination(docs, bench, block):
    assert results(decontamination.digests(decontamination.find(docs, bench, block_bytes=block))) == brute_hits(DOCS, BENCH)
    cut = decontamination.without_hits(docs, bench, block_bytes=block)
    left = {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == docs.columns and left[1] == "The quick brown fox jumps over  ." or left[1].startswith("The quick brown fox jumps over")
    assert left[5] == LONG and left[2] is None and left[None].split() == ["a"]
    assert results(decontamination.digests(decontamination.find(cut, bench)).select("contaminated").distinct()) == [(False,)]


def test_fm_index_finds_all():
    import numpy as np

    rng = np.random.default_rng(1)
    text = rng.integers(0, 4, 400)
    index = decontamination.FMIndex(text)
    patterns = rng.integers(1, 4, (60, 3))
    low, high = index.search(patterns)
    for p, a, b in zip(patterns, low, high, strict=True):
        at = sorted(index.locate(np.arange(a, b)).tolist()) if b > a else []
        assert at == [i for i in range(len(text) - 2) if (text[i : i + 3] == p).all()]


def brute_classes(rows, width, percent):
    sets = {}
    for r, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[r] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    root = {r: r for r in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((r, len(s), find(r)) for r, s in sets.items())


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (1, 50)])
@pytest.mark.parametrize("unit", [1_000_000, 300])
def test_shingle_join(spark, width, percent, unit):
    import random

    rng = random.Random(width)
    base = [[f"w{rng.randrange(900)}" for _ in range(80)] for _ in range(4)]
    rows = []
    for i in range(120):
        words = list(base[i % 4])
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            words[rng.randrange(len(words))] = f"n{rng.randrange(9999)}"
        if i % 10 == 9:
            words = words[: rng.randrange(4)]
        rows.append((i, " ".join(words) if i % 11 else (" ".join(words)).upper()))
    rows += [(500, None), (501, ""), (502, "one two"), (503, "one two"), (504, " ONE two ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = results(jaccard.similarity_classes(df, width, percent, unit=unit))
    assert sorted(got) == brute_classes(rows, width, percent)


def long_words_alike(times=10):
    """The word of Thue and Morse over two letters, and its complement: equal hashes modulo 2 ** 64 for every base."""
    a, b = "a", "b"
    for _ in range(times):
        a, b = a + b, b + a
    return a, b


def test_words_that_collide(spark):
    one, other = long_words_alike()
    head = "one two three four five six seven eight nine "
    rows = [(1, head + one), (2, head + other), (3, head.upper() + one)]
    df = prepared(spark).createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(results(jaccard.similarity_classes(df, 3, 90))) == brute_classes(rows, 3, 90) == [(1, 8, 1), (2, 8, 2), (3, 8, 1)]
    item = [(7, head + one)]
    assert results(decontamination.digests(decontamination.find(df, spark.createDataFrame(item, "item_id bigint, text string")))) == brute_hits(rows, item)
    found = decontamination.occurrences(__import__("pyarrow").array([head + other]), decontamination.windows([("7", head + one)]))
    assert found[1] == [[]]


def test_hashes_that_collide_are_spelled_out(monkeypatch, spark):
    """Were all words of a length equal by hash, results would be the same: hits and links are confirmed on bytes."""
    import numpy as np

    from keyweave.llm import common

    real = common._block_hashes
    weak = lambda *a: (lambda h, s, e: ((e - s).astype(np.uint64), s, e))(*real(*a))
    windows = decontamination.windows([("7", "a cat sat on the old mat by my bed")])
    monkeypatch.setattr(common, "_block_hashes", weak)
    with pytest.raises(ValueError, match="collide"):
        decontamination.windows([("7", "a cat sat on the old mat by my bed")])
    names = np.sort(np.array([len(w) for w in ["a", "sat", "on", "abbot"]], dtype=np.uint64))
    assert decontamination._spelled_so(*(np.array(x) for x in ([99, 97, 116], [0], [3], [0])), windows.spelling, windows.spelled).tolist() in ([True], [False])
    assert jaccard.alike(b"A b c d", b"a  b c d", 3, 90) and not jaccard.alike(b"a b c d", b"a b c e", 3, 90) and len(names) == 4
    sets = [np.array([1, 2, 3], dtype=np.uint64)] * 3
    assert jaccard.classes_in(sets, 90, lambda x, y: {x, y} == {0, 2}).tolist() in ([0, 1, 0], [2, 1, 2])


@pytest.mark.parametrize("percent", [90, 60])
def test_classes_of_many_sets(percent):
    """The T-occurrence search against all pairs, with classes that meet late and lists of every length."""
    import random

    import numpy as np

    rng = random.Random(percent)
    bases = [rng.sample(range(10_000), 60) for _ in range(6)]
    bases += [[*bases[0][:45], *bases[1][:15]], [*bases[2][:30], *bases[3][:30]]]
    sets = []
    for _ in range(400):
        s = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            s[rng.randrange(len(s))] = rng.randrange(10_000, 10_400)
        sets.append(np.unique(np.array(s[: rng.choice([60, 60, 57, 50])], dtype=np.uint64)))
    root = list(range(len(sets)))

    def find(x):
        return x if root[x] == x else find(root[x])

    plain = [set(s.tolist()) for s in sets]
    for i in range(len(plain)):
        for j in range(i):
            if 100 * len(plain[i] & plain[j]) >= percent * len(plain[i] | plain[j]):
                root[find(i)] = find(j)
    got = jaccard.classes_in(sets, percent).tolist()
    want = [find(i) for i in range(len(sets))]
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_connected(spark):
    from keyweave.llm.components import connected

    edges = [(1, 2), (2, 1), (2, 3), (3, 3), (7, 7), (9, 8), (9, 8), (None, 4), (5, None), *((k, k + 1) for k in range(20, 60))]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | {k: 20 for k in range(20, 61)}
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_many_items_share_a_passage():
    """Pairs of document and item are spread in parts, and a list of items that windows share is met once."""
    import pyarrow as pa

    passage = " ".join(f"p{k * 31 % 997}" for k in range(40))
    w = decontamination.windows([(str(k), passage + f" tail{k}") for k in range(2000)])
    assert len(w.first) - 1 == 2001 and len(w.members) == 4000
    texts = [passage, "none of it", passage + " tail5 x"] * 400
    words, spans, pairs = decontamination.occurrences(pa.array(texts), w)
    assert len(pairs[0]) == 400 * 3
    parts = list(decontamination._named(len(texts), pairs, w))
    assert len(parts) > 1 and [len(x) for _, _, found in parts for x in found] == [2000, 0, 2000] * 400
    assert spans[0] == [(0, 40, 0, len(passage))] and words[1] == 3


def test_long_items_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE", 3)
    text = " ".join(f"W{k}" for k in range(40))
    docs = [(k, " ".join(f"w{j}" for j in range(k, k + 12))) for k in range(0, 34, 3)]
    df, item = prepared(spark).createDataFrame(docs, "doc_id bigint, text string"), [(1, text), (2, "w3 w4")]
    bench = spark.createDataFrame(item, "item_id bigint, text string")
    for block in (1 << 20, 30):
        assert results(decontamination.digests(decontamination.find(df, bench, block_bytes=block))) == brute_hits(docs, item)


def test_ids_that_are_no_integers_are_refused(spark):
    df = spark.createDataFrame([("a", "text")], "doc_id string, text string")
    with pytest.raises(TypeError, match="doc_id"):
        suffix_dedup.kept_bytes(df)
    with pytest.raises(TypeError, match="doc_id"):
        token_files.write_sequences(df, WORDS, "unused")


def test_huge_texts_are_hashed_in_segments(spark, docs, monkeypatch):
    want = results(exact_dedup.duplicate_groups(docs))
    monkeypatch.setattr(exact_dedup, "SEGMENT", 64)
    assert results(exact_dedup.duplicate_groups(docs)) == want
    assert results(exact_dedup.duplicate_groups(docs, primes=(2, 3))) == want
    assert exact_dedup.drop_duplicates(docs).count() == 7


def test_quality_is_the_plain_discriminant(spark):
    """The fitted classes and scores against the textbook formulas on the same statistics."""
    import numpy as np
    import pyarrow as pa

    sf = "/root/testdata/sf0.001"
    docs, labels = (prepared(spark).read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    train = [i for i in marks if i in texts and zlib.crc32(str(i).encode()) % 5]
    x = quality.statistics(pa.array([texts[i] for i in train]))
    y = np.array([marks[i] for i in train])
    parts = [x[y == k] for k in (0, 1)]
    pooled = np.mean([np.trace(np.cov(p.T, bias=True)) for p in parts]) / x.shape[1]
    logs = []
    ids = sorted(texts)
    z = quality.statistics(pa.array([texts[i] for i in ids]))
    for p in parts:
        c = np.cov(p.T, bias=True)
        c = (1 - quality.SHRINK) * c + quality.SHRINK * np.diag(np.diag(c)) + max(quality.RIDGE * pooled, 1e-9) * np.eye(len(c))
        d = z - p.mean(axis=0)
        logs.append(np.log(len(p) / len(x)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
    got = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert np.allclose([got[i] for i in ids], want, atol=1e-5)


def test_pipeline_stages_on_edges(spark, docs, none, tmp_path):
    import sentencepiece

    import corpus_pipeline

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for name, rows in (("docs", docs.withColumn("n_chars", F.length("text"))), ("none", none.withColumn("n_chars", F.lit(1)))):
        folder = f"{tmp_path}/{name}"
        rows.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame(BENCH, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, run in corpus_pipeline.STAGES[1:]:
            done = run(spark, now, folder)
            if stage != "tokenize":
                assert done.columns == now.columns
                done.write.parquet(f"{folder}/{stage}")
                now = spark.read.parquet(f"{folder}/{stage}")
        texts = {r.doc_id: r.text or "" for r in now.collect()}
        ids = {r.doc_id: r for r in done.collect()}
        assert {i: r.ids for i, r in ids.items()} == {i: [sp.bos_id(), *sp.encode(t), sp.eos_id()] for i, t in texts.items()}
        assert all(r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(sp.decode(r.ids).encode()).hexdigest() for r in ids.values())
        assert len(ids) == done.count() == (7 if name == "docs" else 0)
        assert corpus_pipeline.run(spark, folder).count() <= len(texts)


def test_shingle_join_edges(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(docs, 3, 90).collect()}
    assert got[2] == (0, 2) and got[3] == (0, 3) and got[6] == (0, 6) and got[4][1] == 1 and got[None][1] is None
    one = jaccard.first_of_each(docs)
    assert one.columns == docs.columns and sorted(str(r.doc_id) for r in one.collect()) == ["1", "2", "3", "5", "6", "7", "8", "None"]
    again = jaccard.first_of_each(docs.where("doc_id IN (2, 4)").unionByName(docs.where("doc_id IN (2, 4)")))
    assert sorted(r.doc_id for r in again.collect()) == [2, 4]


@pytest.mark.parametrize("length", [4, 2048])
def test_token_files(spark, docs, length):
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(WORDS)
    folder = shared_folder(spark, "files")
    got = token_files.sequences_of(spark, docs, WORDS, f"{folder}/s", f"{folder}/m", length=length, n_files=3).collect()
    ids = {r: [*tokens.encode(t or "", add_special_tokens=False).ids, 2] for r, t, _ in DOCS}
    start, want = 0, []
    for r in sorted((r for r, _, _ in DOCS), key=lambda r: (r is not None, r or 0)):
        want.append((r, start, len(ids[r]), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[r]))))
        start += len(ids[r])
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    manifest = spark.read.parquet(f"{folder}/m").collect()
    file = token_files.SequenceFile(f"{folder}/s", manifest[0].name)
    values, mask = file.sequence(0)
    assert len(values) == len(mask) == length


def test_words_are_encoded_as_texts():
    encoder = token_files.WordEncoder(WORDS, entries=3)
    texts = [t or "" for _, t, _ in DOCS] + ["A. b,c. d...e ., .", "<|startoftext|> <|ENDOFTEXT|>x", "İstanbul Σας ΑΣ.", "don't DON'T. 'S v1.2", "ª. º, ŉ. ẞ. ß###"]
    assert encoder.by_word and encoder.lowers
    assert encoder.encode(texts * 2) == encoder._each(texts * 2)


CHATS = [
    (1, 0, "system", "be <<SYS>> nice"), (1, 1, "user", "hi [INST] \\s \\a"), (1, 2, "assistant", "</s> yes"), (1, 3, "user", None), (1, 4, "assistant", "[/INST] "),
    (2, 0, "assistant", "too soon"), (2, 1, "user", "x"), (3, 0, "user", ""), (4, 0, "tool<<ROLE>>", "out"), (4, 1, None, "who"), (5, None, "user", "a"), (5, None, "user", "a"), (None, 0, "user", "lost"),
]


def test_chat_format(spark):
    rows = spark.createDataFrame(CHATS, "conv_id bigint, turn bigint, role string, text string").withColumn("loss", F.lit(1)).repartition(3)
    formatted = chat_format.format_chats(chat_format.conversations(rows))
    back = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    want = defaultdict(list)
    for c, t, role, text in sorted(CHATS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        want[c].append((role or "", text or ""))
    assert {c: [tuple(t) for t in r.turns] for c, r in back.items()} == want
    assert {c: r.loss_text for c, r in back.items()} == {c: "".join(t for role, t in turns if role == "assistant") for c, turns in want.items()}
    assert {c: (r.valid, r.wrong_turn) for c, r in back.items()} == {1: (True, None), 2: (False, 0), 3: (True, None), 4: (False, 0), 5: (False, 1), None: (True, None)}
    controls = chat_format.Template().controls
    text = {r.conv_id: r.formatted for r in formatted.collect()}[1]
    assert {c: text.count(c) for c in controls} == {"<<SYS>>": 1, "[INST]": 2, "[/INST]": 2, "</s>": 5, "<<ROLE>>": 0, "<</ROLE>>": 0}


def test_chat_spans_of_long_conversations(spark):
    text = "aé</s>\\s[INST]"
    rows = spark.range(30_001).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    talks = chat_format.conversations(rows)
    back = chat_format.digests(chat_format.read_back(chat_format.format_chats(talks))).first()
    learned = text * 15_000
    assert (back.n_turns, back.loss_chars, back.valid) == (30_001, len(learned), True)
    assert back.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    empty = spark.createDataFrame([(1, [])], "conv_id int, turns array<struct<turn:int,role:string,text:string>>")
    found = chat_format.read_back(chat_format.format_chats(empty)).first()
    assert (found.turns, found.loss_text, found.formatted, found.valid) == ([], "", "", False)
