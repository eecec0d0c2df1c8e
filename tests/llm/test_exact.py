"""URL cascade, SimHash, suffix automaton, word BPE and transducer against brute force."""

import hashlib
import random

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import functions as F
from pyspark.sql import types as T
import pytest
import xxhash

import corpus_pipeline
from studyloom.llm import common, graph, overlap, simhash, suffix_automaton, transducer, url_cascade, word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " \n\t", "One two  three. It's THE <|endoftext|> end<|endoftext|>", "Äpfel é  x y 中文字 12345 !!! don't", "a" * 3000,
         "the the the the", "the the the the", "naïve café\x1cfile\x85 next", "<|ENDOFTEXT|> <|startoftext|>", "x\x00y " * 20, "word " * 5000]


def documents(spark, texts=TEXTS):
    """Repeated rows, null ids, and extra columns whose names the operators use themselves."""
    rows = [(i if i != 2 else None, t, "x", 1.5, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, unit string, score double, fingerprint string") if len(rows) > 3 else spark.createDataFrame(rows, "doc_id long, text string, unit string, score double, fingerprint string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def judged(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut].translate(str.maketrans(common.UPPER, common.LOWER)), rest[cut:]
        path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else default


@pytest.mark.parametrize("shard_keys", [url_cascade.SHARD_KEYS, 2])
def test_url_cascade(spark, shard_keys):
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/1?x#y", "https://www.example.com/en/2", "http://a.www.example.com/en/", "ftp://x.net/es/a", "x.net/fr/", "http://net/fr/",
            "http://notexample.com/en/", "http://example.com", "http://example.org/en/", "http://example.com?u=http://a.net/fr/", "http://.com/", "http://a..com/\nb", "://", "http://Ä.COM/"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate([*urls, urls[3]])], "page_id long, url string, rule string")
    rules = spark.createDataFrame(url_cascade.RULES, "host string, path string, verdict string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_cascade.judge(pages, rules, shard_keys=shard_keys).collect()}
    assert got == {i: judged(u, url_cascade.RULES) for i, u in enumerate([*urls, urls[3]])}
    assert url_cascade.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_cascade.judge(pages, rules.limit(0), "block").collect()} == {"block"}


def test_cascade_is_exact(spark):
    keys = [f"key{i}" for i in range(4000)]
    universe = spark.createDataFrame([(k, i % 7 == 0) for i, k in enumerate(keys)], "key string, listed boolean").select(*url_cascade.hashed(F.col("key")), "listed").cache()
    cascade = url_cascade.build(universe)
    rows = universe.toPandas()
    listed = cascade.listed(rows["h1"].to_numpy("i8").view("u8"), rows["h2"].to_numpy("i8").view("u8"))
    assert len(cascade.levels) > 1 and (listed == rows["listed"].to_numpy()).all()
    assert sum(len(x[0]) for x in cascade.levels) < 4000  # far under the keys themselves


def plain_print(text, n=4):
    words = "".join(common.LOWER[common.UPPER.index(c)] if c in common.UPPER else c for c in text or "")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs, nodes):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {n: top(n) for n in nodes}


def test_fingerprints(spark):
    got = [(r["doc_id"], r["fingerprint"] % (1 << 64)) for r in simhash.fingerprints(documents(spark)).collect()]
    wanted = [(None if i == 2 else i, plain_print(t)) for i, t in enumerate(TEXTS)]
    assert sorted(got, key=str) == sorted([*wanted, wanted[3]], key=str)


@pytest.mark.parametrize("part", [simhash.PART, 8])
def test_links_lose_nothing(spark, part):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(12)} | {0, 15, (1 << 64) - 1}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    prints = spark.createDataFrame([(v, i) for i, v in enumerate(signed)], "fingerprint long, first long")
    linked = graph.components(simhash.link_fingerprints(prints, part=part))
    got = {r["node"]: r["component"] for r in linked.collect()}
    close = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) % (1 << 64)).bit_count() <= 4]
    wanted = plain_components(close, signed)
    assert {v: got.get(v, v) for v in signed} == wanted


def test_near_duplicates(spark):
    long = " ".join(f"w{i}" for i in range(400))
    docs = documents(spark, [long, None, "", long + " tail", "other words here and there", "fewer", "FEWER", long])
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(0, 0), (1, 1), (None, 1), (3, 0), (4, 4), (5, 5), (6, 5), (7, 0)}
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [0, 1, 4, 5]
    assert simhash.keep_one(docs).columns == docs.columns
    assert simhash.near_duplicates(empty(spark)).count() == 0


def near_copies(rng, n):
    """Texts and copies with 1 to 8 words replaced, and what brute force links at five-word similarity 0.8."""
    texts = []
    for i in range(n):
        base = [f"v{rng.randint(0, 5000)}" for _ in range(rng.randint(100, 400))]
        copy = list(base)
        for at in rng.sample(range(len(copy)), rng.randint(1, 8)):
            copy[at] = f"r{rng.randint(0, 10**6)}"
        texts += [" ".join(base), " ".join(copy)]
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    return texts, [i for i in range(n) if len(sets[2 * i] & sets[2 * i + 1]) >= 0.8 * len(sets[2 * i] | sets[2 * i + 1])]


@pytest.mark.parametrize("part", [overlap.PART, 8])
def test_pipeline_finds_similarity_of_four_fifths(spark, part):
    texts, wanted = near_copies(random.Random(11), 300)
    hot = "one common start " * 3 + " ".join(f"h{i}" for i in range(150))
    texts += [hot + f" end{i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in overlap.near_duplicates(docs, part=part).collect()}
    linked = {i for i in range(300) if got[2 * i + 1] == 2 * i}
    assert linked <= set(wanted) and len(linked) >= 0.99 * len(wanted) and 100 < len(wanted) < 300
    assert {got[i] for i in range(600, 640)} == {600}
    if part == overlap.PART:
        kept = {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, "").collect()}
        assert kept == {i for i, c in got.items() if i == c}


def test_pipeline_links_by_simhash(spark):
    """Entries whose SimHashes are within 4 bits are candidates, and only links that hold exactly stay."""
    base = [f"v{i}" for i in range(400)]
    texts = [" ".join(base), " ".join(base + ["tail"]), " ".join(f"x{i}" for i in range(300)), "", "one two", "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = spark.createDataFrame([(overlap.entry_of(s), simhash.set_print([s])) for s in (overlap.shingle_set(t.encode()) for t in texts[:5] if t)], "fingerprint long, simhash long")
    a, b = (overlap.entry_of(overlap.shingle_set(t.encode())) for t in texts[:2])
    assert {(min(r), max(r)) for r in overlap.simhash_links(prints).collect()} == {(min(a, b), max(a, b))}
    got = {r["doc_id"]: r["component_id"] for r in overlap.near_duplicates(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 4}


def test_null_and_repeated_ids_stand_for_themselves(spark):
    a, b, c = ("".join(f"{x}{i} " for i in range(400)) for x in "abc")
    rows = [(None, a, None, "x"), (None, b, "x", None), (7, c, "x", "x"), (7, "quite another text", "x", "x"), (3, c + "more", "x", "x"), (3, "alone", "x", "x"),
            (9, "equal rows", "x", None), (9, "equal rows", "x", None), (None, a + "more", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `n``odd.name` string, more string")
    for stage in (simhash.keep_one, lambda d: corpus_pipeline.one_of_each(spark, d, "")):
        got = stage(docs)
        kept = sorted((tuple(r) for r in got.collect()), key=str)
        assert got.columns == docs.columns and len([r for r in kept if r[0] is None and r[1].startswith("a")]) == 1
        rest = [r for r in kept if not r[1].startswith("a0")]
        assert rest == sorted([rows[1], rows[3], rows[4], rows[5], rows[6]], key=str)


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(5, 5), (2, 1)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1300)}}


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = common.LOWER[common.UPPER.index(c)] if c in common.UPPER else c
        if c in common.LOWER or "0" <= c <= "9" or ord(c) >= 0x80:
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def hits(text, items, window):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        v = words(item)
        n = min(len(v), window)
        for i in range(len(v) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j:j + n] == v[i:i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("limits", [{}, {"block_chars": 60, "round_bytes": 2000}])
def test_windows(spark, limits):
    rng = random.Random(3)
    vocab = [*"abcdefgh", "Äh", "x1"]
    some = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, some(rng.randint(0, 16))) for i in range(25)] + [(30, None), (31, "!!"), (32, "same same same same same same"), (None, some(12)), (3, some(9))]
    texts = [None, "", "?!", *[some(rng.randint(1, 60)) for _ in range(30)], "same " * 40, *[some(4) + ",\n" + (t or "") + ".X " + some(5) for _, t in items[:12]]]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffix_automaton.match(docs, benchmark, window=6, **limits).collect()
    named = [("" if n is None else n, t) for n, t in items]
    assert {r["doc_id"]: (r["n_words"], sum(s["b"] - s["a"] for s in r["spans"]), r["items"]) for r in got} == {i: hits(t, named, 6) for i, t in enumerate(texts)}
    cleaned = {r["doc_id"]: r["text"] for r in suffix_automaton.clean(docs, benchmark, window=6).collect()}
    for i, t in enumerate(texts):
        n, hit, _ = hits(t, named, 6)
        assert (i in cleaned) == (n == 0 or hit <= n * suffix_automaton.MAX_COVERAGE)
        assert i not in cleaned or hits(cleaned[i], named, 6)[1] == 0
        assert hit or cleaned[i] == t


def test_cleaning_in_rounds(spark):
    rng = random.Random(8)
    some = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    benchmark = spark.createDataFrame([(i, some(rng.randint(3, 16))) for i in range(40)], "item_id long, text string")
    texts = [None, "", *[some(rng.randint(1, 80)) for _ in range(60)], *["x " * 30 + r["text"] + " y" * 30 for r in benchmark.collect()]]
    docs = spark.createDataFrame([(i if i % 5 else None, t, len(t or ""), i) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, row long")
    whole, parts = (sorted(map(tuple, suffix_automaton.clean(docs, benchmark, window=6, **limits).collect()), key=lambda r: r[3])
                    for limits in ({}, {"block_chars": 100, "round_bytes": 3000}))
    assert whole == parts and sum(r[1] != texts[r[3]] for r in whole) > 30 and len(whole) < len(texts)
    assert len(suffix_automaton._in_rounds(benchmark, 6, 3000, 100)[1]) > 2


def test_windows_without_rows(spark):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert {tuple(r["items"]) for r in suffix_automaton.match(documents(spark), benchmark).collect()} == {()}
    assert suffix_automaton.match(empty(spark), benchmark).count() == 0
    assert suffix_automaton.clean(documents(spark), benchmark).count() == len(TEXTS) + 1


@pytest.mark.parametrize("unit_bytes", [word_bpe.UNIT_BYTES, 4000])
def test_encoding_is_the_library_s(spark, unit_bytes):
    t = word_bpe.tokenizer(PATH)
    got = {r["doc_id"]: (bytes(r["ids"]), r["text"]) for r in word_bpe.decode(word_bpe.encode(documents(spark), PATH, unit_bytes), PATH).collect()}
    for i, text in enumerate(TEXTS):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i if i != 2 else None] == (np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False))
    assert word_bpe.encode(empty(spark), PATH).count() == 0


def test_decoding_of_odd_ids(spark):
    rows = [(1, np.array([320, 10**6, 321], "<u4").tobytes()), (2, None), (3, b"")]
    got = {r["doc_id"]: r["text"] for r in word_bpe.decode(spark.createDataFrame(rows, "doc_id long, ids binary"), PATH).collect()}
    piece = word_bpe.tokenizer(PATH).id_to_token
    assert got == {1: f"{piece(320)} {piece(321)}", 2: "", 3: ""}


@pytest.mark.parametrize("least", [1, 3, 10**6])
def test_counts_are_the_library_s(spark, least):
    t = word_bpe.tokenizer(PATH)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in transducer.count_tokens(documents(spark), PATH, least=least).collect()}
    assert got == {i if i != 2 else None: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in enumerate(TEXTS)}
    assert transducer.count_tokens(empty(spark), PATH).count() == 0


def test_transducer_over_chunk_borders():
    rng = random.Random(1)
    known = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))).encode() for _ in range(300)]
    known = sorted(set(known))
    machine = transducer.compile_words(known, [len(w) for w in known])
    picked = [rng.choice(known) for _ in range(4000)]
    joined = b" ".join([*picked, b""])
    out = machine.emitted(machine.classes[np.frombuffer(joined, np.uint8)])
    assert out[out != 0].tolist() == [len(w) for w in picked]
    odd = machine.emitted(machine.classes[np.frombuffer(b"a" * 2000 + b" zz ", np.uint8)])
    assert (odd < 0).sum() == 2


def test_digest_columns(spark, tmp_path):
    from studyloom.llm.queries import QUERIES

    documents(spark, ["one two three", None]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op6_word_bpe"](spark, str(tmp_path)).collect()}
    assert got[1]["n_tokens"] == 0 and got[1]["ids_sha256"] == got[1]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[0]["n_tokens"] == len(word_bpe.tokenizer(PATH).encode("one two three", add_special_tokens=False).ids)


def test_whole_rows_as_ids(spark):
    docs = documents(spark).withColumn("n`odd.name", F.lit(1))
    whole = docs.select(F.struct(*[docs[f"`{c.replace('`', '``')}`"] for c in docs.columns]).alias("doc_id"), "text")
    assert isinstance(common.shape(whole, "text", more="long")["doc_id"].dataType, T.StructType)
    assert pd.Series(common.shape(whole, "text", more="long").names).tolist() == ["doc_id", "text", "more"]
