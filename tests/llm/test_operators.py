"""The operators against brute force, laws and round trips, on small tables with every awkward row."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracelab.llm import ivfpq, langid, merkle, mixing, packing, queries, repair, ring, simhash, token_counts, toxicity
from tracelab.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, kept long, n long"
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def rows():
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    texts = [BASE, BASE, BASE + " x", "", None, " ", "  two  spaces \n\n here ", "a<|endoftext|>b c", "日本 語 👍🏽", "Ünïcode é é", "\x00nul \x1c x", long, long + " end", "x", "Don't STOP it's 123  4\t5"]
    out = [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], 0, 1, "r", 2, 3) for i, t in enumerate(texts)]
    return [*out, out[0], (None, BASE, None, None, None, None, None, None, None), (None, None, "en", "a", 0, 0, "", 0, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered():
    """In order of id, then of the text's XXH64 (as a signed number)."""
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64
    return sorted(((r[0], r[1] or "") for r in rows()), key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))


def test_token_output_round_trip(docs):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for i, t in ordered():
        ids = [*own.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = repair.token_output(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


@pytest.mark.parametrize("kept", [1_000_000, 50])
def test_encoder_against_library(monkeypatch, kept):
    """Random texts of awkward pieces, with cuts kept and not."""
    monkeypatch.setattr(repair, "KEPT_WORDS", kept)
    monkeypatch.setattr(repair, "TOGETHER", 7)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own, rng = Tokenizer.from_file(path), repair.Encoder(path), np.random.default_rng(3)
    bits = [" ", " ", " ", "the", "wörd", "'s", "12", ".", "\n", "\n\n", "\t", "<|endoftext|>", "<|", "\u00a0", "\u0120x", "日本", "👍🏽", "\x00", "\r\n", "…", "\u2003", "A"]
    for _ in range(6):
        texts = ["".join(bits[i] for i in rng.integers(0, len(bits), rng.integers(0, 25))) for _ in range(200)]
        assert any(" \x00" in t for t in texts)
        n, ids = own(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_with_other_tokenizers():
    """One that drops spaces can't be cut at them: every text is encoded whole."""
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), repair.Encoder(path)
    texts = ["a \x00b", "Some words here, 12 of them", "", " x ", "some words here"]
    n, ids = own(texts)
    assert own.whole and [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("first", [50_257, 40, 100_000])
def test_shard_random_access(first):
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 50, 400)
    lengths[7] = 3000
    ids = rng.choice(40, lengths.sum(), p=np.arange(40, 0, -1) / 820).astype(np.uint32)
    image = repair.pack_shard(ids, lengths, first)
    back, tokens = repair.unpack_shard(image)
    left, right, rule_lengths, _, _, symbols, _ = repair.parts(image)
    assert (back == ids).all() and len(left) > 0
    # what rules cost is less than what they save
    size = symbols.itemsize
    assert size * (len(symbols) + 2 * len(left)) + 4 * len(left) < 0.85 * size * len(ids)
    for k in (0, 7, 399):
        own = ids[tokens[k] : tokens[k + 1]]
        assert (repair.unpack_document(image, k) == own).all()
        for start, stop in [(0, 1), (len(own) // 2, len(own) // 2 + 9), (len(own) - 1, None), (5, 5), (0, 10**6), (-3, None)]:
            assert (repair.unpack_document(image, k, start, stop) == own[start:stop]).all()


def test_grammar_is_finished(monkeypatch):
    """No pair that pays for a rule is left, also where more pairs tie than a round takes."""
    monkeypatch.setattr(repair, "PAIRS", 50)
    own = np.random.default_rng(1).permutation(2000)
    ids = np.concatenate([np.r_[own, 0]] * 9).astype(np.uint32)
    ends = np.zeros(len(ids), bool)
    ends[2000::2001] = True
    left, right, lengths, s, ends = repair.repair(ids, ends, 50_257)
    counts = Counter((a, b) for a, b, e in zip(s[:-1].tolist(), s[1:].tolist(), ends[:-1].tolist(), strict=True) if not e)
    assert max(counts.values(), default=0) < repair.LEAST and len(s) < 200 and lengths.max() > 100


def test_token_counts(docs):
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((str(i), len(t.encode()), len(own.encode(t, add_special_tokens=False).ids)) for i, t in ordered())
    got = token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)


@pytest.mark.parametrize("slack", [0.0, 0.2])
def test_ring(spark, docs, slack):
    many = spark.range(5000).selectExpr("id as doc_id", "repeat('x', cast(id % 7 as int)) as text")
    got = ring.shard(many, 24, slack=slack).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == 5000
    assert max(counts.values()) - min(counts.values()) <= 1 if slack == 0 else max(counts.values()) <= np.ceil(1.2 * 5000 / 24)
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    if slack:
        grown = {r.doc_id: r.shard for r in ring.shard(many, 25, slack=slack).collect()}
        assert sum(grown[r.doc_id] != r.shard for r in got) < 0.35 * 5000
    else:
        # ideal: one row in 25
        grown = {r.doc_id: r.shard for r in ring.shard(many, 25, slack=slack).collect()}
        assert sum(grown[r.doc_id] != r.shard for r in got) < 0.08 * 5000
    odd = ring.shard(docs, 24, slack=slack).collect()
    assert len(odd) == len(rows()) and {r.text_crc32 for r in odd} == {zlib.crc32((r[1] or "").encode()) for r in rows()}


def test_merkle_matches_sql(spark, docs):
    documents = table(spark, SF, "documents")
    for frame in (documents, docs.select("doc_id", "text")):
        local = frame.toPandas()  # noqa: F841  read by DuckDB
        con = duckdb.connect()
        con.sql("create view documents as select cast(doc_id as bigint) as doc_id, text from local")
        want = con.sql(queries.MERKLE_SQL).fetchall()
        got = merkle.edited_fingerprints(frame).collect()
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_next_in_small_ranges(spark, docs, monkeypatch):
    """Ranges of a few rows, with null, repeated and text ids, against a sorted list."""
    monkeypatch.setattr(merkle, "RANGE_ROWS", 5)
    same = [(None, f"none {i}") for i in range(40)] + [(7, f"seven {i % 9}") for i in range(60)] + [(i, f"own {i}") for i in range(50)]
    for frame in (docs.select("doc_id", "text"), spark.createDataFrame(same, "doc_id long, text string").repartition(4), spark.createDataFrame([(None if i is None else f"k{i}", t) for i, t in same], "doc_id string, text string")):
        own = sorted(((r.doc_id is not None, r.doc_id or type(r.doc_id or 0)(), hashlib.md5((r.text or "").encode()).hexdigest(), r.text or "") for r in frame.collect()), key=lambda r: r[:3])
        want = Counter((a[3], b[3]) for a, b in zip(own, [*own[1:], own[0]], strict=True))
        assert Counter((r.text, r.next_text) for r in merkle.with_next(frame, "doc_id", "text").collect()) == want


@pytest.mark.parametrize(("of", "ranges"), [("id", 40), ("text", 40), ("row", 40)])
def test_no_range_holds_most_rows(spark, monkeypatch, of, ranges):
    """A third of all rows without ids, of one id, or equal: no task of op1 or op4 has much more than the median."""
    monkeypatch.setattr(merkle, "RANGE_ROWS", 100)
    n = 4000
    rows = [(None if of == "id" else 77, f"text {i}" if of != "row" else "same") if i % 3 == 0 else (1000 + i, f"own {i}") for i in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = merkle.with_next(frame, "doc_id", "text").collect()
    own = sorted(((i is not None, i or 0, hashlib.md5(t.encode()).hexdigest(), t) for i, t in rows))
    assert Counter((r.text, r.next_text) for r in got) == Counter((a[3], b[3]) for a, b in zip(own, [*own[1:], own[0]], strict=True))
    seen = []
    real = merkle._followed
    monkeypatch.setattr(merkle, "_followed", lambda rows, bounds, kind: seen.append((rows, bounds)) or real(rows, bounds, kind))
    merkle.with_next(frame, "doc_id", "text")
    ((used, bounds),) = seen
    keys = sorted((r.key.id is not None, r.key.id or 0, r.key.m) for r in used.select("key").collect())
    cuts = [(b.id is not None, b.id or 0, b.m) for b in bounds]
    sizes = Counter(sum(c <= k for c in cuts) for k in keys)
    assert len(sizes) > ranges / 2 and max(sizes.values()) <= 6 * np.median(list(sizes.values()))
    # op1's ranges
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = repair.write_shards(frame, repair.shared_path(spark, "hot"), public_tokenizers.path("byte_bpe_50k.json"))
        sizes = [r.n for r in shards.groupBy("part").agg(F.sum(F.size("doc_ids")).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == n and len(sizes) > 8 and max(sizes) <= 2 * np.median(sizes)


def test_merkle_locates_edits(spark):
    text = "".join(f"Sentence number {i} says {i * i}.\n" for i in range(200))
    both = spark.createDataFrame([(text, text.replace("number 150 says", "number 150 said"))], "a string, b string")
    r = both.select(merkle.fingerprint(both.a).alias("a"), merkle.fingerprint(both.b).alias("b")).withColumn("c", merkle.changed(F.col("a"), F.col("b"))).first()
    assert r.a != r.b and 1 <= len(r.c) <= 2


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in low).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_simhash(spark, docs):
    documents = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    for frame, data in ((table(spark, SF, "documents"), documents), (docs, [(r[0], r[1]) for r in rows()])):
        fps = [slow_fingerprint(t or "") for _, t in data]
        comp = brute_components(set(fps))
        least = defaultdict(list)
        for (i, _), f in zip(data, fps, strict=True):
            if i is not None:
                least[comp[f]].append(i)
        want = sorted(str((i, f"{f:016x}", min(least[comp[f]], default=None))) for (i, _), f in zip(data, fps, strict=True))
        assert sorted(str(tuple(r)) for r in simhash.near_duplicates(frame).collect()) == want


@pytest.mark.parametrize("spread", [2, 5])
def test_links_of_near_fingerprints(spark, spread):
    """A dense group, chains, and random ones: small and large buckets must join what all pairs would."""
    rng = np.random.default_rng(spread)
    fps = {0x0123456789ABCDEF}
    while len(fps) < 500:
        f = 0x0123456789ABCDEF
        for b in rng.integers(0, 64, spread):
            f ^= 1 << int(b)
        fps.add(f)
    chain = 0xFFFF0000FFFF0000
    for _ in range(40):
        chain ^= sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        fps.add(chain)
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(frame)).collect()}
    comp = brute_components(fps)
    groups, own = defaultdict(set), defaultdict(set)
    for f in fps:
        s = int(np.uint64(f).astype(np.int64))
        groups[comp[f]].add(s)
        own[got.get(s, s)].add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, own.values()))


def test_keep_one(spark, docs):
    kept = simhash.keep_one(docs).select("doc_id", "text").collect()
    found = simhash.near_duplicates(docs, 5, least=0.8).collect()
    assert len(kept) == len({r.component_id for r in found}) and {r.doc_id for r in kept} == {r.component_id for r in found}


def test_keep_one_of_each_component(spark):
    """Components without ids, and with ids that other components have as well."""
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcdef"}
    own = [(None, text["a"]), (None, text["a"]), (None, text["b"]), (None, text["c"]), (None, text["c"] + " end"), (7, text["d"]), (7, text["e"]), (7, text["e"]), (None, text["e"] + " end"), (8, text["e"] + " end"), (9, text["f"])]
    kept = [tuple(r) for r in simhash.keep_one(spark.createDataFrame(own, "doc_id long, text string")).collect()]
    one = [r for r in kept if (r[1] or "").startswith("c")]
    assert len(one) == 1 and one[0] in own
    assert Counter(r for r in kept if r not in one) == Counter([(None, text["a"]), (None, text["b"]), (7, text["d"]), (7, text["e"]), (9, text["f"])])


@pytest.mark.parametrize("small", [32, 3])
def test_similar_texts(spark, monkeypatch, small):
    """Edited copies, some in large buckets, against all pairs."""
    rng = np.random.default_rng(small)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(40):
        base = rng.choice(words, rng.integers(4, 160)).tolist()
        texts.append(base)
        for _ in range(rng.integers(0, 6)):
            own = list(texts[-1] if rng.random() < 0.4 else base)
            for at in rng.integers(0, len(own), rng.integers(1, 4)):
                own[at] = "changed"
            texts.append(own + rng.choice(words, rng.integers(0, 8)).tolist())
    texts = [" ".join(t) for t in texts]
    sets = [set(zip(*[t.split()[k:] for k in range(5)], strict=False)) or {tuple(t.split())} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    monkeypatch.setattr(simhash, "SMALL", small)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame, 5, least=0.8).collect()}
    assert got == {i: find(i) for i in range(len(texts))} and len(set(got.values())) < len(texts)


@pytest.mark.parametrize("small", [32, 1])
def test_similar_texts_with_repeats(spark, monkeypatch, small):
    """Texts of the same distinct shingles, or nearly, whose fingerprints are far apart since one repeats a phrase."""
    phrase = "again and again we say "
    texts = []
    for k in range(12):
        base = " ".join(f"t{k}w{i}" for i in range(60)) + " "
        texts += [base + phrase * 2, base + phrase * 120]
    far = [k for k in range(0, len(texts), 2) if (simhash.fingerprint_of(texts[k], 5) ^ simhash.fingerprint_of(texts[k + 1], 5)).bit_count() > 24]
    assert far
    monkeypatch.setattr(simhash, "SMALL", small)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame, 5, least=0.8).collect()}
    assert all(got[k] == got[k + 1] for k in far)


def test_parities_never_tell_similar_sets_apart():
    """The parities differ in no more places than the sets, of any sizes; sets that are far apart are told so."""
    rng = np.random.default_rng(6)
    pairs = []
    for n in (0, 1, 5, 40, 400, 3000):
        for share in (0.0, 0.02, 0.1, 0.5, 1.0):
            x = np.unique(rng.integers(0, 2**64, n, np.uint64))
            pairs.append((x, np.unique(np.r_[x[rng.random(len(x)) >= share], rng.integers(0, 2**64, int(share * n * 1.3), np.uint64)])))
    told = simhash.odd_differences([simhash.parities(x) for x, _ in pairs], [simhash.parities(y) for _, y in pairs])
    for (x, y), n in zip(pairs, told.tolist(), strict=True):
        alone = len(np.setxor1d(x, y))
        assert n <= alone and (alone < 200 or n > 0.3 * alone)


def test_packing(docs):
    got = packing.pack(docs, shard_pieces=7).collect()
    assert sum(r.n_tokens for r in got) == sum(len((r[1] or "").encode().split()) + 1 for r in rows())
    bins = defaultdict(list)
    for r in got:
        bins[r.shard, r.bin].append(r)
    for held in bins.values():
        end = 0
        for r in sorted(held, key=lambda r: r.bin_offset):
            assert r.bin_offset == end
            end += r.n_tokens
        assert held[0].bin_size == min(x for x in packing.LENGTHS if x >= end)
    pieces = sorted(np.random.default_rng(1).integers(1, 3000, 4000).tolist(), reverse=True)
    _, _, sizes = packing.pack_pieces(pieces)
    assert sum(pieces) / sum(sizes) > 0.97


def test_mixing(spark, docs):
    documents = table(spark, SF, "documents")
    words = {r.doc_id: (r.source, len(r.text.encode().split()) + 1) for r in documents.collect()}
    tokens = Counter()
    for s, n in words.values():
        tokens[s] += n
    total = sum(tokens.values())

    def weights(a):
        p = {s: (n / total) ** a for s, n in tokens.items()}
        return {s: x / sum(p.values()) for s, x in p.items()}

    low, high = 0.0, 1.0
    most = lambda a: max(total * w / tokens[s] for s, w in weights(a).items())
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if most(mid) <= 1.5 else (mid, high)
    got = mixing.mix(documents, max_repeats=1.5, block_rows=3).collect()
    want = weights(high)
    streams = defaultdict(list)
    for r in got:
        assert r.weight == pytest.approx(want[r.source], abs=1e-6)
        streams[r.source].append(r)
    for s, stream in streams.items():
        stream.sort(key=lambda r: r.start_token)
        end = 0
        for r in stream:
            assert r.start_token == end and r.n_tokens == words[r.doc_id][1]
            end += r.n_tokens
        assert end - stream[-1].n_tokens < total * want[s] <= end + 1e-3
        full = [r.doc_id for r in stream if r.repeat == 0]
        assert len(set(full)) == len(full)
    odd = mixing.mix(docs, max_repeats=2.0).collect()
    assert {r.source for r in odd} == {"a", "b", None}


@pytest.mark.parametrize("target", [0.3, 1.1, 1.31, 1.38])
def test_mixing_to_an_entropy(spark, target):
    """Exponents below and above 1 against a plain bisection; sources of 1000, 500, 250 and 250 tokens have 1.21 nats at 1."""
    sizes = {"a": 1000, "b": 500, "c": 250, None: 250}
    own = [(i, "w " * (n // 10 - 1), s) for s, n in sizes.items() for i in range(10)]
    low, high = 0.0, 64.0

    def weights(a):
        p = {s: (n / 1000) ** a for s, n in sizes.items()}
        return {s: x / sum(p.values()) for s, x in p.items()}

    entropy = lambda w: -sum(x * np.log(x) for x in w.values() if x)
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (low, mid) if entropy(weights(mid)) <= target else (mid, high)
    got = mixing.mix(spark.createDataFrame(own, "doc_id long, text string, source string"), target_entropy=target, max_repeats=None).collect()
    found = {r.source: r.weight for r in got}
    assert entropy(found) == pytest.approx(target, abs=1e-6)
    assert found == pytest.approx(weights(high), abs=1e-6) and (high > 1) == (target < 1.2)


def test_mixing_uses_every_document(spark, tmp_path):
    """The query: one source of most rows stands once, small ones are raised up to twice, and no document is left out."""
    own = [(i, "w " * 9, "large" if i < 700 else "middle" if i < 900 else None) for i in range(1000)]
    spark.createDataFrame(own, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op7_temperature_mixing(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(range(1000))
    uses = Counter(r.source for r in got)
    middle = 3.5 ** (np.log(2) / np.log(7))
    assert uses["large"] == 700 and uses[None] == 200 and uses["middle"] == np.ceil(200 * middle)
    weights = {r.source: r.weight for r in got}
    assert weights == pytest.approx({"large": 700 / (900 + 200 * middle), "middle": 200 * middle / (900 + 200 * middle), None: 200 / (900 + 200 * middle)}, abs=1e-6)


def test_mixing_out_of_reach(spark):
    frame = spark.createDataFrame([(0, "a b", "x"), (1, "a b", "y"), (2, "a b c d e", "z")], "doc_id long, text string, source string")
    for how in ({"target_entropy": 1.2}, {"target_entropy": -0.1}, {"max_repeats": 1.5, "budget": 1000}):
        with pytest.raises(ValueError):
            mixing.mix(frame, **{"max_repeats": None} | how)


def test_mixed_documents(spark, docs):
    """Rows that share id and text, in several tasks, divide their uses evenly; nothing else is used more or less."""
    same = [(5, "one two three", "a")] * 40 + [(None, "four five", "b")] * 30 + [(None, "six", "b")] * 7 + [(i, f"word {i}", "c") for i in range(6, 20)]
    frame = spark.createDataFrame(same, "doc_id long, text string, source string").repartition(5)
    uses = Counter((r.doc_id, r.n_tokens) for r in mixing.mix(frame, max_repeats=1.4).collect())
    got = Counter((r.doc_id, len(r.text.split()) + 1) for r in mixing.mixed_documents(frame, max_repeats=1.4).collect())
    assert uses == got and {v for k, v in uses.items() if k[0] == 5}.isdisjoint({40})
    used = mixing.mixed_documents(docs, max_repeats=2.0)
    assert used.columns == docs.columns and used.count() == mixing.mix(docs, max_repeats=2.0).count()


@pytest.mark.parametrize("block", [4096, 64])
def test_neighbours(spark, monkeypatch, block):
    """Against all pairs: equal vectors, repeated ids, another dimension, and rows that take no part."""
    monkeypatch.setattr(ivfpq, "BLOCK", block)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16))
    x[100:300] = x[100]
    data = [(i, v.tolist(), "a", 1.5) for i, v in enumerate(x)]
    data += [(20, (x[20] + 9).tolist(), "b", 0.0), (40, x[40].tolist(), "c", 0.0), *[(3000 + i, [float(i), 2.0], "d", 0.0) for i in range(30)]]
    odd = [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [1.0, None] * 8), (None, [1.0] * 16), (1080, [])]
    frame = spark.createDataFrame([*data, *[(*r, "e", None) for r in odd]], "vec_id long, embedding array<double>, id string, score double")
    got = defaultdict(list)
    for r in ivfpq.search(frame).collect():
        got[r.query_id, r.query_row].append((r.rank, r.vec_id, r.score))
    assert Counter(q for q, _ in got) == Counter(r[0] for r in data if r[0] % 20 == 0)
    want = defaultdict(list)
    for k, (i, v, *_) in enumerate(data):
        if i % 20 == 0:
            others = [(-float(np.dot(v, w)), j) for m, (j, w, *_) in enumerate(data) if m != k and len(w) == len(v)]
            want[i].append(sorted(others)[:20])
    hits = 0
    for (q, _), found in got.items():
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 21))
        assert found == sorted(found, key=lambda f: (-round(f[2], 9), f[1]))
        hits += max(len({i for _, i, _ in found} & {i for _, i in best}) for best in want[q])
    assert hits >= 0.9 * 20 * len(got)
    alone = ivfpq.search(spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 0.0])], "vec_id long, embedding array<float>")).collect()
    assert [tuple(r)[:4] for r in alone] == [(0, 1, 1, 2.0)]


def test_neighbours_recall(spark):
    """Recall over whole tables, with the parameters of the query."""
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    data = sorted((r.vec_id, r.embedding) for r in vectors.select("vec_id", "embedding").collect())
    ids, x = np.array([i for i, _ in data]), np.array([v for _, v in data], np.float64)
    got = defaultdict(set)
    for r in ivfpq.search(vectors).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for k in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[k]
        scores[k] = -np.inf
        hits += len(got[int(ids[k])] & set(ids[np.argsort(-scores, kind="stable")[:20]].tolist()))
    assert hits >= 0.93 * 20 * (ids % 20 == 0).sum() and all(len(v) == 20 for v in got.values())


@pytest.mark.parametrize("kind", ["tails", "clusters", "shift"])
def test_neighbours_of_any_rows(spark, monkeypatch, kind):
    """All of the nearest are found where few rows have most of the length, lie close together, or one component decides; the
    sample is smaller than the table."""
    monkeypatch.setattr(ivfpq, "SAMPLE", 600)
    monkeypatch.setattr(ivfpq, "BLOCK", 512)
    rng = np.random.default_rng(8)
    n, d = 3000, 32
    x = rng.normal(size=(n, d))
    if kind == "tails":
        x *= np.abs(rng.standard_cauchy((n, 1)))
    elif kind == "clusters":
        x = x[rng.integers(0, 100, n)] + 0.01 * x
    else:
        x = 0.1 * x + 100 * np.eye(d)[0]
    got = defaultdict(list)
    for r in ivfpq.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)).collect():
        got[r.query_id].append((r.rank, r.vec_id))
    for k in range(0, n, 20):
        scores = x @ x[k]
        scores[k] = -np.inf
        assert [i for _, i in sorted(got[k])] == np.argsort(-scores, kind="stable")[:20].tolist()


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(2)
    syllables = ["ba", "ko", "ri", "tu", "mel", "san", "dor"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    data, marks = [], []
    for i in range(900):
        words = [word() for _ in range(60)]
        if toxic := int(i % 3 == 0):
            for k in rng.integers(0, 60, 3):
                words[k] = rng.choice(["grimblot", "vexnard", "zoggler"])
        data.append((i, " ".join(words)))
        marks.append((i, toxic))
    docs = spark.createDataFrame([*data, (900, None), (901, ""), (None, "ba ko grimbloot grimbl0t ri")], "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert len(got) == 903 and np.mean([r.predicted == int(r.doc_id % 3 == 0) for r in held]) > 0.97
    assert next(r.score for r in got if r.doc_id is None) > 0.7
    assert toxicity.toxicity(docs, labels.limit(0)).count() == 903
    assert toxicity.reject(docs, labels).count() == sum(1 - r.predicted for r in got)


def test_language_held_out(spark, docs):
    documents = table(spark, "/root/testdata/sf0.01", "documents")
    langs = {r.doc_id: r.lang for r in documents.select("doc_id", "lang").collect()}
    got = langid.language_id(documents).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(langs) and np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.97
    odd = {r.doc_id: r for r in langid.language_id(docs).collect()}
    assert odd[3].lang_pred == odd[4].lang_pred == odd[5].lang_pred == "und" and odd[0].lang_pred in ("en", "de")
    assert langid.reject(docs).columns == docs.columns


def test_many_languages(spark):
    """More languages than 64, each with its own letters."""
    rng = np.random.default_rng(5)
    own = [(14 * k + i, " ".join("".join(chr(0x4E00 + 20 * k + c) for c in rng.integers(0, 20, 4)) for _ in range(40)), f"l{k:02}") for k in range(70) for i in range(14)]
    got = {r.doc_id: r.lang_pred for r in langid.language_id(spark.createDataFrame(own, "doc_id long, text string, lang string")).collect()}
    right = Counter(lang for i, _, lang in own if got[i] == lang)
    assert len(right) == 70 and sum(right.values()) > 0.97 * len(own)
    assert langid.fit([("aa bb", "x"), *[("cc dd", "y")] * 9], seed=0).languages == ["x", "y"]


def slow_packing(pieces, lengths, overhead):
    """Best fit by looking at every open bin, its cost by adding up all pieces that wait."""
    bins, placed = [], []
    for k, n in enumerate(pieces):
        open_bins = [b for b, (size, held, _) in enumerate(bins) if size - held >= n]
        if open_bins:
            # the least room; of equal rooms the one that came to it last
            least = min(bins[b][0] - bins[b][1] for b in open_bins)
            at = max((b for b in open_bins if bins[b][0] - bins[b][1] == least), key=lambda b: bins[b][2])
        else:
            best = None
            for size in lengths:
                if size >= n:
                    room, waiting = size - n, sum(p for p in pieces[k + 1 :] if p <= min(size - n, n))
                    cost = (size + overhead) / (n + min(room, waiting))
                    if best is None or cost < best[0]:
                        best = cost, size
            bins.append([best[1], 0, k])
            at = len(bins) - 1
        placed.append((at, bins[at][1]))
        bins[at] = [bins[at][0], bins[at][1] + n, k]
    return placed, [min(x for x in lengths if x >= held) for _, held, _ in bins]


@pytest.mark.parametrize("seed", range(6))
def test_packing_against_all_bins(seed):
    rng = np.random.default_rng(seed)
    lengths = (16, 32, 64)
    pieces = sorted(rng.integers(1, 65 if seed % 2 else 20, 150).tolist(), reverse=True)
    bins, offsets, sizes = packing.pack_pieces(pieces, lengths, 4)
    placed, want = slow_packing(pieces, lengths, 4)
    assert list(zip(bins, offsets, strict=True)) == placed and sizes == want


@pytest.mark.parametrize("arc_rows", [100_000, 7])
def test_ring_against_a_walk(spark, monkeypatch, arc_rows):
    """Every key walks clockwise from its hash to the first shard with room, the owners' own keys first."""
    monkeypatch.setattr(ring, "ARC_ROWS", arc_rows)
    shards, vnodes = 5, 4
    frame = spark.range(400).selectExpr("id % 90 as doc_id", "'x' as text").repartition(3)
    got = ring.shard(frame, shards, vnodes).collect()
    points, owners = ring.ring_points(shards, vnodes)
    hashes = {r.doc_id: r.h for r in frame.select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().collect()}
    arcs = Counter(int(np.searchsorted(points, hashes[r.doc_id]) % len(points)) for r in got)
    room, own, left = ring.capacities(400, shards, 0).tolist(), Counter(), {}
    for a in range(len(points)):
        s = owners[a]
        n = min(arcs[a], room[s])
        own[a, s], room[s], left[a] = n, room[s] - n, arcs[a] - n
    for a in range(len(points)):
        at = a
        while left[a]:
            at = (at + 1) % len(points)
            n = min(left[a], room[owners[at]])
            own[a, owners[at]] += n
            room[owners[at]] -= n
            left[a] -= n
    found = Counter((int(np.searchsorted(points, hashes[r.doc_id]) % len(points)), r.shard) for r in got)
    assert found == Counter({k: v for k, v in own.items() if v})
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(80)) for s in range(shards))


def test_clashing_names(spark):
    """Columns of labels and documents that share names with each other and with what operators make."""
    docs = spark.createDataFrame([(i, f"text of {i % 4} ko ri", "s", i, "x", 2.0, 1) for i in range(60)], "doc_id long, text string, source string, toxic int, id string, score double, of int")
    labels = spark.createDataFrame([(i, i % 4 // 3, "other", 0.0) for i in range(60)], "doc_id long, toxic int, text string, score double")
    assert toxicity.toxicity(docs, labels).columns == ["doc_id", "held_out", "score", "predicted"] and toxicity.reject(docs, labels).columns == docs.columns
    assert mixing.mixed_documents(docs).columns == docs.columns and ring.shard(docs).count() == 60 and packing.pack(docs).count() == 60
    assert simhash.keep_one(docs).columns == docs.columns


def test_clashing_names_of_readers(spark):
    """Columns named like those that op1, op3, op4, op5 and op6 make or use inside."""
    names = ["id", "hash", "row", "key", "bucket", "times", "lang_pred", "score", "start", "n_tokens", "n_bytes", "held_out", "of", "share", "part", "guard", "next_text"]
    docs = spark.createDataFrame([(i, f"text of {i % 4} and more", "en" if i % 2 else "de", *range(len(names))) for i in range(40)], "doc_id long, text string, lang string, " + ", ".join(f"{n} int" for n in names))
    path = public_tokenizers.path
    assert repair.token_output(docs, path("byte_bpe_50k.json")).select("doc_id", "start", "n_tokens", "ids_crc32").count() == 40
    assert sorted(r.doc_id for r in merkle.edited_fingerprints(docs).collect()) == list(range(40))
    assert token_counts.count_tokens(docs, path("word_bpe_49k.json")).select("n_bytes").distinct().count() == 1
    assert {r.lang_pred for r in langid.language_id(docs).collect()} <= {"en", "de"}
    vectors = spark.createDataFrame([(i, [float(i + 1), 1.0], *range(8)) for i in range(40)], "vec_id long, embedding array<double>, id int, v int, query_id int, rank int, score int, cell int, block int, codes int")
    assert ivfpq.search(vectors).where("query_id in (0, 20)").count() == 40


def test_pipeline(spark, tmp_path):
    """All stages over rows of every awkward kind, against what each may do to its input."""
    import corpus_pipeline

    rng = np.random.default_rng(9)
    words = {"en": "the lamp shines over quiet water while boats come home again".split(), "de": "das licht scheint über stilles wasser wenn boote wieder heim kommen".split()}
    text = lambda lang, n: " ".join(rng.choice(words[lang], n)) + f" {rng.integers(10**9)}"
    rows = [(i, text("de" if i % 3 else "en", 60), "de" if i % 3 else "en", f"s{i % 4}", 0) for i in range(300)]
    marks = [(i, 1, 0) for i in range(300)]
    for i in range(300, 360):
        own = text("en", 60).split()
        for k in rng.integers(0, 60, 6):
            own[k] = rng.choice(["grimblot", "vexnard"])
        rows.append((i, " ".join(own), "en", "s1", 0))
        marks.append((i, 0, 1))
    copied = rows[7][1]
    rows += [(400 + i, copied, "de", "s2", 0) for i in range(40)] + [(450, copied + " end", "de", "s2", 0), (451, copied.replace("wasser", "see", 1), "de", None, 0)]
    rows += [rows[5], rows[5], (None, rows[9][1], "en", "s1", 0), (None, None, None, None, None), (460, "", "en", "s1", 0), (461, "123 456", "en", "s1", 0), (462, text("en", 30_000), "en", "s1", 0)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(str(tmp_path / "t" / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "t" / "labels.parquet"))
    own = str(tmp_path / "t")
    docs, steps = table(spark, own, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, own)
        docs.write.parquet(path := str(tmp_path / f"{len(steps)}"))
        docs = spark.read.parquet(path)
        steps.append((before, docs))
    for before, after in steps[:4]:
        assert after.columns == before.columns
    ids = [{r.doc_id for r in after.select("doc_id").collect()} for _, after in steps]
    toxic = set(range(300, 360))
    assert len(toxic - ids[0]) >= 55 and set(range(300)) <= ids[0]
    assert {460, 461} & ids[1] == set() and set(range(300)) <= ids[1] and 462 in ids[1]
    # copies, a longer and a changed copy, repeated rows: one stays
    assert ids[2] & ({7, 450, 451} | set(range(400, 440))) == {7} and steps[2][1].where("doc_id = 5").count() == 1 and steps[2][1].where("doc_id is null").count() == 0
    assert set(range(300)) - {7} <= ids[2] | {7}
    uses, want = Counter(r.doc_id for r in steps[3][1].collect()), Counter(r.doc_id for r in mixing.mix(steps[2][1]).collect())
    assert uses == want
    packed = steps[4][1].collect()
    sizes = {r.doc_id: len((r.text or "").encode().split()) + 1 for r in steps[3][1].collect()}
    assert sum(r.n_tokens for r in packed) == sum(sizes[i] * n for i, n in uses.items())
    assert corpus_pipeline.run(spark, own).columns == steps[4][1].columns


def test_empty_tables(empty):
    path = public_tokenizers.path
    assert repair.token_output(empty, path("byte_bpe_50k.json")).count() == 0
    assert token_counts.count_tokens(empty, path("word_bpe_49k.json")).count() == 0
    assert ring.shard(empty).count() == merkle.edited_fingerprints(empty).count() == simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == packing.pack(empty).count() == mixing.mix(empty).count() == mixing.mixed_documents(empty).count() == 0
    assert langid.language_id(empty).count() == langid.reject(empty).count() == 0
    assert toxicity.toxicity(empty, empty.selectExpr("doc_id", "cast(n as int) as toxic")).count() == 0
    assert ivfpq.search(empty.selectExpr("doc_id as vec_id", "cast(null as array<float>) as embedding")).count() == 0
