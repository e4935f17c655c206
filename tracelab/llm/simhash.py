"""SimHash near-duplicates: pigeonring candidates, exact Hamming links, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, sized, small, written

#: Most differing bits of a link; the fingerprint's segments. Chains of k segments may differ in k * DISTANCE // SEGMENTS bits.
DISTANCE, SEGMENTS, WIDTH = 3, 4, 16
#: Buckets up to this size compare all their pairs, larger ones go by leaders.
SMALL = 32
#: Least share of common shingles of similar texts.
LEAST = 0.8
#: Of large buckets of similar texts, members that all others are compared with first.
LEADERS = 4
#: Partners of a text that are compared with it in one task.
RUN = 128
#: Frequent shingles come last in the order of shingles. They are looked for in one text of HOT_SAMPLE; a shingle is frequent
#: if HOT_TEXTS of these have it, and at most MOST_HOT (8 bytes each) are known. The links don't depend on these.
HOT_SAMPLE, HOT_TEXTS, MOST_HOT = 32, 6, 200_000

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLACES = np.arange(8, dtype=np.int64) * 256


def fingerprint_of(text: str, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles (A-Z lower-cased, ASCII white space), 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - shingle] + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)]), np.uint8).reshape(-1, 8)
    counts = np.bincount((hashes + _PLACES).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * counts.ravel() > len(hashes)).tobytes(), "big")


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The sorted hashes of a text's distinct word shingles (fewer words: the whole sequence; none: an empty set)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    own = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else ()
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in own), np.uint64, len(own)))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """Columns id and fp (the fingerprint as a signed 64-bit number) of every row; a null text counts as empty."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            fps = np.array([fingerprint_of(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return arrow_map(texts, compute, f"id {kind}, fp long")


def in_budget(a: np.ndarray, b: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Whether the chain from the given segment stays within its budgets: at most k * 3 // 4 bits over each first k segments.

    The last test, over the whole ring, is the full Hamming check; pairs that fail an earlier one never reach it.
    """
    x, by = a ^ b, (segment * WIDTH).astype(np.uint64)
    ring = np.where(by == 0, x, (x >> by) | (x << ((np.uint64(64) - by) % np.uint64(64))))
    alive = np.arange(len(ring))
    for k in range(1, SEGMENTS + 1):
        mask = np.uint64((1 << WIDTH * k) - 1)
        alive = alive[np.bitwise_count(ring[alive] & mask) <= k * DISTANCE // SEGMENTS]
    out = np.zeros(len(ring), bool)
    out[alive] = True
    return out


def link_large(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the same fingerprints as all links of a bucket would, without all its pairs.

    Greedy leaders: a fingerprint within DISTANCE of a leader links to it. Two leaders' groups are compared only while they
    are apart, and only if the leaders are so near that members can link.
    """
    links, leaders, groups, radii = [], [], [], []
    rest = fps
    while len(rest):
        d = np.bitwise_count(rest ^ rest[0])
        near = d <= DISTANCE
        links += [(rest[0], m) for m in rest[near][1:]]
        leaders.append(rest[0])
        groups.append(rest[near])
        radii.append(int(d[near].max()))
        rest = rest[~near]
    heads, radii, root = np.array(leaders, np.uint64), np.array(radii), list(range(len(leaders)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i in range(len(heads)):
        d = np.bitwise_count(heads[i + 1 :] ^ heads[i])
        for j in (np.flatnonzero(d <= DISTANCE + radii[i] + radii[i + 1 :]) + i + 1).tolist():
            if find(i) != find(j):
                for m in groups[i]:
                    if len(hit := np.flatnonzero(np.bitwise_count(groups[j] ^ m) <= DISTANCE)):
                        links.append((m, groups[j][hit[0]]))
                        root[find(i)] = find(j)
                        break
    return links


def link_runs(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of all buckets (runs of equal keys) in the arrays."""
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[begins, len(keys)])
    left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for k in np.flatnonzero(sizes > SMALL):
        if links := link_large(fps[begins[k] : begins[k] + sizes[k]]):
            pairs = np.array(links, np.uint64)
            left.append(pairs[:, 0])
            right.append(pairs[:, 1])
    small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    keys, fps = keys[small], fps[small]
    for lag in range(1, SMALL):
        at = np.flatnonzero(keys[lag:] == keys[:-lag])
        if not len(at):
            break
        ok = at[in_budget(fps[at], fps[at + lag], keys[at] >> np.int64(25))]
        left.append(fps[ok])
        right.append(fps[ok + lag])
    return np.concatenate(left), np.concatenate(right)


def links(distinct: DataFrame) -> DataFrame:
    """Columns u > v: links between different fingerprints that join all fingerprints with DISTANCE or fewer differing bits.

    Pigeonring: on the ring of four 16-bit segments, a pair within 3 bits has a segment from which every chain of k segments
    differs in at most 3k // 4 bits: none in the first segment and one at most in the first two. So one half of the second
    segment is equal as well, and the pair meets in one of 8 tables under 24 equal bits. Buckets are streamed from a sorted
    shuffle; a bucket holds distinct fingerprints, however many documents share one.
    """
    segment = lambda i: F.shiftrightunsigned("fp", WIDTH * (i % SEGMENTS)).bitwiseAND((1 << WIDTH) - 1)
    half = lambda i, h: F.shiftrightunsigned(segment(i + 1), 8 * h).bitwiseAND(255)
    tables = [F.lit((2 * i + h) << 24) + segment(i) * 256 + half(i, h) for i in range(SEGMENTS) for h in (0, 1)]
    keyed = distinct.select("fp", F.explode(F.array(*tables)).alias("key")).repartition("key").sortWithinPartitions("key", "fp")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.r_[keys, batch.column(1).to_numpy()]
            fps = np.r_[fps, batch.column(0).to_numpy().view(np.uint64)]
            if not len(keys):
                continue
            done = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on in the next batch
            u, v = link_runs(keys[:done], fps[:done])
            keys, fps = keys[done:], fps[done:]
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])
        u, v = link_runs(keys, fps)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    found = arrow_map(keyed, link, "u long, v long")
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Columns node, root (its component's least node) of all nodes that have an edge (u > v).

    Alternating large-star and small-star steps. Each step is an aggregation with partial sums and a join on the node, so a
    hub's edges can be split between tasks. Each round is a written table; rounds end when the edges stay the same.
    """
    edges, state = written(edges, "edges"), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def frequent_shingles(texts: DataFrame, shingle: int) -> np.ndarray:
    """Sorted hashes of shingles that stand in many different texts (columns digest, more, text)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 200):
            sets = [shingle_set(t, shingle) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))], ["key"])

    some = texts.where(F.pmod("digest", F.lit(HOT_SAMPLE)) == 0).dropDuplicates(["digest", "more"]).select("text")
    hot = arrow_map(some, spread, "key long").groupBy("key").count().where(F.col("count") >= HOT_TEXTS)
    return np.sort(np.array([r.key for r in hot.orderBy(F.desc("count"), "key").limit(MOST_HOT).collect()], np.int64).view(np.uint64))


def heads(texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Per different text (columns digest, more, text): digest, fp, n (its shingles), and a row for each key of its head with
    rest, the number of the text's shingles from that key on.

    Shingles are ordered by hash, frequent ones last. Two texts that share `least` of their shingles share one of the first
    n - ceil(least * n) + 1 of either: those are the head. This holds for any order that is the same for all texts.
    """
    hot = frequent_shingles(texts, shingle)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            fps, sizes, keys, rests = [], [], [], []
            for text in batch.column(1).to_pylist():
                own = shingle_set(text, shingle)
                late = np.isin(own, hot, assume_unique=True) if len(hot) else np.zeros(len(own), bool)
                keys.append(np.r_[own[~late], own[late]][: len(own) - math.ceil(least * len(own) - 1e-9) + 1].view(np.int64))
                rests.append(len(own) - np.arange(len(keys[-1]), dtype=np.int32))
                fps.append(fingerprint_of(text, shingle))
                sizes.append(len(own))
            n = [len(k) for k in keys]
            take = pa.array(np.repeat(np.arange(len(n)), n))
            columns = [batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(np.array(sizes, np.int32))]
            flat = [pa.array(np.concatenate([*rests, np.zeros(0, np.int32)])), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]))]
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in columns), *flat], ["digest", "fp", "n", "rest", "key"])

    return arrow_map(texts.dropDuplicates(["digest", "more"]).select("digest", "text"), compute, "digest long, fp long, n int, rest int, key long")


def similar_runs(keys: np.ndarray, fps: np.ndarray, sizes: np.ndarray, rests: np.ndarray, roots: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs to verify in all buckets (runs of equal keys, sorted by size and digest).

    Pairs differ in fingerprint, in any number of bits: fingerprints weigh repeated shingles, so those of similar texts can
    be far apart. Texts of n and m shingles that are similar share
    least / (1 + least) * (n + m) of them, and at the first key that they share, all of these are still to come in both: so
    a pair is taken only where the rests of both are as large. That loses no pair, since every pair is looked at under each
    key it shares. Without roots, buckets over SMALL compare a few leaders with all others, those first that have most of
    their shingles still to come; with roots, only those buckets are looked at, and all pairs of members of different
    components are compared.
    """
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[begins, len(keys)])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # the largest partner that the rest of a text allows
    bound = (1 + least) / least * rests - sizes + 1e-6

    def add(a: np.ndarray, b: np.ndarray) -> None:
        ok = (sizes[b] <= bound[a]) & (sizes[a] <= bound[b])
        if roots is not None:
            ok &= roots[a] != roots[b]
        a, b = a[ok], b[ok]
        ok = fps[a] != fps[b]
        left.append(a[ok])
        right.append(b[ok])

    for begin, count in zip(begins[counts > SMALL].tolist(), counts[counts > SMALL].tolist(), strict=True):
        run = np.arange(begin, begin + count)
        if roots is None:
            for a in run[np.lexsort((fps[run], -rests[run] / np.maximum(sizes[run], 1)))[:LEADERS]]:
                add(np.full(count, a), run)
        elif (roots[run] != roots[begin]).any():
            # sizes ascend: a text looks for partners from its own place up to its bound
            upto = np.searchsorted(sizes[run], bound[run], "right")
            for i in np.flatnonzero(upto > np.arange(1, count + 1)).tolist():
                add(np.full(upto[i] - i - 1, run[i]), run[i + 1 : upto[i]])
    if roots is None:
        at = np.flatnonzero(np.repeat((counts > 1) & (counts <= SMALL), counts))
        for lag in range(1, SMALL):
            if not len(at := at[at + lag < len(keys)]) or not len(at := at[keys[at + lag] == keys[at]]):
                break
            add(at, at + lag)
    return np.concatenate(left), np.concatenate(right)


def candidates(rows: DataFrame, least: float) -> DataFrame:
    """A row for each pair to verify: a, b (digests), u, v (fingerprints); rows have root where components are known.

    Where they aren't, the members of buckets over SMALL are returned as well, for a later look: a (digest), u (fingerprint),
    key, n, rest; b and v are null. So the heads are shuffled once.
    """
    known = "root" in rows.columns
    columns = ["key", "n", "digest", "fp", "rest", *(["root"] if known else [])]
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "u", "v", "key")] + [("n", pa.int32()), ("rest", pa.int32())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shaped(**own: np.ndarray) -> list[pa.RecordBatch]:
            length = len(own["a"])
            return pa.table([pa.array(own[f.name]) if f.name in own else pa.nulls(length, f.type) for f in schema], schema).to_batches()

        def pairs(held: pa.Table) -> Iterator[pa.RecordBatch]:
            keys, sizes, digests, fps, rests, *root = (c.to_numpy() for c in held.columns)
            a, b = similar_runs(keys, fps.view(np.uint64), sizes, rests, root[0] if root else None, least)
            order = digests[a] < digests[b]
            a, b = np.where(order, a, b), np.where(order, b, a)
            # a pair that meets under many keys is told once
            _, once = np.unique(np.stack([digests[a], digests[b]]), axis=1, return_index=True)
            a, b = a[once], b[once]
            yield from shaped(a=digests[a], b=digests[b], u=fps[a], v=fps[b])
            if not known:
                counts = np.diff(np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)])
                big = np.repeat(counts > SMALL, counts)
                yield from shaped(a=digests[big], u=fps[big], key=keys[big], n=sizes[big], rest=rests[big])

        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows:
                keys = held.column(0).to_numpy()
                done = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on in the next batch
                if done:
                    yield from pairs(held.slice(0, done))
                    held = held.slice(done)
        if held is not None and held.num_rows:
            yield from pairs(held)

    placed = rows.select(*columns).repartition("key").sortWithinPartitions("key", "n", "digest")
    return arrow_map(placed, find, "a long, b long, u long, v long, key long, n int, rest int")


def parities(own: np.ndarray) -> bytes:
    """Whether each of 2 ** k ranges of hashes holds an odd number of the set's, as bits; about two to four ranges a hash."""
    k = max(6, int(np.ceil(np.log2(max(1, 2 * len(own))))))
    return np.packbits(np.bincount((own >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k).astype(np.uint8) & 1).tobytes()


def odd_differences(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """The number of ranges in which each pair's parities differ: never more than the hashes that one of both sets has alone,
    since each of these turns one parity. Of different numbers of ranges the finer ones are joined in twos."""
    out, sizes = np.zeros(len(a), np.int64), np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    for la, lb in np.unique(sizes, axis=0).tolist():
        at = np.flatnonzero((sizes[:, 0] == la) & (sizes[:, 1] == lb))
        both = []
        for values, size in ((a, la), (b, lb)):
            x = np.frombuffer(b"".join(values[i] for i in at.tolist()), np.uint8).reshape(-1, size)
            while x.shape[1] > min(la, lb):
                bits = np.unpackbits(x, axis=1).reshape(len(x), -1, 2)
                x = np.packbits(bits[:, :, 0] ^ bits[:, :, 1], axis=1)
            both.append(x)
        out[at] = np.bitwise_count(both[0] ^ both[1]).sum(1)
    return out


def beside(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """pairs (a, b, u, v) with the values (columns digest, value) of both sides, value_a and value_b.

    A digest with many partners is sent to several tasks, RUN partners each, so a hot text's pairs don't meet in one.
    """
    asked = pairs.select(F.explode(F.array("a", "b")).alias("digest")).groupBy("digest").count()
    asked = written(asked.select("digest", F.ceil(F.col("count") / RUN).cast("int").alias("runs")), "similar-asked")
    # few texts have a candidate: the others aren't moved while the list of these is short
    listed = sized(asked)
    own = values.join(listed, "digest").withColumn("run", F.explode(F.sequence(F.lit(0), F.col("runs") - 1))).drop("runs")
    for side, other in (("a", "b"), ("b", "a")):
        of = own.select(F.col("digest").alias(side), F.col("run").alias("at"), F.col("value").alias(f"value_{side}"))
        placed = pairs.join(listed.withColumnRenamed("digest", side), side).withColumn("at", F.pmod(F.xxhash64(other), F.col("runs")).cast("int")).drop("runs")
        pairs = placed.join(of, [side, "at"]).drop("at")
    return pairs


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Columns u > v: the pairs whose texts share `least` of their distinct shingles.

    Sets of n and m shingles that are that similar differ in (n + m) * (1 - least) / (1 + least) of them at most. Pairs whose
    parities differ in more are told apart by these (a few bits a shingle); the texts decide on the others.
    """

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = [shingle_set(t, shingle) for t in batch.column(1).to_pylist()]
            values = [pa.array([len(x) for x in sets], pa.int32()), pa.array([parities(x) for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.StructArray.from_arrays(values, ["n", "odd"])], ["digest", "value"])

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 2000):
            (n, a), (m, b) = (batch.column(k).flatten() for k in (4, 5))
            most = (n.to_numpy() + m.to_numpy()) * (1 - least) / (1 + least) + 1e-6
            near = odd_differences(a.to_pylist(), b.to_pylist()) <= most
            yield batch.select([0, 1, 2, 3]).filter(pa.array(near, pa.bool_()))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 200):
            good = []
            for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = shingle_set(s, shingle), shingle_set(t, shingle)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    pairs = written(pairs.where("b is not null").select("a", "b", "u", "v").distinct(), "similar-candidates")
    asked = written(pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct(), "similar-sketched")
    own = texts.join(sized(asked), "digest", "left_semi").dropDuplicates(["digest", "more"]).select("digest", "text")
    sketches = written(arrow_map(own, sketched, "digest long, value struct<n:int,odd:binary>"), "similar-parities")
    columns = ["a", "b", "u", "v"]
    pairs = arrow_map(beside(pairs, sketches).select(*columns, "value_a", "value_b"), likely, ", ".join(f"{c} long" for c in columns))
    pairs = written(pairs.distinct(), "similar-likely")
    asked = written(pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct(), "similar-read")
    own = texts.join(sized(asked), "digest", "left_semi").dropDuplicates(["digest", "more"]).select("digest", F.col("text").alias("value"))
    found = arrow_map(beside(pairs, own).select("u", "v", "value_a", "value_b"), check, "u long, v long")
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def similar_links(docs: DataFrame, near: DataFrame, shingle: int, least: float, text_col: str) -> DataFrame:
    """Columns u > v: near (such links already) and the links between fingerprints of texts that share `least` of their
    distinct shingles, as far as they join what isn't joined yet.

    Texts are told apart by 64 bits of XXH64 and 32 of CRC. 64 bits can't be searched at the distance of such texts, so candidates share a shingle of their heads. A bucket of
    heads over SMALL first compares a few leaders; what is then still apart is compared pair by pair.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("digest"), F.crc32(text.cast("binary")).alias("more"), text.alias("text"))
    found = written(candidates(heads(texts, shingle, least), least), "similar-first")
    near = written(near.unionByName(verified(found, texts, shingle, least)).distinct(), "similar-links")
    large = found.where("b is null").select("key", "n", F.col("a").alias("digest"), F.col("u").alias("fp"), "rest")
    if large.isEmpty():
        return near
    again = large.join(components(near), F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node")
    return near.unionByName(verified(candidates(again, least), texts, shingle, least)).distinct()


def _labelled(docs: DataFrame, shingle: int, id_col: str, text_col: str, least: float | None) -> tuple[DataFrame, DataFrame]:
    """Per row of docs: id, digest (of the text), fp. Per different fingerprint: of, root, component_id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest")).alias("key"), text.alias("text"))
    own = written(fingerprints(keyed, "key", "text", shingle).select("id.id", "id.digest", "fp"), "fingerprints")
    groups = own.groupBy("fp").agg(F.min("id").alias("least"))
    edges = links(groups.select("fp"))
    linked = components(edges if least is None else similar_links(docs, edges, shingle, least, text_col))
    placed = groups.join(linked, groups["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return own, written(placed.join(smallest, "root").select(F.col("fp").alias("of"), "root", "component_id"), "components")


def near_duplicates(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", least: float | None = None) -> DataFrame:
    """Per row: id, fingerprint (16 hexadecimal digits) and component_id, the smallest id reachable over links.

    Fingerprints link at DISTANCE or fewer differing bits. With `least`, those of texts that share this part of all their
    distinct shingles link as well.

    Rows with equal fingerprints are grouped first and only distinct fingerprints are compared, so copies never meet in
    pairs; which fingerprints link is exact. Null and empty texts have fingerprint zero and link like any other. Repeated
    rows stay rows. Rows with a null id take part, but the component's id is the smallest id that isn't null (null if all
    are). An empty table gives an empty result. Other columns are not carried.
    """
    own, labels = _labelled(docs, shingle, id_col, text_col, least)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return own.join(labels, own["fp"] == labels["of"]).select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", least: float | None = LEAST) -> DataFrame:
    """docs without near-duplicates: of each component (see near_duplicates), the row with the smallest id stays, with all
    its columns.

    Components are told apart by their root, so those without ids, or with ids that others have as well, keep a row each. A
    row without an id stays only where no row of its component has one. Rows of a component that share that id are told apart
    by the 64-bit hash of their text, of which the smallest stays, and exact repeats count once.
    """
    own, labels = _labelled(docs, shingle, id_col, text_col, least)
    # rows of one id and text are in one component
    groups = own.groupBy("id", "digest").agg(F.min("fp").alias("fp"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.join(labels, groups["fp"] == labels["of"]).select("id", "digest", "root", "n"), "texts-of-ids")
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("best"))
    stays = (F.col("best.digest") == F.col("digest")) & F.col("best.id").eqNullSafe(F.col("id"))
    # one row of all others stays where it is read
    other = groups.join(best, "root").select(F.col("id").alias("of"), F.col("digest").alias("by"), stays.alias("stays"), "n")
    other = written(other.where("n > 1 or not stays").drop("n"), "not-kept-once")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"))
    rows = rows.join(sized(other), (F.col("digest") == F.col("by")) & F.col("id").eqNullSafe(F.col("of")), "left")
    again = rows.where("stays").dropDuplicates(["id", "digest"])
    return rows.where("stays is null").select("row.*").unionByName(again.select("row.*"))
