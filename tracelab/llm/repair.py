"""Token-ID output: shards of ids under Re-Pair grammars, with random access to documents and within them.

A shard image is, little-endian: the four bytes RPG2; unsigned 32-bit numbers of documents, rules, symbols, tokens and the
first nonterminal; then left and right sides of the rules; unsigned 32-bit expansion lengths of the rules, each document's
first symbol (and the end), each document's first token (and the end); then the symbols. Sides and symbols have 16 bits, or
32 where the vocabulary leaves fewer than FREE nonterminals of 16 bits. No rule crosses the end of a document, so a document
is a slice of the symbols; the lengths tell which symbol holds a token without expanding those before it.
"""

from __future__ import annotations

import functools
import itertools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path

MAGIC, HEAD = b"RPG2", struct.Struct("<5I")
#: A shard is closed at this many ids.
SHARD_IDS = 1_000_000
#: Most pairs replaced in a round, and fewest occurrences of a pair that pays for its rule: a rule takes 8 bytes, an
#: occurrence saves 2.
PAIRS, LEAST = 8000, 5
#: Fewest free 16-bit nonterminals; larger vocabularies have symbols of 32 bits.
FREE = 4096
#: Texts encoded together: what is met for the first time is encoded once for all of them.
STEP = 2000
#: Cuts whose ids a worker keeps.
KEPT_WORDS = 1_000_000
#: New cuts that the library encodes in one text.
TOGETHER = 200


def width(first: int) -> tuple[str, int]:
    """The type of symbols above a vocabulary of `first` ids, and how many symbols it can tell apart."""
    return ("<u2", 1 << 16) if first <= (1 << 16) - FREE else ("<u4", 1 << 32)


def counted(s: np.ndarray, ends: np.ndarray, narrow: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different adjacent pairs within documents, where each begins in the list of places, how often it occurs, and that
    list: the places of all pairs, ascending for each."""
    if narrow:  # pair and place fit into one number
        placed = np.arange(len(s) - 1, dtype=np.uint64)
        placed |= ((s[:-1] << np.uint32(16)) | s[1:]).astype(np.uint64) << np.uint64(32)
        placed = placed[~ends[:-1]]
        placed.sort()
        pairs, at = (placed >> np.uint64(32)).astype(np.uint32), (placed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    else:
        at = np.flatnonzero(~ends[:-1])
        pairs = s[at].astype(np.uint64) << np.uint64(32) | s[at + 1].astype(np.uint64)
        order = np.argsort(pairs, kind="stable")
        pairs, at = pairs[order], at[order]
    begins = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]][: len(pairs)])
    return pairs[begins], begins, np.diff(np.r_[begins, len(pairs)]), at


def repair(ids: np.ndarray, ends: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Left and right sides of the rules, their expansion lengths, the remaining symbols, and their document-end marks.

    Each round counts all adjacent pairs within documents, takes the PAIRS most frequent ones (ties in order of the pair) and
    replaces their occurrences by nonterminals, from left to right where occurrences overlap. A pair that overlaps leave with
    fewer than LEAST occurrences gets no rule. Rounds go on until no pair pays for a rule, or no symbol is free.
    """
    kind, symbols = width(first)
    s, ends = ids.astype(np.uint32), ends.copy()
    left, right, lengths, rules = [], [], np.ones(first, np.int64), first
    while len(s) > 1 and rules < symbols:
        pairs, begins, n, at = counted(s, ends, symbols == 1 << 16)
        chosen = np.flatnonzero(n >= LEAST)
        chosen = np.sort(chosen[np.argsort(-n[chosen], kind="stable")[: min(PAIRS, symbols - rules)]])
        if not len(chosen):
            break
        n = n[chosen]
        flat = np.repeat(begins[chosen] - np.cumsum(n) + n, n) + np.arange(n.sum())
        pair_at = np.full(len(s), -1, np.int32)
        pair_at[at[flat]] = np.repeat(np.arange(len(chosen)), n)
        at = np.flatnonzero(pair_at >= 0)
        starts = np.r_[True, np.diff(at) > 1]
        place = np.arange(len(at)) - np.flatnonzero(starts)[np.cumsum(starts) - 1]
        at = at[place % 2 == 0]
        which = pair_at[at]
        used = np.bincount(which, minlength=len(chosen)) >= LEAST
        if not used.any():
            break
        at, which = at[used[which]], (np.cumsum(used) - 1)[which[used[which]]]
        shift = np.uint64(16 if symbols == 1 << 16 else 32)
        pairs = pairs[chosen[used]].astype(np.uint64)
        sides = (pairs >> shift).astype(np.int64), (pairs & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
        left.append(sides[0])
        right.append(sides[1])
        lengths = np.r_[lengths, lengths[sides[0]] + lengths[sides[1]]]
        s[at] = which.astype(np.uint32) + np.uint32(rules)
        ends[at] = ends[at + 1]
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        rules += len(pairs)
        s, ends = s[keep], ends[keep]
    join = lambda x: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    return join(left), join(right), lengths[first:], s.astype(kind), ends


def expansions(left: np.ndarray, right: np.ndarray, lengths: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every symbol, terminals included: the place of its expansion in one flat array, its length, and that array."""
    flat = np.arange(first, first + len(left), dtype=np.int64)
    while (rule := flat >= first).any():
        times = 1 + rule
        starts = np.cumsum(times) - times
        grown = np.repeat(flat, times)
        grown[starts[rule]] = left[flat[rule] - first]
        grown[starts[rule] + 1] = right[flat[rule] - first]
        flat = grown
    lengths = lengths.astype(np.int64)
    return np.r_[np.arange(first), first + np.cumsum(lengths) - lengths], np.r_[np.ones(first, np.int64), lengths], np.r_[np.arange(first), flat].astype("<u4")


def gather(index: np.ndarray, starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The slices of flat that the entries of index name, one after another."""
    n = lengths[index]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[index] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def pack_shard(ids: np.ndarray, lengths: np.ndarray, first: int) -> bytes:
    """The image of a shard of documents with the given numbers of ids (each at least 1)."""
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum(lengths) - 1] = True
    left, right, rule_lengths, symbols, ends = repair(ids, ends, first)
    doc_symbols = np.r_[0, np.flatnonzero(ends) + 1]
    doc_tokens = np.r_[0, np.cumsum(lengths)]
    head = MAGIC + HEAD.pack(len(lengths), len(left), len(symbols), len(ids), first)
    return head + left.tobytes() + right.tobytes() + b"".join(x.astype("<u4").tobytes() for x in (rule_lengths, doc_symbols, doc_tokens)) + symbols.tobytes()


def parts(image: bytes) -> tuple[np.ndarray, ...]:
    """Left and right sides, rule lengths, documents' first symbols and tokens, symbols, and the first nonterminal."""
    if image[:4] != MAGIC:
        raise ValueError("not a shard image")
    docs, rules, symbols, _, first = HEAD.unpack_from(image, 4)
    at, out, kind = 4 + HEAD.size, [], width(first)[0]
    for n, of in ((rules, kind), (rules, kind), (rules, "<u4"), (docs + 1, "<u4"), (docs + 1, "<u4"), (symbols, kind)):
        out.append(np.frombuffer(image, of, n, at))
        at += out[-1].nbytes
    return *out, first


def unpack_shard(image: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a shard and each document's first token (and the end)."""
    left, right, rule_lengths, _, doc_tokens, symbols, first = parts(image)
    starts, lengths, flat = expansions(left, right, rule_lengths, first)
    return gather(symbols, starts, lengths, flat), doc_tokens


def unpack_document(image: bytes, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids of the k-th document of a shard, or those from `start` up to `stop`, without expanding anything else.

    The stored lengths tell which symbols, and which sides of their rules, lie outside the range: those are passed over.
    """
    left, right, rule_lengths, doc_symbols, doc_tokens, symbols, first = parts(image)
    own = symbols[doc_symbols[k] : doc_symbols[k + 1]].astype(np.int64)
    size = int(doc_tokens[k + 1]) - int(doc_tokens[k])
    start, stop, _ = slice(start, stop).indices(size)
    lengths = np.ones(len(own), np.int64)
    lengths[own >= first] = rule_lengths[own[own >= first] - first]
    before = np.cumsum(lengths) - lengths
    held = slice(max(0, int(np.searchsorted(before, start, "right")) - 1), int(np.searchsorted(before, stop, "left")))
    out, stack = [], list(zip(own[held].tolist(), before[held].tolist(), lengths[held].tolist(), strict=True))[::-1]
    while stack:
        s, at, n = stack.pop()
        if at + n <= start or at >= stop:
            continue
        if s < first:
            out.append(s)
        else:
            a, b = int(left[s - first]), int(right[s - first])
            of_a = int(rule_lengths[a - first]) if a >= first else 1
            stack += [(b, at + of_a, n - of_a), (a, at, of_a)]
    return np.array(out, "<u4")


class Cuts(dict):
    """Numbers of cuts in the order in which they were first met. The head of a text, which no space precedes, is a tuple."""

    def __missing__(self, cut: str | tuple[str]) -> int:
        self[cut] = n = len(self)
        return n


class Store:
    """Starts, lengths and ids of cuts in arrays that grow by doubling, so that a batch copies only what it adds."""

    def __init__(self):
        self.starts, self.lengths, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.uint32)

    def after(self, used: int, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """The arrays with new cuts written after the first `used` ones."""
        for name, at, new in (("starts", used, starts), ("lengths", used, lengths), ("flat", int(starts[0]) if len(starts) else 0, ids)):
            if at + len(new) > len(own := getattr(self, name)):
                own = np.concatenate([own, np.zeros(at + len(new), own.dtype)])
                setattr(self, name, own)
            own[at : at + len(new)] = new
        return self.starts, self.lengths, self.flat


class Encoder:
    """Ids of whole texts under a byte-level BPE file of the tokenizers library.

    A byte-level tokenizer starts a new pre-token at every space that stands before another character and isn't part of a
    run of white space. Texts are cut there; each distinct cut is encoded once per worker, up to KEPT_WORDS cuts are kept.
    New cuts are joined by spaces into texts for the library: no pre-token spans two of them, and the first id of each is
    the only one that begins with a space. Cuts with special strings and heads of texts are encoded one by one, and so is a
    whole text with a space before white space or at its end. A tokenizer that doesn't begin a token at each such space
    encodes every text whole.
    """

    #: A cut (without its space) that can't be told apart from its neighbours, and cuts joined by spaces that hold such a one.
    joined, doubtful = re.compile(r"\s|$"), re.compile(r"<\||(?:^| )(?:\s|$)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        vocabulary = self.own.get_vocab()
        #: By id: whether it begins with a space, which byte-level models spell as U+0120.
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t[:1] == "\u0120"]] = True
        self.first, self.whole = len(self.spaced), False
        self.known = Cuts()
        #: Where kept cuts end in the store: what a batch adds beyond that is overwritten by the next.
        self.store, self.used, self.held, self.odd = Store(), 0, 0, np.zeros(0, np.int64)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.own.encode(text, add_special_tokens=False).ids, np.uint32)

    def encoded(self, cuts: list[str | tuple[str]]) -> tuple[np.ndarray, np.ndarray, list[int]] | None:
        """Numbers of ids of each cut, all ids, and the cuts that can't be told apart in a text. None if none can."""
        n, ids, odd = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], []
        alone = {i for i, w in enumerate(cuts) if type(w) is tuple}
        for i in range(0, len(cuts), TOGETHER):
            part = [w if type(w) is str else "x" for w in cuts[i : i + TOGETHER]]
            if self.doubtful.search(" ".join(part)):
                strange = [k for k, w in enumerate(part, i) if self.joined.match(w)]
                odd += strange
                alone.update(strange, (k for k, w in enumerate(part, i) if "<|" in w))
        begin = 0
        for end in [*sorted(alone), len(cuts)]:
            for i in range(begin, end, TOGETHER):
                part = cuts[i : min(i + TOGETHER, end)]
                got = self.ids(" " + " ".join(part))
                counts = np.diff(np.r_[np.flatnonzero(self.spaced[got]), len(got)])
                if len(counts) != len(part):
                    return None
                n.append(counts)
                ids.append(got)
            if end < len(cuts):
                w = cuts[end]
                ids.append(self.ids(w[0] if isinstance(w, tuple) else " " + w))
                n.append(np.array([len(ids[-1])]))
            begin = end + 1
        return np.concatenate(n), np.concatenate(ids), odd

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of each text, and all ids."""
        if self.whole:
            ids = [self.ids(t) for t in texts]
            return np.array([len(x) for x in ids], np.int64), np.concatenate([np.zeros(0, np.uint32), *ids])
        known, before = self.known, len(self.known)
        index = []
        for t in texts:
            cuts = t.split(" ")
            cuts[0] = (cuts[0],)
            index.append(np.fromiter(map(known.__getitem__, cuts), np.int64, len(cuts)))
        new = list(itertools.islice(reversed(known), len(known) - before))[::-1]
        got = self.encoded(new)
        if got is None:
            self.whole = True
            return self(texts)
        n, ids, odd = got
        self.odd = np.r_[self.odd, np.array(odd, np.int64) + before]
        whole = []
        if len(self.odd):
            for k, t in enumerate(texts):
                if np.isin(index[k], self.odd).any():
                    index[k] = np.array([before + len(new) + len(whole)])
                    whole.append(self.ids(t))
            n, ids = np.r_[n, [len(x) for x in whole]].astype(np.int64), np.concatenate([ids, *whole])
        starts, lengths, flat = self.store.after(self.used, self.held + np.cumsum(n) - n, n, ids)
        if len(known) <= KEPT_WORDS and not whole:
            self.used, self.held = self.used + len(n), self.held + len(ids)
        else:
            for w in new:
                del known[w]
            self.odd = self.odd[self.odd < before]
        of_text = [int(lengths[i].sum()) for i in index]
        return np.array(of_text, np.int64), gather(np.concatenate(index), starts, lengths, flat)


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each worker."""
    return Encoder(path)


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all texts, end_id after each, to shards in ascending order of ids, and returns their table.

    The table at `path` has a row for each shard: part and seq (their order is the order of documents), part_start (ids of
    the same part before the shard), n_tokens, doc_ids and image. Spark's writer commits whole files, so a lost executor
    leaves no half shard. Texts move once, into ranges of ids; a task holds one batch and one open shard.

    A null text counts as empty and gives end_id only. Null ids come first; rows of one id stay beside each other, ordered by
    their texts' XXH64. Ranges are cut by id, that hash and a number of the row, so rows without ids, of one id or equal
    altogether are spread over ranges like any others. Nonterminals begin after the tokenizer's last id, or after end_id. Other columns are not carried.
    """
    kind = docs.schema[id_col].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(tokenizer), TaskContext.get().partitionId()
        first = max(own.first, end_id + 1)
        names, lengths, ids, held, seq, before = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal names, lengths, ids, held, seq, before
            image = pack_shard(np.concatenate(ids), np.concatenate(lengths), first)
            row = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before]), pa.array([held]), pa.array([names], pa.list_(arrow)), pa.array([image])]
            seq, before = seq + 1, before + held
            names, lengths, ids, held = [], [], [], 0
            return pa.RecordBatch.from_arrays(row, ["part", "seq", "part_start", "n_tokens", "doc_ids", "image"])

        for batch in batches:
            arrow = batch.column(0).type
            texts, keys = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for i in range(0, len(texts), STEP):
                n, flat = own(texts[i : i + STEP])
                ends = np.cumsum(n)
                names += keys[i : i + STEP]
                lengths.append(n + 1)
                ids.append(np.insert(flat, ends, end_id))
                held += int(ends[-1]) + len(n)
                if held >= SHARD_IDS:
                    yield close()
        if names:
            yield close()

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keys = ["id", "hash", "row"]
    ordered = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "text")
    schema = f"part int, seq int, part_start long, n_tokens long, doc_ids array<{kind.simpleString()}>, image binary"
    ordered.mapInArrow(encode, schema).write.option("compression", "lz4").parquet(path)
    return docs.sparkSession.read.parquet(path)


def read_documents(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document of the shards: id, start (ids of all documents before it), n_tokens and ids_crc32, all from the images."""
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    # one row for each range of ids, however many shards it has
    totals = sorted((r.part, r.n) for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base = dict(zip((p for p, _ in totals), np.cumsum([0, *(n for _, n in totals)]).tolist(), strict=False))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, begun, keys, image = (batch.column(k)[i] for k in range(4))
                ids, tokens = unpack_shard(image.as_py())
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(tokens[:-1].tolist(), tokens[1:].tolist(), strict=True)]
                start = tokens[:-1].astype(np.int64) + base[part.as_py()] + begun.as_py()
                columns = [keys.values, pa.array(start), pa.array(np.diff(tokens).astype(np.int64)), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "start", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "part_start", "doc_ids", "image").mapInArrow(decode, f"id {kind}, start long, n_tokens long, ids_crc32 long")
    return rows.withColumnRenamed("id", id_col)


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all texts' ids to shards in the shared folder and reads every document back from them."""
    path = shared_path(docs.sparkSession, "token-shards")
    return read_documents(write_shards(docs, path, tokenizer, end_id, id_col, text_col), id_col)
