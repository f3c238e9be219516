"""Language-model scoring with a probabilistic suffix tree over words.

The symbols are the distinct words of the training texts (between ASCII white space, A-Z folded), one symbol for all
unknown words, and the end of a text. A context is the last symbols before a token, up to ``DEPTH`` of them within its
text, the start of the text included. A context is a candidate if at least ``LEAST_COUNT`` training tokens follow it:
an absolute count, so the tree grows with the corpus. It is retained if the distribution of the next symbol diverges
from that after the suffix one symbol shorter: count times Kullback-Leibler divergence of at least ``DIVERGENCE`` nats
for each different next symbol. Distributions are smoothed down the chain of suffixes by as many pseudo-counts as there
are different next symbols; the empty context's is add-one over all symbols, which is the base model. A token is scored
in the state of the longest retained suffix of what precedes it, so the score is the log10 probability that the tree
gives to the sequence of symbols.

Nothing of the tree is broadcast or collected. A task writes its texts as chunks: words once, texts as numbers of words.
For each length of context in turn a chunk lists its distinct (context, next symbol) with their training counts, dealt
to parts by a hash of the context; a part sums over all chunks and tells each chunk the sums of what it listed; with them
the chunk knows its candidates of the next length. So counts are aggregated before they are shuffled, and what is
shuffled are distinct pairs of chunks, not occurrences. Contexts of two symbols or more are listed in ``TURNS``, each for
some of the parts, and the parts tell whether a context is retained instead of sending its sums. A context that more than a share ``HOT`` of all tokens follows is
dealt to as many parts as its share of them, by its next symbols. The words of the shortest contexts travel as they are;
longer contexts are named by 48 bits of a hash beside their part, and next symbols within a context by 40 bits.

Cases: a null text is empty: just the end; with nothing to train on every symbol is the unknown one and both scores are
0; words only in held-out texts have count 0; repeated rows count as often as they occur; an unbroken run of any length
is one word; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import crc_mod, documents, part_count, small_batches, store, store_bucketed

DEPTH = 2
LEAST_COUNT = 4
DIVERGENCE = 2.0
CHUNK_BYTES = 8 << 20
#: Share of all tokens from which a context is dealt to several parts.
HOT = 1 / 2_000
#: In how many turns the parts are told of longer contexts: the shuffle files of one turn are gone before the next.
TURNS = 2
#: The start of a text, among the words of a part: no word holds white space.
START = b"\t"

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW40 = np.uint64((1 << 40) - 1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ordering(key: np.ndarray) -> np.ndarray:
    """Places that sort numbers of 0 or more; equal ones keep their order where key and place fit 63 bits together."""
    bits = len(key).bit_length()
    if not len(key) or int(key.max()) >> (63 - bits):
        return np.argsort(key)
    return np.sort(key.astype(np.int64) << bits | np.arange(len(key))) & ((1 << bits) - 1)


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers of 0 or more in order, of each a place where it stands, and of every place its number's rank."""
    order = ordering(key)
    ordered = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    inv = np.empty(len(key), np.int64)
    inv[order] = np.cumsum(new) - 1
    return ordered[new], order[new], inv


def pack(values: np.ndarray) -> bytes:
    """Numbers of one type, byte by byte of their places, compressed."""
    least = np.min_scalar_type(values.max(initial=0)) if values.dtype.kind == "u" else values.dtype
    values = np.ascontiguousarray(values.astype(least))
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return least.char.encode() + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(raw: bytes) -> np.ndarray:
    kind = np.dtype(raw[:1].decode())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel()


def narrow(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each number."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widened(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def blanked(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


# ---- chunks ----------------------------------------------------------------------------------------------------


def chunked(df: DataFrame) -> DataFrame:
    """Rows (chunk, words, ids, doc_id, train, length, hot, hot_n) of documents (doc_id, text, train), dealt as they stand.

    ``words`` are the chunk's distinct words, most frequent first; ``ids`` its texts, one after another; ``hot`` the
    contexts that a share HOT of its training tokens follows.
    """
    kind = df.schema["doc_id"].dataType.simpleString()
    names = ["chunk", "words", "ids", "doc_id", "train", "length", "tokens", "hot", "hot_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, size = TaskContext.get().partitionId() << 33, 0, 0
        number: dict[bytes, int] = {}
        texts: list[np.ndarray] = []
        ids: list[pa.Array] = []
        train: list[bool] = []

        def flush() -> pa.RecordBatch:
            length = np.array([len(x) for x in texts], np.int64)
            flat = np.concatenate([np.zeros(0, np.int32), *texts])
            order = np.argsort(-np.bincount(flat, minlength=len(number)), kind="stable")
            place = np.empty(len(number), np.uint32)
            place[order] = np.arange(len(number), dtype=np.uint32)
            words = np.array([*number, None], object)[:-1][order]
            used = np.repeat(np.array(train, bool), length)
            follows = np.bincount(place[flat[used]], minlength=len(words))
            tokens = int(used.sum()) + sum(train)
            hot = np.flatnonzero(follows >= max(1, HOT * tokens)).tolist()
            listed = [words[k] for k in hot] + [START]
            counts = [int(follows[k]) for k in hot] + [sum(train)]
            columns = [[base + made], [zstandard.ZstdCompressor(level=6).compress(b"\n".join(words))], [pack(place[flat])]]
            docs = [pa.concat_arrays(ids).to_pylist(), train.copy(), length.tolist()]
            types = [pa.int64(), pa.binary(), pa.binary(), pa.list_(ids[0].type), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            values = [*columns, *([x] for x in docs), [tokens], [listed], [counts]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names)

        for b in batches:
            raw = b.column("blank").cast(pa.binary())
            told = b.column("train").to_pylist()
            for k in range(b.num_rows):
                text = raw[k].as_py()
                texts.append(np.array([number.setdefault(w, len(number)) for w in text.lower().split()], np.int32))
                ids.append(b.column("doc_id").slice(k, 1))
                train.append(told[k])
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield flush()
                    made, size = made + 1, 0
                    for x in (number, texts, ids, train):
                        x.clear()
        if texts:
            yield flush()

    schema = f"chunk long, words binary, ids binary, doc_id array<{kind}>, train array<boolean>, length array<long>, tokens long, hot array<binary>, hot_n array<long>"
    return small_batches(df.select("doc_id", "train", blanked("text").alias("blank"))).mapInArrow(run, schema)


@dataclass
class Told:
    """What all tasks know: bounded numbers, whatever the corpus."""

    parts: int
    hot: dict[bytes, int]  # frequent contexts of one symbol (at most 1 / HOT and the start) and to how many parts each is dealt
    tokens: int = 0
    kinds: int = 0
    least: int = LEAST_COUNT
    divergence: float = DIVERGENCE


@dataclass
class Level:
    """The distinct (context, next) of a chunk and how they are dealt to parts."""

    inv: np.ndarray  # of each occurrence its pair
    first: np.ndarray  # of each pair an occurrence
    context: np.ndarray  # of each pair
    n: np.ndarray  # of each pair: training occurrences
    owner: np.ndarray  # of each entry, part by part: its context
    salt: np.ndarray
    part: np.ndarray
    order: np.ndarray  # pairs, entry by entry
    entry: np.ndarray  # of each pair in that order: its entry
    key40: np.ndarray  # of each pair in that order: the next symbol
    names: np.ndarray  # of each entry
    split: np.ndarray  # of each entry: whether other parts have a share of its context

    @classmethod
    def of(cls, context: np.ndarray, symbol: np.ndarray, symbols: int, train: np.ndarray, names: np.ndarray, salts: np.ndarray, hashes: np.ndarray, parts: int) -> Level:
        key, first, inv = distinct(context.astype(np.int64) * symbols + symbol)
        of, nxt = key // symbols, key % symbols
        begin = np.cumsum(salts) - salts
        owner = np.repeat(np.arange(len(salts)), salts)
        salt = np.arange(len(owner)) - begin[owner]
        named = mixed(names[owner] + salt.astype(np.uint64) * _ODD)
        part = (named % np.uint64(parts)).astype(np.int64)
        dealt = ordering(part)
        rank = np.empty(len(dealt), np.int64)
        rank[dealt] = np.arange(len(dealt))
        short = hashes[nxt] & _LOW40
        entry = rank[begin[of] + (short % salts[of].astype(np.uint64)).astype(np.int64)]
        order = ordering(entry)
        n = np.bincount(inv, weights=train, minlength=len(key))
        return cls(inv, first, of, n, owner[dealt], salt[dealt], part[dealt], order, entry[order], short[order], named[dealt], salts[owner[dealt]] > 1)

    def rows(self, chunk: int, keys, sums: np.ndarray | None = None, asked: np.ndarray | None = None, turn: int = 0, turns: int = 1) -> pa.Table:
        """One row for each part of this turn; ``keys(i, j)`` packs the names of entries i to j.

        ``asked`` has the kinds of entries of which only the ``sums`` are listed, else 0.
        """
        cuts = np.flatnonzero(np.concatenate(([True], self.part[1:] != self.part[:-1], [True]))) if len(self.part) else np.zeros(1, np.int64)
        runs = np.bincount(self.entry, minlength=len(self.part)).astype(np.uint64)
        at = np.concatenate(([0], np.cumsum(runs))).astype(np.int64)
        n = self.n[self.order].astype(np.uint64)
        out: dict[str, list] = {k: [] for k in ("part", "keys", "runs", "next", "n", "sums", "asked", "split")}
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if self.part[i] % turns != turn:
                continue
            a, b = at[i], at[j]
            out["part"].append(int(self.part[i]))
            out["keys"].append(keys(i, j))
            out["runs"].append(pack(runs[i:j]))
            out["next"].append(narrow(self.key40[a:b], 5))
            out["n"].append(pack(n[a:b]))
            out["sums"].append(None if sums is None else pack(sums[i:j].astype(np.float32)))
            out["asked"].append(None if asked is None else pack(asked[i:j]))
            out["split"].append(None if sums is None else pack(np.packbits(self.split[i:j])))
        kinds = {"part": pa.int64(), "keys": pa.binary(), "runs": pa.binary(), "next": pa.binary(), "n": pa.binary(), "sums": pa.binary(), "asked": pa.binary(), "split": pa.binary()}
        return pa.table({"chunk": pa.array([chunk] * len(out["part"]), pa.int64()), **{k: pa.array(v, kinds[k]) for k, v in out.items()}})

    def heard(self, answers: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """From parts' answers: of each context how many tokens follow it (of the shortest), how many kinds, its sum (where
        several parts have a share), and else whether it is retained; n of each pair."""
        answers = sorted(answers, key=lambda r: r["part"])
        contexts, size = int(self.owner.max(initial=-1)) + 1, np.bincount(self.part)
        total, kinds, gain, n = (np.concatenate([np.zeros(0), *(unpack(r[c]).astype(float) for r in answers)]) for c in ("total", "kinds", "gain", "n"))
        kept = np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(unpack(r["kept"]), count=int(size[r["part"]])) for r in answers if r["kept"])])
        shared = np.flatnonzero(self.split) if len(kept) else np.zeros(0, np.int64)
        of = [self.owner[: len(total)], self.owner, self.owner[shared], self.owner[: len(kept)]]
        total, kinds, gain, kept = (np.bincount(o, weights=x, minlength=contexts) for o, x in zip(of, (total, kinds, gain, kept), strict=True))
        each = np.empty(len(self.order))
        each[self.order] = n
        return total, kinds, gain, kept > 0, each


_SENT = "chunk long, part long, keys binary, runs binary, next binary, n binary, sums binary, asked binary, split binary"
_HEARD = "of long, level int, part long, kept binary, total binary, kinds binary, gain binary, n binary, words long, tokens long"


def retained(total: np.ndarray, kinds: np.ndarray, gain: np.ndarray, divergence: float) -> np.ndarray:
    """Whether contexts of two symbols or more are, by how many tokens follow them, how many kinds, and their sums."""
    return (kinds > 0) & (gain - total * np.log(np.maximum(total, 1)) >= divergence * kinds)


def summed(level: int, rows: pa.Table, divergence: float = DIVERGENCE) -> pa.Table:
    """Of one part: for every row the sums over all rows of what it lists.

    Of longer contexts the chunk knows how many tokens follow, so the part tells whether they are retained, and sends sums
    only of those that other parts have a share of.
    """
    told = rows.to_pylist()
    runs = [unpack(r["runs"]).astype(np.int64) for r in told]
    cut_e = np.concatenate(([0], np.cumsum([len(x) for x in runs]))).astype(np.int64)
    words: dict[bytes, int] = {}
    if level == 1:
        gid = np.concatenate([np.fromiter((words.setdefault(w, len(words)) for w in r["keys"].split(b"\n")), np.int64) for r in told])
    else:
        gid = distinct(np.concatenate([widened(r["keys"], 6) for r in told]).astype(np.int64))[2]
    size = int(gid.max(initial=-1)) + 1
    runs_ = np.concatenate(runs)
    cut_p = np.concatenate(([0], np.cumsum(runs_)))[cut_e]
    of = np.repeat(gid, runs_)
    nxt = widened(b"".join(r["next"] for r in told), 5)
    n = np.concatenate([np.zeros(0, np.int64), *(unpack(r["n"]).astype(np.int64) for r in told)])
    order = np.argsort(of << 40 | nxt.astype(np.int64)) if size < 1 << 23 else np.lexsort((nxt, of))
    new = np.ones(len(order), bool)
    new[1:] = (of[order][1:] != of[order][:-1]) | (nxt[order][1:] != nxt[order][:-1])
    group = np.cumsum(new) - 1
    each = np.bincount(group, weights=n[order], minlength=int(new.sum()))
    back = np.empty(len(order), np.int64)
    back[order] = group
    context = of[order][new]
    total = np.bincount(context, weights=each, minlength=size)
    kinds = np.bincount(context, weights=each > 0, minlength=size)
    gain = np.bincount(context, weights=each * np.log(np.maximum(each, 1)), minlength=size)
    if level > 1:
        gain = gain - np.bincount(gid, weights=np.concatenate([unpack(r["sums"]) for r in told]), minlength=size)
        asked = np.concatenate([unpack(r["asked"]).astype(np.int64) for r in told])
        kinds[gid[asked > 0]] = asked[asked > 0]
        split = np.concatenate([np.unpackbits(unpack(r["split"]), count=len(x)) for r, x in zip(told, runs, strict=True)]).astype(bool)
        kept = retained(total, kinds, gain, divergence)[gid]
    plain = sum(total[k] > 0 for w, k in words.items() if not w.startswith(START) and b" " not in w)
    out = []
    for k, r in enumerate(told):
        e, p = slice(cut_e[k], cut_e[k + 1]), slice(cut_p[k], cut_p[k + 1])
        some = gid[e]
        found = [
            None if level == 1 else pack(np.packbits(kept[e])),
            pack(total[some if level == 1 else some[:0]].astype(np.uint64)),
            pack(kinds[some].astype(np.uint64)),
            pack(gain[some[:0] if level == 1 else some[split[e]]]),
            pack(each[back[p]].astype(np.uint64)),
        ]
        out.append((r["chunk"], level, r["part"], *found, int(plain) if not k else 0, int(total.sum()) if not k else 0))
    types = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 5, pa.int64(), pa.int64()]
    names = ["of", "level", "part", "kept", "total", "kinds", "gain", "n", "words", "tokens"]
    return pa.table({c: pa.array([r[k] for r in out], t) for k, (c, t) in enumerate(zip(names, types, strict=True))})


@dataclass
class Chunk:
    """A chunk's tokens, and what is known of them so far."""

    told: Told
    row: dict

    def __post_init__(self) -> None:
        raw = zstandard.ZstdDecompressor().decompress(self.row["words"])
        self.words = raw.split(b"\n") if raw else []
        ids = unpack(self.row["ids"]).astype(np.int64)
        length = np.array(self.row["length"], np.int64) + 1
        self.cuts = np.concatenate(([0], np.cumsum(length)))
        self.end, self.start = len(self.words), len(self.words) + 1
        self.symbol = np.full(int(self.cuts[-1]), self.end, np.int64)
        inside = np.ones(len(self.symbol), bool)
        inside[self.cuts[1:] - 1] = False
        self.symbol[inside] = ids
        before = np.concatenate(([self.start], self.symbol[:-1]))
        before[self.cuts[:-1]] = self.start
        self.train = np.repeat(np.array(self.row["train"], bool), length).astype(float)
        self.hashes = np.array([*map(xxhash.xxh64_intdigest, self.words), 0, 1], np.uint64)
        self.salts = np.ones(self.start + 1, np.int64)
        self.salts[self.end] = 0
        for w, k in self.told.hot.items():
            if w == START:
                self.salts[self.start] = k
        if self.told.hot:
            for at, w in enumerate(self.words):
                if w in self.told.hot:
                    self.salts[at] = self.told.hot[w]
        self.names = self.hashes
        self.level = Level.of(before, self.symbol, self.start + 1, self.train, self.names, self.salts, self.hashes, self.told.parts)
        self.at = np.arange(len(self.symbol))  # tokens with a context of the level's length

    def first_rows(self) -> pa.Table:
        names = [*self.words, b"", START]
        x = self.level

        def keys(i: int, j: int) -> bytes:
            # a context in several parts carries the number of its share; a blank is in no word
            return b"\n".join(names[c] if self.salts[c] == 1 else names[c] + b" %d" % s for c, s in zip(x.owner[i:j].tolist(), x.salt[i:j].tolist(), strict=True))

        return x.rows(self.row["chunk"], keys)

    def walk(self, answers: dict[int, list[dict]], upto: int, last: bool = False) -> np.ndarray:
        """Take in the answers on contexts of 1 .. ``upto`` symbols and, unless they are the ``last``, file those one longer.

        Returns the natural log of each token's probability in the longest retained state so far.
        """
        kept = None
        for d in range(1, upto + 1):
            total, kinds, gain, sure, n = self.level.heard(answers.get(d, []))
            if d == 1:
                total, kinds = (np.concatenate((x, np.zeros(self.start + 1)))[: self.start + 1] for x in (total, kinds))
                seen = total.copy()
                seen[self.end] = total[self.start]  # as many texts end as start
                self.seen = seen[self.symbol]
                self.chain = np.log((seen + 1) / (self.told.tokens + self.told.kinds + 1))[self.symbol]
                self.base, scores = self.chain, self.chain.copy()
                extra = np.flatnonzero(total >= self.told.least)
                sums = -self.divergence(total, n)[extra]
            else:
                size = len(self.names)
                gain, kinds, sure = (np.concatenate((x, np.zeros(size + len(extra), x.dtype))) for x in (gain, kinds, sure))
                if d == 2:  # asked beside the longer contexts: which of the shortest are retained
                    keep = np.zeros(self.start + 1, bool)
                    keep[extra] = sure[size : size + len(extra)]
                    settle(scores, keep, *kept[1:])
                total = self.totals
                keep = np.where(self.shared, retained(total, kinds[:size], gain[:size], self.told.divergence), sure[:size])
                extra, sums = extra[:0], np.zeros(0)
            self.smooth(total, kinds, n)
            if d > 1:
                settle(scores, keep, self.before, self.of, self.chain)
            if last and d == upto:
                break
            kept = kinds, self.before, self.of, self.chain
            self.lengthen(n)
            self.file(mixed(self.hashes[extra] ^ _ODD), sums, kept[0][extra])
        return scores

    def divergence(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        """This chunk's share of count times divergence from the shorter context, of each context."""
        x = self.level
        with np.errstate(divide="ignore", invalid="ignore"):
            part = np.where(x.n > 0, x.n * (np.log(n / total[x.context]) - self.chain[self.at[x.first]]), 0.0)
        return np.bincount(x.context, weights=part, minlength=len(total))

    def smooth(self, total: np.ndarray, kinds: np.ndarray, n: np.ndarray) -> None:
        """Smooth the level's distributions down to the shorter contexts'."""
        x, c = self.level, self.level.context
        shorter = self.chain[self.at[x.first]]
        candidate = total[c] >= self.told.least
        with np.errstate(divide="ignore"):
            smooth = np.where(candidate, np.log((n + kinds[c] * np.exp(shorter)) / np.maximum(total[c] + kinds[c], 1)), shorter)
        self.chain = self.chain.copy()
        self.chain[self.at] = smooth[x.inv]
        self.before, self.of = self.at, c[x.inv]

    def lengthen(self, n: np.ndarray) -> None:
        """Turn to contexts of one symbol more."""
        x, c = self.level, self.level.context
        here = self.at[x.first]
        use = np.flatnonzero((n >= self.told.least) & (self.symbol[here] != self.end))
        place = np.full(len(n), -1)
        place[use] = np.arange(len(use))
        follow = place[x.inv]
        self.names = mixed(self.names[c[use]] * np.uint64(3) + mixed(self.hashes[self.symbol[here[use]]]))
        self.totals = n[use]
        self.next = follow[follow >= 0]
        self.at = self.at[follow >= 0] + 1  # a token that is not the end has a next one in its text

    def file(self, extra: np.ndarray, sums: np.ndarray, kinds: np.ndarray) -> None:
        """Deal the contexts to parts; ``extra`` are names of contexts of which, by their ``sums`` and ``kinds``, only
        whether they are retained is asked."""
        share = self.totals / max(1, self.told.tokens)
        salts = np.where(share >= HOT, np.ceil(share * self.told.parts), 1).astype(np.int64)
        self.shared = salts > 1
        names, salts = np.concatenate((self.names, extra)), np.concatenate((salts, np.ones(len(extra), np.int64)))
        self.level = x = Level.of(self.next, self.symbol[self.at], self.start + 1, self.train[self.at], names, salts, self.hashes, self.told.parts)
        self.sums = np.bincount(x.entry, weights=(x.n * self.chain[self.at[x.first]])[x.order], minlength=len(x.owner)).astype(float)
        asked = x.owner >= len(self.names)
        self.sums[asked] = sums[x.owner[asked] - len(self.names)]
        self.asked = np.zeros(len(x.owner), np.uint64)
        self.asked[asked] = kinds[x.owner[asked] - len(self.names)]

    def rows(self, turn: int = 0, turns: int = 1) -> pa.Table:
        x = self.level
        return x.rows(self.row["chunk"], lambda i, j: narrow(x.names[i:j], 6), self.sums, self.asked, turn, turns)


def settle(scores: np.ndarray, keep: np.ndarray, tokens: np.ndarray, context: np.ndarray, chain: np.ndarray) -> None:
    """Tokens after a retained context take its probability."""
    at = tokens[keep[context]]
    scores[at] = chain[at]


# ---- scoring ---------------------------------------------------------------------------------------------------


def by_level(answers: pa.Table) -> dict[int, list[dict]]:
    out: dict[int, list[dict]] = {}
    for r in answers.to_pylist():
        out.setdefault(r["level"], []).append(r)
    return out


def chunk_rows(t: pa.Table) -> dict:
    (row,) = t.to_pylist()
    return row


def score(df: DataFrame, depth: int = DEPTH, least: int = LEAST_COUNT, divergence: float = DIVERGENCE) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score and score of every row of ``df`` (doc_id, text, train)."""
    kind = df.schema["doc_id"].dataType.simpleString()
    chunks = store_bucketed(chunked(df), "chunks", "chunk")
    parts = part_count(df)
    total = chunks.agg(F.sum("tokens")).first()[0] or 0
    frequent = chunks.select(F.explode(F.arrays_zip("hot", "hot_n")).alias("x")).groupBy("x.hot").agg(F.sum("x.hot_n").alias("n"))
    hot = {bytes(r["hot"]): -(-r["n"] * parts // total) for r in frequent.where(F.col("n") >= max(1, HOT * total)).collect()}  # at most 1 / HOT and the start
    told = Told(parts, hot, least=least, divergence=divergence)
    heard = "of", "level", "part", "kept", "total", "kinds", "gain", "n"

    def list_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield from Chunk(told, row).first_rows().to_batches()

    def sums_of(level: int, rows: DataFrame) -> DataFrame:
        return rows.groupBy("part").applyInArrow(lambda t: summed(level, t, divergence), _HEARD)

    answers = store(sums_of(1, small_batches(chunks).mapInArrow(list_first, _SENT)), "sums")
    seen = answers.agg(F.sum("words").alias("v"), F.sum("tokens").alias("n")).first()
    frequent_words = sum(w != START and k > 1 for w, k in hot.items())  # a part does not count the words it has a share of
    ends = 1 if total else 0
    told = replace(told, tokens=seen["n"] or 0, kinds=(seen["v"] or 0) + frequent_words + ends)
    answers = answers.select(*heard)

    def cogrouped(f, schema: str) -> DataFrame:
        return chunks.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(f, schema)

    def lister(known: int, turn: int):
        def list_longer(c: pa.Table, a: pa.Table) -> pa.Table:
            chunk = Chunk(told, chunk_rows(c))
            chunk.walk(by_level(a), known)
            return chunk.rows(turn, TURNS)

        return list_longer

    for d in range(2, depth + 1):
        found = [store(sums_of(d, cogrouped(lister(d - 1, turn), _SENT)).select(*heard), "sums") for turn in range(TURNS)]
        for x in found:
            answers = answers.unionByName(x)

    def add(c: pa.Table, a: pa.Table) -> pa.Table:
        row = chunk_rows(c)
        chunk = Chunk(told, row)
        logp = chunk.walk(by_level(a), depth, last=True) / np.log(10)
        begins, size = chunk.cuts[:-1], np.diff(chunk.cuts)
        sums = [np.add.reduceat(x, begins) for x in (logp, chunk.base / np.log(10), (chunk.seen > 0).astype(np.int64))]
        return pa.table({"doc_id": pa.array(row["doc_id"], c.schema.field("doc_id").type.value_type), "train": pa.array(row["train"], pa.bool_()), "n_tokens": pa.array(size, pa.int64()), "n_known": pa.array(sums[2], pa.int64()), "train_tokens": pa.array(np.full(len(size), told.tokens), pa.int64()), "base_score": pa.array(sums[1]), "score": pa.array(sums[0])})

    return cogrouped(add, f"doc_id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("train", crc_mod("doc_id", 7) != 2)
    return score(docs).withColumn("held_out", ~F.col("train")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
