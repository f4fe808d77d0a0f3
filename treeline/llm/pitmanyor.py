"""A hierarchical Pitman-Yor bigram model, sampled by blocked Gibbs over the cluster.

Every context (the word before; each its own) is a Chinese restaurant whose customers are the words that follow; its tables are
customers of one root restaurant, the parent of all contexts. The root's base is diffuse: each known word is one dish with one
table there, and all unknown words together are the event of a new dish. The state is the number of tables per (context, word);
who sits where is summed out with generalised Stirling numbers.

A sweep is exact blocked Gibbs. Given the tables, the root's word probabilities are Dirichlet (customers less the discount, and
strength plus discount times words for what is new); they are drawn as gamma variables. A gamma variable per context takes up
the dependence of its tables through their total. Given both, all table counts are independent, and each is drawn from its
conditional S(count, t) (discount g p)^t. Types of count one have one table always, so only types that occur more than once are
state; the others enter through totals.

Three groupings, each of a bounded size: *chunks* of texts (by id and text hash) are tokenised and packed; *buckets* of words
hold the types of their words; a bucket also owns its words as contexts. A word with a thousandth of all tokens or more is dealt
by context instead, over all buckets, and its sums (there are at most a thousand such words) go through the driver. Each
sweep sends, for every context of a repeated type, its tables to its owner, and the context's gamma variable back. In the end
every chunk gets its words' and types' counts back, in its own order, and scores its texts; no token is ever moved.

Scores average the predictive probabilities of the last sweeps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, mix, remainder, words, written
from .seating import draw_tables, log_stirling

SWEEPS, AVERAGED = 4, 2
STRENGTH = 1.0
SEED = 5
CHUNK_BYTES = 6 << 20  #: text bytes of a chunk
BUCKET_BYTES = 8 << 20  #: text bytes whose types make a bucket
HOT = 1000  #: a word with at least this part of all tokens is dealt by context
_SHIFT = np.uint64(16)  # word ids are 48-bit hashes
_END, _START = (int(mix(np.array([k], np.uint64))[0] >> _SHIFT) for k in (11, 12))


def stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids, text of each token, and tokens per text; every text ends with one end token."""
    n = len(column)
    h, doc = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for w in words(column):
        h.append(w.hashes >> _SHIFT)
        doc.append(w.doc)
    h, doc = np.concatenate(h), np.concatenate(doc)
    size = np.bincount(doc, minlength=n) + 1
    token = np.full(int(size.sum()), _END, np.uint64)
    token[np.arange(len(h)) + doc] = h
    return token, np.repeat(np.arange(n), size), size


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return ((ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)


def _ints(value: bytes) -> np.ndarray:
    return np.frombuffer(value, np.uint64 if value[0] else np.uint32, offset=1).astype(np.int64)


def _ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, np.uint64)


def _bytes(values: np.ndarray) -> bytes:
    """Counts with four bytes each, or eight where one needs them."""
    wide = bool(values.size and values.max() >= 1 << 32)
    return bytes([wide]) + values.astype(np.uint64 if wide else np.uint32).tobytes()


def _table(rows: Iterator[dict], schema: pa.Schema) -> pa.Table:
    """Rows as a table, with binary values compressed."""
    pack = zstandard.ZstdCompressor(level=1).compress
    columns: list[list] = [[] for _ in schema]
    for r in rows:
        for values, f in zip(columns, schema):
            v = r.get(f.name)
            values.append(pack(v) if isinstance(v, bytes) else v)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _rows(table: pa.Table) -> list[dict]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [{k: unpack(v) if isinstance(v, bytes) else v for k, v in r.items()} for r in table.to_pylist()]


def _schema(text: str) -> tuple[str, pa.Schema]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    return text, pa.schema([(n, kinds[k]) for n, k in (x.split() for x in text.split(", "))])


# ---------------------------------------------------------------- chunks


class Chunk:
    """The types of some texts in a fixed order: by bucket, then word (hot ones last), then context; and the words by home bucket."""

    def __init__(self, column: pa.Array, buckets: int, hot: np.ndarray):
        token, self.doc, self.size = stream(column)
        self.begin = np.cumsum(self.size) - self.size
        ids, at = np.unique(np.append(token, np.uint64(_START)), return_inverse=True)
        word = at[:-1]
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[self.begin] = at[-1]
        home = bucket_of(ids, buckets).astype(np.int64)
        by_home = np.argsort(home, kind="stable")
        rank = np.empty_like(by_home)  # words are numbered by home bucket from here on
        rank[by_home] = np.arange(len(by_home))
        self.ids, self.home, self.start = ids[by_home], home[by_home], int(rank[at[-1]])
        self.token = rank[word]
        types, self.type = np.unique(self.token * len(ids) + rank[context], return_inverse=True)
        self.type_word, self.type_context = np.divmod(types, len(ids))
        bucket = self.home[self.type_word]
        self.is_hot = np.isin(self.ids, hot)
        spread = self.is_hot[self.type_word]
        bucket[spread] = bucket_of(mix(self.ids[self.type_context[spread]]), buckets).astype(np.int64)
        order = np.argsort(2 * bucket + spread, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.type = place[self.type]
        self.bucket, self.type_word, self.type_context = bucket[order], self.type_word[order], self.type_context[order]

    def requests(self, held: np.ndarray) -> Iterator[dict]:
        """For each bucket: its words with training counts, hot words with types there, and how many types each of these has; the
        types' contexts and training counts, word by word."""
        train = ~held
        of_word = np.bincount(self.token, train[self.doc], len(self.ids))
        of_word[self.start] = train.sum()
        of_type = np.bincount(self.type, train[self.doc], len(self.bucket))
        for b in np.unique(np.concatenate((self.home, self.bucket))).tolist():
            w = slice(*np.searchsorted(self.home, [b, b + 1]))
            t = slice(*np.searchsorted(self.bucket, [b, b + 1]))
            word = self.type_word[t]
            heads, times = np.unique(word[self.is_hot[word]], return_counts=True)
            times = np.concatenate((np.bincount(word[~self.is_hot[word]] - w.start, minlength=w.stop - w.start), times))
            yield {
                "bucket": b, "words": self.ids[w].tobytes(), "counts": _bytes(of_word[w]), "heads": self.ids[heads].tobytes(),
                "times": _bytes(times), "contexts": self.ids[self.type_context[t]].tobytes(), "types": _bytes(of_type[t]),
            }


REQUEST = _schema("bucket int, chunk int, words binary, counts binary, heads binary, times binary, contexts binary, types binary")


# ---------------------------------------------------------------- buckets

#: ``own``: a bucket's words; ``ask``: a chunk's order; ``state``: types of count over one; ``mail``: tables to owners; ``sum``: numbers for the driver
RESTAURANT = _schema("kind int, bucket int, chunk int, peer int, words binary, counts binary, singles binary, times binary, contexts binary, types binary, tables binary, base binary, weight binary, id long, value double, gamma double")
OWN, ASK, STATE, MAIL, SUM = range(5)
#: ids of the sums that belong to no hot word
TOKENS, KNOWN, ONES, TWOS, ROOT, ROOT_ONES, ROOT_TWOS, QUIET, QUIET_WORDS, GAMMA = range(-10, 0)


def merge(rows: list[dict], buckets: int, hot: np.ndarray) -> Iterator[dict]:
    """A bucket's words, state and mail, and each chunk's order of them, from the chunks' requests."""
    rows = sorted(rows, key=lambda r: r["chunk"])
    bucket = rows[0]["bucket"]
    parts = [_ids(r["words"]) for r in rows]
    own, at = np.unique(np.concatenate(parts), return_inverse=True)
    count = np.bincount(at, np.concatenate([_ints(r["counts"]) for r in rows]), len(own)).astype(np.int64)
    cut = np.cumsum([0, *map(len, parts)])
    word = np.concatenate([np.repeat(_ids(r["words"] + r["heads"]), _ints(r["times"])) for r in rows])
    context = np.concatenate([_ids(r["contexts"]) for r in rows])
    trained = [_ints(r["types"]) for r in rows]
    train = np.concatenate(trained)
    heads, w = np.unique(word, return_inverse=True)
    openers, u = np.unique(context, return_inverse=True)
    key, of = np.unique(w * max(len(openers), 1) + u, return_inverse=True)
    n = np.bincount(of, train, len(key)).astype(np.int64)
    many = n > 1
    kind = np.minimum(n, 2).astype(np.uint8)
    number = np.cumsum(many) - 1
    sizes = np.cumsum([0, *map(len, trained)])
    for r, a, b, c, d in zip(rows, cut, cut[1:], sizes, sizes[1:]):
        mine = of[c:d]
        yield {"kind": ASK, "bucket": bucket, "chunk": r["chunk"], "words": _bytes(at[a:b]), "types": kind[mine].tobytes(), "tables": _bytes(number[mine[many[mine]]])}
    w, u, n1 = key[many] // max(len(openers), 1), key[many] % max(len(openers), 1), n[many]
    used, w = np.unique(w, return_inverse=True)
    ids = heads[used]
    total = np.bincount(w, n1, len(ids)).astype(np.int64)
    is_hot = np.isin(ids, hot)
    singles = np.zeros(len(ids), np.int64)
    singles[~is_hot] = count[np.searchsorted(own, ids[~is_hot])] - total[~is_hot]
    yield {"kind": OWN, "bucket": bucket, "words": own.tobytes(), "counts": _bytes(count)}
    state = State(bucket, ids, is_hot, singles, w, openers[u], n1, np.ones(len(n1), np.int64), None, None)
    yield state.row(buckets)
    yield from state.mail(buckets)
    # what the driver needs: sizes, counts of counts, and words without a repeated type
    real = (count > 0) & (own != np.uint64(_START))
    cold = real & ~np.isin(own, hot)
    quiet = cold & ~np.isin(own, ids)
    root = np.where(is_hot, 0, singles + np.bincount(w, minlength=len(ids)))
    ones, twos = lambda x: float((x == 1).sum()), lambda x: float((x == 2).sum())
    sums = {TOKENS: count[real].sum(), KNOWN: real.sum(), ONES: ones(n), TWOS: twos(n), ROOT: root.sum() + count[quiet].sum(), ROOT_ONES: ones(root) + ones(count[quiet]), ROOT_TWOS: twos(root) + twos(count[quiet]), QUIET: count[quiet].sum(), QUIET_WORDS: quiet.sum()}
    for i, v in sums.items():
        yield {"kind": SUM, "id": i, "value": float(v)}
    times = np.bincount(w, minlength=len(ids))
    for i in np.flatnonzero(real & ~cold).tolist():  # a hot word's singles: its count less that of its repeated types
        yield {"kind": SUM, "id": int(own[i]), "value": float(count[i]), "gamma": 0.0}
    for i in np.flatnonzero(is_hot).tolist():
        yield {"kind": SUM, "id": int(ids[i]), "value": float(-total[i]), "gamma": float(times[i])}


@dataclass
class State:
    """Types of count over one of a bucket: their words (with the singles of each), contexts, counts and tables."""

    bucket: int
    ids: np.ndarray
    is_hot: np.ndarray
    singles: np.ndarray
    word: np.ndarray
    context: np.ndarray
    count: np.ndarray
    tables: np.ndarray
    base: np.ndarray | None  # per distinct context, in the order of `owners`: tables of types of count one
    weight: np.ndarray | None  # per word: its gamma variable

    @staticmethod
    def of(row: dict, hot: np.ndarray) -> State:
        ids, times = _ids(row["words"]), _ints(row["times"])
        base = None if row["base"] is None else _ints(row["base"])
        weight = None if row["weight"] is None else np.frombuffer(row["weight"], float)
        return State(row["bucket"], ids, np.isin(ids, hot), _ints(row["singles"]), np.repeat(np.arange(len(ids)), times), _ids(row["contexts"]), _ints(row["types"]), _ints(row["tables"]), base, weight)

    def row(self, buckets: int) -> dict:
        times = np.bincount(self.word, minlength=len(self.ids))
        out = {"kind": STATE, "bucket": self.bucket, "words": self.ids.tobytes(), "singles": _bytes(self.singles), "times": _bytes(times), "contexts": self.context.tobytes(), "types": _bytes(self.count), "tables": _bytes(self.tables)}
        return out | {"base": None if self.base is None else _bytes(self.base), "weight": None if self.weight is None else self.weight.tobytes()}

    def owners(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct contexts by owner, their owners, and each type's place among them."""
        ids, at = np.unique(self.context, return_inverse=True)
        owner = bucket_of(ids, buckets).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return ids[order], owner[order], place[at]

    def mail(self, buckets: int) -> Iterator[dict]:
        """Tables by context, to each owner; without ``base`` also the customers."""
        ids, owner, at = self.owners(buckets)
        tables = np.bincount(at, self.tables, len(ids))
        customers = np.bincount(at, self.count, len(ids)) if self.base is None else None
        edge = np.flatnonzero(np.diff(owner, prepend=-1, append=-2))
        for a, b in zip(edge.tolist(), edge[1:].tolist()):
            some = {"types": _bytes(customers[a:b])} if self.base is None else {"base": _bytes(self.base[a:b])}
            yield {"kind": MAIL, "bucket": int(owner[a]), "peer": self.bucket, "words": ids[a:b].tobytes(), "tables": _bytes(tables[a:b])} | some


def contexts_of(rows: list[dict]) -> tuple[list[dict], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An owner's mail by peer, its contexts, each letter's places among them, their tables, and those of count-one types."""
    mail = sorted((r for r in rows if r["kind"] == MAIL), key=lambda r: r["peer"])
    ids, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *[_ids(r["words"]) for r in mail]]), return_inverse=True)
    base = np.zeros(len(ids), np.int64)
    if mail and mail[0]["base"] is None:
        own = next(r for r in rows if r["kind"] == OWN)
        count = _ints(own["counts"])[np.searchsorted(_ids(own["words"]), ids)]
        base = count - np.bincount(at, np.concatenate([_ints(r["types"]) for r in mail]), len(ids)).astype(np.int64)
    elif mail:
        base[at] = np.concatenate([_ints(r["base"]) for r in mail])
    tables = base + np.bincount(at, np.concatenate([np.zeros(0, np.int64), *[_ints(r["tables"]) for r in mail]]), len(ids)).astype(np.int64)
    return mail, ids, at, tables, base


REPLY = _schema("kind int, bucket int, peer int, base binary, gammas binary")


def reply(rows: list[dict], c: Constants, sweep: int) -> Iterator[dict]:
    """An owner's answer to each bucket: the gamma variables of its contexts, given their tables."""
    mail, ids, at, tables, base = contexts_of(rows)
    if not mail:
        return
    owner = mail[0]["bucket"]
    g = np.random.default_rng([c.seed, sweep, owner, 1]).standard_gamma(c.strength / c.discount + tables)
    end = 0
    for r in mail:
        begin, end = end, end + len(r["words"]) // 8
        yield {"kind": MAIL, "bucket": r["peer"], "peer": owner, "base": _bytes(base[at[begin:end]]), "gammas": g[at[begin:end]].tobytes()}


@dataclass(frozen=True)
class Constants:
    """Of a whole run."""

    tokens: int
    known: int
    discount: float
    root_discount: float
    hot: np.ndarray  # ids, sorted
    hot_singles: np.ndarray
    quiet: float  # customers at the root of words without a repeated type, and their number
    quiet_words: float
    strength: float = STRENGTH
    seed: int = SEED

    @property
    def new(self) -> float:
        return self.strength + self.root_discount * self.known


@dataclass(frozen=True)
class Root:
    """The root before a sweep: all words' customers, those of hot words, and the probabilities that it was drawn with."""

    customers: float
    hot_customers: np.ndarray
    hot_weight: np.ndarray
    total: float  # of all gamma variables

    @staticmethod
    def drawn(c: Constants, customers: float, hot_customers: np.ndarray, cold_gamma: float, sweep: int) -> Root:
        """Gamma variables of hot words, of quiet words together, and of what is new; those of the others are summed up."""
        r = np.random.default_rng([c.seed, sweep, 0, 2])
        hot = r.standard_gamma(np.maximum(hot_customers - c.root_discount, 1e-9))
        rest = r.standard_gamma(max(c.quiet - c.root_discount * c.quiet_words, 0.0)) + r.standard_gamma(c.new)
        return Root(customers, hot_customers, hot, float(hot.sum() + rest + cold_gamma))

    @staticmethod
    def mean(c: Constants, customers: float, hot_customers: np.ndarray) -> Root:
        return Root(customers, hot_customers, hot_customers - c.root_discount, c.strength + customers)


def swept(rows: list[dict], c: Constants, root: Root, sweep: int, buckets: int) -> Iterator[dict]:
    """A bucket after a sweep: new state and mail, and sums."""
    found = [r for r in rows if r["kind"] == STATE]
    if not found:
        return
    s = State.of(found[0], c.hot)
    letters = sorted((r for r in rows if r["kind"] == MAIL), key=lambda r: r["peer"])
    g = np.concatenate([np.zeros(0), *[np.frombuffer(r["gammas"], float) for r in letters]])
    base = np.concatenate([np.zeros(0, np.int64), *[_ints(r["base"]) for r in letters]])
    _, _, at = s.owners(buckets)
    customers = s.singles + np.bincount(s.word, s.tables, len(s.ids))
    weight = customers - c.root_discount if s.weight is None else s.weight
    if len(c.hot) and s.is_hot.any():
        weight = np.where(s.is_hot, root.hot_weight[np.minimum(np.searchsorted(c.hot, s.ids), len(c.hot) - 1)], weight)
    own = np.random.default_rng([c.seed, sweep, s.bucket, 0])
    drawn = draw_tables(s.count, c.discount * g[at] * (weight / root.total)[s.word], c.discount, log_stirling(c.discount), own)
    by_word = np.bincount(s.word, drawn, len(s.ids))
    customers = s.singles + by_word
    weight = np.where(s.is_hot, 0.0, own.standard_gamma(np.maximum(customers - c.root_discount, 1e-9)))
    now = State(s.bucket, s.ids, s.is_hot, s.singles, s.word, s.context, s.count, drawn, base, weight)
    yield now.row(buckets)
    yield from now.mail(buckets)
    yield {"kind": SUM, "id": GAMMA, "value": float(customers[~s.is_hot].sum()), "gamma": float(weight.sum())}
    for i in np.flatnonzero(s.is_hot).tolist():
        yield {"kind": SUM, "id": int(s.ids[i]), "value": float(by_word[i])}


ANSWER = _schema("chunk int, bucket int, counts binary, customers binary, tables binary, types binary, repeated binary, seated binary")


def answers(rows: list[dict], c: Constants, roots: list[Root]) -> Iterator[dict]:
    """For each chunk: its words' training counts, root customers and tables as contexts (per averaged state), and its types'
    counts (0, 1, more) with count and summed tables of those that are repeated."""
    own = next((r for r in rows if r["kind"] == OWN), None)
    if own is None:
        return
    ids, count = _ids(own["words"]), _ints(own["counts"])
    customers, openings, seated, repeated = [], [], np.zeros(1, np.int64), np.zeros(0, np.int64)
    for k, root in enumerate(roots):
        some = [r for r in rows if r["sample"] == k]
        at_root, opening = count.copy(), count.copy()
        for r in some:
            if r["kind"] == STATE:
                s = State.of(r, c.hot)
                cold = ~s.is_hot
                at_root[np.searchsorted(ids, s.ids[cold])] = (s.singles + np.bincount(s.word, s.tables, len(s.ids)))[cold]
                seated, repeated = seated + s.tables, s.count
        if len(c.hot):
            place = np.minimum(np.searchsorted(ids, c.hot), max(len(ids) - 1, 0))
            mine = (ids[place] == c.hot) & (count[place] > 0) if len(ids) else np.zeros(len(c.hot), bool)
            at_root[place[mine]] = root.hot_customers[mine]
        _, contexts, _, tables, _ = contexts_of([*some, own])
        opening[np.searchsorted(ids, contexts)] = tables
        customers.append(at_root)
        openings.append(opening)
    for r in rows:
        if r["kind"] == ASK:
            w, t = _ints(r["words"]), _ints(r["tables"])
            yield {"chunk": r["chunk"], "bucket": r["bucket"], "counts": _bytes(count[w]), "customers": _bytes(np.stack(customers)[:, w]), "tables": _bytes(np.stack(openings)[:, w]), "types": r["types"], "repeated": _bytes(repeated[t]), "seated": _bytes(seated[t])}


def log_scores(chunk: Chunk, rows: list[dict], c: Constants, roots: list[Root]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 probability, base score and known tokens of each text of a chunk, from the buckets' answers."""
    rows = sorted(rows, key=lambda r: r["bucket"])
    k = len(roots)
    join = lambda name: np.concatenate([_ints(r[name]) for r in rows])
    per_sample = lambda name: np.concatenate([_ints(r[name]).reshape(k, -1) for r in rows], axis=1)
    count, customers, openings = join("counts"), per_sample("customers"), per_sample("tables")
    kind = np.concatenate([np.frombuffer(r["types"], np.uint8) for r in rows])
    weight = np.where(kind == 0, 0.0, 1.0 - c.discount)
    weight[kind == 2] = join("repeated") - c.discount * join("seated") / k
    back = np.zeros(len(kind))
    for s, root in enumerate(roots):
        p = np.where(count > 0, customers[s] - c.root_discount, c.new) / (c.strength + root.customers)
        back += (c.strength + c.discount * openings[s])[chunk.type_context] * p[chunk.type_word] / k
    p = (weight + back) / (c.strength + count)[chunk.type_context]
    texts = len(chunk.size)
    total = np.bincount(chunk.doc, np.log10(p)[chunk.type], texts)
    base = np.bincount(chunk.doc, np.log10((count + 1) / (c.tokens + c.known + 1))[chunk.token], texts)
    return total, base, np.bincount(chunk.doc, (count > 0)[chunk.token], texts).astype(np.int64)


# ---------------------------------------------------------------- the operator


def hot_words(texts: DataFrame, part: int = HOT) -> np.ndarray:
    """Ids of at most ``part`` words; every word with 1.5 times a ``part``-th of all tokens or more is among them.

    A batch reports words that have half a ``part``-th of its tokens, with their counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, _, _ = stream(batch.column(0))
            ids, n = np.unique(token, return_counts=True)
            some = n * 2 * part >= len(token)
            yield pa.RecordBatch.from_arrays([pa.array([*ids[some].astype(np.int64).tolist(), -1], pa.int64()), pa.array([*n[some].tolist(), len(token)], pa.int64())], names=["id", "n"])

    seen = written(texts.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")), "frequent")
    total = seen.where("id < 0").first()
    found = seen.where((F.col("id") >= 0) & (F.col("n") * part >= (total.n if total else 0))).select("id").collect()  # `part` rows at most
    drop(seen)
    return np.array(sorted(r.id for r in found), np.uint64)


def _discount(ones: float, twos: float) -> float:
    return float(np.clip(ones / max(ones + 2 * twos, 1), 0.1, 0.95))


def score(docs: DataFrame, fold: int = 7, held: int = 2, sweeps: int = SWEEPS, averaged: int = AVERAGED, text: str = "text", ident: str = "doc_id", bucket_bytes: int = BUCKET_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity for every row.

    Learns from rows whose id's crc32 modulo ``fold`` is not ``held``. ``base_score`` adds one to training counts; ``score`` is
    the model's log10 probability, in which an unknown word is the one event of a word not seen in training; ``perplexity`` is
    10 to minus the score per token. Null and empty texts are one end token. Repeated rows count and stay; null ids are
    carried; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    volume = docs.agg(F.sum(F.octet_length(raw) + 16)).first()[0] or 0
    buckets, chunks = int(volume // bucket_bytes) + 1, int(volume // chunk_bytes) + 1
    source = docs.select(F.col(ident).alias("doc_id"), (remainder(F.col(ident), fold) == held).alias("held"), raw.alias("text"))
    source = source.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"), "doc_id", "held", "text")
    hot = hot_words(source.select("text"))

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack_ = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([pack_(t.as_buffer().to_pybytes()) for t in batch.column(3)], pa.binary())], names=["chunk", "doc_id", "held", "text"])

    kind = source.schema["doc_id"].dataType.simpleString()
    dealt = source.mapInArrow(shrink, f"chunk int, doc_id {kind}, held boolean, text binary").groupBy("chunk")  # texts are moved twice

    def texts_of(group: pa.Table) -> pa.Array:
        unpack = zstandard.ZstdDecompressor().decompress
        return pa.array([unpack(t.as_py()).decode() for t in group["text"]], pa.large_string())

    def pack(group: pa.Table) -> pa.Table:
        chunk = Chunk(texts_of(group), buckets, hot)
        number = group["chunk"][0].as_py()
        return _table((r | {"chunk": number} for r in chunk.requests(group["held"].to_numpy())), REQUEST[1])

    def merged(group: pa.Table) -> pa.Table:
        return _table(merge(_rows(group), buckets, hot), RESTAURANT[1])

    requests = dealt.applyInArrow(pack, REQUEST[0])
    first = written(requests.groupBy("bucket").applyInArrow(merged, RESTAURANT[0]), "restaurants")

    def sums(table: DataFrame) -> dict[int, tuple[float, float]]:
        found = table.where(F.col("kind") == SUM).groupBy("id").agg(F.sum("value").alias("v"), F.coalesce(F.sum("gamma"), F.lit(0.0)).alias("g")).collect()  # some numbers, and one for each hot word
        return {r.id: (r.v, r.g) for r in found}

    s = sums(first)
    get = lambda i: s.get(i, (0.0, 0.0))[0]
    trained = [int(i) for i in hot if int(i) in s]
    singles, repeated = np.array([s[i] for i in trained]).reshape(-1, 2).T
    c = Constants(int(get(TOKENS)), int(get(KNOWN)), _discount(get(ONES), get(TWOS)), _discount(get(ROOT_ONES), get(ROOT_TWOS)), np.array(trained, np.uint64), singles, get(QUIET), get(QUIET_WORDS))
    root = Root.mean(c, get(ROOT) + (singles + repeated).sum(), singles + repeated)  # every repeated type has one table

    def gammas(k: int):
        def run(group: pa.Table) -> pa.Table:
            return _table(reply(_rows(group), c, k), REPLY[1])

        return run

    def step(k: int, root: Root):
        def run(group: pa.Table) -> pa.Table:
            return _table(swept(_rows(group), c, root, k, buckets), RESTAURANT[1])

        return run

    own = first.where(F.col("kind") == OWN)
    states, roots, made = [first], [root], []
    for k in range(1, (sweeps if c.tokens else 0) + 1):
        last, root = states[-1], roots[-1]

        mail = last.where(F.col("kind") == MAIL)
        replies = (mail.unionByName(own) if k == 1 else mail).groupBy("bucket").applyInArrow(gammas(k), REPLY[0])
        both = last.where(F.col("kind") == STATE).unionByName(replies, allowMissingColumns=True)
        now = written(both.groupBy("bucket").applyInArrow(step(k, root), RESTAURANT[0]), "sweep")
        found = sums(now)
        at_hot = c.hot_singles + np.array([found.get(int(i), (0.0, 0.0))[0] for i in c.hot])
        customers, gamma = found.get(GAMMA, (0.0, 0.0))
        states.append(now)
        roots.append(Root.drawn(c, customers + c.quiet + at_hot.sum(), at_hot, gamma, k))
        if k > 1 and k - 1 <= sweeps - averaged:
            drop(last)
    used = list(range(max(len(states) - averaged, min(1, len(states) - 1)), len(states)))
    final_roots = [roots[k] for k in used]
    parts = first.where(F.col("kind").isin(OWN, ASK)).withColumn("sample", F.lit(-1))
    for n, k in enumerate(used):
        parts = parts.unionByName(states[k].where(F.col("kind").isin(STATE, MAIL)).withColumn("sample", F.lit(n)))

    def answer(group: pa.Table) -> pa.Table:
        return _table(answers(_rows(group), c, final_roots), ANSWER[1])

    returned = written(parts.drop("id", "value", "gamma").groupBy("bucket").applyInArrow(answer, ANSWER[0]), "answers")
    drop(first, *(states[k] for k in used if k))

    def scored(texts: pa.Table, found: pa.Table) -> pa.Table:
        chunk = Chunk(texts_of(texts), buckets, hot)
        total, base, known = log_scores(chunk, _rows(found), c, final_roots)
        return pa.table({"doc_id": texts["doc_id"], "held": texts["held"], "n_tokens": pa.array(chunk.size, pa.int64()), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(total)})

    out = dealt.cogroup(returned.groupBy("chunk")).applyInArrow(scored, f"doc_id {kind}, held boolean, n_tokens long, n_known long, base_score double, score double")
    per_token = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return out.select(F.col("doc_id").alias(ident), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(c.tokens).cast("long").alias("train_tokens"), "base_score", "score", per_token.alias("perplexity"))
