"""Operator 6, near-duplicates by b-bit MinHash.

A document's set holds the distinct n-word shingles of its lower-cased words (n = 2 unless told
otherwise), as 64-bit hashes. Of each of 96 minima the low 8 bits are kept, packed into 96 bytes.
Documents with equal sets form a class, and only a class's smallest id goes on. 24 bands of
4 packed bytes give candidates; similarity is estimated from the packed signatures by XOR and counting
equal bytes, less the share that would agree by chance (1/256), and what may reach the limit is confirmed
on the full sets.

A bucket of m members never yields its m * m pairs: each member is held against the bucket's
pivot (another one in each band), components are made of the confirmed links, and only members that are
still outside their bucket's largest component are compared, in blocks, with the members of other
components. Thus a link is only left out between documents that are connected already. Two sets at the limit
of 0.8 share no band with probability 3e-6, and fall below the estimates' limits (0.62 by 96 hashes of 8 bits, 0.77 by
the 4096 of 2 bits of the block comparisons) about as rarely.

Cases: a null text, and one without words, has an empty set and is linked with nothing; fewer
words than n make one shingle of them all; a null id takes part in nothing and gets a null component; rows that
repeat an id are one document for linking; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, arrow_map, pieces_of, stored
from .components import components

HASHES, BANDS, ROWS = 96, 24, 4
#: Hashes and bits of the longer signatures by which members of mixed buckets are compared, and members a block.
LONG, LONG_BITS, BLOCK = 4096, 2, 256
#: So many pairs of a member with one other component come out of a block at first; a second pass has the others.
EACH = 32
#: So many ids are sent to every task to pick their texts; more of them meet the texts by a shuffle.
MOST_IDS = 2_000_000


class _Hashes(dict):
    """64-bit hashes of words, begun anew when it has grown to its bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 50_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Hashes()


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles."""
    words = text.encode("utf-8").translate(ASCII_LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(n, len(h))
    x = np.full(len(h) - size + 1, 0x9E3779B97F4A7C15 ^ size, np.uint64)
    for k in range(size):
        x = (x ^ h[k : len(h) - size + 1 + k]) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return np.unique(x)


def _coefficients(hashes: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240601 + hashes)
    return rng.integers(0, 2**32, hashes, np.uint32)[:, None] | np.uint32(1), rng.integers(0, 2**32, hashes, np.uint32)[:, None]


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int = 8) -> np.ndarray:
    """The low bits of the minimum under each hash, packed (8 / bits hashes a byte)."""
    x = ((shingles >> np.uint64(32)) ^ shingles).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    step = max(64, (1 << 18) // len(a))
    for k in range(0, len(x), step):
        np.minimum(low, (x[k : k + step] * a + b).min(axis=1), out=low)
    part = (low & np.uint32((1 << bits) - 1)).astype(np.uint8).reshape(-1, 8 // bits)
    return np.bitwise_or.reduce(part << (bits * np.arange(8 // bits, dtype=np.uint8)), axis=1)


def estimate(x: np.ndarray, y: np.ndarray, bits: int = 8) -> np.ndarray:
    """Similarity of packed signatures (rows of uint64), corrected for chance agreement of the bits kept."""
    d = x ^ y
    at = bits // 2
    while at:
        d |= d >> np.uint64(at)
        at //= 2
    lowest = np.uint64(sum(1 << k for k in range(0, 64, bits)))
    differing = np.bitwise_count(d & lowest).sum(axis=-1)
    agree = 1 - differing / (64 // bits * x.shape[-1])
    return (agree - 2.0**-bits) / (1 - 2.0**-bits)


def spread(limit: float, hashes: int, bits: int) -> float:
    """The standard deviation of an estimate at the limit."""
    agree = limit + (1 - limit) * 2.0**-bits
    return (max(agree * (1 - agree), 0.09) / hashes) ** 0.5 / (1 - 2.0**-bits)


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (hi, lo) and the packed signature."""

    def run(batches):
        import xxhash

        a, b = _coefficients()
        for whole in batches:
            for batch in pieces_of(whole, text_col):
                sizes, hi, lo, packed = [], [], [], []
                for text in batch.column(text_col).to_pylist():
                    s = shingle_set(text, n)
                    digest = xxhash.xxh3_128_digest(s.tobytes())
                    sizes.append(len(s))
                    hi.append(int.from_bytes(digest[:8], "little", signed=True))
                    lo.append(int.from_bytes(digest[8:], "little", signed=True))
                    packed.append(signature(s, a, b).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col), pa.array(sizes, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(packed, pa.binary())],
                    ["doc_id", "n_shingles", "hi", "lo", "sig"],
                )

    slim = docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias(text_col))
    return arrow_map(slim, run, "doc_id long, n_shingles long, hi long, lo long, sig binary")


def _rows(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<u8").reshape(len(values), -1)


def _of_texts(ids: DataFrame, most: int, docs: DataFrame, id_col: str, text_col: str, n: int, **make) -> DataFrame:
    """(doc_id, a binary column for each make(shingle set)) of the documents that ids (doc_id, `most` at most) names, and of no others."""
    ids = ids.distinct()
    if most <= MOST_IDS:
        ids = F.broadcast(ids)
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(batches):
        for whole in batches:
            for x in pieces_of(whole, "text"):
                sets = [shingle_set(t, n) for t in x.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([x.column("doc_id"), *(pa.array([f(k) for k in sets], pa.binary()) for f in make.values())], ["doc_id", *make])

    found = arrow_map(slim.join(ids, "doc_id", "left_semi"), run, "doc_id long, " + ", ".join(f"{k} binary" for k in make))
    return stored(found.dropDuplicates(["doc_id"]), "of_texts")


def _likely(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Of pairs (a < b), those whose packed signatures allow the limit."""

    def run(batches):
        for x in batches:
            if x.num_rows:
                est = estimate(_rows(x.column("sig_a").to_pylist()), _rows(x.column("sig_b").to_pylist()))
                yield x.select(["a", "b"]).filter(pa.array(est >= least))

    sig = sigs.select("doc_id", "sig")
    both = pairs.join(sig.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b")
    return arrow_map(both, run, "a long, b long")


def confirmed(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a < b), those with 100 * intersection >= percent * union of their full sets, which known (doc_id, shingles) has.

    Sets meet their pairs in Arrow batches of bounded bytes; no more than a batch of them is held at a time.
    """
    both = pairs.join(known.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), "a").join(known.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b")

    def run(batches):
        for x in batches:
            good = []
            for p, q in zip(x.column("set_a"), x.column("set_b"), strict=True):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * common >= percent * (len(p) + len(q) - common) and common > 0)
            yield x.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return arrow_map(both, run, "a long, b long")


def _mixed(banded: DataFrame, labels: DataFrame) -> DataFrame:
    """band, doc_id, component, m, largest, u of the members of buckets of three or more in different components.

    m: members of the bucket, largest: the component with most of them, u: those outside it.
    """
    named = banded.join(labels, banded.doc_id == labels.id, "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    parts = named.groupBy("band", "component").agg(F.count("*").alias("n"))
    buckets = parts.groupBy("band").agg(F.sum("n").alias("m"), F.max(F.struct("n", "component")).alias("most")).where("m > 2 and m > most.n")
    return named.join(buckets.select("band", "m", F.col("most.component").alias("largest"), (F.col("m") - F.col("most.n")).alias("u")), "band")


def _left_over(inside: DataFrame, signed: DataFrame, least: float, each: int | None) -> DataFrame:
    """Likely pairs of members of one bucket in different components.

    Members outside their bucket's largest component are held against all members, block by block, by longer
    signatures; a pair comes out of the first band that it shares. Both sides' blocks are written, so that adaptive
    execution can split a large bucket's blocks over tasks. With `each`, only that many of the likeliest
    pairs of a member with another component in a block come out: one link is enough to join them. Where that leaves
    pairs out, a row (null, band) says so, and what is still unjoined in that band is asked again without the bound.
    """

    def blocks(members: DataFrame, size: str, name: str) -> DataFrame:
        part = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col(size) / BLOCK)).alias("part")
        wide = members.select("band", "doc_id", "component", part).join(signed.select("doc_id", "sig", "long"), "doc_id")
        made = wide.groupBy("band", "part").agg(F.collect_list(F.struct("doc_id", "component", "sig", "long")).alias(name))
        return stored(made.select("band", name), f"blocks_{name}")

    q, m = blocks(inside.where("component <> largest"), "u", "asked"), blocks(inside, "m", "members")

    def run(batches):
        def side(items):
            items = items.values
            ids, kinds = (items.field(k).to_numpy() for k in ("doc_id", "component"))
            return ids, kinds, _rows(items.field("sig").to_pylist()).view("<u4"), _rows(items.field("long").to_pylist())

        for x in batches:
            for k in range(x.num_rows):
                first = x.column("band")[k].as_py() >> 32
                (qi, qc, qs, ql), (ri, rc, rs, rl) = side(x.column("asked")[k]), side(x.column("members")[k])
                low, high, cut = [np.empty(0, np.int64)], [np.empty(0, np.int64)], False
                for i in range(len(qi)):
                    score = estimate(ql[i], rl, LONG_BITS)
                    near = np.flatnonzero((rc != qc[i]) & (score >= least))
                    near = near[(rs[near] == qs[i]).argmax(axis=1) == first]
                    if each is not None and len(near) > each:
                        near = near[np.lexsort((-score[near], rc[near]))]
                        kinds = rc[near]
                        starts = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1]))
                        few = np.arange(len(near)) - np.repeat(starts, np.diff(np.append(starts, len(near)))) < each
                        cut |= not few.all()
                        near = near[few]
                    low.append(np.minimum(qi[i], ri[near]))
                    high.append(np.maximum(qi[i], ri[near]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in (low, high)], ["a", "b"])
                if cut:
                    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), x.column("band")[k : k + 1]], ["a", "b"])

    return arrow_map(q.join(m, "band"), run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: id, n_shingles, component_id, kept (the smallest id of its component)."""
    # 4.5 standard deviations of the estimates below the limit
    limit = percent / 100
    least, least_long = (limit - 4.5 * spread(limit, k, bits) for k, bits in ((HASHES, 8), (LONG, LONG_BITS)))
    sigs = stored(signatures(docs, id_col, text_col, words), "signatures")
    able = sigs.where("n_shingles > 0 and doc_id is not null")
    firsts = stored(able.groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id"), F.min_by("sig", "doc_id").alias("sig")), "firsts")
    keys = [F.lit(k << 32).bitwiseOR(F.conv(F.hex(F.substring("sig", ROWS * k + 1, ROWS)), 16, 10).cast("long")) for k in range(BANDS)]
    banded = firsts.select("doc_id", F.explode(F.array(*keys)).alias("band"))
    pivots = banded.groupBy("band").agg(F.min(F.struct(F.xxhash64("doc_id", "band").alias("h"), "doc_id")).alias("p"), F.count("*").alias("m")).where("m > 1").select("band", F.col("p.doc_id").alias("pivot"))
    shared = stored(banded.join(pivots, "band"), "shared")
    pairs = stored(shared.where("doc_id <> pivot").select(F.least("doc_id", "pivot").alias("a"), F.greatest("doc_id", "pivot").alias("b")).distinct(), "pairs")
    likely = stored(_likely(pairs, firsts, least), "likely")
    named = likely.select(F.explode(F.array("a", "b")).alias("doc_id"))
    links = stored(confirmed(likely, _of_texts(named, 2 * likely.count(), docs, id_col, text_col, words, shingles=np.ndarray.tobytes), percent), "links")
    labels = components(links)
    # what the pivots left: first the likeliest pairs between components, then all that are still between components
    inside = stored(_mixed(shared.select("band", "doc_id"), labels), "inside")
    short, long = _coefficients(), _coefficients(LONG)
    signed = _of_texts(
        inside.select("doc_id"), inside.count(), docs, id_col, text_col, words,
        sig=lambda s: signature(s, *short).tobytes(), long=lambda s: signature(s, *long, LONG_BITS).tobytes(), shingles=np.ndarray.tobytes,
    )
    tested = pairs
    for each in (EACH, None):
        rest = stored(_left_over(inside, signed, least_long, each).join(tested, ["a", "b"], "left_anti"), "rest")
        more = stored(confirmed(rest.where("a is not null"), signed, percent), "links")
        if not more.isEmpty():
            labels = components(more, known=labels)
        cut = rest.where("a is null").select(F.col("b").alias("band"))
        if each is None or cut.isEmpty():
            break
        inside = stored(_mixed(inside.select("band", "doc_id").join(cut, "band", "left_semi"), labels), "inside")
        tested = tested.unionByName(rest)
    # an exact copy's component is that of its class
    of_class = firsts.join(labels, firsts["doc_id"] == labels["id"], "left").select("hi", "lo", F.coalesce("component", "doc_id").alias("component_id"))
    out = sigs.select("doc_id", "n_shingles", "hi", "lo").join(of_class, ["hi", "lo"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", (F.col("component_id").eqNullSafe(F.col("doc_id"))).alias("kept"))


#: What op6 returns, for two-word shingles: all pairs that share a shingle, then everything reachable.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * k >= 80 * (len(sa.s) + len(sb.s) - k)),
pairs AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT pairs.b, r.c FROM r JOIN pairs ON pairs.a = r.id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.c) AS component_id, min(r.c) = s.doc_id AS kept FROM s JOIN r ON r.id = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
