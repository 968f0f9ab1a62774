"""N-gram Jaccard join by grouped prefixes.

A document's set holds the distinct n-word shingles of its whole lower-cased
text, as 64-bit hashes.  Sets are put in one total order: ordinary shingles by
hash, then the most frequent ones (``heavy``) by hash, so that passages and
lines that many documents share stay out of the prefixes.  Two sets of Jaccard
similarity p/100 or more share a token of their first ``n - ceil(p n / 100) +
1`` (of the smaller set, its first ``n - ceil(2 p n / (100 + p)) + 1``).

1. Documents with identical prefixes and size form one group, and those with
   identical sets one text inside it: copies of any number are one node.
2. Group pairs that share a prefix token are filtered by size and by the
   positions of that token.
3. The pairs are expanded to their texts and verified on the whole sets.

Only the components matter to the result, so the pairs are taken in turns.  First each
token's groups are paired with three of their own (the smallest, and the first
under two hashes) - linear in the length of the list.  Links found so far merge
groups.  Members outside a token's largest component are then paired with a few
drawn from it, and those still outside with all members of the list that are in
other components: pair by pair, or, where a list would give more than ``LARGE``
pairs, by blocks of sets compared as matrices, so that no row is made for a
pair.  No pair that could be a link between components is left out.

The list of heavy tokens is the only broadcast: at most ``MAX_HEAVY`` hashes,
whatever the corpus.  It affects the order, hence speed, never the result.

Defined cases: null or empty texts, or ones without words, have size 0 and stay
alone; with fewer words than n the whole sequence is one shingle; repeated rows
are copies; a null id takes part in links but never names a component (a
component of null ids only has a null id); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.components import connected_components
from . import textops
from .common import checkpoint, most_frequent, tidy, trimmed

MAX_HEAVY = 1 << 18
HEAVY_DF = 16  # a token in more documents than this may be heavy
PIECE = 1 << 20
HELD = 1_000_000  # tokens that a task counts at a time
HALF = np.uint64(1 << 63)
MAX_BITS = 1 << 27  # of a sieve
LARGE = 4096  # pairs of one list beyond which it is verified by blocks
BLOCK_TOKENS = 1 << 16
DRAWN = 8  # members of a list's largest component that its other members are compared with first


def _pieces(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Slices of about PIECE bytes of text, or one document."""
    for batch in batches:
        ends, at = np.cumsum(np.diff(textops.utf8(batch.column(text))[0])), 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + PIECE, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    first, hashes = textops.shingles(*textops.words(column), n)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        s = np.sort(hashes[a:b])
        out.append(s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s)
    return out


def heavy_tokens(docs: DataFrame, text: str, n: int) -> tuple[np.ndarray, np.uint64]:
    """The most frequent shingles by number of documents, at most MAX_HEAVY, ascending.

    Prefixes are taken from the low end of the hashes, so those of the lower half
    are counted.  Tasks send their distinct tokens in blobs by hash range, 24 bits
    of each (beside the bits that the range fixes) with their counts; a range is
    summed in one task.  The number of ranges follows that of the input partitions.
    """
    parts = docs.rdd.getNumPartitions()
    bits = max(6, min(16, int(np.ceil(np.log2(2 * parts + 1)))))
    low = np.uint64(63 - bits - 24)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            bucket = (token >> np.uint64(24)).astype(np.int32)
            three = token.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
            at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            cut = lambda x: [y.tobytes() for y in np.split(x, at[1:])]
            return pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(cut(three), pa.binary()), pa.array(cut(count.astype(np.uint32)), pa.binary())], ["bucket", "tokens", "counts"])

        for part in _pieces(batches, text):
            held += [s[: np.searchsorted(s, HALF)] >> low for s in _sets(part.column(text), n)]
            if sum(map(len, held)) > HELD:
                yield flush()
        if sum(map(len, held)):
            yield flush()

    def add(table: pa.Table) -> pa.Table:
        three = np.concatenate([np.frombuffer(x, np.uint8) for x in table["tokens"].to_pylist()]).reshape(-1, 3)
        token = three[:, 0] + three[:, 1].astype(np.uint32) * 256 + three[:, 2].astype(np.uint32) * 65536
        count = np.concatenate([np.frombuffer(x, np.uint32) for x in table["counts"].to_pylist()])
        order = np.argsort(token, kind="stable")
        token, count = token[order], count[order]
        at = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        df, token = np.add.reduceat(count.astype(np.int64), at), token[at].astype(np.int64)
        keep = df > HEAVY_DF
        base = table["bucket"][0].as_py() << 24
        return pa.table({"token": token[keep] + base, "df": df[keep]})

    counted = docs.select(text).mapInArrow(trimmed(emit), "bucket int, tokens binary, counts binary").groupBy("bucket").applyInArrow(add, "token bigint, df bigint")
    rows = most_frequent(checkpoint(counted), "df", MAX_HEAVY).select("token").toPandas()  # MAX_HEAVY rows at most
    return np.sort(rows["token"].to_numpy().astype(np.uint64)), low


def _prefix(s: np.ndarray, often: np.ndarray, low: np.uint64, percent: int) -> tuple[np.ndarray, int]:
    """The first tokens of a set in the common order, and how many of them are not heavy."""
    k = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
    if not len(often):
        return s[:k], k
    key = s >> low
    heavy = often[np.minimum(np.searchsorted(often, key), len(often) - 1)] == key
    prefix = s[~heavy][:k]
    return np.concatenate([prefix, s[heavy][: k - len(prefix)]]), len(prefix)


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text"))


def signatures(docs: DataFrame, heavy: tuple[np.ndarray, np.uint64], *, id_col: str, text: str, n: int, percent: int) -> DataFrame:
    """id, key (the id as text), n (set size), f (hash of the set), g (hash of prefix and size)."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, low = shared.value
        for part in _pieces(batches, "text"):
            sets = _sets(part.column("text"), n)
            f, g = [textops.fold(s) for s in sets], [_group(s, often, low, percent)[0] for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(f, pa.int64()), pa.array(g, pa.int64())], ["id", "key", "n", "f", "g"])

    return _keyed(docs, id_col, text).mapInArrow(trimmed(run), f"id {kind}, key string, n bigint, f bigint, g bigint")


def _group(s: np.ndarray, often: np.ndarray, low: np.uint64, percent: int) -> tuple[int, np.ndarray, int]:
    prefix, plain = _prefix(s, often, low, percent)
    return textops.fold(np.append(prefix, np.uint64(len(s)))) if len(s) else 0, prefix, plain


def _sieve(keys: DataFrame) -> np.ndarray:
    """A bitmap of the documents' keys, of 16 bits for each and MAX_BITS at most: tasks skip most other documents by it.  Exact joins follow."""
    bits = 1 << min(MAX_BITS.bit_length() - 1, max(16, (16 * keys.count()).bit_length()))
    at = F.pmod(F.xxhash64("key"), F.lit(bits))
    words = keys.select(at.alias("at")).groupBy(F.expr("at div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(at % 64))")).alias("b"))
    rows = words.toPandas()  # MAX_BITS / 64 rows at most
    out = np.zeros(bits // 64, np.uint64)
    out[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64).view(np.uint64)
    return out


def _selected(batches: Iterator[pa.RecordBatch], sieve: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows whose key may be in the sieve, before their texts are looked at."""
    for batch in batches:
        at = np.array([xxhash.xxh64_intdigest(k.encode(), 42) & (len(sieve) * 64 - 1) for k in batch.column("key").to_pylist()], np.uint64)
        keep = (sieve[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
        if keep.any():
            yield batch.filter(pa.array(keep.astype(bool)))


def postings(docs: DataFrame, heavy: tuple[np.ndarray, np.uint64], leads: DataFrame, *, id_col: str, text: str, n: int, percent: int) -> DataFrame:
    """token, g, n, pos, heavy: the prefixes of the groups, from one document of each (leads: f, key)."""
    shared = docs.sparkSession.sparkContext.broadcast((*heavy, _sieve(leads)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, low, sieve = shared.value
        for part in _pieces(_selected(batches, sieve), "text"):
            tokens, groups, sizes, places, marks = [], [], [], [], []
            for s in _sets(part.column("text"), n):
                if len(s):
                    g, prefix, plain = _group(s, often, low, percent)
                    tokens.append(prefix)
                    groups.append(np.full(len(prefix), g, np.int64))
                    sizes.append(np.full(len(prefix), len(s), np.int32))
                    places.append(np.arange(len(prefix), dtype=np.int32))
                    marks.append(np.arange(len(prefix)) >= plain)
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (groups, sizes, places, marks))], ["token", "g", "n", "pos", "heavy"])

    return _keyed(docs, id_col, text).mapInArrow(trimmed(run), "token bigint, g bigint, n int, pos int, heavy boolean")


def _index_prefix(n: Column, percent: int) -> Column:
    return n - F.expr(f"({2 * percent} * n + {99 + percent}) div {100 + percent}") + 1


def _possible(percent: int) -> Column:
    """The filter on two postings (n, pos, ip) and (n2, pos2, ip2) of one token: size, index prefix and what can still follow."""
    n, m, i, j = (F.col(c) for c in ("n", "n2", "pos", "pos2"))
    need = F.ceil(percent * (n + m) / F.lit(100 + percent)).cast("long")
    indexed = F.when(n <= m, F.col("pos") < F.col("ip")).otherwise(F.col("pos2") < F.col("ip2"))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & indexed & (F.least(n - i, m - j) >= need)


def _whole_sets(need: DataFrame, docs: DataFrame, *, id_col: str, text: str, n: int, repeated: bool) -> DataFrame:
    """f, key, s: the whole sets of at least the documents of need (f and the key of one document with that set).

    repeated: some key stands for several rows of one text; then each (f, key)
    is kept once, by a sum that shuffles as the joins do.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_sieve(need))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, seen = shared.value, set()
        for part in _pieces(_selected(batches, sieve), "text"):
            sets, keys = _sets(part.column("text"), n), part.column("key").to_pylist()
            f = [textops.fold(s) for s in sets]
            if repeated:
                own = [k for k, x in enumerate(zip(f, keys, strict=True)) if x not in seen and not seen.add(x)]
                sets, keys, f = [sets[k] for k in own], [keys[k] for k in own], [f[k] for k in own]
            first = np.zeros(len(sets) + 1, np.int64)
            np.cumsum([len(s) for s in sets], out=first[1:])
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(keys, pa.string()), textops.list_array(first, flat)], ["f", "key", "s"])

    sets = _keyed(docs, id_col, text).select("key", "text").mapInArrow(trimmed(run), "f bigint, key string, s array<bigint>").where("size(s) > 0")
    return sets.groupBy("f", "key").agg(F.first("s").alias("s")) if repeated else sets


def _verify(pairs: DataFrame, docs: DataFrame, reps: DataFrame, *, id_col: str, text: str, n: int, percent: int, repeated: bool) -> DataFrame:
    """The pairs (a, b) of texts whose sets are similar enough.  reps: f and the key of one document with that set.

    Both sides join the same table of sets on the same columns, so its texts are
    read and its rows are shuffled once; the key leaves out other documents of
    the same set that passed the sieve.
    """
    named = pairs.join(reps.withColumnsRenamed({"f": "a", "key": "ka"}), "a").join(reps.withColumnsRenamed({"f": "b", "key": "kb"}), "b")
    named = checkpoint(named.select("a", "ka", "b", "kb"))
    need = checkpoint(named.select(F.col("a").alias("f"), F.col("ka").alias("key")).union(named.select("b", "kb")).distinct())
    sets = _whole_sets(need, docs, id_col=id_col, text=text, n=n, repeated=repeated)
    at = lambda side, f, key: (F.col(f) == F.col(f"{side}.f")) & (F.col(key) == F.col(f"{side}.key"))
    both = named.join(sets.alias("x"), at("x", "a", "ka")).join(sets.alias("y"), at("y", "b", "kb"))
    x, y = F.col("x.s"), F.col("y.s")
    common = F.size(F.array_intersect(x, y))
    return both.where(common * 100 >= (F.size(x) + F.size(y) - common) * percent).select("a", "b").distinct()


def _verify_clusters(members: DataFrame, docs: DataFrame, reps: DataFrame, *, id_col: str, text: str, n: int, percent: int, repeated: bool) -> DataFrame:
    """Links (a, b) between texts of one cluster and different roots, one of them minor, without a row for each pair.

    members: c (cluster), f, n (set size), root, minor.  A cluster is cut by
    size (steps of the size ratio, so partners are in the same or the next
    step) and by hash into blocks of about BLOCK_TOKENS; blocks are joined and
    each pair of blocks is compared as a product of their incidence matrices.
    """
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")
    members = checkpoint(members.withColumn("b", step))
    parts = members.groupBy("c", "b").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("parts"))
    placed = members.join(parts, ["c", "b"]).withColumn("h", F.pmod(F.xxhash64("f"), F.col("parts")))
    need = checkpoint(members.select("f").distinct().join(reps, "f"))
    sets = _whole_sets(need, docs, id_col=id_col, text=text, n=n, repeated=repeated)
    rows = placed.join(need, "f").join(sets, ["f", "key"]).dropDuplicates(["c", "b", "h", "f"]).select("c", "b", "h", "f", "root", "minor", "s")

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = [x.values.to_numpy() for x in table["s"]]
        blob = lambda x: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())
        minor = table["minor"].to_numpy()
        return pa.table({"c": table["c"][:1], "b": table["b"][:1], "h": table["h"][:1], "any": pa.array([bool(minor.any())]), "f": blob(table["f"].to_numpy()), "root": blob(table["root"].to_numpy()), "minor": blob(minor.astype(np.uint8)), "len": blob(np.array([len(x) for x in lists], np.int64)), "s": blob(np.concatenate(lists))})

    blobs = "f binary, root binary, minor binary, len binary, s binary"
    blocks = checkpoint(rows.groupBy("c", "b", "h").applyInArrow(pack, f"c bigint, b int, h bigint, any boolean, {blobs}"))
    left = blocks.where("any").withColumn("b", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1))).select("c", "b", *(F.col(k) for k in ("f", "root", "minor", "len", "s")))
    right = blocks.select("c", "b", *(F.col(k).alias(f"{k}2") for k in ("f", "root", "minor", "len", "s")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):  # a pair of blocks at a time
                r = batch.slice(row, 1).to_pylist()[0]
                side = [{k: np.frombuffer(r[k + t], np.uint8 if k == "minor" else np.int64) for k in ("f", "root", "minor", "len", "s")} for t in ("", "2")]
                both = np.intersect1d(side[0]["s"], side[1]["s"])
                sizes = [x["len"] for x in side]
                common = np.zeros((len(sizes[0]), len(sizes[1])), np.float32)
                for at in range(0, len(both), 4096):
                    token, dense = both[at : at + 4096], []
                    for x in side:
                        k = np.minimum(np.searchsorted(token, x["s"]), len(token) - 1)
                        hit = token[k] == x["s"]
                        m = np.zeros((len(x["len"]), len(token)), np.float32)
                        m[np.repeat(np.arange(len(x["len"])), x["len"])[hit], k[hit]] = 1
                        dense.append(m)
                    common += dense[0] @ dense[1].T
                union = sizes[0][:, None] + sizes[1][None, :] - common
                ok = (common * 100.0 >= union * float(percent)) & (side[0]["minor"] > 0)[:, None] & (side[0]["root"][:, None] != side[1]["root"][None, :])
                i, j = np.nonzero(ok)
                a, b = side[0]["f"][i], side[1]["f"][j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return left.join(right, ["c", "b"]).select(*(F.col(f"{k}{t}") for t in ("", "2") for k in ("f", "root", "minor", "len", "s"))).mapInArrow(trimmed(compare), "a bigint, b bigint").distinct()


def components(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """id_col, n_shingles, n_links (verified links of its text that were needed) and component_id, one row for each row of docs."""
    how = {"id_col": id_col, "text": text, "n": n, "percent": percent}
    heavy = heavy_tokens(docs, text, n)
    sig = checkpoint(signatures(docs, heavy, **how))
    full = sig.where("n > 0")
    # a text is read through a document whose id is not repeated, if it has one
    rows = full.groupBy("g", "f", "id", "key").agg((F.count("*") > 1).alias("again"))
    texts = rows.groupBy("g", "f").agg(F.min("id").alias("id"), F.min(F.struct("again", F.col("id").isNull().alias("none"), "id", "key")).alias("m"))
    texts = checkpoint(texts.select("g", "f", "id", "m.key", "m.again"))
    repeated = not texts.where("again").isEmpty()
    leads = texts.groupBy("g").agg(F.min(F.struct("f", "key")).alias("m")).select("g", F.col("m.f").alias("lead"), F.col("m.key").alias("key"))
    post = postings(docs, heavy, leads.select(F.col("lead").alias("f"), "key"), **how)
    # tokens that one group has are of no use: one shuffle finds them; the long lists of heavy tokens need no count and are split
    part = F.when(F.col("heavy"), F.xxhash64("g")).otherwise(0)
    post = post.withColumn("k", F.count("*").over(W.partitionBy("token", part))).where("k > 1 OR heavy").select("token", "g", "n", "pos")
    stored = checkpoint(post)
    post = stored.withColumn("n", F.col("n").cast("bigint")).withColumn("ip", _index_prefix(F.col("n"), percent))

    spark, spent = docs.sparkSession, [stored]
    tidy(spark)
    verify = lambda pairs: _verify(pairs, docs, texts.select("f", "key"), repeated=repeated, **how)
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))

    # first pass: a few centres for each token, and each group's lead for its texts
    as_centre = lambda *key: F.min(F.struct(*key, F.col("g").alias("g2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("ip").alias("ip2")))
    hashed = lambda seed: F.xxhash64("g", F.lit(seed)).alias("h")
    centres = post.groupBy("token").agg(as_centre(F.col("n").alias("h")).alias("c0"), as_centre(hashed(1)).alias("c1"), as_centre(hashed(2)).alias("c2"))
    each = post.join(centres, "token").select("g", "n", "pos", "ip", F.explode(F.array_distinct(F.array("c0.g2", "c1.g2", "c2.g2"))).alias("w"), "c0", "c1", "c2")
    chosen = F.when(F.col("w") == F.col("c0.g2"), F.struct("c0.g2", "c0.n2", "c0.pos2", "c0.ip2")).when(F.col("w") == F.col("c1.g2"), F.struct("c1.g2", "c1.n2", "c1.pos2", "c1.ip2")).otherwise(F.struct("c2.g2", "c2.n2", "c2.pos2", "c2.ip2"))
    star = each.select("g", "n", "pos", "ip", chosen.alias("c")).select("g", "n", "pos", "ip", "c.*").where((F.col("g") != F.col("g2")) & _possible(percent)).select(*ordered("g", "g2")).distinct()
    lead = leads.select("g", "lead")
    star = star.join(lead.withColumnsRenamed({"g": "a", "lead": "x"}), "a").join(lead.withColumnsRenamed({"g": "b", "lead": "y"}), "b").select(*ordered("x", "y"))
    inner = texts.join(lead, "g").where("f <> lead").select(*ordered("f", "lead"))
    first = checkpoint(star.union(inner).distinct())
    links = checkpoint(verify(first))
    labels = checkpoint(connected_components(links, "a", "b", checkpoint))

    # then what is still in different components: first against a few members of each list's largest, last against all
    seen = [first]
    for last in (False, True):
        named = checkpoint(texts.join(labels, texts["f"] == labels["node"], "left").select("g", "f", F.coalesce("root", "f").alias("root")))
        by_group = named.groupBy("g").agg(F.min("root").alias("root"), (F.min("root") != F.max("root")).alias("mixed"))
        rooted = checkpoint(post.join(by_group, "g").select("token", "n", "g", "pos", "ip", F.when(F.col("mixed"), F.col("g")).otherwise(F.col("root")).alias("root"), "mixed"))
        per = rooted.groupBy("token", "root").agg(F.count("*").alias("k"), F.max("mixed").alias("mixed"))
        major = per.groupBy("token").agg(F.max(F.struct(F.when(F.col("mixed"), 0).otherwise(F.col("k")).alias("k"), "root")).alias("m"), F.count("*").alias("roots")).where("roots > 1").select("token", F.col("m.root").alias("major"))
        open_lists = checkpoint(rooted.join(major, "token"))
        spent += [named, rooted, open_lists]
        inside = (F.col("root") == F.col("major")) & ~F.col("mixed")
        minor = open_lists.where(~inside).drop("major")
        member = F.struct(F.col("g").alias("g2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("ip").alias("ip2"), F.col("root").alias("root2"))
        if last:  # lists with many such pairs are verified by blocks, below
            large = open_lists.groupBy("token").agg((F.count_if(~inside) * F.count("*") > LARGE).alias("large"))
            open_lists = checkpoint(open_lists.join(large, "token"))
            spent.append(open_lists)
            crowd = open_lists.where("large").groupBy(F.col("major").alias("c"), "g").agg(F.max(~inside).alias("minor"), F.max("n").alias("n"))
            minor = open_lists.where(~inside & ~F.col("large")).drop("major", "large")
            other = open_lists.where("NOT large").select("token", member.alias("o")).select("token", "o.*")
        else:
            drawn = [F.min(F.struct(F.xxhash64("g", F.lit(seed)).alias("h"), member.alias("o"))).alias(f"c{seed}") for seed in range(3, 3 + DRAWN)]
            other = open_lists.where(inside).groupBy("token").agg(*drawn).select("token", F.explode(F.array(*(F.col(f"c{seed}.o") for seed in range(3, 3 + DRAWN)))).alias("o")).select("token", "o.*").distinct()
        pairs = minor.join(other, "token").where((F.col("root") != F.col("root2")) & _possible(percent)).select("g", "g2").distinct()
        left, right = named.select("g", F.col("f").alias("x"), F.col("root").alias("rx")), named.select(F.col("g").alias("g2"), F.col("f").alias("y"), F.col("root").alias("ry"))
        found = pairs.join(left, "g").join(right, "g2").where("rx <> ry").select(*ordered("x", "y"))
        if last:  # and texts of one group that are not yet together: those outside its largest component against all
            size = named.groupBy("g", "root").agg(F.count("*").alias("k")).groupBy("g").agg(F.max(F.struct("k", "root")).alias("m"), F.count("*").alias("roots")).where("roots > 1").select("g", F.col("m.root").alias("major"))
            outside = named.join(size, "g").where("root <> major").select("g", F.col("f").alias("x"), F.col("root").alias("rx"))
            found = found.union(outside.join(named.select("g", F.col("f").alias("y"), F.col("root").alias("ry")), "g").where("rx <> ry").select(*ordered("x", "y")))
        found = found.distinct()
        for done in seen:
            found = found.join(done, ["a", "b"], "left_anti")
        found = checkpoint(found)
        seen.append(found)
        more = verify(found)
        if last:
            more = more.union(_verify_clusters(crowd.join(named, "g").select("c", "f", "n", "root", "minor"), docs, texts.select("f", "key"), repeated=repeated, **how))
        more = checkpoint(more)
        spent.append(more)
        if not more.isEmpty():
            links = checkpoint(links.union(more).distinct())
            labels = checkpoint(connected_components(links, "a", "b", checkpoint))
        tidy(spark)
    tidy(spark, *spent, *seen)  # the result reads the signatures, texts, links and labels only
    all_links = links
    degree = all_links.select(F.col("a").alias("f")).union(all_links.select("b")).groupBy("f").agg(F.count("*").alias("n_links"))
    named = texts.join(labels, texts["f"] == labels["node"], "left").select("f", "id", F.coalesce("root", "f").alias("root"))
    names = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = named.join(names, "root").join(degree, "f", "left").select("f", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    done = full.select("id", "n", "f").join(named, "f").select("id", "n", "component_id", "n_links")
    alone = sig.where("n = 0").select("id", "n", F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return done.union(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "n_links")
