"""N-gram Jaccard join by partitioning the universe of shingles; components of the links.

Sets of similarity 9/10 and sizes a <= b differ in at most (a + b) / 19 shingles. For each size band the hash range is cut
into m segments and segment i may be allotted z = 1 (equal) or z = 2 (equal, or one shingle more or less). If the z add up to
one more than the differences allowed, two similar sets agree in some segment within its allotment; they then share one of
the segment's signatures: that of its whole content, or with z = 2 that of the content without one shingle. The allocation
per band is the one of least cost, signatures plus expected chance meetings. A set has signatures in its own band and in the
band below if that may hold a smaller partner.

Equal sets are one class first. Per signature every class is compared with the smallest one; the links so found give
components, and then all pairs of a signature that lie in different components are compared too. In both rounds pairs whose parity
bitmaps differ in more bits than similar sets have different shingles are left out before their sets travel (a bound that no pair escapes).
So no similar pair goes unseen unless it is already connected, and a large group of near copies costs a star and not all its
pairs. Sets are compared exactly, as sets of 64-bit shingle hashes; classes are 64-bit fingerprints of sets.

With ``counted`` the signatures are counted in buckets before they travel with their sets: one that occurs once is met by nobody and goes
no further. At low thresholds, where a set has many signatures, this takes four bytes a signature and little more.

Defined results: a text of fewer words than a shingle is one shingle; no words or null text: an empty set, its own component;
a row with a null id links its neighbours and gets their smallest id; repeated rows are one class; long texts are read
whole; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cache_of, discard, parts, text_bytes, tidy, unpack, written
from .components import components
from .encoding import batches

SHINGLE = 3
PERCENT = 90
BAND_RATIO = 1.25
CACHE_WORDS = 400_000
BITMAP = 1024
#: Bytes of text for each bucket of signatures that are counted together, and characters whose signatures go there as one row.
BUCKET_TEXT, CUT_TEXT = 8 << 20, 2 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Hashes(dict):
    def __missing__(self, word):
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; ``bytes`` lower-cases A-Z alone and splits at the six ASCII spaces alone."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, _U)
    known = cache_of("jaccard").setdefault("words", _Hashes())
    if len(known) > CACHE_WORDS:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), _U, len(words))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, _U(n))
    for i in range(n):
        out = mix(out * _U(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def fingerprint(shingle_set: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(mix(shingle_set ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U, keepdims=True) + _U(len(shingle_set)))[0].astype(np.int64))


@functools.cache
def bands(limit: int) -> list[int]:
    """Lower ends of the size bands up to ``limit``."""
    out = [1]
    while out[-1] <= limit:
        out.append(max(out[-1] + 1, int(out[-1] * BAND_RATIO)))
    return out


@functools.cache
def allocation(low: int, high: int, percent: int = PERCENT) -> tuple[int, int]:
    """Segments and how many of them tolerate one difference, for pairs whose smaller size is in [low, high).

    The sum of the allotments must be one more than the differences allowed. ``a`` is the mean content of a segment; the
    chance that two sets that share half their shingles agree in it falls with it.
    """
    a, b = high - 1, (high - 1) * 100 // percent
    differ = (a + b) * (100 - percent) // (100 + percent)
    best = None
    for tolerant in range((differ + 1) // 2 + 1):
        m = differ + 1 - tolerant
        mean = (low + high) / 2 / m
        meet = 200 * 0.5**mean
        cost = (m - tolerant) * (1 + meet) + tolerant * (mean + 1) * (1 + meet)
        if best is None or cost < best[0]:
            best = cost, m, tolerant
    return best[1], best[2]


def signatures(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """All signatures, set after set, and how many each has."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return np.zeros(0, _U), np.zeros(len(sets), np.int64)
    edges = np.array(bands(int(sizes.max()) + 1))
    own = np.searchsorted(edges, sizes, side="right") - 1
    below = np.searchsorted(edges, -(-sizes * percent // 100), side="right") - 1
    parts, owner = [], []
    for shift in range(int((own - below).max()) + 1):
        for k in np.unique(own):
            band = int(k) - shift
            if band < 0:
                continue
            at = np.flatnonzero((own == k) & (below <= band) & (sizes > 0))
            m, tolerant = allocation(int(edges[band]), int(edges[band + 1]), percent)
            if not len(at) or m == 1 and not tolerant:  # only equal sets are similar, and those are one class
                continue
            flat = np.concatenate([sets[i] for i in at])
            place = np.repeat(np.arange(len(at)), sizes[at])
            segment = ((flat >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
            cell = place * m + segment  # ascending, since a set is sorted
            value = mix(flat + _U(0xD6E8FEB86659FD93))
            count = np.bincount(cell, minlength=len(at) * m)
            ends = np.cumsum(count)
            run = np.concatenate([np.zeros(1, _U), np.cumsum(value, dtype=_U)])
            total = run[ends] - run[ends - count]
            names = mix(np.arange(m, dtype=_U) + _U(band << 32))
            parts.append(mix(total ^ np.tile(names, len(at))))
            owner.append(np.repeat(at, m))
            if tolerant:
                some = segment < tolerant
                parts.append(mix((total[cell[some]] - value[some]) ^ names[segment[some]]))
                owner.append(at[place[some]])
    if not parts:
        return np.zeros(0, _U), np.zeros(len(sets), np.int64)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(parts)[order], np.bincount(owner, minlength=len(sets))


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """Parity of the number of shingles at each of ``BITMAP`` places, as 64-bit words; sets in d shingles different differ in d bits at most."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = (np.concatenate(sets) & _U(BITMAP - 1)).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
    odd = np.bincount(np.repeat(np.arange(len(sets)) * BITMAP, sizes) + flat, minlength=len(sets) * BITMAP).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def may_be_similar(n1, n2, bits1, bits2, percent: int = PERCENT):
    """False only for pairs whose bitmaps prove that they differ in too many shingles."""
    differ = sum((F.bit_count(F.get(bits1, F.lit(i)).bitwiseXOR(F.get(bits2, F.lit(i)))) for i in range(BITMAP // 64)), F.lit(0))
    return differ * (100 + percent) <= (n1 + n2) * (100 - percent)


def wide_bitmap(shingle_set: np.ndarray) -> bytes | None:
    """Parity by place of a set of more than ``BITMAP`` shingles, for which ``bitmaps`` says little: two to four places a shingle."""
    if len(shingle_set) <= BITMAP:
        return None
    places = 1 << (2 * len(shingle_set) - 1).bit_length()
    odd = np.bincount((shingle_set & _U(places - 1)).astype(np.int64), minlength=places).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two wide bitmaps differ; the longer one is folded, which joins places and keeps their parity."""
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def possible(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of classes that their bitmaps leave: whole sets travel for these alone."""

    def joined(columns):
        out = pairs
        for side, k in (("a", "1"), ("b", "2")):
            out = out.join(classes.select(F.col("v").alias(side), *[F.col(c).alias(c + k) for c in columns]), side)
        return out

    def leave(stream):
        for batch in stream:
            rows = zip(*(batch.column(c).to_pylist() for c in ("n1", "n2")), batch.column("wide1"), batch.column("wide2"), strict=True)
            keep = [not (x.is_valid and y.is_valid) or differing(*(unpack(z.as_buffer(), np.uint8) for z in (x, y))) * (100 + percent) <= (n + m) * (100 - percent) for n, m, x, y in rows]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = joined(["n", "bits"]).filter(may_be_similar(*map(F.col, ("n1", "n2", "bits1", "bits2")), percent)).select("a", "b")
    return joined(["n", "wide"]).select("a", "b", "n1", "n2", "wide1", "wide2").mapInArrow(leave, "a long, b long")


def digests(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, counted: bool = False) -> DataFrame:
    """doc_id, n (set size), v (class), bits, wide (bitmap of a large set), signatures (none with ``counted``)."""

    def run(stream):
        with np.errstate(over="ignore"):
            for batch in stream:
                for texts, rest in batches(batch, 2 << 20):
                    sets = [shingles(t, size) for t in texts]
                    flat, count = (np.zeros(0, _U), np.zeros(len(sets), np.int64)) if counted else signatures(sets, percent)
                    offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
                    yield pa.record_batch({
                        "doc_id": rest.column("doc_id").cast(pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()), "v": pa.array([fingerprint(s) for s in sets], pa.int64()),
                        "bits": pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (BITMAP // 64)), pa.array(bitmaps(sets))),
                        "wide": pa.array([wide_bitmap(s) for s in sets], pa.binary()), "signatures": pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64))),
                    })

    return docs.select("doc_id", "text").mapInArrow(lambda stream: tidy(run(stream)), "doc_id long, n long, v long, bits array<long>, wide binary, signatures array<long>")


def _numbers(x: np.ndarray) -> bytes:
    """Numbers in as few bytes as the largest takes; the first byte says how many."""
    width = 1 if not len(x) or x.max() < 1 << 8 else 2 if x.max() < 1 << 16 else 4
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _from_numbers(blob) -> np.ndarray:
    raw = bytes(blob)
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def met(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """v (class), n (set size), s: the signatures of each set, but for those that occur once.

    A signature's name is its bucket and 32 bits of it; buckets grow with the text, so few names stand for two signatures. Those
    count as one signature, which can only bring more sets together; every pair is compared exactly later.
    """
    buckets = parts(text_bytes(docs), BUCKET_TEXT)
    schema = "bucket int, batch long, sets binary, counts binary, entries binary"
    of_set = np.dtype([("v", "<i8"), ("n", "<i8")])

    def cut(stream):
        """Per group of texts a row with its sets, and for each bucket a row with how many names each set has there, and the names."""
        from pyspark import TaskContext

        batch_id = TaskContext.get().partitionId() << 32
        with np.errstate(over="ignore"):
            for batch in stream:
                for texts, _ in batches(batch, CUT_TEXT):
                    sets = list({fingerprint(x): x for t in texts if len(x := shingles(t, size))}.items())
                    if not sets:
                        continue
                    flat, count = signatures([x for _, x in sets], percent)
                    own = np.repeat(np.arange(len(sets)), count)
                    bucket = ((flat >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")  # within a bucket by set
                    own, flat = own[order], flat[order].astype("<u4")
                    ends = np.cumsum(np.bincount(bucket, minlength=buckets))
                    used = np.flatnonzero(np.diff(ends, prepend=0))
                    spans_ = list(zip(np.concatenate([[0], ends])[used].tolist(), ends[used].tolist(), strict=True))
                    about = np.array([(v, len(x)) for v, x in sets], of_set).tobytes()
                    yield pa.record_batch({
                        "bucket": pa.array([batch_id % buckets, *used.tolist()], pa.int32()), "batch": pa.array([batch_id] * (1 + len(used)), pa.int64()), "sets": pa.array([about, *[None] * len(used)], pa.binary()),
                        "counts": pa.array([None, *[_numbers(np.bincount(own[a:b], minlength=len(sets))) for a, b in spans_]], pa.binary()),
                        "entries": pa.array([None, *[flat[a:b].tobytes() for a, b in spans_]], pa.binary()),
                    })
                    batch_id += 1

    def count(table):
        """The names of a bucket that occur more than once."""
        about = table.filter(table.column("entries").is_null())
        rest = table.filter(table.column("entries").is_valid())
        if not rest.num_rows:
            return about
        names = [np.frombuffer(x.as_buffer(), "<u4") for x in rest.column("entries")]
        flat = np.sort(np.concatenate(names))
        often = np.unique(flat[1:][flat[1:] == flat[:-1]])
        out = [[], []]
        for own, counts in zip(names, rest.column("counts"), strict=True):
            counts = _from_numbers(counts.as_buffer())
            some = often[np.minimum(np.searchsorted(often, own), len(often) - 1)] == own if len(often) else np.zeros(len(own), bool)
            out[0].append(_numbers(np.bincount(np.repeat(np.arange(len(counts)), counts)[some], minlength=len(counts))))
            out[1].append(own[some].tobytes())
        for name, blobs in zip(("counts", "entries"), out, strict=True):
            rest = rest.set_column(rest.schema.get_field_index(name), name, pa.array(blobs, pa.binary()))
        return pa.concat_tables([about, rest.filter(pc.greater(pc.binary_length(rest.column("entries")), 0))])

    def name(table):
        """The sets of a group of texts with what is left of their names."""
        about = np.frombuffer(next(x for x in table.column("sets") if x.is_valid).as_buffer(), of_set)
        found = [(b, c.as_buffer(), e.as_buffer()) for b, c, e in zip(*(table.column(k) for k in ("bucket", "counts", "entries")), strict=True) if e.is_valid]
        own = np.concatenate([np.zeros(0, np.int64), *[np.repeat(np.arange(len(about)), _from_numbers(c)) for _, c, _ in found]])
        s = np.concatenate([np.zeros(0, np.int64), *[b.as_py() << 32 | np.frombuffer(e, "<u4").astype(np.int64) for b, _, e in found]])
        return pa.table({"v": about["v"][own], "n": about["n"][own], "s": s})

    cuts = docs.select("doc_id", "text").mapInArrow(lambda stream: tidy(cut(stream)), schema)
    common = written(cuts.groupBy("bucket").applyInArrow(count, schema), "jaccard-common")
    out = written(common.groupBy("batch").applyInArrow(name, "v long, n long, s long").distinct(), "jaccard-met")
    discard(common)
    return out


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the similarity."""
    wanted = pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v"))).distinct()
    ids = written(wanted.join(classes, "v").select("v", F.col("rep").alias("rep")), "jaccard-wanted")

    def read(stream):
        with np.errstate(over="ignore"):
            for batch in stream:
                for texts, _ in batches(batch, 2 << 20):
                    sets = [shingles(t, size) for t in texts]
                    yield pa.record_batch({"v": pa.array([fingerprint(s) for s in sets], pa.int64()), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})

    rows = docs.select("doc_id", "text").join(ids.select("rep").distinct(), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    # a class's document may share its id with documents of other classes
    sets = rows.mapInArrow(lambda stream: tidy(read(stream)), "v long, shingles binary").dropDuplicates(["v"]).join(ids.select("v"), "v", "left_semi")
    sets = written(sets, "jaccard-sets")

    def compare(stream):
        for batch in stream:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.select(F.col("v").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("v").alias("b"), F.col("shingles").alias("y")), "b")
    out = written(joined.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "jaccard-links")
    discard(ids, sets)
    return out


def similar_lengths(p, q, percent: int = PERCENT):
    return F.least(p, q) * 100 >= F.greatest(p, q) * percent


def link(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, counted: bool = False) -> tuple[DataFrame, DataFrame]:
    """Per document: doc_id, n_shingles, class_id, component_id, set (class) and label (the smallest class of the component;
    null for an empty set); and the links between classes that connect them: a, b."""
    rows = written(digests(docs, size, percent, counted), "jaccard-digests")
    classes = written(rows.filter("n > 0").groupBy("v").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.any_value("bits").alias("bits"), F.any_value("wide").alias("wide")), "jaccard-classes")
    if counted:
        once = seen = met(docs, size, percent)
    else:
        once = rows.filter(F.size("signatures") > 0).dropDuplicates(["v"]).select("v", "n", F.explode("signatures").alias("s"))
    once = once.repartition("s")  # one exchange for the smallest class and for its partners
    least = once.groupBy("s").agg(F.min(F.struct("v", "n")).alias("c"), F.max("v").alias("most")).filter("c.v <> most")
    shared = written(once.join(least, "s").select("s", "v", "n", F.col("c.v").alias("center"), F.col("c.n").alias("center_n")).distinct(), "jaccard-shared")
    if counted:
        discard(seen)
    pairs = shared.filter("v <> center").filter(similar_lengths(F.col("n"), F.col("center_n"), percent)).select(F.col("center").alias("a"), F.col("v").alias("b")).distinct()
    stars = written(possible(pairs, classes, percent), "jaccard-stars")
    found = verified(docs, stars, classes, size, percent)
    labels = components(found)
    named = shared.select("s", "v", "n").join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    named = written(named.select("s", "v", "n", "label"), "jaccard-named")
    discard(shared)
    mixed = named.groupBy("s").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.min("v").alias("center"), F.count(F.lit(1)).alias("k")).filter("l <> m and k > 2").select("s", "center")
    opened = named.join(mixed, "s").filter("v <> center")  # pairs with the smallest class are known
    opened = written(opened.join(classes.select("v", "bits"), "v"), "jaccard-open")
    discard(named)
    left, right = (opened.select(*[F.col(c).alias(c + k) for c in ("s", "v", "n", "label", "bits")]) for k in "12")
    near = (F.col("s1") == F.col("s2")) & (F.col("v1") < F.col("v2")) & (F.col("label1") != F.col("label2")) & similar_lengths(F.col("n1"), F.col("n2"), percent)
    rest = left.join(right, near & may_be_similar(*map(F.col, ("n1", "n2", "bits1", "bits2")), percent)).select(F.col("v1").alias("a"), F.col("v2").alias("b")).distinct()
    rest = written(possible(rest.join(stars, ["a", "b"], "left_anti"), classes, percent), "jaccard-rest")
    discard(opened, stars)
    if rest.limit(1).count():
        more = verified(docs, rest, classes, size, percent)
        if more.limit(1).count():
            found = found.union(more)
            discard(labels)
            labels = components(found)
    members = labels.join(classes, "v").groupBy("label").agg(F.min("rep").alias("component"))
    grouped = written(labels.join(members, "label").select("v", "component", "label"), "jaccard-components")
    discard(rest, labels)
    out = rows.select("doc_id", "n", "v").join(classes.select("v", "rep"), "v", "left").join(grouped, "v", "left")
    empty = F.col("n") == 0
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("rep")).alias("class_id"), F.when(empty, F.col("doc_id")).otherwise(F.coalesce("component", "rep")).alias("component_id"), F.col("v").alias("set"), F.when(~empty, F.coalesce("label", "v")).alias("label"))
    return out, found


def query(spark, sf_dir: str) -> DataFrame:
    """op6: components of all ``documents``."""
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0].select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
with recursive w as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select r, doc_id, case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')] else list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) end as sh from w),
n as (select r, doc_id, len(sh)::bigint as n from s),
e as (select r, unnest(sh) as g from s),
f as (select g, count(*) as c from e group by 1 having count(*) > 1),
o as (select r, g, row_number() over (partition by r order by coalesce(c, 1), g) as k from e left join f using (g)),
p as (select r, g from o join n using (r) where k <= n - ceil(0.9 * n) + 1),
c as (select distinct a.r as a, b.r as b from p a join p b on a.g = b.g and a.r < b.r),
i as (select c.a, c.b, len(list_intersect(x.sh, y.sh)) as both_, len(x.sh) + len(y.sh) as total from c join s x on x.r = c.a join s y on y.r = c.b where 10 * least(len(x.sh), len(y.sh)) >= 9 * greatest(len(x.sh), len(y.sh))),
l as (select a, b from i where 100 * both_ >= 90 * (total - both_)),
u as (select a, b from l union all select b, a from l),
t(r, m) as (select r, r from n union select u.b, t.m from t join u on u.a = t.r where t.m < u.b),
q as (select r, min(m) as root from t group by 1),
z as (select q.r, min(doc_id) over (partition by root) as component_id from q join n using (r))
select doc_id, n as n_shingles, component_id from n join z using (r)"""
