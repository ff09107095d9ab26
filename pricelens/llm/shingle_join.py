"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles. Two sets link at Jaccard similarity 0.8 (exactly:
100 * common >= 80 * union). Shingles are put in one order for all, the rarest first. If two sets
link, their prefixes of ``n - ceil(0.8 * n) + l`` shingles share at least ``l``, for any ``l``. Each
document picks its own ``l``: the one with the least estimated cost, the postings its prefix meets
plus the verification of the at most ``postings / l`` documents that can share ``l`` of them. Two
documents are then a candidate pair if their prefixes share as many as the lesser of their two ``l``.

Work and memory at scale

* Equal sets are one class from the start; only classes are joined.
* Shingles go to buckets as arrays, one row for a block of documents, so a frequent shingle costs a
  bucket an entry for each document in a compact array and no rows. Buckets answer with the number of
  shingles of a document that some other document has too; one that has less than 0.8 of its set
  cannot link with anything and needs no further work. Only the rest is read again and ordered.
* Classes are put in cells by the least class with which they share most shingles, so a family of
  near copies meets in one cell. Cells are split into chunks of bounded size. A task compares chunks
  exactly by multiplying their incidence matrices and gives back only the links that join something,
  never all pairs. Families need no pair rows, whatever their size: once a chunk's members
  are one component, only the classes outside the cell's largest component meet the other chunks.
* What remains, candidates from different cells, is found on the posting lists of the prefixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelens.llm.components import components
from pricelens.llm.tables import buckets_for, stored
from pricelens.llm.words import mixed, word_hashes
from pricelens.operators.lookup import hot_lookup

SHINGLE = 5
#: Links need 100 * common >= PERCENT * union.
PERCENT = 80
#: The most matches asked of a prefix, shingles in a block, classes and shingles in a chunk.
MOST_MATCHES, BLOCK, CHUNK, CHUNK_SHINGLES = 32, 1 << 20, 512, 1 << 20
TEXTS_AT_ONCE = 256
_ABOUT = np.dtype([("doc_id", "<i8"), ("has_id", "?"), ("key", "<i8"), ("t", "<i8"), ("n", "<i8"), ("sid", "<i8")])


def shingle_sets(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Fewer words than a shingle are one shingle together."""
    words, offsets = word_hashes(texts)
    out = []
    for low, high in zip(offsets[:-1], offsets[1:], strict=True):
        own = words[low:high]
        width = min(size, len(own))
        if not width:
            out.append(own)
            continue
        found = mixed(own[: len(own) - width + 1] ^ np.uint64(width))
        for k in range(1, width):
            found = mixed(found * np.uint64(0x9E3779B97F4A7C15) + own[k : len(own) - width + 1 + k])
        out.append(np.unique(found))
    return out


def set_id(shingles: np.ndarray) -> int:
    """A 64-bit id of a set; equal sets have equal ids."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_common(n: int | np.ndarray) -> int | np.ndarray:
    """How many shingles a set of ``n`` must have in common with any set it links with."""
    return -(-n * PERCENT // 100)


def _to_buckets(sets: list[np.ndarray], about: np.ndarray, block: int, buckets: int, whole: bool) -> pa.RecordBatch:
    """A block's shingles by bucket: which of its documents, and the hash (32 bits of it unless ``whole``).
    What is known about the documents travels in one of the rows."""
    hashes = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
    bucket = (hashes % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    hashes, doc = hashes[order], doc[order]
    values = hashes if whole else (hashes // np.uint64(buckets)).astype("<u4")
    home = block % buckets
    used = [b for b in range(buckets) if ends[b] < ends[b + 1] or b == home]
    cut = lambda x, b: x[ends[b] : ends[b + 1]].tobytes()
    return pa.RecordBatch.from_pydict(
        {
            "bucket": pa.array(used, pa.int32()),
            "block": pa.array([block] * len(used), pa.int64()),
            "docs": pa.array([cut(doc, b) for b in used], pa.binary()),
            "hashes": pa.array([cut(values, b) for b in used], pa.binary()),
            "about": pa.array([about.tobytes() if b == home else None for b in used], pa.binary()),
            "sids": pa.array([about["sid"].tobytes() if whole else None] * len(used), pa.binary()),
        }
    )


_SENT = "bucket int, block long, docs binary, hashes binary, about binary, sids binary"


def _sent(docs: DataFrame, buckets: int, whole: bool) -> DataFrame:
    """Shingles of ``docs`` (``doc_id``, ``key``, ``t``, ``text``) by bucket. With ``whole``, ``sid`` says which set
    is wanted of a text, and a set is sent once; equal sets must then be in one partition."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        seen: set[int] = set()
        sets, about, held = [], [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(start, TEXTS_AT_ONCE)
                wanted = part.column("sid").to_pylist() if whole else [None] * part.num_rows
                known = [part.column(c).to_pylist() for c in ("doc_id", "key", "t")]
                rows = zip(*known, wanted, shingle_sets([t or "" for t in part.column("text").to_pylist()]), strict=True)
                for doc_id, key, t, want, own in rows:
                    sid = set_id(own)
                    if whole and (sid != want or sid in seen):
                        continue
                    if whole:
                        seen.add(sid)
                    sets.append(own)
                    about.append((doc_id or 0, doc_id is not None, key, t, len(own), sid))
                    held += len(own)
                if held >= BLOCK or len(sets) >= 60_000:
                    yield _to_buckets(sets, np.array(about, _ABOUT), block, buckets, whole)
                    sets, about, held, block = [], [], 0, block + 1
        if sets:
            yield _to_buckets(sets, np.array(about, _ABOUT), block, buckets, whole)

    return docs.mapInArrow(send, _SENT)


def document_sets(docs: DataFrame, buckets: int) -> DataFrame:
    """Every document's ``n_shingles``, its set's id and whether it can link with a text at all."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = [len(h) // 4 for h in rows["hashes"]]
        values = np.frombuffer(b"".join(rows["hashes"]), "<u4")
        _, at, times = np.unique(values, return_inverse=True, return_counts=True)
        shared = times[at] > 1
        out = []
        for docs_of, low, n in zip(rows["docs"], np.cumsum(sizes) - sizes, sizes, strict=True):
            out.append(np.bincount(np.frombuffer(docs_of, "<u2")[shared[low : low + n]]).astype("<u4").tobytes())
        return pd.DataFrame({"block": rows["block"], "shared": out, "about": rows["about"]})

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        about = np.frombuffer(rows["about"].dropna().iloc[0], _ABOUT)
        shared = np.zeros(len(about), np.int64)
        for raw in rows["shared"]:
            own = np.frombuffer(raw, "<u4")
            shared[: len(own)] += own
        return pd.DataFrame(
            {
                "doc_id": pd.arrays.IntegerArray(about["doc_id"].copy(), ~about["has_id"]),
                "key": about["key"],
                "t": about["t"],
                "n_shingles": about["n"],
                "sid": about["sid"],
                "alive": (about["n"] > 0) & (shared >= least_common(about["n"])),
            }
        )

    counted = _sent(docs, buckets, False).groupBy("bucket").applyInPandas(count, "block long, shared binary, about binary")
    return counted.groupBy("block").applyInPandas(judge, "doc_id long, key long, t long, n_shingles long, sid long, alive boolean")


def matches_asked(n: int, df: np.ndarray) -> tuple[int, int]:
    """``l`` and how many of the shared shingles (``df`` of each, rising) lie in the prefix."""
    alone, need = n - len(df), least_common(n)
    asked = np.arange(1, min(need, MOST_MATCHES) + 1)
    inside = np.clip(n - need + asked - alone, 0, len(df))
    met = np.concatenate([[0], np.cumsum(df - 1)])[inside]
    best = int(np.argmin(met + n * met / asked))
    return int(asked[best]), int(inside[best])


def candidates(docs: DataFrame, buckets: int) -> DataFrame:
    """Of each class that can link: ``sid``, ``n``, ``l``, ``cell``, ``prefix`` and ``shared``, its shingles
    that other classes have too. ``docs`` has ``doc_id``, ``key``, ``text`` and the ``sid`` wanted of it."""

    def weigh(rows: pd.DataFrame) -> pd.DataFrame:
        hashes = np.frombuffer(b"".join(rows["hashes"]), np.uint64)
        sizes = [len(h) // 8 for h in rows["hashes"]]
        owner = np.concatenate([np.frombuffer(s, "<i8")[np.frombuffer(d, "<u2")] for s, d in zip(rows["sids"], rows["docs"], strict=True)])
        keys, at, times = np.unique(hashes, return_inverse=True, return_counts=True)
        leader = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(leader, at, owner)
        shared = times[at] > 1
        out: dict[str, list] = {"docs": [], "hashes": [], "df": [], "leaders": []}
        for docs_of, low, n in zip(rows["docs"], np.cumsum(sizes) - sizes, sizes, strict=True):
            own = slice(low, low + n)
            keep = shared[own]
            out["docs"].append(np.frombuffer(docs_of, "<u2")[keep].tobytes())
            out["hashes"].append(hashes[own][keep].tobytes())
            out["df"].append(times[at[own][keep]].astype("<u4").tobytes())
            out["leaders"].append(leader[at[own][keep]].astype("<i8").tobytes())
        return pd.DataFrame({"block": rows["block"], **out, "about": rows["about"]})

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        about = np.frombuffer(rows["about"].dropna().iloc[0], _ABOUT)
        join = lambda name, kind: np.frombuffer(b"".join(rows[name]), kind)
        doc, hashes, df, leaders = join("docs", "<u2"), join("hashes", np.uint64), join("df", "<u4").astype(np.int64), join("leaders", "<i8")
        order = np.lexsort((hashes, df, doc))
        doc, hashes, df, leaders = doc[order], hashes[order], df[order], leaders[order]
        bounds = np.searchsorted(doc, np.arange(len(about) + 1))
        out = []
        for k, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            n = int(about["n"][k])
            if high - low < least_common(n):
                continue
            asked, inside = matches_asked(n, df[low:high])
            names, times = np.unique(leaders[low:high], return_counts=True)
            prefix = hashes[low : low + inside].view(np.int64)
            out.append((int(about["sid"][k]), n, asked, int(names[times.argmax()]), prefix, np.sort(hashes[low:high]).tobytes()))
        return pd.DataFrame(out, columns=["sid", "n", "l", "cell", "prefix", "shared"])

    weighed = _sent(docs, buckets, True).groupBy("bucket").applyInPandas(weigh, "block long, docs binary, hashes binary, df binary, leaders binary, about binary")
    return weighed.groupBy("block").applyInPandas(choose, "sid long, n long, l int, cell long, prefix array<long>, shared binary")


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``a`` has in common with each of ``b``."""
    both = np.intersect1d(np.concatenate(a), np.concatenate(b)) if a and b else np.empty(0, np.uint64)
    out = np.zeros((len(a), len(b)), np.float32)
    cells = [[np.searchsorted(both, s[np.isin(s, both, assume_unique=True)]) for s in side] for side in (a, b)]
    for start in range(0, len(both), 4096):
        parts = []
        for side in cells:
            matrix = np.zeros((len(side), min(4096, len(both) - start)), np.float32)
            for row, at in enumerate(side):
                low, high = np.searchsorted(at, [start, start + 4096])
                matrix[row, at[low:high] - start] = 1
            parts.append(matrix)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def joining_links(ids_a: np.ndarray, ids_b: np.ndarray, linked: np.ndarray, label: dict[int, int]) -> list[tuple[int, int]]:
    """Of all links (a matrix) only those that join two components, given what is joined already."""
    parent = {v: v for v in label.values()}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = root(label[int(ids_a[i])]), root(label[int(ids_b[j])])
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(ids_a[i]), int(ids_b[j])))
    return out


def _links_between(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Links that join components among two chunks (``sid``, ``n``, ``label``, ``shared``)."""
    sets_a, sets_b = ([np.frombuffer(x, np.uint64) for x in side["shared"]] for side in (a, b))
    common = common_counts(sets_a, sets_b)
    union = a["n"].to_numpy()[:, None] + b["n"].to_numpy()[None] - common
    ids_a, ids_b = a["sid"].to_numpy(), b["sid"].to_numpy()
    label = dict(zip(np.concatenate([ids_a, ids_b]).tolist(), np.concatenate([a["label"], b["label"]]).tolist(), strict=True))
    linked = (100 * common >= PERCENT * union) & (ids_a[:, None] != ids_b[None])
    return pd.DataFrame(joining_links(ids_a, ids_b, linked, label), columns=["a", "b"]).astype("int64")


def links(classes: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) that connect what the join connects, from ``candidates`` (stored)."""
    size = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum(F.octet_length("shared")) / (8 * CHUNK_SHINGLES))).cast("int")
    cells = classes.groupBy("cell").agg(size.alias("chunks"))
    dealt = classes.join(cells, "cell").withColumn("chunk", F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int"))
    dealt = stored(dealt.select("sid", "n", "l", "cell", "chunks", "chunk", "prefix", "shared"), "dealt")

    def inside(rows: pd.DataFrame) -> pd.DataFrame:
        return _links_between(rows, rows)

    alone = dealt.select("cell", "chunk", "sid", "n", F.col("sid").alias("label"), "shared")
    first = stored(alone.groupBy("cell", "chunk").applyInPandas(inside, "a long, b long"), "inside")
    labels = components(classes.select(F.col("sid").alias("id")), first).select(F.col("id").alias("sid"), "label")
    known = stored(dealt.join(labels, "sid"), "known")

    # The same cell, another chunk: every class outside the cell's largest component meets every chunk.
    split = known.where("chunks > 1").select("cell", "chunks", "chunk", "sid", "n", "label", "shared")
    sizes = split.groupBy("cell", "label").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("cell").agg(F.max_by("label", F.struct("size", "label")).alias("largest"))
    others = split.join(largest, "cell").where("label <> largest").drop("largest")
    others = others.withColumnRenamed("chunk", "own").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    others = others.where("own <> chunk").select(*(F.col(c).alias(c) for c in ("cell", "chunk", "sid", "n", "label", "shared")))

    def across(rows: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
        found = [_links_between(guests.iloc[k : k + CHUNK], rows) for k in range(0, len(guests), CHUNK)] if len(rows) else []
        return pd.concat(found) if found else pd.DataFrame({"a": [], "b": []}).astype("int64")

    split = split.drop("chunks")
    second = split.groupBy("cell", "chunk").cogroup(others.groupBy("cell", "chunk")).applyInPandas(across, "a long, b long")

    # Other cells: posting lists of the prefixes, a list for each shingle and chunk, so lists are bounded.
    posts = known.select(F.explode("prefix").alias("shingle"), "cell", "chunk", "sid", "l", "label")
    mixed_lists = posts.groupBy("shingle").agg(F.min("cell").alias("c0"), F.max("cell").alias("c1"), F.min("label").alias("l0"), F.max("label").alias("l1"))
    posts = posts.join(mixed_lists.where("c0 <> c1 AND l0 <> l1").select("shingle"), "shingle")
    lists = posts.groupBy("shingle", "cell", "chunk").agg(F.collect_list(F.struct("sid", "l", "label")).alias("held"))
    left = lists.select("shingle", F.col("cell").alias("cell_a"), F.col("held").alias("held_a"))
    pairs = left.join(lists, "shingle").where("cell_a < cell").select(F.explode("held_a").alias("x"), "held")
    pairs = pairs.select("x", F.explode(F.filter("held", lambda y: y["label"] != F.col("x.label"))).alias("y"))
    pairs = pairs.groupBy(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).agg(F.count("*").alias("met"), F.min(F.least("x.l", "y.l")).alias("asked"))
    pairs = pairs.where("met >= asked").select("a", "b")
    side = lambda name: known.select(F.col("sid").alias(name), F.col("n").alias(f"n_{name}"), F.col("shared").alias(f"s_{name}"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            common = np.array([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), True)) for x, y in zip(batch["s_a"], batch["s_b"], strict=True)], np.int64)
            good = 100 * common >= PERCENT * (batch["n_a"].to_numpy() + batch["n_b"].to_numpy() - common)
            yield batch.loc[good, ["a", "b"]]

    third = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInPandas(verify, "a long, b long")
    return first.union(second).union(third)


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and what tells rows apart: ``key``, the id or else a hash, and ``t``, the text's hash."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.xxhash64(text)).alias("key"), F.xxhash64(text).alias("t"), text.alias("text"))


def document_components(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``key``, ``t``, ``n_shingles`` and ``label`` of every document; links join documents of one label."""
    plain = _keyed(docs)
    buckets = buckets_for(docs, 12)
    sets = stored(document_sets(plain, buckets), "sets")
    wanted = sets.where("alive").groupBy("sid").agg(F.min(F.struct("key", "t")).alias("row")).select("sid", "row.key", "row.t")
    again = plain.join(wanted, ["key", "t"]).select("doc_id", "key", "t", "text", "sid")
    classes = stored(candidates(again.repartition(buckets, "sid"), buckets), "classes")
    labels = components(classes.select(F.col("sid").alias("id")), links(classes)).select(F.col("id").alias("sid"), "label")
    # Copies share a class and near copies a label, so either may have very many rows.
    return hot_lookup(sets, labels, "sid").select("doc_id", "key", "t", "n_shingles", F.coalesce("label", "sid").alias("label"))


def linked_documents(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles``, ``component_id``, the least ``doc_id`` that links reach.

    A null or empty text, or one without a word, has no shingle and links with nothing. Rows that
    repeat a ``doc_id`` are documents of their own and share its name; a null ``doc_id`` takes part in
    links but names no component, so a component of null ids alone has a null name. No row for an
    empty table.
    """
    found = stored(document_components(docs), "components")
    least = found.where("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    component = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return hot_lookup(found, least, "label").select("doc_id", "n_shingles", component.alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of each component: that of the least ``doc_id``, null ids last. Texts
    without a word all stay. Columns pass through."""
    found = document_components(docs).where("n_shingles > 0")
    stay = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "key", "t")).alias("row")).select("row.key", "row.t")
    text = F.col("text").cast("string")
    doc_id, whole = F.col("doc_id").cast("long"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(whole, F.coalesce(doc_id, F.xxhash64(F.coalesce(text, F.lit("")))).alias("key"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("t"), F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded"))
    first = F.row_number().over(Window.partitionBy("key", "t").orderBy(F.lit(0)))
    kept = rows.where("worded").join(stay.distinct(), ["key", "t"]).withColumn("nth", first).where("nth = 1")
    return kept.select("row").union(rows.where("NOT worded").select("row")).select("row.*")
