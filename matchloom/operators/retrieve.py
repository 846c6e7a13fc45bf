"""Exact top-k similarity search of a stated query set, and the filters behind it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import text as X
from matchloom.session import checkpointed

#: Query vectors that may be held by every task at once; more are worked off in blocks of this size.
QUERY_BLOCK = 4096


def _unit(col: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(col.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def _places(*keys: np.ndarray) -> np.ndarray:
    """The place of each row within its run of equal keys; the rows are sorted by them."""
    n = np.arange(len(keys[0]))
    new = np.ones(len(n), bool)
    if len(n):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return n - np.maximum.accumulate(np.where(new, n, 0)) if len(n) else n


def _best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, nid: np.ndarray, k: int, low: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, score) of the k greatest scores of each query at `low` or above, compared at 12 digits as in
    the ranking; ties by smaller id. Single precision chooses with room to spare, double precision decides."""
    s = q.astype(np.float32) @ x.astype(np.float32).T
    if k < len(x):
        last = np.partition(s, len(x) - k - 1, axis=1)[:, len(x) - k - 1]  # one more than k, for the query itself
        low32 = np.maximum(last, low) - 1e-5
    else:
        low32 = np.full(len(q), max(low, -2.0) - 1e-5)
    r, c = np.nonzero(s >= low32[:, None].astype(np.float32))
    other = ids[r] != nid[c]
    r, c = r[other], c[other]
    exact = np.einsum("nd,nd->n", q[r], x[c])
    order = np.lexsort((nid[c], -np.round(exact, 12), r))
    order = order[(_places(r[order]) < k) & (exact[order] >= low - 1e-12)]
    return r[order], c[order], exact[order]


def _matcher(dim: int, k: int, threshold: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                ids, nid = (np.asarray(b.column(c)[row].as_py(), dtype=np.int64) for c in ("qid", "ids"))
                q, x = (np.frombuffer(b.column(c)[row].as_py(), dtype=np.float64).reshape(-1, dim) for c in ("qvec", "vecs"))
                r, c, sims = _best(q, x, ids, nid, k, -2.0 if threshold is None else threshold)
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(nid[c]), pa.array(sims)], ["qid", "id", "score"])

    return run


def _packer(dim: int, names: tuple[str, str, str]):
    """Rows of vectors to rows of blocks: (block, ids, unit vectors as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, QUERY_BLOCK):
                p = b.slice(at, QUERY_BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([p.column("i").to_pylist()], pa.list_(pa.int64())), pa.array([_unit(p.column("v"), dim).tobytes()], pa.binary())], list(names[1:]))

    return run


def usable(vector: str, dim: int, strict: bool) -> Column:
    """Is this a vector of dim numbers? Under strict a vector of another length fails the query instead."""
    right = F.size(vector) == dim
    if strict:
        right = F.when(right, True).otherwise(F.raise_error(F.format_string(f"a vector has %d numbers, not {dim}", F.size(vector))).cast("boolean"))
    return F.col(vector).isNotNull() & right


def vector_topk(queries: DataFrame, items: DataFrame, item: str, vector: str, dim: int, k: int, threshold: float | None = None, strict: bool = False) -> DataFrame:
    """query, item, score, rank: the k items of greatest cosine for each query, itself left out; ties by smaller item.

    Both sides become rows of whole blocks; every block of queries meets every block of items in one matrix product,
    after which only k rows per query and block are left. Null vectors are left out; so are those of another length,
    which under strict are an error.
    """
    ok = usable(vector, dim, strict)
    pick = [F.col(item).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")]
    q = queries.filter(ok).select(*pick).mapInArrow(_packer(dim, ("", "qid", "qvec")), "qid array<long>, qvec binary")
    x = items.filter(ok).select(*pick).mapInArrow(_packer(dim, ("", "ids", "vecs")), "ids array<long>, vecs binary")
    met = x.crossJoin(q)  # of blocks: thousands of vectors each
    found = met.mapInArrow(_matcher(dim, k, threshold), "qid long, id long, score double")
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(F.col("qid").alias("query"), F.col("id").alias("item"), "score", "rank")


_PAIRED = "jd_id string, jd_block_no int, resume_id string, resume_block_no int, score double, jd_section string, resume_section string, overlap boolean, rank int"


def _stored(v: pa.Array, dim: int) -> bytes:
    """Vectors as bytes: unit rows of double precision or, of lists of signed places (HashedEmbedder.compact), their
    number, their lengths, their places."""
    if not pa.types.is_integer(v.type.value_type):
        return _unit(v, dim).tobytes()
    sizes = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[len(v)], sizes, v.flatten().to_numpy(zero_copy_only=False)]).astype(np.int32).tobytes()


def _read(data: bytes, dim: int, places: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Unit rows and, where the bytes hold places, the squares of the lengths that the rows of counts had."""
    if not places:
        return np.frombuffer(data, dtype=np.float64).reshape(-1, dim), None
    flat = np.frombuffer(data, dtype=np.int32).astype(np.int64)
    n = int(flat[0])
    sizes, at = flat[1 : n + 1], flat[n + 1 :]
    x = np.bincount(np.repeat(np.arange(n), sizes) * dim + np.abs(at) - 1, np.sign(at), n * dim).reshape(-1, dim)
    squares = np.einsum("nd,nd->n", x, x)
    return x / np.sqrt(np.where(squares == 0, 1, squares))[:, None], squares


#: Products of lengths up to which single precision finds the whole number that a product of counts is.
SINGLE = 4096.0


def _similar(q: tuple[np.ndarray, np.ndarray | None], x: tuple[np.ndarray, np.ndarray | None], threshold: float) -> Callable[[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A function of (first row of q, row after the last): (row of q from the first on, row of x, similarity at six digits)
    of those at the threshold or above, in the order of rows. Of counts the products are whole numbers: single precision
    finds them, and the similarity is made of them in double precision."""
    (qu, qs), (xu, xs) = q, x
    slack = 1e-6
    if qs is not None and len(qs) and len(xs) and np.sqrt(qs.max() * xs.max()) < SINGLE:
        qu, xu, slack = qu.astype(np.float32), xu.astype(np.float32), 1e-4
    low = qu.dtype.type(threshold - slack)

    def run(at: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = (qu[at:to] @ xu.T).ravel()
        flat = np.flatnonzero(s >= low)
        exact = s[flat].astype(np.float64)
        r, c = np.divmod(flat, len(xu))
        if qs is not None:
            lengths = np.sqrt(np.where(qs == 0, 1, qs)[at + r] * np.where(xs == 0, 1, xs)[c])
            exact = np.rint(exact * lengths) / lengths
        exact = np.round(exact, 6)
        kept = exact >= threshold
        return r[kept], c[kept], exact[kept]

    return run


def _cut(pair: np.ndarray, exact: np.ndarray, number: np.ndarray, k: int) -> np.ndarray | None:
    """Which rows of each pair are its k most similar ones, if any pair has more; ties by the smaller number. A pair's rows
    stand together."""
    if k >= len(pair) or not (full := np.flatnonzero(pair[k:] == pair[:-k])).size:
        return None
    over = np.flatnonzero(np.isin(pair, pair[full]))
    order = over[np.lexsort((number[over], -exact[over], pair[over]))]
    kept = np.ones(len(pair), bool)
    kept[order[_places(pair[order]) >= k]] = False
    return kept


def _row_of(p: pa.Table, dim: int, out: tuple[str, ...]) -> pa.RecordBatch:
    """One row of what a block of vectors holds: documents, block numbers and what else there is of each, vectors as
    bytes (see _stored)."""
    own = [p.column(c).combine_chunks() for c in p.column_names[:-1]]
    lists = [pa.ListArray.from_arrays(pa.array([0, p.num_rows], pa.int32()), x.chunk(0) if isinstance(x, pa.ChunkedArray) else x) for x in own]
    return pa.RecordBatch.from_arrays([*lists, pa.array([_stored(pa.concat_arrays(p.column("v").chunks), dim)], pa.binary())], list(out))


def _pair_packer(dim: int, out: tuple[str, ...]):
    """Rows (doc, no, section, terms, any others, v), a document's together, to rows of blocks. No document is cut: a block takes whole
    ones up to QUERY_BLOCK vectors, or a single larger one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            while held.num_rows > QUERY_BLOCK:
                docs = held.column("doc").to_numpy()
                ends = np.nonzero(docs[1:] != docs[:-1])[0] + 1  # of whole documents; the last may go on
                if not len(ends):
                    break
                cut = int(ends[max(np.searchsorted(ends, QUERY_BLOCK, "right") - 1, 0)])
                yield _row_of(held.slice(0, cut), dim, out)
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield _row_of(held, dim, out)

    return run


def _term_bits(q: pa.Array, x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two lists of terms, parted by blanks, as rows of bits: one for each term of q. Rows with a common term share a bit."""

    def flat(a: pa.Array) -> tuple[np.ndarray, pa.Array]:
        parts = pc.split_pattern(pc.fill_null(a, ""), " ")
        return pc.list_parent_indices(parts).to_numpy(), pc.list_flatten(parts)

    (qr, qt), (xr, xt) = flat(q), flat(x)
    words = pc.unique(qt)
    words = words.filter(pc.not_equal(words, ""))
    out = []
    for n, rows, terms in ((len(q), qr, qt), (len(x), xr, xt)):
        at = pc.fill_null(pc.index_in(terms, words), -1).to_numpy()
        bits = np.zeros((n, (len(words) + 63) // 64 * 64), bool)
        bits[rows[at >= 0], at[at >= 0]] = True
        out.append(np.packbits(bits, axis=1).view(np.uint64))
    return out[0], out[1]


#: Query vectors of one matrix product, and hits whose terms are compared at once: bounds of a task's memory.
PRODUCT_ROWS, BIT_ROWS = 512, 8192


def _pair_matcher(dim: int, k: int, threshold: float, boost: float, places: bool = False):
    names = [x.split()[0] for x in _PAIRED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                part = lambda c: b.column(c)[row].values  # noqa: B023, E731
                x, every = (_read(b.column(c)[row].as_py(), dim, places) for c in ("rv", "qv"))
                similar, total = _similar(every, x, threshold), len(every[0])
                jd, jno, jsec, jt, res, rno, rsec, rt = map(part, ("jd", "jno", "jsec", "jt", "res", "rno", "rsec", "rt"))
                docs = res.to_numpy(zero_copy_only=False)
                candidate = np.concatenate([[0], np.cumsum(docs[1:] != docs[:-1])]).astype(np.int64)
                many = int(candidate[-1]) + 1
                _, codes = np.unique(np.concatenate([["unknown"], pc.fill_null(jsec, "unknown").to_numpy(zero_copy_only=False), pc.fill_null(rsec, "unknown").to_numpy(zero_copy_only=False)]).astype(str), return_inverse=True)
                none, jcode, rcode = codes[0], codes[1 : len(jsec) + 1], codes[len(jsec) + 1 :]
                number = rno.to_numpy()
                for at in range(0, total, PRODUCT_ROWS):
                    to = min(at + PRODUCT_ROWS, total)
                    r, c, exact = similar(at, to)
                    if not len(r):
                        continue
                    pair = r * many + candidate[c]  # ascends, since a candidate's blocks stand together
                    if (kept := _cut(pair, exact, number[c], k)) is not None:
                        r, c, exact, pair = r[kept], c[kept], exact[kept], pair[kept]
                    same = (jcode[at + r] == rcode[c]) & (rcode[c] != none)
                    up = np.where(same, np.minimum(exact + boost, 1.0), exact)
                    alike = pair[1:] == pair[:-1]
                    several = np.flatnonzero(np.concatenate([alike, [False]]) | np.concatenate([[False], alike]))  # only these have an order
                    order = several[np.lexsort((number[c[several]], -exact[several], -np.round(up[several], 12), pair[several]))]
                    r[several], c[several], exact[several] = r[order], c[order], exact[order]
                    rank = (_places(pair) + 1).astype(np.int32)
                    qbits, xbits = _term_bits(jt.slice(at, to - at), rt)
                    common = np.concatenate([(qbits[r[i : i + BIT_ROWS]] & xbits[c[i : i + BIT_ROWS]]).any(axis=1) for i in range(0, len(r), BIT_ROWS)])
                    j, i = pa.array(at + r), pa.array(c)
                    yield pa.RecordBatch.from_arrays([jd.take(j), jno.take(j), res.take(i), rno.take(i), pa.array(exact), jsec.take(j), rsec.take(i), pa.array(common), pa.array(rank)], names)

    return run


def graded_topk(queries: DataFrame, items: DataFrame, doc: str, no: str, vector: Column, dim: int, k: int, threshold: float, boost: float = 0.0, strict: bool = False, checked: bool = True, places: bool = False) -> DataFrame:
    """jd_id, jd_block_no, resume_id, resume_block_no, score, jd_section, resume_section, overlap, rank: for each block of the
    query documents the k best blocks of every candidate document, at the threshold or above; ties by the smaller block
    number. Scores have six digits, which is what vectors in single precision give. overlap: do their texts have a term in
    common? rank: the place among the kept ones of a candidate after `boost` (see boosted).

    A candidate's blocks are never parted, so a matrix product cuts to k and ranks for each candidate within the task, and
    hits, of which there are many times more than blocks, are not shuffled. Every block of candidates is made once, since
    the query blocks are one partition of a checkpoint. checked=False: every vector has dim numbers. places: vector is the
    compact form of HashedEmbedder, of which similarities are exact to the sixth digit.
    """
    terms = F.array_join(X.terms(F.col("text")), " ").alias("terms")
    pick = [F.col(doc).cast("string").alias("doc"), F.col(no).cast("int").alias("no"), "section", terms, (vector if places else vector.cast("array<double>")).alias("v")]
    # a filter over a function in Python would be pushed below the shuffle, and the function run twice
    ok = usable("v", dim, strict) if checked else F.lit(True)
    kinds = lambda a: ", ".join(f"{n} {t}" for n, t in zip(a, ("array<string>", "array<int>", "array<string>", "array<string>", "binary"), strict=True))
    left, right = ("jd", "jno", "jsec", "jt", "qv"), ("res", "rno", "rsec", "rt", "rv")
    q = checkpointed(queries.select(*pick).filter(ok).mapInArrow(_pair_packer(dim, left), kinds(left))).coalesce(1)
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = items.withColumn("__doc", F.col(doc).cast("string")).repartition(n, "__doc").sortWithinPartitions("__doc", no).drop("__doc")
    x = own.select(*pick).filter(ok).mapInArrow(_pair_packer(dim, right), kinds(right))
    return x.crossJoin(q).mapInArrow(_pair_matcher(dim, k, threshold, boost, places), _PAIRED)  # of blocks: thousands of vectors each


#: Places of a table of terms for each row: terms that share one are compared one by one.
TERM_PLACES = 8192


def _common_terms(q: pa.Array, x: pa.Array) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of (rows of q, rows of x): have their lists of terms, parted by blanks, a term in common?"""

    def flat(a: pa.Array) -> tuple[np.ndarray, pa.Array]:
        parts = pc.split_pattern(pc.fill_null(a, ""), " ")
        return pc.list_parent_indices(parts).to_numpy(), pc.list_flatten(parts)

    (qr, qt), (xr, xt) = flat(q), flat(x)
    words = pc.unique(qt)
    words = words.filter(pc.not_equal(words, ""))
    qi, xi = (pc.fill_null(pc.index_in(t, words), -1).to_numpy().astype(np.int64) for t in (qt, xt))
    qr, qi, xr, xi = qr[qi >= 0], qi[qi >= 0], xr[xi >= 0], xi[xi >= 0]
    starts = np.searchsorted(qr, np.arange(len(q) + 1))
    table = np.zeros((len(x), max(1, min(len(words), TERM_PLACES))), bool)
    table[xr, xi % table.shape[1]] = True
    pairs = np.sort(xr * len(words) + xi) if len(words) > TERM_PLACES else None

    def run(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.zeros(len(r), bool)
        for at in range(0, len(r), BIT_ROWS):
            first, n = starts[r[at : at + BIT_ROWS]], starts[r[at : at + BIT_ROWS] + 1] - starts[r[at : at + BIT_ROWS]]
            hit = np.repeat(np.arange(len(n)), n)
            term, row = qi[np.arange(len(hit)) + np.repeat(first - (np.cumsum(n) - n), n)], c[at : at + BIT_ROWS][hit]
            on = np.flatnonzero(table[row, term % table.shape[1]])
            if pairs is not None and len(on):
                want = row[on] * len(words) + term[on]
                on = on[pairs[np.minimum(np.searchsorted(pairs, want), len(pairs) - 1)] == want]
            out[at + hit[on]] = True
        return out

    return run


def _runs(key: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)


def _summed(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of the rows of each key, keys ascending."""
    order = np.argsort(key, kind="stable")
    first = _runs(key[order])
    return key[order][first], np.add.reduceat(values[order], first, axis=0) if len(first) else values[:0]


def _sums_matcher(dim: int, k: int, threshold: float, boost: float, n: int, gates: dict[str, float], gate: float, points: Callable, credit: Callable, places: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                part = lambda c: b.column(c)[row].values  # noqa: B023, E731
                x, every = (_read(b.column(c)[row].as_py(), dim, places) for c in ("rv", "qv"))
                similar, total = _similar(every, x, threshold), len(every[0])
                jd, jsec, jt, jmark, res, rno, rsec, rt, rmark = map(part, ("jd", "jsec", "jt", "jmark", "res", "rno", "rsec", "rt", "rmark"))
                document, candidate = (np.concatenate([[0], np.cumsum(d[1:] != d[:-1])]).astype(np.int64) for d in (a.to_numpy(zero_copy_only=False) for a in (jd, res)))
                jname, rname = (pc.fill_null(a, "unknown").to_numpy(zero_copy_only=False).astype(str) for a in (jsec, rsec))
                _, codes = np.unique(np.concatenate([["unknown"], jname, rname]), return_inverse=True)
                none, jcode, rcode = codes[0], codes[1 : len(jname) + 1], codes[len(jname) + 1 :]
                jgate = np.array([gates.get(s, gate) for s in jname])
                number, mark, common, many = rno.to_numpy(), jmark.to_numpy(), _common_terms(jt, rt), int(candidate[-1]) + 1
                first_j, first_r = pa.array(_runs(document)), pa.array(_runs(candidate))

                def given(key: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
                    j, i = first_j.take(pa.array(key // many)), first_r.take(pa.array(key % many))  # noqa: B023
                    own = [pa.StructArray.from_arrays([pa.array(values[:, m * 3 + f]) for f in range(3)], ["matched", "total", "credit"]) for m in range(n)]
                    return pa.RecordBatch.from_arrays([jd.take(j), res.take(i), rmark.take(i), *own], ["jd_id", "resume_id", "mark", *(f"c{m}" for m in range(n))])  # noqa: B023

                held = np.empty(0, np.int64), np.empty((0, n * 3), np.int64)  # sums of documents that go on
                for at in range(0, total, PRODUCT_ROWS):
                    to = min(at + PRODUCT_ROWS, total)
                    r, c, exact = similar(at, to)
                    pair = r * many + candidate[c]  # ascends, since a candidate's blocks stand together
                    if (kept := _cut(pair, exact, number[c], k)) is not None:
                        r, c, exact, pair = r[kept], c[kept], exact[kept], pair[kept]
                    if len(r):
                        same = (jcode[at + r] == rcode[c]) & (rcode[c] != none)
                        up = np.where(same, np.minimum(exact + boost, 1.0), exact)
                        score, real = points(up, jgate[at + r], lambda i: common(at + r[i], c[i]))  # noqa: B023
                        first = _runs(pair)
                        best, real = np.maximum.reduceat(score, first), np.maximum.reduceat(real, first)
                        r, who = at + r[first], candidate[c[first]]
                        on = ((mark[r][:, None] >> np.arange(n)) & 1).astype(np.int64) * real[:, None]
                        values = np.stack([on, on * best[:, None], on * credit(best)[:, None]], axis=2).reshape(-1, n * 3)
                        held = tuple(map(np.concatenate, zip(held, (document[r] * many + who, values), strict=True)))
                    done = np.ones(len(held[0]), bool) if to == total else held[0] // many < document[to]
                    if done.any():
                        yield given(*_summed(held[0][done], held[1][done]))
                    held = _summed(held[0][~done], held[1][~done])

    return run


def pair_sums(queries: DataFrame, items: DataFrame, names: tuple[str, ...], vector: Column, dim: int, k: int, threshold: float, boost: float, gates: dict[str, float], gate: float, points: Callable, credit: Callable, places: bool = False) -> DataFrame:
    """jd_id, resume_id, mark, and for each of names a struct (matched, total, credit): a row for each pair of a query
    document and a candidate with any hit of graded_topk.

    A hit's score is points (see evidence.points_of) of its boosted similarity; a query block counts with its greatest, if
    any hit of it is real, for those names that its components hold: how many do, the sum of scores in ten-thousandths, the
    sum of their credit. queries(doc_id, block_no, section, text, components); items(doc_id, block_no, section, text, mark)
    come with a document's blocks together and in order; mark is an int of the candidate that stays. places: as in
    graded_topk.

    Candidates and query documents are whole within a task, so neither hits nor blocks leave it: only pairs do.
    """
    terms = F.array_join(X.terms(F.col("text")), " ").alias("terms")
    pick = lambda m: [F.col("doc_id").cast("string").alias("doc"), F.col("block_no").cast("int").alias("no"), "section", terms, m.cast("int").alias("mark"), (vector if places else vector.cast("array<double>")).alias("v")]
    kinds = lambda a: ", ".join(f"{n} {t}" for n, t in zip(a, ("array<string>", "array<int>", "array<string>", "array<string>", "array<int>", "binary"), strict=True))
    left, right = ("jd", "jno", "jsec", "jt", "jmark", "qv"), ("res", "rno", "rsec", "rt", "rmark", "rv")
    bits = sum((F.array_contains("components", c).cast("int") * (1 << i) for i, c in enumerate(names)), F.lit(0))
    own = queries.repartition(max(1, queries.count() // QUERY_BLOCK), "doc_id").sortWithinPartitions("doc_id", "block_no")
    q = checkpointed(own.select(*pick(bits)).mapInArrow(_pair_packer(dim, left), kinds(left))).coalesce(1)
    x = items.select(*pick(F.col("mark"))).mapInArrow(_pair_packer(dim, right), kinds(right))
    each = ", ".join(f"c{i} struct<matched: bigint, total: bigint, credit: bigint>" for i in range(len(names)))
    out = x.crossJoin(q).mapInArrow(_sums_matcher(dim, k, threshold, boost, len(names), gates, gate, points, credit, places), f"jd_id string, resume_id string, mark int, {each}")
    return out.withColumnsRenamed({f"c{i}": c for i, c in enumerate(names)})


def candidates_topk(queries: DataFrame, items: DataFrame, doc: str, no: str, vector: str, dim: int, k: int, threshold: float, strict: bool = False) -> DataFrame:
    """graded_topk without grades: jd_id, jd_block_no, resume_id, resume_block_no, score."""
    bare = [d.select(doc, no, vector, F.lit("unknown").alias("section"), F.lit("").alias("text")) for d in (queries, items)]
    return graded_topk(*bare, doc, no, F.col(vector), dim, k, threshold, strict=strict).select("jd_id", "jd_block_no", "resume_id", "resume_block_no", "score")


def boosted(score: Column, query_section: Column, section: Column, boost: float = 0.05) -> Column:
    """A match within one known section counts more, up to 1."""
    same = (query_section == section) & (query_section != "unknown")
    return F.when(same, F.least(score + boost, F.lit(1.0))).otherwise(score)
