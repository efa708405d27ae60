"""Vector metrics: static token vectors averaged per text or matched token by token.

Vectors come in as a table (key, vec).  `token_key` turns a token into its key; the
default is the token itself, a hashed vocabulary passes a hash.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmeter.functions import text
from gistmeter.functions.vectors import as_vector, component_sums, cosine
from gistmeter.operators import counting
from gistmeter.operators.layout import lookup_join, plan_bytes
from gistmeter.operators.mapped import mapped_lookup
from gistmeter.operators.tokens import SUMMARY, TEXT, is_coded, of_words, side_rows, word_codes

BLOCK = 1024
SMALL = 16 << 20  # bytes of a vector table that goes to every task
MAPPED = 2 << 30  # bytes of one that tasks map


def own_key(token):
    return token


def vector_dim(vectors: DataFrame) -> int:
    return vectors.select(F.size("vec")).first()[0]


class Lookup:
    """A vector table as every task has it: sorted keys and a matrix."""

    def __init__(self, keys: pa.Array, matrix: np.ndarray):
        order = pc.sort_indices(keys)
        self.keys, self.matrix = keys.take(order), matrix[order.to_numpy()]

    def __len__(self) -> int:
        return len(self.matrix)

    def take(self, at: np.ndarray) -> np.ndarray:
        """The vectors of these rows."""
        return self.matrix[at]

    def rows(self, asked: pa.Array) -> np.ndarray:
        """The row of each key; -1 where there is none."""
        return pc.fill_null(pc.index_in(asked, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype("int64")


def small_lookup(vectors: DataFrame):
    """A broadcast `Lookup` of a table (key, vec) of at most SMALL bytes, all keys of which are distinct and have whole
    vectors; else None, and the table has to be joined."""
    if plan_bytes(vectors) > SMALL:
        return None
    small = vectors.select("key", "vec").toArrow().combine_chunks()
    keys, vecs = (small.column(c).combine_chunks() for c in ("key", "vec"))
    lengths = pc.list_value_length(vecs)
    if not len(keys) or keys.null_count or vecs.null_count or len(pc.unique(keys)) < len(keys) or len(pc.unique(lengths)) > 1:
        return None
    flat = vecs.flatten()
    if flat.null_count or not pc.all(pc.is_finite(flat)).as_py():
        return None
    lookup = Lookup(keys, flat.to_numpy(zero_copy_only=False).astype("float64").reshape(len(keys), -1))
    return vectors.sparkSession.sparkContext.broadcast(lookup)


def held_lookup(vectors: DataFrame):
    """A broadcast lookup of a table that tasks can hold: a small one itself, a larger one's files, which they map.  None
    if the table has to be joined."""
    shared = small_lookup(vectors)
    if shared is None and SMALL < plan_bytes(vectors) <= MAPPED:
        files = mapped_lookup(vectors)
        shared = files and vectors.sparkSession.sparkContext.broadcast(files)
    return shared


class Keyed:
    """What the vector metrics of some pairs share: `rows` (id, t, s), the keys of each side's tokens by sentence, and the lookup.
    Instead of keys, rows may have the words' numbers and `at`, the lookup's row for each of them, as `word_codes` lays them out."""

    def __init__(self, rows: DataFrame, held):
        self.rows, self.held = rows, held


def token_keys(worded: DataFrame, token_key=own_key) -> DataFrame:
    """(id, t, s): the keys of the words of both sides, by sentence.  A `token_key` that also takes many strings, as
    `of_strings`, is asked once for each distinct word of a batch."""
    many = getattr(token_key, "of_strings", None)
    if many is not None:
        @F.arrow_udf("array<array<bigint>>")
        def keys_of(sents: pa.Array) -> pa.Array:
            lists = sents.flatten()
            toks = lists.flatten().dictionary_encode()
            known = many(toks.dictionary).take(toks.indices)
            return counting.listed(counting.listed(known, lists), sents)
        return worded.select("id", keys_of("t").alias("t"), keys_of("s").alias("s"))

    def keys(side: str) -> Column:
        return F.transform(side, lambda sent: F.transform(sent, token_key)).alias(side)
    return worded.select("id", keys("t"), keys("s"))


def rows_of(token_key, held):
    """The lookup's row for many words at a time; None for a `token_key` that takes columns only."""
    many = (lambda toks: toks) if token_key is own_key else getattr(token_key, "of_strings", None)
    return None if many is None else lambda toks: held.value.rows(many(toks))


def coded_rows(pairs: DataFrame, token_key, held) -> DataFrame:
    """`word_codes` of pairs, with the lookup's row for each word if there is a lookup."""
    if held is None:
        return word_codes(pairs)
    found = rows_of(token_key, held)
    if found is not None:
        return word_codes(pairs, found)

    @F.arrow_udf("binary")
    def rows_of_keys(keys: pa.Array) -> pa.Array:
        return counting.packed(held.value.rows(keys.flatten()), counting.lengths(keys))
    return word_codes(pairs).withColumn("at", rows_of_keys(F.transform(F.split("words", " "), token_key)))


def looked_up(rows: pa.RecordBatch, side: str, lookup: Lookup) -> np.ndarray:
    """The lookup's row of every token of a side; -1 where there is none."""
    if "at" in rows.schema.names:
        return of_words(rows, "at", side).to_numpy(zero_copy_only=False).astype("int64")
    tokens = rows.column(side)
    while pa.types.is_list(tokens.type):
        tokens = tokens.flatten()
    return lookup.rows(tokens)


def key_lists(split, side: str, token_key) -> Column:
    """The keys of a text's tokens, in order."""
    return F.transform(split(F.col(side)), token_key)


def _known(rows: pa.RecordBatch, side: str, owner: np.ndarray, lookup: Lookup):
    """(owner, row of the table, times), distinct: what each id has of the table."""
    row, _ = counting.within(counting.lengths(rows.column(side)))
    at = looked_up(rows, side, lookup)
    own, at = owner[row][at >= 0], at[at >= 0]
    both, times = np.unique(own * len(lookup) + at, return_counts=True)
    return both // len(lookup), both % len(lookup), times


def _sides(pairs: DataFrame, token_key, keyed: Keyed | None) -> DataFrame:
    if keyed is not None:
        if is_coded(keyed.rows):
            return counting.by_id(keyed.rows, F.col("t"), F.col("s"), F.col("at"))
        return counting.by_id(keyed.rows, F.flatten("t").alias("t"), F.flatten("s").alias("s"))
    return counting.by_id(pairs, key_lists(text.words, "text", token_key).alias("t"), key_lists(text.words, "summary", token_key).alias("s"))


def _text_vectors(pairs: DataFrame, shared, token_key, keyed: Keyed | None, wide: bool = False) -> DataFrame:
    """(id, side, vec), or (id, t, s) if `wide`."""
    def count(rows, owner, ids):
        lookup, made = shared.value, []
        for side, name in ((TEXT, "t"), (SUMMARY, "s")):
            own, at, times = _known(rows, name, owner, lookup)
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            if len(starts):
                n = np.add.reduceat(times, starts)
                used, at = np.unique(at, return_inverse=True)
                matrix = lookup.take(used)
                total = np.stack([times[i:j] @ matrix[at[i:j]] for i, j in zip(starts, [*starts[1:], len(own)])])
                made.append((own[starts], np.full(len(starts), side, "int32"), total / n[:, None]))
        if not made:
            made = [(np.empty(0, "int64"), np.empty(0, "int32"), np.empty((0, 1)))]
        own, side, vec = (np.concatenate(x) for x in zip(*made))
        vecs = list_array(vec)
        if not wide:
            return {"id": ids.take(pa.array(own)), "side": pa.array(side), "vec": vecs}
        found = np.unique(own)
        at = np.full((2, len(found)), -1)
        at[(side == SUMMARY).astype(int), np.searchsorted(found, own)] = np.arange(len(own))
        return {"id": ids.take(pa.array(found)), **{c: vecs.take(pa.array(a, mask=a < 0)) for c, a in zip(("t", "s"), at)}}
    schema = "t array<double>, s array<double>" if wide else "side int, vec array<double>"
    return counting.mapped(_sides(pairs, token_key, keyed), count, f"id {counting.key_type(pairs)}, {schema}")


def list_array(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(len(matrix) + 1) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(matrix.ravel()))


def text_vectors(pairs: DataFrame, vectors: DataFrame, token_key=own_key, keyed: Keyed | None = None) -> DataFrame:
    """(id, side, vec): mean of the vectors of a text's tokens; texts without any are left out."""
    shared = keyed.held if keyed is not None else held_lookup(vectors)
    if shared is not None:
        return _text_vectors(pairs, shared, token_key, keyed)
    dim = vector_dim(vectors)
    rows = side_rows(pairs, text.words).select("id", "side", F.explode("toks").alias("tok"))
    counts = rows.select("id", "side", token_key(F.col("tok")).alias("key")).groupBy("id", "side", "key").count()
    found = lookup_join(counts, vectors, "key", how="inner")
    sums = found.groupBy("id", "side").agg(
        F.sum("count").alias("_n"), *component_sums("vec", F.col("count").cast("double"), dim))
    return sums.select("id", "side", F.transform(as_vector(dim), lambda x: x / F.col("_n")).alias("vec"))


def embedding_similarity(pairs: DataFrame, vectors: DataFrame, token_key=own_key, keyed: Keyed | None = None) -> DataFrame:
    """(id, embedding_similarity): cosine of the two text vectors."""
    shared = keyed.held if keyed is not None else held_lookup(vectors)
    if shared is not None:
        sides = _text_vectors(pairs, shared, token_key, keyed, wide=True)
    else:
        sides = text_vectors(pairs, vectors, token_key).groupBy("id").agg(
            F.max(F.when(F.col("side") == TEXT, F.col("vec"))).alias("t"),
            F.max(F.when(F.col("side") == SUMMARY, F.col("vec"))).alias("s"))
    return sides.select("id", cosine(F.col("t"), F.col("s")).alias("embedding_similarity"))


_NUMBERS = T.ArrayType(T.DoubleType())


@F.pandas_udf(T.StructType([T.StructField("s_best", _NUMBERS), T.StructField("t_best", _NUMBERS)]))
def best_matches(s_vecs: pd.Series, t_vecs: pd.Series, dim: pd.Series) -> pd.DataFrame:
    """Highest cosine of each vector of one block to the vectors of another."""
    s_best, t_best = [], []
    for s, t, d in zip(s_vecs, t_vecs, dim):
        a, b = (np.asarray(v, dtype="float64").reshape(-1, d) for v in (s, t))
        with np.errstate(invalid="ignore", divide="ignore"):
            a, b = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (a, b))
        sims = np.nan_to_num(a @ b.T, nan=-1.0)
        s_best.append(sims.max(axis=1))
        t_best.append(sims.max(axis=0))
    return pd.DataFrame({"s_best": s_best, "t_best": t_best})


def _unit(m: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.linalg.norm(m, axis=1, keepdims=True)


def _matched(pairs: DataFrame, shared, token_key, block: int, keyed: Keyed | None) -> DataFrame:
    """(id, p, r): means over the tokens of each side of the best cosine on the other."""
    def count(rows, owner, ids):
        lookup = shared.value
        own, at, times = zip(*(_known(rows, c, owner, lookup) for c in ("s", "t")))
        used, at = np.unique(np.concatenate(at), return_inverse=True)
        unit, at = _unit(lookup.take(used)), np.split(at, [len(own[0])])
        whole = np.isfinite(unit).all()
        ends = [np.searchsorted(o, np.arange(len(ids) + 1)) for o in own]
        has = np.minimum(*(np.diff(e) for e in ends)) > 0
        # only an id whose sides both have vectors has a score
        found = np.flatnonzero(has)
        p, r = np.empty(len(found)), np.empty(len(found))
        for k, i in enumerate(found):
            (s, ns), (t, nt) = ((a[e[i]:e[i + 1]], w[e[i]:e[i + 1]]) for a, w, e in zip(at, times, ends))
            s_best, t_best = np.full(len(s), -np.inf), np.full(len(t), -np.inf)
            for x in range(0, len(s), block):
                for y in range(0, len(t), block):
                    sims = unit[s[x:x + block]] @ unit[t[y:y + block]].T
                    if not whole:
                        sims = np.nan_to_num(sims, nan=-1.0)
                    s_best[x:x + block] = np.maximum(s_best[x:x + block], sims.max(axis=1))
                    t_best[y:y + block] = np.maximum(t_best[y:y + block], sims.max(axis=0))
            p[k], r[k] = s_best @ ns / ns.sum(), t_best @ nt / nt.sum()
        return {"id": ids.take(pa.array(found)), "p": pa.array(p), "r": pa.array(r)}
    return counting.mapped(_sides(pairs, token_key, keyed), count, f"id {counting.key_type(pairs)}, p double, r double").filter("id is not null")


def _f1(pr: DataFrame) -> DataFrame:
    p, r = F.col("p"), F.col("r")
    return pr.select("id", p.alias("BERT Precision"), r.alias("BERT Recall"),
                     F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("BERT F1"))


def bert_score(pairs: DataFrame, vectors: DataFrame, token_key=own_key, block: int = BLOCK, keyed: Keyed | None = None) -> DataFrame:
    """(id, BERT Precision, BERT Recall, BERT F1): greedy matching of token vectors.

    The distinct keys of each side are packed into blocks of bounded size.  Blocks are
    matched, never single tokens, and a long pair spreads over many block rows.  With a vector table that tasks hold
    or map each matches the blocks of its pairs itself, and vectors are not shuffled.
    """
    shared = keyed.held if keyed is not None else held_lookup(vectors)
    if shared is not None:
        return _f1(_matched(pairs, shared, token_key, block, keyed))
    dim = vector_dim(vectors)
    rows = side_rows(pairs, text.words).select("id", "side", F.explode("toks").alias("tok"))
    counts = rows.select("id", "side", token_key(F.col("tok")).alias("key")).groupBy("id", "side", "key").agg(
        F.count("*").alias("n"))
    found = lookup_join(counts, vectors, "key", how="inner")
    rank = F.row_number().over(Window.partitionBy("id", "side").orderBy("key")) - 1
    packed = (found.withColumn("block", F.floor(rank / block)).groupBy("id", "side", "block")
              .agg(F.collect_list(F.struct("key", "n", "vec")).alias("m")))
    packed = packed.select("id", "side", "block", F.transform("m", lambda x: x["key"]).alias("keys"),
                           F.transform("m", lambda x: x["n"]).alias("ns"),
                           F.flatten(F.transform("m", lambda x: x["vec"])).alias("vecs"))
    t = packed.filter(F.col("side") == TEXT).selectExpr("id", "keys t_keys", "ns t_ns", "vecs t_vecs")
    s = packed.filter(F.col("side") == SUMMARY).selectExpr("id", "keys s_keys", "ns s_ns", "vecs s_vecs")
    matched = s.join(t, "id").select(
        "id", "s_keys", "s_ns", "t_keys", "t_ns", best_matches("s_vecs", "t_vecs", F.lit(dim)).alias("b"))
    both = F.array(
        F.struct(F.lit(SUMMARY).alias("side"), F.arrays_zip(
            F.col("s_keys").alias("key"), F.col("s_ns").alias("n"), F.col("b.s_best").alias("best")).alias("m")),
        F.struct(F.lit(TEXT).alias("side"), F.arrays_zip(
            F.col("t_keys").alias("key"), F.col("t_ns").alias("n"), F.col("b.t_best").alias("best")).alias("m")))
    rows = matched.select("id", F.inline(both)).select("id", "side", F.inline("m"))
    best = rows.groupBy("id", "side", "key").agg(F.max("best").alias("best"), F.max("n").alias("n"))

    def mean(side):
        here = F.col("side") == side
        return F.try_divide(F.sum(F.when(here, F.col("best") * F.col("n"))), F.sum(F.when(here, F.col("n"))).cast("double"))

    pr = best.groupBy("id").agg(mean(SUMMARY).alias("p"), mean(TEXT).alias("r"))
    return _f1(pr)
