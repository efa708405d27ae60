"""Names of a list in texts: token runs that equal a name, the leftmost first and of those the longest."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmeter.functions import text
from gistmeter.operators import counting
from gistmeter.operators.layout import lookup_join, materialise, plan_bytes
from gistmeter.operators.tokens import SUMMARY, TEXT, side_rows

GAP = "\x1f"
HELD = 8 << 20


def name_keys(names: DataFrame) -> DataFrame:
    """(key, entity, first, n): the tokens of each name of (entity), joined, the first of them, and how many."""
    toks = names.select("entity").distinct().withColumn("toks", text.cased_words(F.col("entity"))).filter(F.size("toks") > 0)
    return toks.select(F.array_join("toks", GAP).alias("key"), "entity", F.get("toks", F.lit(0)).alias("first"), F.size("toks").alias("n"))


def name_spans(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """(id, side, pos, n, key): every run of n tokens from position pos (0 is the first) that equals a name, overlaps included.

    A name without capitals also matches whatever the text's case is, any other name matches as it is written.
    A place is looked at only if its token opens a name, and only at the lengths that such names have, so the rows made
    follow the names met, not the tokens times the longest name.
    """
    keys = name_keys(names)
    opens = keys.groupBy(F.col("first").alias("head")).agg(F.sort_array(F.collect_set("n")).alias("ns"))
    longest = keys.agg(F.max("n")).first()[0] or 1
    windows = side_rows(pairs, text.cased_words).select("id", "side", F.posexplode(F.transform(
        F.col("toks"), lambda t, i: F.slice("toks", i + 1, F.lit(longest)))).alias("pos", "window"))
    forms = F.array_distinct(F.array(F.get("window", F.lit(0)), F.lower(F.get("window", F.lit(0)))))
    heads = lookup_join(windows.withColumn("head", F.explode(forms)), opens, "head", how="inner")
    runs = heads.select("id", "side", "pos", "window", F.explode("ns").alias("n")).filter(F.col("n") <= F.size("window")).distinct()
    run = F.array_join(F.slice("window", F.lit(1), F.col("n")), GAP)
    asked = runs.select("id", "side", "pos", "n", F.explode(F.array_distinct(F.array(run, F.lower(run)))).alias("key"))
    return lookup_join(asked, keys.select("key").distinct(), "key", how="left_semi").select("id", "side", "pos", "n", "key")


def leftmost_longest(spans: DataFrame) -> DataFrame:
    """Of the spans (id, side, pos, n, key) of each text, those that a reader from the left takes: at each free place the longest.

    Spans of a text are sorted into one task and read in order; the task holds nothing but where the last one ended.
    """
    longest = spans.groupBy("id", "side", "pos", "n").agg(F.collect_set("key").alias("keys")).groupBy("id", "side", "pos").agg(
        F.max_by(F.struct("n", "keys"), "n").alias("top"))
    rows = longest.select("id", "side", "pos", F.col("top.n").alias("n"), F.col("top.keys").alias("keys"))

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, end = None, 0
        for batch in batches:
            keep = []
            for i, side, pos, n in zip(*(c.to_pylist() for c in batch.columns[:4])):
                if (i, side) != last:
                    last, end = (i, side), 0
                keep.append(pos >= end)
                if keep[-1]:
                    end = pos + n
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.repartition("id", "side").sortWithinPartitions("id", "side", "pos").mapInArrow(taken, rows.schema)


def _read(rows, owner: np.ndarray, ids: pa.Array, opens: dict, keys: dict):
    """(id, side, entity) distinct, as a reader with the whole list finds them: only places whose token opens a name are looked at."""
    which, sides, entities = [], [], []
    for side in (TEXT, SUMMARY):
        cased, low = rows.column(f"cased{side}"), rows.column(f"low{side}")
        toks, lows = (c.flatten().dictionary_encode() for c in (cased, low))
        row, place = counting.within(counting.lengths(cased))
        opening = [np.array([t in opens for t in x.dictionary.to_pylist()], bool)[x.indices.to_numpy()] if len(x) else np.zeros(0, bool) for x in (toks, lows)]
        at = np.flatnonzero(opening[0] | opening[1])
        ends = np.cumsum(counting.lengths(cased))[row[at]]
        own = owner[row[at]]
        words, lowered = toks.to_pylist(), lows.to_pylist()
        order = np.lexsort((place[at], own))
        last, spans = -1, {}

        def taken(spans: dict):
            end, met = 0, set()
            for pos in sorted(spans):
                n, found = spans[pos]
                if pos >= end:
                    end = pos + n
                    met.update(e for key in found for e in keys[key])
            return met

        def told(i: int, spans: dict) -> None:
            met = taken(spans)
            which.extend([i] * len(met))
            sides.extend([side] * len(met))
            entities.extend(met)

        for i, j, pos, end in zip(own[order].tolist(), at[order].tolist(), place[at][order].tolist(), ends[order].tolist()):
            if i != last:
                if spans:
                    told(last, spans)
                last, spans = i, {}
            for n in sorted({*opens.get(words[j], ()), *opens.get(lowered[j], ())}, reverse=True):
                if j + n <= end:
                    found = {run for run in (GAP.join(words[j:j + n]), GAP.join(lowered[j:j + n])) if run in keys}
                    if found:
                        n_before, before = spans.get(pos, (0, set()))
                        spans[pos] = (n, found | before) if n == n_before else max((n, found), (n_before, before), key=lambda s: s[0])
                        break
        if spans:
            told(last, spans)
    return {"id": ids.take(pa.array(which, pa.int64())), "side": pa.array(sides, pa.int32()), "entity": pa.array(entities, pa.string())}


def _mentions_of_few(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """The mentions of a list that every task can hold: texts are read where they are, and only mentions become rows."""
    known, opens = {}, {}
    for key, entity, first, n in zip(*(c.to_pylist() for c in keys.toArrow().columns)):
        known.setdefault(key, set()).add(entity)
        opens.setdefault(first, set()).add(n)
    shared = pairs.sparkSession.sparkContext.broadcast((opens, known))
    lists = [c.alias(f"{name}{side}") for side, x in ((TEXT, "text"), (SUMMARY, "summary")) for name, c in (
        ("cased", text.cased_words(F.col(x))), ("low", F.transform(text.cased_words(F.col(x)), F.lower)))]
    return counting.mapped(counting.by_id(pairs, *lists), lambda rows, owner, ids: _read(rows, owner, ids, *shared.value),
                           f"id {counting.key_type(pairs)}, side int, entity string")


def name_mentions(pairs: DataFrame, names: DataFrame, held_bytes: int = HELD) -> DataFrame:
    """(id, side, entity) distinct: the names of (entity) that each text mentions, without those inside longer ones.

    Names that differ in blanks alone are all mentioned where one is.  A list of at most `held_bytes`, as files, is held by
    every task; a longer one is joined.
    """
    keys = materialise(name_keys(names), "names")
    if plan_bytes(keys) <= held_bytes:
        return _mentions_of_few(pairs, keys)
    taken = leftmost_longest(name_spans(pairs, names)).select("id", "side", F.explode("keys").alias("key")).distinct()
    spelt = keys.groupBy("key").agg(F.collect_set("entity").alias("entities"))
    return lookup_join(taken, spelt, "key", how="inner").select("id", "side", F.explode("entities").alias("entity")).distinct()
