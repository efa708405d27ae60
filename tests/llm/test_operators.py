"""Each operator against a plain calculation, on rows of every awkward kind."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gistmeter.llm import (byte_bpe, chat, columns, decontaminate, exact_dedup, kneser_ney, line_dedup, minhash, quality, sharding,
                           token_store)
from gistmeter.llm import queries as llm_queries
from gistmeter.llm.shared import fresh_folder

from .conftest import edge_rows, sentence

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bag(df, *names):
    return collections.Counter(tuple(r[n] for n in names) for r in df.collect())


def split_words(text):
    return [w for w in re.split("[" + BLANK + "]+", (text or "").translate(LOWER)) if w]


# exact dedup

def plain_exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        norm = "".join(c for c in t or "" if c not in BLANK)
        groups[norm].append((-len(t or ""), i is None, i or 0, i))
    out = collections.Counter()
    for i, t in rows:
        norm = "".join(c for c in t or "" if c not in BLANK)
        keep = min(groups[norm])[3]
        out[(i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest())] += 1
    return out


def test_exact_dedup(edge, nothing):
    want = plain_exact([r[:2] for r in edge_rows()])
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert bag(exact_dedup.exact_duplicates(edge), *names) == want
    assert exact_dedup.exact_duplicates(nothing).count() == 0


def test_exact_dedup_survives_clashing_fingerprints(edge):
    few = lambda c: F.length(c).cast("long") % 3
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert bag(exact_dedup.exact_duplicates(edge, few), *names) == plain_exact([r[:2] for r in edge_rows()])


def test_chunks_follow_content(spark):
    rnd = random.Random(3)
    text = "".join(sentence(rnd, 4000).split())
    moved = spark.createDataFrame([(1, text), (2, "inserted" + text)], "doc_id long, text string")
    table = exact_dedup.chunk_table(moved).collect()
    assert sum(len(r["chunk"]) for r in table) < 1.5 * len(text.encode())  # most chunks are shared
    assert max(len(r["chunk"]) for r in table) <= exact_dedup.LARGEST + 3


# sharding

def test_sharding(edge, nothing):
    rows = sharding.sharded(edge, shards=4).collect()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == collections.Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in edge_rows())
    for s in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.sharded(nothing).count() == 0


def test_maps_are_stored_read_and_edited(spark, tmp_path):
    rnd = random.Random(8)
    docs = spark.createDataFrame([(k, "x" * rnd.randint(0, 400)) for k in range(6000)], "doc_id long, text string")
    folder = str(tmp_path / "maps")

    def run(rows, shards):
        out = {r["doc_id"]: (r["vslot"], r["shard"], r["size"]) for r in sharding.sharded(rows, shards, 2048, folder).collect()}
        weight = collections.Counter()
        for _, shard, size in out.values():
            weight[shard] += size
        assert set(weight) == set(range(shards)) and max(weight.values()) < 1.03 * sum(weight.values()) / shards
        return out

    first = run(docs, 8)
    assert max(w for _, w, _ in first.values()) == 7 and sharding.stored_map(spark, folder)[0] == 1
    assert run(docs, 8) == first and sharding.stored_map(spark, folder)[0] == 1
    grown = run(docs, 9)
    assert sharding.stored_map(spark, folder)[0] == 2
    moved = sum(first[k][2] for k in first if first[k][1] != grown[k][1]) / sum(v[2] for v in first.values())
    assert 1 / 9 * 0.9 < moved < 1.3 / 9
    # more rows than the map was made for
    more = docs.filter("doc_id % 3 > 0")
    run(more, 9)
    version, of = sharding.stored_map(spark, folder, 1)
    assert version == 1 and all(of[v] == s for v, s, _ in first.values())


def test_slot_maps_are_even_and_edited_little():
    rnd = random.Random(5)
    loads = {v: rnd.randint(1, 1000) for v in range(4096)}
    first = sharding.first_map(loads, 16, 4096)
    weight = lambda of: [sum(loads[v] for v in range(4096) if of[v] == s) for s in range(max(of) + 1)]
    assert max(weight(first)) - min(weight(first)) <= 2
    for shards in (17, 12):
        second = sharding.edited_map(first, loads, shards)
        w = weight(second)
        assert len(w) == shards and max(w) < 1.02 * sum(w) / shards
        moved = sum(loads[v] for v in range(4096) if first[v] != second[v]) / sum(loads.values())
        assert moved < (1.2 / 17 if shards == 17 else 1.2 * 4 / 16)


# quality

def test_quality_learns_and_scores_everything(spark, edge, nothing):
    rnd = random.Random(11)
    texts = [(k, sentence(rnd, 50) if k % 3 else " ".join(w.upper() + "!!" for w in sentence(rnd, 50).split())) for k in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(300)] + [(None, 1), (5, None), (6, 7)], "doc_id long, label int")
    weights = quality.train(docs, labels)
    rows = quality.scored(docs, weights).filter("doc_id >= 300").collect()
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in rows]) > 0.95
    scores = quality.scored(edge, weights)
    assert scores.columns == ["doc_id", "text", "source", "n_lines", "rest", "count", "score", "predicted"]
    found = scores.collect()
    assert len(found) == len(edge_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    empty = {r["score"] for r in found if not (r["text"] or "")}
    assert len(empty) == 1
    assert quality.scored(nothing, weights).count() == 0
    assert not quality.train(nothing, labels).any() and not quality.train(docs, labels.limit(0)).any()


# near duplicates

def plain_components(rows, size):
    sets = []
    for i, t in rows:
        w = split_words(t)
        sets.append((i, frozenset(zip(*[w[k:] for k in range(size)])) if len(w) >= size else frozenset([tuple(w)] if w else [])))
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return collections.Counter((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets)


def test_near_duplicates(edge, nothing):
    rows = [r[:2] for r in edge_rows()]
    names = ("doc_id", "n_shingles", "component_id", "kept")
    for size in (2, 5):
        assert bag(minhash.near_duplicates(edge, size), *names) == plain_components(rows, size)
    assert minhash.near_duplicates(nothing, 2).count() == 0


@pytest.mark.parametrize("block", [1000, 9])
def test_near_duplicates_of_a_large_group(spark, monkeypatch, block):
    """Copies of one text, most of them not similar to most others, so hubs alone do not join them; in one block and in many."""
    monkeypatch.setattr(minhash, "SET_BLOCK", block)
    monkeypatch.setattr(minhash, "LIST_BLOCK", block)
    rnd = random.Random(13)
    base, rows = [f"w{k}" for k in range(100)], []
    for k in range(220):
        words = list(base)
        for _ in range(rnd.randint(0, 14)):
            words[rnd.randrange(100)] = f"u{rnd.randint(0, 10 ** 6)}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join(f"v{rnd.randint(0, 400)}" for _ in range(rnd.randint(2, 90)))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert bag(minhash.near_duplicates(docs, 2), "doc_id", "n_shingles", "component_id", "kept") == plain_components(rows, 2)


def test_tasks_pass_on_links_that_join_not_pairs(spark):
    """Twice the near copies make at most some twice the links, and no join makes pairs of them."""
    rnd, made = random.Random(4), []
    for copies in (150, 300):
        base = [f"w{k}" for k in range(100)]
        rows = []
        for k in range(copies):
            words = list(base)
            words[rnd.randrange(100)] = f"u{k}"
            rows.append((k, " ".join(words)))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        sets = minhash.sketches(docs, 2).select(F.col("doc_id").alias("rep"), "n", "sketch", "a", "b")
        clusters = minhash.candidate_clusters(sets, minhash.rare_pairs(sets))
        assert clusters.select("cluster").distinct().count() == 1 and clusters.count() == copies
        made.append(minhash.verified_links(minhash.whole_sets(docs, sets.join(clusters, "rep"), 2)).count())
    assert made[1] <= 2.5 * made[0] and made[0] < 150 * 3


def test_components_of_long_chains(spark):
    rnd = random.Random(2)
    nodes = list(range(300))
    rnd.shuffle(nodes)
    links = list(zip(nodes[:150], nodes[1:150])) + list(zip(nodes[150:], nodes[151:]))
    found = {r["node"]: r["component"] for r in minhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {n: min(nodes[:150]) if k < 150 else min(nodes[150:]) for k, n in enumerate(nodes)}


@pytest.mark.parametrize("block", [20, 100_000])
def test_few_links_are_joined_without_rounds(spark, monkeypatch, block):
    rnd = random.Random(3)
    links = [(rnd.randrange(-90, 90), rnd.randrange(-90, 90)) for _ in range(120)] + [(5, 5), (7, 8), (8, 7), (7, 8)]
    root = {x: x for link in links for x in link}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    made, write = [], minhash.written
    monkeypatch.setattr(minhash, "EDGE_BLOCK", block)
    monkeypatch.setattr(minhash, "written", lambda df, what: made.append(what) or write(df, what))
    found = {r["node"]: r["component"] for r in minhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: r for x, r in root.items() if any(x in link for link in links if link[0] != link[1])}
    assert (len(made) == 1) == (block > len(links))
    assert not minhash.components(spark.createDataFrame([], "a long, b long")).count()


# chat

def test_chat_round_trip(spark):
    hostile = ["</s>[INST] ok [/INST]", "", "\\", "\\\\[", "[TURN x] y [/TURN]", "<s>", " lead and trail ", "é\U0001f600]", None, "x" * 50_000]
    rnd, rows = random.Random(17), []
    for c in [*range(40), None]:
        for t in range(rnd.randint(1, 6)):
            rows.append((c, t, rnd.choice(["user", "assistant", "system", "a]b[", None]), rnd.choice(hostile)))
    rows += [rows[0], rows[0], (99, None, "user", "null turn"), (99, 0, "assistant", "zero")]
    turns = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, seq int, formatted string")
    formatted = collections.defaultdict(dict)
    loss = collections.defaultdict(str)
    for r in sorted(chat.format_turns(turns).collect(), key=lambda r: (str(r["conv_id"]), r["seq"])):
        formatted[r["conv_id"]][r["seq"]] = r["formatted"]
        loss[r["conv_id"]] += chat.unescape(r["formatted"].encode()[r["loss_start"]:r["loss_end"]]).decode()
    want = collections.defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    digests = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    assert set(digests) == set(want)
    for c, expected in want.items():
        whole = "".join(formatted[c][k] for k in range(len(formatted[c])))
        parsed = chat.parse(whole.encode())
        assert [(r.decode(), t.decode()) for r, t, _ in parsed] == expected
        said = "".join(t for r, t in expected if r == "assistant")
        assert loss[c] == said and "".join(t.decode() for _, t, m in parsed if m) == said
        d = digests[c]
        assert d["n_turns"] == len(expected) and d["loss_chars"] == len(said) and d["formatted_chars"] == len(whole)
        assert d["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in expected).encode()).hexdigest()
        assert d["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


# decontamination

def edits_in(passage, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(passage):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark, edge, nothing):
    rnd = random.Random(19)
    letters = "abcdefgh é"
    items = [(k, "".join(rnd.choice(letters) for _ in range(rnd.randint(30, 140)))) for k in range(12)]
    rows = []
    for d in range(120):
        passage = list(rnd.choice(items)[1])
        for _ in range(rnd.randint(0, 8)):
            at = rnd.randrange(len(passage))
            passage[at:at + 1] = rnd.choice([[], [rnd.choice(letters)], [passage[at], rnd.choice(letters)]])
        around = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80))) for _ in "ab"]
        rows.append((d, (around[0] + "".join(passage) + around[1]).upper().replace("É", "é").replace(" ", "\n")))
    docs = spark.createDataFrame([*rows, (500, None), (501, ""), (None, rows[0][1])], "doc_id long, text string")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items] + [(90, None, 1), (91, "", 1), (92, "short", 1), (3, items[3][1], 1)], "item_id long, text string, q int")
    fold = lambda t: t.translate(LOWER).replace("\n", " ")
    want = {}
    for d, t in rows:
        for i, p in items:
            k = edits_in(p, fold(t))
            if k <= decontaminate.budget(len(p)):
                want[(d, i)] = k
    assert len(want) > 40
    for block in (decontaminate.BLOCK_CHARS, 200):
        found = [r for r in decontaminate.matches(docs, bench, block_chars=block).collect() if r["doc_id"] is not None]
        assert {(r["doc_id"], r["item_id"]): r["edits"] for r in found} == want and len(found) == len(want)
        for r in found:
            assert edits_in(dict(items)[r["item_id"]], fold(dict(rows)[r["doc_id"]])[r["start"]:r["end"]]) == r["edits"]
    clean = {r["doc_id"] for r in decontaminate.without_matches(docs, bench, block_chars=200).collect()}
    assert clean - {None} == {d for d, _ in rows} - {d for d, _ in want} | {500, 501}
    assert decontaminate.matches(edge, bench.limit(0)).count() == 0 and decontaminate.matches(nothing, bench).count() == 0
    assert decontaminate.without_matches(edge, bench).count() == len(edge_rows())


# language model

def test_language_model(edge, nothing, monkeypatch):
    for name, value in (("VOCABULARY_BYTES", 50_000), ("PAIR_BYTES", 20_000), ("HOT", 50), ("FOLLOWERS", 100), ("HELD", 5000)):
        monkeypatch.setattr(kneser_ney, name, value)
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    texts = [(i, [*split_words(t), None]) for i, t, _ in edge_rows()]
    train = [t for i, t in texts if not out(i)]
    count = collections.Counter(w for t in train for w in t)
    pairs = collections.Counter(p for t in train for p in zip(["<s>", *t[:-1]], t))
    total, distinct = sum(count.values()), len(count)
    context = collections.Counter()
    followers = collections.defaultdict(lambda: [0, 0, 0])
    for (a, _), k in pairs.items():
        context[a] += k
        followers[a][min(k, 3) - 1] += 1
    contexts = collections.Counter(b for _, b in pairs)
    of = lambda counts: [sum(k == n for k in counts) for n in (1, 2, 3, 4)]
    d, u = kneser_ney.discounts(*of(pairs.values())), kneser_ney.discounts(*of(contexts.values()))
    rest = sum(u[min(k, 3) - 1] for k in contexts.values()) / len(pairs)

    def chance(a, b):
        k = contexts[b]
        p = max(k - (0, *u)[min(k, 3)], 0) / len(pairs) + rest / (distinct + 1)
        if context[a]:
            k = pairs[(a, b)]
            p = (max(k - (0, *d)[min(k, 3)], 0) + sum(x * y for x, y in zip(d, followers[a])) * p) / context[a]
        return p

    assert abs(sum(chance("the", w) for w in count) + chance("the", "never seen") - 1) < 1e-9
    model = kneser_ney.train(edge.filter(~kneser_ney.held_out(F.col("doc_id"))))
    assert model.total == total and model.words == distinct
    want = collections.defaultdict(list)
    for i, t in texts:
        score = sum(math.log10(chance(a, b)) for a, b in zip(["<s>", *t[:-1]], t))
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in t)
        want[i].append((len(t), sum(w in count for w in t), round(base, 4), round(score, 4)))
    found = collections.defaultdict(list)
    for r in kneser_ney.scored(edge, model).collect():
        found[r["doc_id"]].append((r["n_tokens"], r["n_known"], round(r["base_score"], 4), round(r["score"], 4)))
    assert {i: sorted(x) for i, x in found.items()} == {i: sorted(x) for i, x in want.items()}
    assert kneser_ney.train(nothing) is None and kneser_ney.scored(nothing, model).count() == 0
    assert {(r["score"], r["n_known"]) for r in kneser_ney.scored(edge, None).collect()} == {(0.0, 0)}


# lines

def test_line_dedup(edge, nothing):
    rows = [(i, t) for i, t, _ in edge_rows()]
    last = (1 << 63) - 1
    holders = collections.defaultdict(set)
    key = lambda line: line.translate(LOWER).strip(BLANK)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(last if i is None else i)
    want = collections.Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        own = last if i is None else i
        stay = [x for x in lines if len(holders[key(x)]) < 2 or min(holders[key(x)]) == own]
        want[(i, len(lines), len(lines) - len(stay), "\n".join(stay))] += 1
    found = line_dedup.dedup_lines(edge)
    assert found.columns == ["doc_id", "text", "source", "score", "rest", "count", "n_lines", "n_dropped"]
    assert bag(found, "doc_id", "n_lines", "n_dropped", "text") == want
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(23)
    hi, lo = rng.integers(0, 1 << 64, (2, 20_000), dtype=np.uint64)
    hi[:50] = hi[0]  # equal halves
    made = line_dedup.perfect_hash(hi, lo)
    assert sorted(line_dedup.hash_index(hi, lo, *made)) == list(range(20_000))
    assert len(line_dedup.hash_index(hi[:0], lo[:0], *line_dedup.perfect_hash(hi[:0], lo[:0]))) == 0


# byte-level BPE

def awkward_texts(n):
    rnd = random.Random(29)
    alphabet = "ab'st relv  \n\t\r \u0085éß12²!?<|x\U0001f600語፨՘Ⅷ  "
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(n)] + [
        "a" * 3000, " " * 3000, "'s't'll're x'S's\n's ' s", "aaab" * 400, "<|endoftext|>"]


def test_byte_bpe_is_exact(spark, edge, nothing):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    rows = list(enumerate(awkward_texts(3000)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(edge.select("doc_id", "text"))
    found = byte_bpe.encoded(docs, path, public_tokenizers.PATTERN, ("n_tokens", "ids", "decoded"))
    want = collections.Counter()
    for i, t in rows + [r[:2] for r in edge_rows()]:
        ids = library.encode_ordinary(t or "")
        want[(i, len(ids), np.array(ids, "<u4").tobytes(), t or "")] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in found.collect()) == want
    assert byte_bpe.encoded(nothing, path, public_tokenizers.PATTERN).count() == 0


# token files

def test_token_files(spark, edge, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    rows = [(5000 + k, t) for k, t in enumerate(awkward_texts(1500))] + [r[:2] for r in edge_rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    folder = fresh_folder(spark, "tokens")
    manifest = token_store.write_tokens(docs, folder, path)
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_store.read_documents(manifest, folder).collect()), key=lambda r: r[1]) == want
    empty = token_store.write_tokens(nothing, fresh_folder(spark, "tokens"), path)
    assert token_store.read_documents(empty, folder).count() == 0


def test_token_output_finds_added_tokens(spark, monkeypatch):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rnd, end = random.Random(41), "<|endoftext|>"
    cut = ["one" + end + "two", end, end * 3, " " + end + " ", "a  " + end + "  b", "it'" + end + "s", end[:-1], "<" + end + ">", end[:7], end[7:],
           "<|endoftext" + end + "|>", "grün" + end + "猫", "it's  " * 300_000 + end + "x" + end]
    mixed = ["".join(rnd.choice([end, t[:9], " ", "'s"]) for _ in range(rnd.randint(1, 8))) for t in awkward_texts(500)]
    rows = [(k, t) for k, t in enumerate(cut + mixed + awkward_texts(300) + [None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(llm_queries, "table", lambda *_: docs)
    start, want = 0, []
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, llm_queries.op10_token_output(spark, "").collect())) == want


def test_planes_give_any_range(tmp_path):
    ids = np.random.default_rng(31).integers(0, 60_000, 200_000).astype(np.uint32)
    with open(tmp_path / "x", "wb") as f:
        writer = token_store.PlaneWriter(f)
        writer.add([7, None], ids, np.array([150_000, 50_000]))
        assert writer.close() == (2, 200_000)
    import pyarrow as pa

    reader = token_store.PlaneReader(pa.OSFile(str(tmp_path / "x")))
    for a, b in ((0, 0), (0, 5), (65_530, 131_080), (199_999, 200_000), (0, 200_000)):
        assert (reader.ids(a, b) == ids[a:b]).all()


# hashing

def test_words_in_pieces(monkeypatch):
    rnd = random.Random(37)
    texts = [sentence(rnd, rnd.randint(0, 60)) for _ in range(200)] + ["x" * 5000]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    whole = columns.words(data, offsets)
    monkeypatch.setattr(columns, "SLICE", 200)
    pieces = columns.words(data, offsets)
    assert (whole[0] == pieces[0]).all() and (whole[1] == pieces[1]).all()
    flat = [(k, w) for k, t in enumerate(texts) for w in split_words(t)]
    assert [k for k, _ in flat] == whole[1].tolist()
    of = collections.defaultdict(set)
    for (_, w), h in zip(flat, whole[0].tolist()):
        of[w].add(h)
    assert all(len(x) == 1 for x in of.values()) and len({min(x) for x in of.values()}) == len(of)
